"""Text rules: filters, tokenizers, hashes, intent and extraction, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
HEARTBEAT = ("^heartbeat", "^cron", "^scheduled", "^triggered by", r"\[CRON\]", r"\[HEARTBEAT\]", r"\[SCHEDULED\]", "自动任务", "定时任务", "心跳检测", "system check", "health check", "ping check")
SYSTEM_PROMPT = ("^you are a", "^you are an", "^as an? ai", "^as a? assistant", "system prompt", "instruction:", "角色设定", "你是谁", "请记住", "always ", "never ", "based on the context", "given the conversation", "according to our conversation", "remember that", "note that")
GENERIC = ("^好的", "^好的，", "^收到", "^了解", "^明白", "^OK", "^好的好的", "^嗯", "^是", "^对", "^没错", "^是的是的", "^哈哈", "^嘿嘿", "^请问", "^你好", "^您好")
TIME_QUERY = ("现在几点了", "今天星期几", "现在是几点", "当前时间", "what time is it", "what's the time", "current time", "what day is it")
NOISE = ("^(你好|您好|嗨|hi|hello|hey)[\\s,.!?]*$", "^(早上好|下午好|晚上好|早安|晚安)[\\s,.!?]*$", "^(好的|是的|嗯|OK|ok|好|行|可以|没问题)[\\s,.!?]*$", "^(收到|了解|明白|知道了)[\\s,.!?]*$", "^(谢谢|感谢|多谢|thx|thanks)[\\s,.!?]*$")
SKIP = ("^(hi|hello|hey|你好|您好|嗨|哈喽)", "^/", "^(ok|好|yes|yeah|yep|okay|好的|可以)", "^(thanks|thank you|谢谢)")
NEGATION_PATTERNS = ("不(是|喜欢|会|能|知道|想|愿|应该|擅长)", "(没|无|非)常", "(讨厌|反感|拒绝|避免)", "从(没|未|不)有", "不.*什么$")
NEGATION = ("不", "没", "无", "非", "别", "讨厌", "反感", "拒绝", "避免", "排除", "难以", "困难", "害怕", "担心", "顾虑")
MULTIHOP = ("朋友的", "同事的", "老板的", "家人的", ".+的.+的", "使用的技术")
LESSON = ("学", "教训", "经验", "总结", "明白", "懂得", "掌握", "理解", "发现", "错误", "失败", "问题", "反思", "复盘", "知道", "清楚", "了解", "体会", "领悟", "NOTE", "注意", "提醒", "警告")
TEMPORAL = ("以前", "过去", "曾经", "刚才", "最近", "近来", "近日", "这阵子", "将来", "未来", "以后", "今后", "今年", "去年", "明年", "本月", "上月", "这周", "上周", "下周", "今天", "昨天", "明天", "2024", "2025", "2026", "星期", "周一", "周末")
DECISION = ("选择", "决定", "决策", "取舍", "为什么选", "为什么决定", "原因", "理由", "最终", "最后", "采取", "采用", "用了", "用过", "用了什么")
PINYIN = {"hangzhou": "杭州", "shanghai": "上海", "beijing": "北京", "guangzhou": "广州", "shenzhen": "深圳", "nanjing": "南京", "chengdu": "成都", "xian": "西安", "wuhan": "武汉"}
INTENT_WORDS = {
    "habit": ("习惯", "通常", "平时", "日常", "总是", "经常", "往往", "一般会", "动不动"),
    "skill": ("会", "擅长", "精通", "掌握", "熟悉", "会用", "会做", "会写", "会说", "能力", "技能"),
    "goal": ("目标", "计划", "想要", "希望", "打算", "愿望", "志向", "梦想", "将要", "未来想"),
    "health": ("健康", "身体", "体检", "医生", "病", "过敏", "体质", "不舒服", "疼", "痛"),
    "work": ("工作", "职位", "公司", "上班", "加班", "下班", "同事", "领导", "老板", "项目"),
    "fact": ("什么", "是谁", "在哪", "叫什么", "哪个"),
    "preference": ("喜欢", "偏好", "爱", "想", "要"),
    "entity": ("认识", "朋友", "同事", "使用", "工具"),
}
SYNONYMS = {"经验": ("总结", "知道", "了解", "教训", "学"), "教训": ("错误", "失败", "问题", "反思"), "开发经验": ("开发", "代码", "编程", "开发过"), "擅长": ("会", "能", "精", "熟悉"), "不擅长": ("不会", "难以", "困难"), "做过": ("做", "完成", "进行", "参与")}
#: type, subtype, pattern.
AUTO_RULES = (
    ("fact", "location", "(?:用户|我)(?:在|于|是|叫|住在)([^\\s，,。]+)"),
    ("fact", "work", "(?:用户|我)(?:工作|任职|就职)于?([^\\s，,。]+)"),
    ("fact", "tool", "(?:用户|我).*?(?:使用|用)([^\\s，,。]+)"),
    ("fact", "age", "(?:用户|我)([^\\s，,。]+)(?:岁|年龄)"),
    ("fact", "education", "(?:用户|我)(?:毕业[于]?)([^\\s，,。]+)"),
    ("fact", "profession", "(?:用户|我)(?:从事|做)([^\\s，,。]+)"),
    ("preference", "like", "(?:用户|我).*?喜欢([^\\s，,。]+)"),
    ("preference", "dislike", "(?:用户|我).*?讨厌([^\\s，,。]+)"),
    ("preference", "want", "(?:用户|我).*?想要([^\\s，,。]+)"),
    ("preference", "prefer", "(?:用户|我).*?倾向于([^\\s，,。]+)"),
    ("preference", "not_like", "(?:用户|我).*?不(?:太?)?喜欢([^\\s，,。]+)"),
    ("preference", "prefer", "(?:用户|我).*?(?:更?愿|比?较愿)意([^\\s，,。]+)"),
    ("decision", "decision", "(?:用户|我).*?决定([^\\s，,。]+)"),
    ("decision", "decision", "(?:用户|我).*?选择([^\\s，,。]+)"),
    ("decision", "adopted", "(?:用户|我).*?已[经]?采用([^\\s，,。]+)"),
    ("decision", "will_use", "(?:用户|我).*?(?:将|会)使用([^\\s，,。]+)"),
    ("decision", "plan_use", "(?:用户|我).*?(?:准备|计划)(?:使用|采用)([^\\s，,。]+)"),
    ("goal", "goal", "(?:用户|我).*?想要([^\\s，,。]+)"),
    ("goal", "goal", "(?:用户|我).*?希望([^\\s，,。]+)"),
    ("goal", "goal", "(?:用户|我).*?的目标是([^\\s，,。]+)"),
    ("goal", "plan", "(?:用户|我).*?打算([^\\s，,。]+)"),
    ("goal", "in_progress", "(?:用户|我).*?正(?:在|准备)([^\\s，,。]+)"),
    ("lesson", "learned", "(?:用户|我).*?从([^\\s，,。]+)中学到"),
    ("lesson", "discovered", "(?:用户|我).*?(?:意识[到]?|发现)([^\\s，,。]+)"),
    ("lesson", "mistake", "(?:用户|我).*?(?:犯错|失误|失败)(?:于|在)([^\\s，,。]+)"),
    ("lesson", "lesson", "(?:用户|我).*?(?:经验|教训)(?:是|：)([^\\s，,。]+)"),
)
AUTO_CONFIDENCE = {"fact": 0.85, "preference": 0.80, "decision": 0.90, "goal": 0.75, "lesson": 0.80}
QUICK_RULES = (
    ("preference", "(?:我|用户).*(?:喜欢|prefer|倾向|倾向于)(.+)"), ("preference", "(?:我|用户).*(?:讨厌|不喜欢|hate|dislike)(.+)"), ("preference", "(?:我|用户).*(?:用|使用|using|use)(.+?)(?:而不是|instead of|不)(.+)"),
    ("preference", "(?:我|用户).*(?:偏好|preference).*(:|是)(.+)"), ("decision", "(?:决定|decided|决策).*(?:用|使用|用)(.+)"), ("decision", "(?:我们|我).*(?:决定|decided|选择|chose)(.+)"),
    ("decision", "(?:用|使用)(.+?)(?:吧|吧|好了|的)"), ("fact", "(?:我|用户).*(?:住在|位于|在)(.+?)(?:市|省|县|区)"), ("fact", "(?:我|用户).*(?:是|是一名|做)(.+?)(?:工程|开发|设计|产品|运营|市场)"),
    ("fact", "(?:我|用户).*(?:工作|任职|就职)(?:于|在)(.+)"), ("task_state", "截止.*?(?:是|到|在|为)(.+?[日周月年])"), ("task_state", "deadline.*?(is|:|到|是)(.+)"),
)
#: relation, type, pattern, groups of subject (0: none) and object.
GRAPH_RULES = (
    ("works_at", "person_company", "([一-鿿]{2,8})(?:在|于|就职于|工作于)([一-鿿]{2,10})(?:公司|集团|企业|工作室)", 1, 2),
    ("is_company", "company", "(?:在|于|就职于)([一-鿿]{2,10})(?:公司|集团|企业)", 0, 1),
    ("uses", "person_tool", "(?:使用|采用|基于)(React|Vue|Angular|Python|Java|Go|Rust|JavaScript|TypeScript|\\S+)", 0, 1),
    ("is_a", "person_profession", "([一-鿿]{2,4})(?:是|担任)([一-鿿]+)工程师", 1, 2),
    ("likes", "preference", "(?:喜欢|爱|偏好)([一-鿿A-Za-z0-9]+)", 0, 1),
    ("worked_on", "project", "(?:项目|做了)([一-鿿A-Za-z0-9]{2,15})", 0, 1),
    ("works_at", "company", "(?:在|于)([一-鿿]{2,10})(?:公司|集团|企业)(?:工作|任职)", 0, 1),
    ("mentioned", "tech_company", "((?:字节跳动|阿里巴巴|腾讯|百度|京东|美团|滴滴|小米|华为|网易|新浪|搜狐|360|快手|拼多多|抖音|头条|微信|支付宝)[一-鿿]*)", 0, 1),
    ("lives_in", "location", "(?:住在|定居于|位于)([一-鿿]{2,10})", 0, 1),
    ("graduated_from", "education", "(?:毕业于|就读于)([一-鿿]{2,15})(?:大学|学院|学校)", 0, 1),
    ("has_position", "position", "(?:职位是|担任|当)([一-鿿]{2,8})(?:工程|开发|设计|产品|运营|市场|销售|经理|总监| CTO| CEO| CFO| COO| VP)", 0, 1),
    ("has_social", "social", "(?:有|认识|结交了)([一-鿿]{1,5})(?:朋友|同事|伙伴)", 0, 1),
    ("dislikes", "dislike", "(?:不喜欢|讨厌|厌恶|反感)([一-鿿A-Za-z0-9]+)", 0, 1),
    ("allergic_to", "allergy", "(?:对|过敏|敏感)([一-鿿A-Za-z0-9]+)(?:过敏|敏感)", 0, 1),
    ("knows", "person_known", "(?:朋友|同学|同事)([一-鿿]{1,5})(?:叫|名|是)", 0, 1),
    ("learned", "skill_acquired", "(?:学过|学习过|掌握|精通)([一-鿿A-Za-z0-9]+)", 0, 1),
)
TECH = (
    "React", "Vue", "Angular", "Svelte", "jQuery", "HTML", "CSS", "Node.js", "Python", "Java", "Go", "Rust", "C++", "C#", "Ruby", "PHP", "MySQL", "PostgreSQL", "MongoDB", "Redis", "Elasticsearch",
    "AWS", "Azure", "GCP", "阿里云", "腾讯云", "TensorFlow", "PyTorch", "Keras", "scikit-learn", "OpenAI", "React Native", "Flutter", "Swift", "Kotlin", "Android", "iOS",
)
COMPANY_WORDS = ("公司", "集团", "企业", "工作室", "医院", "学校", "银行")
COMPANIES = ("字节跳动", "阿里巴巴", "腾讯", "百度", "京东", "美团", "小米", "华为", "网易", "新浪", "搜狐", "快手", "拼多多", "滴滴", "抖音", "微信", "支付宝")
CITIES = ("北京", "上海", "深圳", "广州", "杭州", "南京", "成都", "武汉", "西安", "苏州", "天津", "重庆", "长沙", "郑州", "东莞", "青岛", "沈阳", "大连", "厦门", "福州")
FORCED = ("(记得|记住|回忆|想起)", "(之前|上次|过去|曾经|以前).*说", "(我的|我之前|曾说过)")
MEMORY_WORDS = ("记得", "之前", "上次", "过去", "曾经", "以前", "我的", "我之前", "我记得", "你记得吗", "曾经说", "过去说", "之前提到", "上次说", "remember", "before", "previously", "last time", "previously mentioned", "you said earlier", "my", "i previously", "i said before")
NEGATED_WORDS = ("喜欢", "吃", "做")
RECENT_WORDS = ("最近", "近期", "现在", "目前", "这周", "这月", "今天", "昨天", "当前", "进行中", "正在")
PAST_WORDS = ("以前", "过去", "之前", "曾经", "早些", "当年", "那时", "曾经的", "过去的")
#: A negation and the words of an earlier statement that it speaks against.
CONTRADICTIONS = (("不喜欢", "喜欢"), ("不是", "是"), ("没有", "有"), ("从不", "偶尔"), ("讨厌", "喜欢"))
CORRECTIONS = ("实际上", "其实", "不对", "错了", "更正", "纠正", "改口", "之前.*说错了", "不是.*而是", "之前说.*现在")
PLACEHOLDERS = ("high importance", "importance上限", "测试重要性", "test", "测试", "placeholder", "todo", "tmp")
CHANNEL_WEIGHTS = {"negation": (0.25, 0.35, 0.10, 0.10, 0.20), "temporal": (0.30, 0.20, 0.10, 0.10, 0.30), "lesson": (0.35, 0.25, 0.15, 0.15, 0.10), "multihop": (0.30, 0.15, 0.10, 0.35, 0.10), "fuzzy": (0.45, 0.25, 0.10, 0.05, 0.15), "decision": (0.35, 0.25, 0.15, 0.15, 0.10)}
DEFAULT_WEIGHTS = (0.40, 0.20, 0.15, 0.10, 0.15)


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def denoise_reason(content: Column, importance: Column, confidence: Column, repeats: Column) -> Column:
    """Why a memory isn't stored, the first reason that holds; null: it is stored."""
    t = stripped(content)
    starts = tuple("^(?:" + p.removeprefix("^") + ")" for p in SYSTEM_PROMPT)
    return (
        F.when(F.length(t) < 8, "short").when(F.length(t) > 5000, "long").when(t.rlike(f"(?i){any_of(HEARTBEAT)}"), "heartbeat")
        .when(F.substring(t, 1, 100).rlike(f"(?i){any_of(starts)}"), "system_prompt").when(F.lower(t).rlike(any_of(TIME_QUERY)), "time_query")
        .when(confidence < 0.6, "confidence").when(importance < 0.3, "importance").when(repeats >= 3, "repeat")
        .when((importance < 0.5) & F.substring(t, 1, 20).rlike(f"(?i){any_of(GENERIC)}"), "generic")
    )


def is_noise(text: Column) -> Column:
    """Short, a greeting, an acknowledgement or thanks alone, or without a letter, digit or underscore of any script."""
    t = stripped(text)
    return (F.length(t) < 2) | t.rlike(f"(?i){any_of(NOISE)}") | ~t.rlike(r"[\p{L}\p{N}_]")


def should_retrieve(query: Column) -> Column:
    q = stripped(query)
    return (F.length(q) > 0) & ~q.rlike(f"(?i){any_of(SKIP)}") & ~q.rlike("^[😀-🙏]+$")


def keyword_class(query: Column) -> Column:
    """(score, order, intent, confidence) of the class with the most words; specific classes count double and win ties."""
    specific = ("habit", "skill", "goal", "health", "work")
    rows = []
    for n, (name, words) in enumerate(INTENT_WORDS.items()):
        score = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(query, w))) * (2 if name in specific else 1)
        known = name in (*specific, "fact")
        rows.append(F.struct(score.alias("score"), F.lit(-n).alias("order"), F.when(score > 0, name if known else "fact").otherwise("fact").alias("intent"), F.when(score > 0, 0.75 if known else 0.5).otherwise(0.5).alias("confidence")))
    return F.array_max(F.array(*rows))


def intent(query: Column) -> Column:
    """The name of the first rule that holds, else the keyword class."""
    return (
        F.when(query.rlike(any_of((*NEGATION_PATTERNS, *NEGATION))), "negation").when(query.rlike(any_of(MULTIHOP)), "multihop")
        .when(query.rlike(any_of(LESSON)), "lesson").when(query.rlike(any_of(TEMPORAL)), "temporal").when(F.lower(query).rlike(any_of(tuple(PINYIN))), "fuzzy")
        .when(query.rlike(any_of(DECISION)), "decision").otherwise(keyword_class(query)["intent"])
    )


def intent_confidence(query: Column, name: Column) -> Column:
    fixed = F.when(name == "negation", 0.9).when(name.isin("multihop", "lesson", "temporal"), 0.85).when(name.isin("fuzzy", "decision"), 0.8)
    return fixed.otherwise(keyword_class(query)["confidence"])


def expand(query: Column) -> Column:
    """The query and its rewrites, in order: names in Hanzi, synonyms that are new, and for a negation its positive forms, which may repeat."""
    low, negated = F.lower(query), query.rlike(any_of((*NEGATION_PATTERNS, *NEGATION)))
    swap = lambda text, a, b: F.replace(text, F.lit(a), F.lit(b))
    made = [(low.contains(p), swap(low, p, h), True) for p, h in PINYIN.items()]
    made += [(query.contains(w), swap(query, w, s), False) for w, found in SYNONYMS.items() for s in found]
    for word in NEGATED_WORDS:
        made += [(negated & query.contains(word), swap(query, f"不{word}", word), True), (negated & query.contains(word), swap(query, "不喜欢", "喜欢"), True)]
    made += [(negated & query.contains("不擅长"), swap(query, a, b), True) for a, b in (("不擅长", "擅长"), ("不擅长什么", "什么"))]
    rows = F.array(*(F.struct(F.coalesce(c, F.lit(False)).alias("holds"), t.alias("text"), F.lit(always).alias("always")) for c, t, always in made))
    add = lambda acc, r: F.when(r["holds"] & (r["always"] | ~F.array_contains(acc, r["text"])), F.concat(acc, F.array(r["text"]))).otherwise(acc)
    return F.aggregate(rows, F.array(query), add)


def bm25_tokens(text: Column) -> Column:
    """Latin words; of runs of Chinese characters, pairs and triples."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    # A text of single-byte characters has no Chinese ones, so it isn't searched for them.
    return F.when(F.octet_length(low) == F.length(low), latin).otherwise(F.concat(F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3)))), latin))


def core_tokens(text: Column) -> Column:
    """Latin words with underscores; of runs of Chinese characters, pairs and the last character."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), pairs)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.lower(F.regexp_replace(text, r"[ \t\n\r]+", " "))), 256), 1, 16)


def cache_key(params: Column) -> Column:
    return F.substring(F.sha2(F.to_json(params), 256), 1, 16)


def fingerprint(text: Column) -> Column:
    """A hash of the text in lower case without white space, full-width marks, brackets and double quotes."""
    return F.substring(F.md5(F.regexp_replace(F.lower(text), r'[\s\p{Z}\x0b\x1c-\x1f\x85，。、！？；："（）\[\]【】]', "")), 1, 16)


def is_valid(content: Column, summary: Column | None = None) -> Column:
    """False for contents under 5 characters, and for short texts with a placeholder's word."""
    both = F.trim(F.concat(F.lower(content), F.lit(" "), F.lower(F.coalesce(summary, F.lit(""))))) if summary is not None else F.trim(F.lower(content))
    return (F.length(content) >= 5) & ~((F.length(both) < 30) & both.rlike(any_of(PLACEHOLDERS)))


def auto_extract(text: Column) -> Column:
    """array of (type, content, confidence): all matches of all rules, distinct by type and content."""
    parts = [_facts(text, kind, sub, pattern) for kind, sub, pattern in AUTO_RULES]
    return F.array_distinct(F.concat(*parts))


def _facts(text: Column, kind: str, sub: str, pattern: str) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.length(x) > 1)
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"用户{sub}: "), x).alias("content"), F.lit(AUTO_CONFIDENCE[kind]).alias("confidence")))


def quick_extract(text: Column) -> Column:
    """array of (type, content, importance): the first match of each rule."""

    def one(kind: str, pattern: str) -> Column:
        got = F.trim(F.regexp_extract(text, f"(?i){pattern}", 0))
        weight = F.when(got.rlike("(?i)deadline|截止"), 0.95).when(got.rlike("(?i)decided|决定"), 0.9).when(got.rlike("(?i)prefer|喜欢"), 0.8).otherwise(0.5)
        return F.when(got != "", F.struct(F.lit(kind).alias("type"), got.alias("content"), weight.alias("importance")))

    return F.when(is_noise(text), F.array().cast("array<struct<type:string,content:string,importance:double>>")).otherwise(F.array_compact(F.array(*(one(k, p) for k, p in QUICK_RULES))))


def graph_entities(text: Column) -> Column:
    """array of (relation, type, subject, entity) by the rules, then the technologies that the text names; first sighting of a name wins."""
    by_rule = [F.zip_with(_group(text, p, obj), _group(text, p, subj) if subj else F.array().cast("array<string>"), _entity(r, t)) for r, t, p, subj, obj in GRAPH_RULES]
    named = F.filter(F.array(*map(F.lit, TECH)), lambda w: F.contains(F.lower(text), F.lower(w)))
    every = F.concat(*by_rule, F.transform(named, lambda w: _entity("mentioned", "technology")(w, F.lit(None).cast("string"))))
    names = F.transform(every, lambda v: v["entity"])
    return F.filter(every, lambda v, i: F.array_position(names, v["entity"]) == i + 1)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))


def _entity(relation: str, kind: str):  # noqa: ANN202
    return lambda x, subject: F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("type"), subject.alias("subject"), x.alias("entity"))


def entity_type(name: Column) -> Column:
    """company, location, technology or concept, by the words in a name."""
    tech = F.exists(F.array(*map(F.lit, TECH)), lambda w: F.contains(F.lower(name), F.lower(w)))
    return F.when(name.rlike(any_of((*COMPANY_WORDS, *COMPANIES))), "company").when(name.rlike(any_of(CITIES)), "location").when(tech, "technology").otherwise("concept")


def weights_of(name: Column) -> Column:
    out = F.array(*map(F.lit, DEFAULT_WEIGHTS))
    for k, w in CHANNEL_WEIGHTS.items():
        out = F.when(name == k, F.array(*map(F.lit, w))).otherwise(out)
    return out


def temporal_match(query: Column, content: Column) -> Column:
    """How a text's time words fit those of the query; null where the query has none, or where they don't fit (.3 and less)."""
    words = lambda t, w: F.lower(t).rlike(any_of(w))
    recent, past = words(query, RECENT_WORDS), words(query, PAST_WORDS)
    new, old = words(content, RECENT_WORDS), words(content, PAST_WORDS)
    score = (
        F.when(recent & past, F.when(new, 0.9).when(old, 0.3).otherwise(0.5)).when(recent, F.when(new, 1.0).when(old, 0.1).otherwise(0.5))
        .when(past, F.when(old, 1.0).when(new, 0.1).otherwise(0.5))
    )
    return F.when(score > 0.3, score)


def linked_entities(text: Column) -> Column:
    """array of (subject, relation, entity, type): X is Y, tools that are used, and employers; names of one character are left out."""
    name = "[A-Za-z0-9一-鿿]+"
    is_a = F.zip_with(_group(text, f"({name})是的?({name})", 1), _group(text, f"({name})是的?({name})", 2), lambda a, b: F.struct(a.alias("subject"), F.lit("is_a").alias("relation"), b.alias("entity"), F.lit("concept").alias("type")))
    pairs = F.filter(is_a, lambda x: (F.length(x["subject"]) > 1) & (F.length(x["entity"]) > 1) & (x["subject"] != x["entity"]))
    alone = lambda pattern, kind: F.transform(F.filter(_group(text, pattern, 1), lambda x: F.length(x) > 1), lambda x: F.struct(F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("relation"), x.alias("entity"), F.lit(kind).alias("type")))
    return F.concat(pairs, alone(f"使用({name})", "tool"), alone(f"在({name})工作", "company"))


def _long_enough(query: Column) -> Column:
    return (F.length(F.regexp_replace(query, "[^一-鿿]", "")) >= 6) | (F.size(F.regexp_extract_all(query, F.lit("[a-zA-Z]+"), F.lit(0))) >= 15)


def retrieval_reason(query: Column) -> Column:
    """Why a query is searched for, or isn't: empty, skip, forced, length, keyword or short."""
    q = stripped(query)
    skip = F.lower(q).rlike(any_of(SKIP)) | q.rlike("^[😀-🙏]+$")
    return (
        F.when(F.length(q) == 0, "empty").when(skip, "skip").when(q.rlike(any_of(FORCED)), "forced").when(_long_enough(q), "length")
        .when(F.lower(q).rlike(any_of(MEMORY_WORDS)), "keyword").otherwise("short")
    )


def query_kind(query: Column) -> Column:
    """greeting, command, confirm, simple_question, memory_recall, fact_query or other."""
    low = F.lower(stripped(query))
    return (
        F.when(low.rlike("^(hi|hello|hey|你好|您好|嗨|哈喽)"), "greeting").when(low.startswith("/"), "command").when(low.rlike("^(ok|好|yes|yeah|yep|okay|好的|可以|没问题)"), "confirm")
        .when(F.length(low) < 10, "simple_question").when(low.rlike(any_of(MEMORY_WORDS)), "memory_recall").when(_long_enough(low), "fact_query").otherwise("other")
    )
