"""Filters, predicates, scalar functions and literal text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import scoring, text
from mnemosaic.operators import search, windows

from .registry import query
from .views import MEM, NOW, literal_sql, literals, memories, said, said_sql, table

Q = ["用户不喜欢吃什么", "用户最近在做什么", "hangzhou 天气", "用户的名字叫什么", "老板的朋友的公司", "学到什么教训", "为什么选择它", "平时的习惯", "/help", "hello", "", "咖啡", "记得我的生日吗", "hello there friend", "好的", "谢谢!", "weather"]


def _re(patterns: tuple[str, ...]) -> str:
    return text.any_of(patterns).replace("'", "''")


_STRIP = r"regexp_replace(coalesce({0}, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
_SYSTEM = _re(tuple("^(?:" + p.removeprefix("^") + ")" for p in text.SYSTEM_PROMPT))
DENOISE = f"""CASE WHEN length(t) < 8 THEN 'short' WHEN length(t) > 5000 THEN 'long'
 WHEN regexp_matches(t, '(?i){_re(text.HEARTBEAT)}') THEN 'heartbeat' WHEN regexp_matches(substr(t, 1, 100), '(?i){_SYSTEM}') THEN 'system_prompt'
 WHEN regexp_matches(lower(t), '{_re(text.TIME_QUERY)}') THEN 'time_query' WHEN importance < 0.3 THEN 'importance' WHEN repeats >= 3 THEN 'repeat'
 WHEN importance < 0.5 AND regexp_matches(substr(t, 1, 20), '(?i){_re(text.GENERIC)}') THEN 'generic' END"""
HASH = r"substr(sha256(trim(lower(regexp_replace(content, '[ \t\n\r]+', ' ', 'g')))), 1, 16)"


@query("f1_f3_denoise", f"""WITH {MEM}, h AS (SELECT *, {HASH} AS hash, {_STRIP.format('content')} AS t FROM mem),
r AS (SELECT *, count(*) OVER (PARTITION BY hash ORDER BY epoch_us(created_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS repeats FROM h),
x AS (SELECT id, repeats, {DENOISE} AS reason, CASE WHEN importance > 0.5 THEN 'warm' WHEN importance >= 0.3 THEN 'cold' ELSE 'discard' END AS class FROM r)
SELECT id, repeats, reason, class, reason IS NULL AND class <> 'discard' AS stored FROM x""")
def f1(spark, d):
    """Texts are judged where they are read; only hashes, times and the judgement are moved to count repeats, which rank before a generic reply."""
    m = search.spread(memories(spark, d).select("id", "content", "importance", "created_at"))
    judged = m.select("id", "created_at", text.content_hash(F.col("content")).alias("hash"), text.denoise_reason(F.col("content"), F.col("importance"), F.lit(1.0), F.lit(0)).alias("first"), scoring.keep_class(F.col("importance")).alias("class"))
    counted = windows.repeats_before(judged, "hash", "created_at")
    reason = F.when((F.col("repeats") >= 3) & (F.col("first").isNull() | (F.col("first") == "generic")), "repeat").otherwise(F.col("first"))
    return counted.select("id", "repeats", reason.alias("reason"), "class", (reason.isNull() & (F.col("class") != "discard")).alias("stored"))


DENOISED = {
    "[HEARTBEAT] system ok": "heartbeat", "scheduled: run the jobs": "heartbeat", "好的": "short", "You are a helpful assistant": "system_prompt", "note that this is long enough": "system_prompt", "请问现在几点了，谢谢你": "time_query",
    "What time is it over there?": "time_query", "用户喜欢川菜和粤菜的味道": None, "用户不喜欢吃什么": None, "学到什么教训": "short", "/help": "short", "": "short", "hello there friend": None,
}


@query("f1_denoise_literals", "SELECT * FROM (VALUES " + ", ".join("('" + q + "', " + ("NULL" if r is None else f"'{r}'") + ")" for q, r in DENOISED.items()) + ") AS t(q, reason)")
def f1_literals(spark, d):
    """The expected reasons are written by hand."""
    rows = literals(spark, list(DENOISED))
    return rows.select("q", text.denoise_reason(F.col("q"), F.lit(0.6), F.lit(0.9), F.lit(0)).alias("reason"))


NOISES = ["привет мир", "ありがとう", "안녕하세요", "你好!", "hello", "Hi there", "😀😀", "👍", "。。。", "???", "好的", "谢谢!", "thx", "a", "", "早上好", "知道了吗", "_x", "٣٤"]
#: Written out here, apart from the constants of the code.
_NOISE_SQL = r"""length(t) < 2 OR regexp_matches(t, '(?i)^(你好|您好|嗨|hi|hello|hey|早上好|下午好|晚上好|早安|晚安|好的|是的|嗯|ok|好|行|可以|没问题|收到|了解|明白|知道了|谢谢|感谢|多谢|thx|thanks)[\s,.!?]*$')
 OR regexp_matches(t, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{P}\p{S}\p{M}\p{C}]*$')"""


@query("f4_noise", rf"""WITH {literal_sql(NOISES)}, c AS (SELECT conv_id, turn, {_STRIP.format('text')} AS t FROM conversations UNION ALL SELECT NULL, NULL, {_STRIP.format('q')} FROM l)
SELECT conv_id, turn, CASE WHEN conv_id IS NULL THEN t END AS said, {_NOISE_SQL} AS noise FROM c""")
def f4(spark, d):
    """Messages, and literals of several scripts."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("string").alias("said"))
    more = literals(spark, NOISES).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("q").alias("text"), text.stripped(F.col("q")).alias("said"))
    return rows.unionByName(more).select("conv_id", "turn", "said", text.is_noise(F.col("text")).alias("noise"))


_KEYWORDS = "记得|之前|上次|过去|曾经|以前|我的|我之前|我记得|你记得吗|曾经说|过去说|之前提到|上次说|remember|before|previously|last time|previously mentioned|you said earlier|my|i previously|i said before"
_FORCED = ("(记得|记住|回忆|想起)", "(之前|上次|过去|曾经|以前).*说", "(我的|我之前|曾说过)")
_LONG = "(length(regexp_replace(t, '[^一-鿿]', '', 'g')) >= 6 OR len(regexp_extract_all(t, '[a-zA-Z]+')) >= 15)"


@query("f5_f6_gate", rf"""WITH {literal_sql(Q)}, s AS (SELECT q, {_STRIP.format('q')} AS t FROM l UNION ALL SELECT text, {_STRIP.format('text')} FROM conversations),
f AS (SELECT q, t, regexp_matches(lower(t), '^(hi|hello|hey|你好|您好|嗨|哈喽)|^/|^(ok|好|yes|yeah|yep|okay|好的|可以)|^(thanks|thank you|谢谢)|^[😀-🙏]+$') AS skip FROM s)
SELECT q, length(t) > 0 AND NOT skip AS retrieve,
CASE WHEN length(t) = 0 THEN 'empty' WHEN skip THEN 'skip' WHEN regexp_matches(t, '{"|".join(_FORCED)}') THEN 'forced' WHEN {_LONG} THEN 'length' WHEN regexp_matches(lower(t), '{_KEYWORDS}') THEN 'keyword' ELSE 'short' END AS reason,
CASE WHEN regexp_matches(lower(t), '^(hi|hello|hey|你好|您好|嗨|哈喽)') THEN 'greeting' WHEN starts_with(t, '/') THEN 'command' WHEN regexp_matches(lower(t), '^(ok|好|yes|yeah|yep|okay|好的|可以|没问题)') THEN 'confirm'
WHEN length(t) < 10 THEN 'simple_question' WHEN regexp_matches(lower(t), '{_KEYWORDS}') THEN 'memory_recall' WHEN {_LONG.replace('(t,', '(lower(t),')} THEN 'fact_query' ELSE 'other' END AS kind FROM f""")
def f5(spark, d):
    """Whether a query is searched for, why, and what kind it is: literals and every message."""
    rows = literals(spark, Q).unionByName(table(spark, d, "conversations").select(F.col("text").alias("q")))
    return rows.select("q", text.should_retrieve(F.col("q")).alias("retrieve"), text.retrieval_reason(F.col("q")).alias("reason"), text.query_kind(F.col("q")).alias("kind"))


@query("f8_f10_tenants", f"""WITH {MEM}, r(requested) AS (VALUES ('global'), ('user'), ('project')) SELECT requested, id, requested = 'global' OR scope = 'global' OR (scope = 'user' AND scope_id = 's3') OR (scope NOT IN ('global', 'user') AND scope_id = 's2') AS visible,
CASE WHEN scope = 'global' THEN true WHEN scope = 'user' THEN scope_id = 's3' WHEN scope IN ('project','agent','session','channel') THEN scope_id = 's2' ELSE false END AS writable,
substr(sha256(scope_id), 1, 16) AS scope_hash FROM mem, r""")
def f8(spark, d):
    """What user s3 in scope s2 may see and write, for each scope that may be asked for; scope ids leave as hashes, and transcripts don't leave."""
    asked = F.explode(F.array(*map(F.lit, ("global", "user", "project")))).alias("requested")
    own = F.when(F.col("scope") == "user", F.col("scope_id") == "s3").otherwise(F.col("scope_id") == "s2")
    visible = (F.col("requested") == "global") | (F.col("scope") == "global") | own
    writable = F.when(F.col("scope") == "global", True).when(F.col("scope").isin("user", "project", "agent", "session", "channel"), own).otherwise(False)
    return memories(spark, d).select("*", asked).select("requested", "id", visible.alias("visible"), writable.alias("writable"), F.substring(F.sha2("scope_id", 256), 1, 16).alias("scope_hash"))


SHORTS = [("a test", "x"), ("fine words here", "todo"), ("abcd", ""), ("todo: something that is long enough to keep", ""), ("High Importance", None), ("用户喜欢川菜", "测试"), ("tmp", "a summary of more than thirty characters")]
_SHORTS = "s(content, summary) AS (VALUES " + ", ".join(f"('{c}', {'NULL' if x is None else repr(x)})" for c, x in SHORTS) + ")"


@query("f11_placeholder", f"""WITH {MEM}, {_SHORTS}, u AS (SELECT id, content, substr(content, 1, 20) AS summary FROM mem UNION ALL SELECT NULL, content, summary FROM s), t AS (SELECT *, trim(lower(content) || ' ' || lower(coalesce(summary, ''))) AS b FROM u)
SELECT id, CASE WHEN id IS NULL THEN content END AS said, length(content) >= 5 AND NOT (length(b) < 30 AND regexp_matches(b, 'high importance|importance上限|测试重要性|test|测试|placeholder|todo|tmp')) AS valid FROM t""")
def f11(spark, d):
    m = memories(spark, d).select("id", "content", F.substring("content", 1, 20).alias("summary"), F.lit(None).cast("string").alias("said"))
    more = spark.createDataFrame([(None, c, x, c) for c, x in SHORTS], "id long, content string, summary string, said string")
    return m.unionByName(more).select("id", "said", text.is_valid(F.col("content"), F.col("summary")).alias("valid"))


@query("f12_f14_tiers", f"""WITH {MEM}, t AS (SELECT id, importance, CASE WHEN importance > 0.9 THEN 'HOT' WHEN importance > 0.7 THEN 'WARM' WHEN importance > 0.5 THEN 'COLD' ELSE 'ARCHIVED' END AS tier FROM mem)
SELECT id, tier, CASE WHEN tier = 'HOT' THEN 'WARM' ELSE tier END AS assigned, importance > 0.7 AS fits_warm FROM t""")
def f12(spark, d):
    t = memories(spark, d).withColumn("tier", scoring.tier(F.col("importance")))
    return t.select("id", "tier", F.when(F.col("tier") == "HOT", "WARM").otherwise(F.col("tier")).alias("assigned"), (F.col("importance") > 0.7).alias("fits_warm"))


@query("f15_f18_old_rows", f"""WITH {MEM} SELECT id, created_at < TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND importance >= 0.5 AS to_cold, importance < 0.3 AS to_archive,
last_accessed < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS stale, source = '' AS orphan FROM mem WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY""")
def f15(spark, d):
    ago = lambda n: F.expr(f"TIMESTAMP '{NOW}' - INTERVAL {n} DAY")
    m = memories(spark, d).where(F.col("created_at") < ago(10))
    return m.select("id", ((F.col("created_at") < ago(20)) & (F.col("importance") >= 0.5)).alias("to_cold"), (F.col("importance") < 0.3).alias("to_archive"), (F.col("last_accessed") < ago(30)).alias("stale"), (F.col("source") == "").alias("orphan"))


@query("f21_slow_operations", "SELECT event_id, event_type, value FROM events WHERE value > 100 ORDER BY ts DESC, event_id LIMIT 10")
def f21(spark, d):
    return table(spark, d, "events").where("value > 100").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "event_type", "value")


@query("x1_x6_hashes", rf"""WITH {MEM} SELECT id, length(regexp_replace(substr(content, 1, 50000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS clean_length, {HASH} AS denoise_hash,
sha256(lower(trim(content))) AS unify_hash, sha256(content) AS guard_hash, substr(sha256(content), 1, 12) AS version_hash,
substr(md5(regexp_replace(lower(content), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]|，|。|、|！|？|；|：|\"|（|）|\[|\]|【|】', '', 'g')), 1, 16) AS fingerprint, substr(content, 1, 50) AS preview FROM mem""")
def x1(spark, d):
    c = F.col("content")
    clean = F.regexp_replace(F.substring(c, 1, 50000), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return memories(spark, d).select(
        "id", F.length(clean).cast("long").alias("clean_length"), text.content_hash(c).alias("denoise_hash"), F.sha2(F.lower(F.trim(c)), 256).alias("unify_hash"), F.sha2(c, 256).alias("guard_hash"),
        F.substring(F.sha2(c, 256), 1, 12).alias("version_hash"), text.fingerprint(c).alias("fingerprint"), F.substring(c, 1, 50).alias("preview"),
    )


@query("x2_x3_tokenizers", f"""WITH {MEM}, t AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS a, regexp_extract_all(lower(content), '[a-z0-9]+') AS b FROM mem)
SELECT id, len(a)::INT AS n_core, len(b)::INT AS n_module, md5(array_to_string(b, ' ')) AS digest FROM t""")
def x2(spark, d):
    m = memories(spark, d).select("id", text.core_tokens(F.col("content")).alias("a"), text.bm25_tokens(F.col("content")).alias("b"))
    return m.select("id", F.size("a").alias("n_core"), F.size("b").alias("n_module"), F.md5(F.array_join("b", " ")).alias("digest"))


@query("x3_token_literals", """SELECT * FROM (VALUES ('用户ab', ['ab', '户', '用户'], ['用户', 'ab']), ('用户名ab', ['ab', '名', '户名', '用户'], ['用户', '户名', '用户名', 'ab']), ('hangzhou 天气', ['hangzhou', '天气', '气'], ['天气', 'hangzhou']),
('学到什么教训', ['么教', '什么', '到什', '学到', '教训', '训'], ['学到', '到什', '什么', '么教', '教训', '学到什', '到什么', '什么教', '么教训']), ('Snake_case x2', ['snake_case', 'x2'], ['snake', 'case', 'x2']), ('', [], [])) AS t(q, core, module)""")
def x3(spark, d):
    """Both tokenizers; the expected tokens are written by hand."""
    return literals(spark, ["用户ab", "用户名ab", "hangzhou 天气", "学到什么教训", "Snake_case x2", ""]).select("q", F.array_sort(F.array_distinct(text.core_tokens(F.col("q")))).alias("core"), text.bm25_tokens(F.col("q")).alias("module"))


_AUTO = "[" + ", ".join(f"[{{'type': '{k}', 'content': '用户{s}: ' || x, 'confidence': {text.AUTO_CONFIDENCE[k]}::DOUBLE}} for x in regexp_extract_all(q, '{p}', 1) if length(x) > 1]" for k, s, p in text.AUTO_RULES) + "]"
FACTS = ["用户喜欢川菜", "用户讨厌川菜", "我使用Python", "用户住在杭州市", "我决定使用Spark", "用户的目标是学习", "我从失败中学到坚持", "张三在字节公司工作", "hello", "项目截止日期是下周", "用户对花生过敏"]


@query("x7_x9_extract", f"""WITH {said_sql(FACTS)}, f AS (SELECT q, list_distinct(flatten({_AUTO})) AS found FROM l), u AS (SELECT q, unnest(found) AS x FROM f)
SELECT q, x.type AS type, x.content AS content, x.confidence AS confidence, length(x.content) >= 8 AS stored FROM u""")
def x7(spark, d):
    return said(spark, d, FACTS).select("q", F.explode(text.auto_extract(F.col("q"))).alias("x")).select("q", "x.type", "x.content", "x.confidence", text.denoise_reason(F.col("x.content"), F.col("x.confidence"), F.col("x.confidence"), F.lit(0)).isNull().alias("stored"))


@query("x6_fingerprints", r"""WITH l(q, fingerprint) AS (VALUES ('用户说："我喜欢川菜"', substr(md5('用户说我喜欢川菜'), 1, 16)), ('（A）[b]【c】 d', substr(md5('abcd'), 1, 16)), ('it''s “so”', substr(md5('it''s“so”'), 1, 16)), ('a　b', substr(md5('ab'), 1, 16))) SELECT * FROM l""")
def x6(spark, d):
    """Quoted and bracketed texts; the expected values are hashes of the bare words."""
    return literals(spark, ['用户说："我喜欢川菜"', "（A）[b]【c】 d", "it's “so”", "a　b"]).select("q", text.fingerprint(F.col("q")).alias("fingerprint"))


_QUICK = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN [{{'pos': {n}, 'type': '{k}', 'content': trim(regexp_extract(q, '(?i){p}', 0))}}] ELSE [] END" for n, (k, p) in enumerate(text.QUICK_RULES)) + "])"


@query("x7_u7_quick_extract", f"""WITH {said_sql(FACTS)}, f AS (SELECT q, unnest({_QUICK}) AS x FROM l WHERE length(q) >= 2), g AS (SELECT q, x.pos AS pos, x.type AS type, x.content AS content,
CASE WHEN regexp_matches(x.content, '(?i)deadline|截止') THEN 0.95 WHEN regexp_matches(x.content, '(?i)decided|决定') THEN 0.9 WHEN regexp_matches(x.content, '(?i)prefer|喜欢') THEN 0.8 ELSE 0.5 END::DOUBLE AS importance FROM f WHERE x.content <> '' AND q <> 'hello'),
h AS (SELECT *, substr(md5(regexp_replace(lower(content), '[ ，。、！？；：（）]', '', 'g')), 1, 16) AS fingerprint FROM g)
SELECT q, type, content, importance, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY q, pos) AS n FROM h) WHERE n = 1""")
def x7_quick(spark, d):
    """Facts of quick rules; of equal ones the first by text and rule stays."""
    rows = said(spark, d, FACTS).select("q", F.posexplode(text.quick_extract(F.col("q"))).alias("pos", "x")).select("q", "pos", "x.*")
    rows = rows.withColumn("fingerprint", text.fingerprint(F.col("content")))
    return windows.newest(rows, ["fingerprint"], [F.col("q"), F.col("pos")]).select("q", "type", "content", "importance", "fingerprint")


_COUNT = lambda ws: " + ".join(f"contains(q, '{w}')::INT" for w in ws)
_SC = {k: f"(({_COUNT(w)}) * {2 if k in ('habit', 'skill', 'goal', 'health', 'work') else 1})" for k, w in text.INTENT_WORDS.items()}
_BEST = f"greatest({', '.join(_SC.values())})"


@query("x13_x14_intent", f"""WITH {said_sql(Q)}, i AS (SELECT q, CASE WHEN regexp_matches(q, '{_re((*text.NEGATION_PATTERNS, *text.NEGATION))}') THEN 'negation' WHEN regexp_matches(q, '{_re(text.MULTIHOP)}') THEN 'multihop'
 WHEN regexp_matches(q, '{_re(text.LESSON)}') THEN 'lesson' WHEN regexp_matches(q, '{_re(text.TEMPORAL)}') THEN 'temporal' WHEN regexp_matches(lower(q), '{_re(tuple(text.PINYIN))}') THEN 'fuzzy' WHEN regexp_matches(q, '{_re(text.DECISION)}') THEN 'decision'
 {' '.join(f"WHEN {_BEST} > 0 AND {_SC[k]} = {_BEST} THEN '{k}'" for k in ('habit', 'skill', 'goal', 'health', 'work', 'fact'))} ELSE 'fact' END AS intent FROM l)
SELECT q, intent, CASE WHEN intent = 'negation' THEN 0.9 WHEN intent IN ('multihop','lesson','temporal') THEN 0.85 WHEN intent IN ('fuzzy','decision') THEN 0.8 WHEN {_BEST} > 0 AND {_BEST} IN ({', '.join(_SC[k] for k in ('habit', 'skill', 'goal', 'health', 'work', 'fact'))}) THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM i""")
def x13(spark, d):
    name = text.intent(F.col("q"))
    return said(spark, d, Q).select("q", name.alias("intent")).withColumn("confidence", text.intent_confidence(F.col("q"), F.col("intent")))


REWRITES = {
    "hangzhou 天气": ["hangzhou 天气", "杭州 天气"], "用户不喜欢吃什么": ["用户不喜欢吃什么", "用户喜欢吃什么", "用户喜欢吃什么", "用户不喜欢吃什么", "用户喜欢吃什么"],
    "学到什么教训": ["学到什么教训", "学到什么错误", "学到什么失败", "学到什么问题", "学到什么反思"], "咖啡": ["咖啡"], "BEIJING to Xian": ["BEIJING to Xian", "北京 to xian", "beijing to 西安"],
    "他不擅长什么": ["他不擅长什么", "他不会什么", "他不能什么", "他不精什么", "他不熟悉什么", "他难以什么", "他困难什么", "他擅长什么", "他什么"],
}


@query("x14_expand", "SELECT * FROM (VALUES " + ", ".join(f"('{q}', {found})" for q, found in REWRITES.items()) + ") AS t(q, queries)")
def x14(spark, d):
    """The queries that a query is searched as; the expected lists are written by hand."""
    return literals(spark, list(REWRITES)).select("q", text.expand(F.col("q")).alias("queries"))


MOMENTS = [("用户最近在做什么", "最近在学习"), ("用户最近在做什么", "以前在学习"), ("用户最近在做什么", "在学习"), ("以前住哪", "以前住杭州"), ("以前住哪", "现在住上海"), ("最近和以前", "过去的事"), ("最近和以前", "今天的事"), ("天气", "今天下雨")]


@query("m14_temporal_match", "SELECT * FROM (VALUES ('用户最近在做什么', '最近在学习', 1.0::DOUBLE), ('用户最近在做什么', '在学习', 0.5), ('以前住哪', '以前住杭州', 1.0), ('最近和以前', '今天的事', 0.9)) AS t(q, content, score)")
def m14_match(spark, d):
    """Time words of a query against those of a text; scores up to .3 are left out."""
    rows = spark.createDataFrame(MOMENTS, "q string, content string")
    return rows.select("q", "content", text.temporal_match(F.col("q"), F.col("content")).alias("score")).where("score IS NOT NULL")


LINKS = ["张三是的工程师", "我是我", "使用Spark和使用R", "他在字节跳动工作", "A是B", "项目是Memory"]


@query("x12_linked_entities", "SELECT * FROM (VALUES ('张三是的工程师', '张三', 'is_a', '工程师', 'concept'), ('使用Spark和使用R', NULL, NULL, 'Spark和使用R', 'tool'), ('他在字节跳动工作', NULL, NULL, '字节跳动', 'company'), ('项目是Memory', '项目', 'is_a', 'Memory', 'concept')) AS t(q, subject, relation, entity, type)")
def x12(spark, d):
    """The rules that link a memory's entities; the expected rows are written by hand."""
    return literals(spark, LINKS).select("q", F.explode(text.linked_entities(F.col("q"))).alias("x")).select("q", "x.*")


AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400000000.0"
_S = f"CASE WHEN {AGE} < 0 THEN 1.0 ELSE exp(-pow({AGE} / 30, 0.5)) END"
_B = f"CASE WHEN {AGE} <= 0 THEN importance ELSE greatest(importance * exp(-pow({AGE} / (CASE WHEN importance >= 0.9 THEN 60.0 WHEN importance >= 0.7 THEN 45.0 ELSE 30.0 END), 1.5)), importance * 0.3) END"


@query("m4_m9_decay", f"""WITH {MEM}, x AS (SELECT id, importance, access_count, {AGE} AS age, {_S} AS s, {_B} AS b FROM mem)
SELECT id, round(s, 6) AS survival, round(b, 6) AS protected, b < 0.2 AS forget, round(least(1.0, b * (1 + 0.1 * access_count)), 6) AS with_boost, round(least(1.0, importance * s + 0.1), 6) AS on_access,
round(greatest(0.0, least(1.0, 0.5 * least(age / 90, 1.0) + 0.5 * greatest(0.0, 1 - access_count / 20.0) - 0.2 * importance)), 6) AS forgetting,
round((CASE WHEN age < 7 THEN 1.2 WHEN age > 30 AND importance * s < 0.6 THEN 0.8 WHEN age > 90 THEN 0.5 ELSE 1.0 END) * (CASE WHEN access_count > 10 THEN 1.1 WHEN access_count > 5 THEN 1.05 ELSE 1.0 END), 4)::DOUBLE AS multiplier FROM x""")
def m4(spark, d):
    m = memories(spark, d).withColumn("age", scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("last_accessed").cast("timestamp")))
    m = m.withColumns({"s": scoring.survival(F.col("age")), "b": scoring.protected_decay(F.col("importance"), F.col("age"))})
    acc, imp = F.col("access_count"), F.col("importance")
    return m.select(
        "id", F.round("s", 6).alias("survival"), F.round("b", 6).alias("protected"), (F.col("b") < 0.2).alias("forget"), F.round(scoring.boosted(F.col("b"), acc), 6).alias("with_boost"),
        F.round(F.least(F.lit(1.0), imp * F.col("s") + 0.1), 6).alias("on_access"), F.round(scoring.forgetting_score(F.col("age"), acc, imp), 6).alias("forgetting"),
        F.round(scoring.decay_multiplier(F.col("age"), imp * F.col("s"), acc), 4).alias("multiplier"),
    )


@query("m10_decay_curve", "SELECT t::INT AS day, round(exp(-pow(t / 30.0, 0.5)), 6) AS a, round(greatest(0.5 * exp(-pow(t / 30.0, 1.5)), 0.15), 6) AS b FROM range(0, 91) r(t)")
def m10(spark, d):
    t = F.col("id").cast("double")
    return spark.range(0, 91).select(F.col("id").cast("int").alias("day"), F.round(F.exp(-F.pow(t / 30, F.lit(0.5))), 6).alias("a"), F.round(F.greatest(0.5 * F.exp(-F.pow(t / 30, F.lit(1.5))), F.lit(0.15)), 6).alias("b"))


@query("m14_m17_formulas", """WITH {0} SELECT id, round(60 / (5 * importance + 0.5), 6) AS effective_k, abs(length(content) - access_count * 100)::DOUBLE / greatest(length(content), access_count * 100, 1) >= 0.30 AS new_node,
CASE WHEN age <= 1 THEN 1.0 WHEN age <= 7 THEN 0.9 WHEN age <= 30 THEN 0.5 WHEN age <= 90 THEN 0.3 ELSE 0.1 END::DOUBLE AS temporal FROM (SELECT *, {1} AS age FROM mem)""".format(MEM, AGE))
def m14(spark, d):
    m = memories(spark, d).withColumn("age", scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("last_accessed").cast("timestamp")))
    n = F.length("content")
    near = F.when(F.col("age") <= 1, 1.0).when(F.col("age") <= 7, 0.9).when(F.col("age") <= 30, 0.5).when(F.col("age") <= 90, 0.3).otherwise(0.1)
    return m.select("id", F.round(scoring.effective_k(F.col("importance")), 6).alias("effective_k"), (F.abs(n - F.col("access_count") * 100) / F.greatest(n, F.col("access_count") * 100, F.lit(1)) >= 0.3).alias("new_node"), near.alias("temporal"))
