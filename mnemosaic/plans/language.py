"""Time expressions, entities, contradictions and profiles; their texts are literals, as the tables hold no Chinese."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import scoring, temporal, text
from mnemosaic.operators import windows

from .registry import query
from .rules import FACTS
from .views import EDGES, NOW, graph_edges, literal_sql, literals, said, said_sql

TIMES = ["昨天和张三在杭州开会", "大后天交报告，后天复习", "2024年3月5日发布了新版本", "2023年12月总结", "3月8日放假", "上周去了上海", "下个月搬家", "去年毕业", "今晚看电影", "下午三点", "周五提交", "刚才吃饭", "正月初一回家", "2月30日", "没有时间词", ""]


_EXPECTED = [
    ("昨天和张三在杭州开会", 0, "昨天", "day", "2024-01-31 00:00:00", "2024-01-31 23:59:59"), ("大后天交报告，后天复习", 0, "大后天", "day", "2024-02-04 00:00:00", "2024-02-04 23:59:59"), ("大后天交报告，后天复习", 7, "后天", "day", "2024-02-03 00:00:00", "2024-02-03 23:59:59"),
    ("2024年3月5日发布了新版本", 0, "2024年3月5日", "date", "2024-03-05 00:00:00", "2024-03-05 23:59:59"), ("2023年12月总结", 0, "2023年12月", "date", "2023-12-01 00:00:00", "2023-12-31 23:59:59"), ("3月8日放假", 0, "3月8日", "date", "2024-03-08 00:00:00", "2024-03-08 23:59:59"),
    ("上周去了上海", 0, "上周", "week", "2024-01-22 00:00:00", "2024-01-28 23:59:59"), ("下个月搬家", 0, "下个月", "month", "2024-03-01 00:00:00", "2024-03-31 23:59:59"), ("去年毕业", 0, "去年", "year", "2023-01-01 00:00:00", "2023-12-31 23:59:59"),
    ("今晚看电影", 0, "今晚", "part_of_day", "2024-02-01 18:00:00", "2024-02-01 23:59:59"), ("下午三点", 0, "下午", "part_of_day", "2024-02-01 13:00:00", "2024-02-01 18:00:00"), ("周五提交", 0, "周五", "weekday", "2024-02-02 00:00:00", "2024-02-02 23:59:59"),
    ("刚才吃饭", 0, "刚才", "moment", "2024-02-01 00:00:00", "2024-02-01 23:59:59"), ("正月初一回家", 0, "正月初一", "lunar", None, None), ("2月30日", 0, "2月30日", "date", None, None),
]


@query("x15_x16_time_expressions", "SELECT q, pos::INT AS pos, text, category, start::TIMESTAMP AS start, until::TIMESTAMP AS until FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in _EXPECTED) + ") AS t(q, pos, text, category, start, until)")
def x15(spark, d):
    found = literals(spark, TIMES).select("q", F.explode(temporal.time_expressions(F.col("q"), F.lit(NOW).cast("timestamp"))).alias("x"))
    return found.select("q", "x.pos", "x.text", "x.category", F.col("x.range.start").cast("timestamp_ntz").alias("start"), F.col("x.range.end").cast("timestamp_ntz").alias("until"))


_RULES = ", ".join(
    f"list_transform(list_zip(regexp_extract_all(q, '{p}', {o}), {f"regexp_extract_all(q, '{p}', {s})" if s else 'CAST([] AS VARCHAR[])'}), lambda x: {{'relation': '{r}', 'type': '{t}', 'subject': x[2], 'entity': x[1]}})"
    for r, t, p, s, o in text.GRAPH_RULES
)
_TECH = "[" + ", ".join(f"'{w}'" for w in text.TECH) + "]"


@query("x10_x12_graph_extract", f"""WITH {said_sql(FACTS)}, f AS (SELECT q, flatten([{_RULES}, list_transform(list_filter({_TECH}, lambda w: contains(lower(q), lower(w))), lambda w: {{'relation': 'mentioned', 'type': 'technology', 'subject': NULL::VARCHAR, 'entity': w}})]) AS found FROM l),
u AS (SELECT q, unnest(found) AS x, generate_subscripts(found, 1) AS n FROM f), w AS (SELECT q, x, row_number() OVER (PARTITION BY q, x.entity ORDER BY n) AS k FROM u)
SELECT q, x.relation AS relation, x.type AS type, x.subject AS subject, x.entity AS entity FROM w WHERE k = 1""")
def x10(spark, d):
    return said(spark, d, FACTS).select("q", F.explode(text.graph_entities(F.col("q"))).alias("x")).select("q", "x.*")


NAMES = ["字节跳动", "人民医院", "杭州市", "PostgreSQL", "postgresql 15", "川菜", "", "北京银行", "Spark"]


@query("x11_entity_types", f"""WITH {literal_sql(NAMES)} SELECT q, CASE WHEN regexp_matches(q, '{text.any_of((*text.COMPANY_WORDS, *text.COMPANIES))}') THEN 'company' WHEN regexp_matches(q, '{text.any_of(text.CITIES)}') THEN 'location'
WHEN len(list_filter({_TECH}, lambda w: contains(lower(q), lower(w)))) > 0 THEN 'technology' ELSE 'concept' END AS type FROM l""")
def x11(spark, d):
    return literals(spark, NAMES).select("q", text.entity_type(F.col("q")).alias("type"))


SAID = [(1, "用户喜欢川菜"), (2, "用户是工程师"), (3, "用户不喜欢川菜"), (4, "其实用户不是工程师"), (5, "用户讨厌下雨"), (6, "用户有一只猫"), (7, "用户没有猫"), (8, "用户从不喝酒")]
_SAID = "l AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{q}')" for n, q in SAID) + ") AS t(n, q))"


@query("j17_contradictions", f"""WITH {_SAID} SELECT n, coalesce({', '.join(f"(SELECT max(o.n) FROM l o WHERE o.n < l.n AND o.n >= l.n - 100 AND contains(l.q, '{no}') AND contains(o.q, '{yes}'))" for no, yes in text.CONTRADICTIONS)}) AS contradicts,
regexp_matches(q, '{text.any_of(text.CORRECTIONS)}') AS corrects FROM l""")
def j17(spark, d):
    rows = spark.createDataFrame([("s", *r) for r in SAID], "scope string, n int, q string")
    return windows.contradictions(rows, ["scope"], "n", "q").select("n", "contradicts", "corrects")


ABOUT = ["用户的名字叫李雷,住在杭州", "用户名字叫韩梅梅", "喜欢川菜", ""]


@query("r12_profile_update", f"WITH {literal_sql(ABOUT)} SELECT q, nullif(trim(regexp_extract(q, '名字叫([^,]*)', 1)), '') AS name, CASE WHEN contains(q, '喜欢') THEN [q] ELSE [] END AS preferences FROM l")
def r12(spark, d):
    name = F.nullif(F.trim(F.regexp_extract("q", "名字叫([^,]*)", 1)), F.lit(""))
    return literals(spark, ABOUT).select("q", name.alias("name"), F.when(F.col("q").contains("喜欢"), F.array("q")).otherwise(F.array().cast("array<string>")).alias("preferences"))


@query("m15_graph_scores", f"""WITH {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS node, count(*)::DOUBLE / (SELECT count(DISTINCT src) - 1 FROM u) AS centrality FROM u GROUP BY src)
SELECT dst AS node, round(centrality * 0.1 / 1.5, 9) AS score FROM u JOIN c ON u.dst = c.node WHERE src = 'n3'""")
def m15(spark, d):
    """Degree centrality of the neighbours of one entity, as the graph channel scores them at depth one."""
    both = graph_edges(spark, d).select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("links"))
    total = degree.agg((F.count("*") - 1).alias("others"))  # one row
    near = both.where("src = 'n3'").select(F.col("dst").alias("node"))
    return degree.join(near, "node").crossJoin(F.broadcast(total)).select("node", F.round(scoring.graph_score(F.col("links") / F.col("others"), F.lit(1)), 9).alias("score"))


@query("r15_cache_keys", "SELECT user_id, event_type, substr(sha256('{\"query\":\"' || event_type || '\",\"user\":' || user_id || '}'), 1, 16) AS key FROM (SELECT DISTINCT user_id, event_type FROM events)")
def r15(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct()
    return e.select("user_id", "event_type", text.cache_key(F.struct(F.col("event_type").alias("query"), F.col("user_id").alias("user"))).alias("key"))
