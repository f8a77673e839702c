"""Aggregates, reports and windows over memories, events and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemosaic.functions import scoring
from mnemosaic.operators import profiles, windows

from .registry import query
from .views import MEM, NOW, memories, table

_OLD = f"last_accessed < TIMESTAMP '{NOW}' - INTERVAL 30 DAY"


@query("a1_a2_stats", f"WITH {MEM} SELECT t.type, count(m.id) AS n, round(avg(importance), 6) AS avg_importance, count(*) FILTER (importance >= 0.8) AS high, count(*) FILTER (importance >= 0.5 AND importance < 0.8) AS medium, count(*) FILTER (importance < 0.5) AS low FROM (VALUES ('fact'),('preference'),('decision'),('lesson'),('entity'),('task_state')) t(type) LEFT JOIN mem m ON m.type = t.type GROUP BY t.type")
def a1(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("fact", "preference", "decision", "lesson", "entity", "task_state")], "type string")
    imp = F.col("importance")
    sums = memories(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(imp), 6).alias("avg_importance"), F.count_if(imp >= 0.8).alias("high"), F.count_if((imp >= 0.5) & (imp < 0.8)).alias("medium"), F.count_if(imp < 0.5).alias("low"))
    return kinds.join(sums, "type", "left").na.fill(0, ["n", "high", "medium", "low"])


@query("a3_a4_health", f"""WITH {MEM}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (importance >= 0.8) AS h, count(*) FILTER (importance >= 0.5 AND importance < 0.8) AS m, count(*) FILTER (importance >= 0.3 AND importance < 0.5) AS l,
count(*) FILTER (importance < 0.3) AS c, count(*) FILTER ({_OLD}) AS stale, count(*) FILTER (source = '') AS orphan FROM mem)
SELECT h AS high, m AS medium, l AS low, c AS critical, stale, orphan, round(greatest(0.0, least(100.0, 100 - 30 * stale / n - 20 * orphan / n - 25 * (l + c) / n)), 6) AS score, round((0.9 * h + 0.65 * m + 0.4 * l + 0.15 * c) / n, 6)::DOUBLE AS avg_bucketed FROM c""")
def a3(spark, d):
    imp = F.col("importance")
    c = memories(spark, d).agg(
        F.count("*").cast("double").alias("n"), F.count_if(imp >= 0.8).alias("high"), F.count_if((imp >= 0.5) & (imp < 0.8)).alias("medium"), F.count_if((imp >= 0.3) & (imp < 0.5)).alias("low"),
        F.count_if(imp < 0.3).alias("critical"), F.count_if(F.expr(_OLD)).alias("stale"), F.count_if(F.col("source") == "").alias("orphan"),
    )
    score = F.expr("greatest(0D, least(100D, 100 - 30 * stale / n - 20 * orphan / n - 25 * (low + critical) / n))")
    return c.select("high", "medium", "low", "critical", "stale", "orphan", F.round(score, 6).alias("score"), F.round(F.expr("(0.9D * high + 0.65D * medium + 0.4D * low + 0.15D * critical) / n"), 6).alias("avg_bucketed"))


@query("a5_a7_dashboard", f"""WITH {MEM}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER ({_OLD}) AS stale, count(*) FILTER (source = '') AS orphan, count(*) FILTER (importance < 0.5) AS low, count(*) FILTER (type = 'fact') AS fact, count(*) FILTER (type = 'preference') AS pref FROM mem),
t AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM mem GROUP BY type)),
s AS (SELECT round(100 - least(25, 5 * stale) - least(15, 3 * orphan) - CASE WHEN low / n > 0.3 THEN 10 ELSE 0 END - CASE WHEN top / n > 0.8 THEN 5 ELSE 0 END - CASE WHEN (fact > 0 AND pref = 0) OR (fact > 20 AND pref < 3) THEN 5 ELSE 0 END, 2)::DOUBLE AS score, stale > 0 AS refresh, orphan > 0 AS link, low / n > 0.3 AS raise FROM c, t)
SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS label, list_filter([CASE WHEN refresh THEN 'refresh stale' END, CASE WHEN link THEN 'link orphans' END, CASE WHEN raise THEN 'raise low' END], lambda x: x IS NOT NULL) AS advice FROM s""")
def a5(spark, d):
    m = memories(spark, d)
    by = m.groupBy("type").agg(F.count("*").alias("k"), F.count_if(F.expr(_OLD)).alias("stale"), F.count_if(F.col("source") == "").alias("orphan"), F.count_if(F.col("importance") < 0.5).alias("low"))
    c = by.agg(F.sum("k").cast("double").alias("n"), F.sum("stale").alias("stale"), F.sum("orphan").alias("orphan"), F.sum("low").alias("low"), F.max("k").alias("top"), F.coalesce(F.sum(F.when(F.col("type") == "fact", F.col("k"))), F.lit(0)).alias("fact"), F.coalesce(F.sum(F.when(F.col("type") == "preference", F.col("k"))), F.lit(0)).alias("pref"))
    score = F.expr("round(cast(100 - least(25, 5 * stale) - least(15, 3 * orphan) - if(low / n > 0.3, 10, 0) - if(top / n > 0.8, 5, 0) - if((fact > 0 and pref = 0) or (fact > 20 and pref < 3), 5, 0) as double), 2)")
    label = F.expr("case when score >= 90 then 'excellent' when score >= 75 then 'good' when score >= 50 then 'fair' when score >= 25 then 'poor' else 'critical' end")
    advice = F.expr("array_compact(array(if(stale > 0, 'refresh stale', null), if(orphan > 0, 'link orphans', null), if(low / n > 0.3, 'raise low', null)))")
    return c.withColumn("score", score).select("score", label.alias("label"), advice.alias("advice"))


@query("a6_a19_forgetting", f"""WITH {MEM}, x AS (SELECT access_count, CASE WHEN a <= 0 THEN importance ELSE greatest(importance * exp(-pow(a / (CASE WHEN importance >= 0.9 THEN 60.0 WHEN importance >= 0.7 THEN 45.0 ELSE 30.0 END), 1.5)), importance * 0.3) END AS b FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400000000.0 AS a FROM mem))
SELECT count(*) FILTER (b < 0.2) AS to_forget, round(count(*) FILTER (b < 0.2) / count(*)::DOUBLE, 6) AS ratio, round(avg(b), 6) AS avg_current, round(avg(access_count), 6) AS avg_access FROM x""")
def a6(spark, d):
    age = scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("last_accessed").cast("timestamp"))
    x = memories(spark, d).select("access_count", scoring.protected_decay(F.col("importance"), age).alias("b"))
    return x.agg(F.count_if(F.col("b") < 0.2).alias("to_forget"), F.round(F.count_if(F.col("b") < 0.2) / F.count("*"), 6).alias("ratio"), F.round(F.avg("b"), 6).alias("avg_current"), F.round(F.avg("access_count"), 6).alias("avg_access"))


_TIER = "CASE WHEN importance > 0.9 THEN 'HOT' WHEN importance > 0.7 THEN 'WARM' WHEN importance > 0.5 THEN 'COLD' ELSE 'ARCHIVED' END"


@query("a8_tier_rollup", f"WITH {MEM} SELECT coalesce(tier, 'total') AS tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM mem) GROUP BY ROLLUP (tier)")
def a8(spark, d):
    return memories(spark, d).select(scoring.tier(F.col("importance")).alias("tier")).rollup("tier").agg(F.count("*").alias("n")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "n")


@query("a16_a17_unify", f"""WITH {MEM}, h AS (SELECT *, sha256(lower(trim(content))) AS hash FROM mem)
SELECT hash, min(id) AS id, count(*) AS n, list_sort(list(DISTINCT source)) AS sources, round(100.0 * (count(*) - 1) / count(*), 6)::DOUBLE AS duplicate_rate FROM h GROUP BY hash""")
def a16(spark, d):
    h = memories(spark, d).withColumn("hash", F.sha2(F.lower(F.trim("content")), 256))
    return h.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), F.round(F.lit(100.0) * (F.count("*") - 1) / F.count("*"), 6).alias("duplicate_rate"))


@query("a18_ordered_dedup", f"WITH {MEM} SELECT type, scope_id, id, importance FROM (SELECT *, row_number() OVER (PARTITION BY type, scope_id ORDER BY importance DESC, id) AS n FROM mem) WHERE n = 1")
def a18(spark, d):
    return windows.newest(memories(spark, d), ["type", "scope_id"], [F.desc("importance"), F.col("id")]).select("type", "scope_id", "id", "importance")


@query("a20_a21_learner", """WITH r AS (SELECT user_id % 10 AS learner, (event_id % 8 + 1) AS rank, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click'),
s AS (SELECT learner, count(*) AS clicks, avg(rank) AS avg_rank, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 5) AS top5 FROM r WHERE n <= 100 GROUP BY learner),
w AS (SELECT *, greatest(0.05, 0.4 + CASE WHEN clicks < 10 OR avg_rank <= 2 THEN 0 WHEN avg_rank <= 5 THEN -0.03 ELSE 0.1 END) AS v, greatest(0.05, 0.2 + CASE WHEN clicks < 10 OR avg_rank <= 2 THEN 0 WHEN avg_rank <= 5 THEN 0.05 ELSE -0.05 END) AS b FROM s)
SELECT learner, clicks, round(avg_rank, 6) AS avg_rank, top1, top3, top5, round(v / (v + b + 0.4), 6)::DOUBLE AS vector_weight, round(b / (v + b + 0.4), 6)::DOUBLE AS bm25_weight FROM w""")
def a20(spark, d):
    clicks = table(spark, d, "events").where("event_type = 'click'").selectExpr("user_id % 10 AS learner", "event_id % 8 + 1 AS rank", "ts", "event_id")
    last = windows.newest(clicks, ["learner"], [F.desc("ts"), F.desc("event_id")], 100)
    s = last.groupBy("learner").agg(F.count("*").alias("clicks"), F.avg("rank").alias("avg_rank"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 3, 5)))
    s = s.selectExpr("*", "greatest(0.05D, 0.4D + case when clicks < 10 or avg_rank <= 2 then 0D when avg_rank <= 5 then -0.03D else 0.1D end) as v", "greatest(0.05D, 0.2D + case when clicks < 10 or avg_rank <= 2 then 0D when avg_rank <= 5 then 0.05D else -0.05D end) as b")
    return s.selectExpr("learner", "clicks", "round(avg_rank, 6) as avg_rank", "top1", "top3", "top5", "round(v / (v + b + 0.4D), 6) as vector_weight", "round(b / (v + b + 0.4D), 6) as bm25_weight")


_SCORES = "[(event_id % 100) / 100.0, (event_id % 37) / 37.0, (event_id % 11) / 11.0, (event_id % 5) / 5.0]::DOUBLE[]"


@query("a22_click_weights", f"""WITH RECURSIVE c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_SCORES} AS x FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, n, CASE WHEN list_sum(x) = 0 THEN NULL ELSE list_transform(x, lambda v: v / list_sum(x)) END AS x FROM c), f AS (SELECT user_id, 0::BIGINT AS n, [0.40, 0.25, 0.20, 0.15]::DOUBLE[] AS w FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT user_id, n, CASE WHEN x IS NULL THEN w ELSE list_transform(m, lambda v: v / list_sum(m)) END FROM (SELECT p.user_id, p.n, p.x, f.w, list_transform([1, 2, 3, 4], lambda i: greatest(0.05, least(0.8, f.w[i] + (p.x[i] - f.w[i]) * 0.1))::DOUBLE) AS m FROM f JOIN p ON p.user_id = f.user_id AND p.n = f.n + 1))
SELECT user_id, round(w[1], 6) AS vector, round(w[2], 6) AS bm25, round(w[3], 6) AS importance, round(w[4], 6) AS kg FROM (SELECT user_id, arg_max(w, n) AS w FROM f GROUP BY user_id)""")
def a22(spark, d):
    """Weights of four channels after each user's clicks, in their order: a tenth towards each click's shares, clamped to [.05, .8], normalised."""
    scores = F.expr("array((event_id % 100) / 100D, (event_id % 37) / 37D, (event_id % 11) / 11D, (event_id % 5) / 5D)")
    clicks = table(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", "event_id", scores.alias("scores"))
    w = windows.click_weights(clicks, "user_id", "ts", "event_id", "scores")
    return w.select("user_id", *(F.round(F.col("weights")[n], 6).alias(c) for n, c in enumerate(("vector", "bm25", "importance", "kg"))))


@query("a23_w11_performance", "SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(count(*) FILTER (value < 100) / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY event_type")
def a23(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.count_if(v < 100) / F.count("*"), 6).alias("success_rate"))


@query("a17_unify_report", f"""WITH {MEM}, s AS (SELECT sha256(lower(trim(content))) AS hash, 'memory' AS origin FROM mem UNION ALL SELECT sha256(lower(trim(text))), 'session' FROM conversations UNION ALL SELECT sha256(lower(trim(html))), 'page' FROM pages),
h AS (SELECT hash, count(*) AS n, list(DISTINCT origin) AS origins FROM s GROUP BY hash), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS uniq FROM h) SELECT origin, count(*) AS unique_rows, any_value(total) AS total, any_value(uniq) AS unique_total, round((1 - any_value(uniq)::DOUBLE / any_value(total)) * 100, 4)::DOUBLE AS duplicate_rate FROM (SELECT unnest(origins) AS origin FROM h), t GROUP BY origin""")
def a17(spark, d):
    """All sources together: how many rows, how many are unique, and how many of those each source has."""
    norm = lambda df, c, name: df.select(F.sha2(F.lower(F.trim(c)), 256).alias("hash"), F.lit(name).alias("origin"))
    s = norm(memories(spark, d), "content", "memory").unionByName(norm(table(spark, d, "conversations"), "text", "session")).unionByName(norm(table(spark, d, "pages"), "html", "page"))
    h = s.groupBy("hash").agg(F.count("*").alias("n"), F.collect_set("origin").alias("origins"))
    t = h.agg(F.sum("n").alias("total"), F.count("*").alias("unique_total"))
    by = h.select(F.explode("origins").alias("origin")).groupBy("origin").agg(F.count("*").alias("unique_rows"))
    return by.crossJoin(F.broadcast(t)).withColumn("duplicate_rate", F.round((1 - F.col("unique_total") / F.col("total")) * 100, 4))


STATES = [(0, 0, 0, 0, 0, 0, 0.0), (100, 0, 0, 10, 20, 30, 0.05), (100, 5, 0, 40, 2, 30, 0.15), (100, 0, 7, 30, 2, 60, 0.3), (10, 0, 0, 3, 0, 0, 0.0)]


@query("a7_suggestions", "SELECT * FROM (VALUES (0, ['empty']), (1, ['healthy']), (2, ['stale', 'low', 'few_preferences', 'decaying']), (3, ['orphaned', 'few_preferences', 'mostly_facts', 'forgetting']), (4, ['healthy'])) AS t(n, advice)")
def a7(spark, d):
    """Six rules over the figures of a store; the expected rows are written by hand."""
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(STATES)], "n int, total int, stale int, orphaned int, low int, preferences int, facts int, forget_ratio double")
    return rows.select("n", profiles.suggestions().alias("advice"))


@query("a24_a25_totals", "SELECT user_id % 5 AS kind, count(*) AS n, sum(length(props)) AS bytes, max(ts) AS last_ts FROM events GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"), F.max("ts").alias("last_ts"))


SAID = [("u1", "fact", "用户喜欢川菜，也擅长编程"), ("u1", "fact", "用户住在杭州,在公司工作"), ("u1", "preference", "用户觉得咖啡比茶好"), ("u1", "preference", "喜欢红色"), ("u2", "fact", "懂一点法语"), ("u2", "task_state", "喜欢"), ("u2", "fact", "")]


@query("a28_x17_profile", """SELECT * FROM (VALUES ('u1', ['喜欢川菜，也擅长编程'], ['觉得咖啡比茶好'], ['擅长编程'], ['住在杭州,在公司工作', '在杭州,在公司工作'], ''), ('u2', [], [], ['懂一点法语'], [], NULL)) AS t(user_id, interests, preferences, skills, locations, work)""")
def a28(spark, d):
    """A profile out of memories: what follows the words of each category; the expected rows are written by hand."""
    rows = spark.createDataFrame(SAID, "user_id string, type string, content string")
    return profiles.profile(rows).select("user_id", "interests", "preferences", "skills", "locations", "work")


@query("a29_preference_timeline", "WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders) SELECT o_custkey, count(*) AS n, count(*) FILTER (until IS NULL OR until > TIMESTAMP '2001-01-01') AS n_current, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS timeline FROM v GROUP BY o_custkey")
def a29(spark, d):
    """Each key's versions, newest first, and how many still hold."""
    v = windows.version_chain(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")
    holds = F.col("valid_until").isNull() | (F.col("valid_until") > F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"))
    rows = v.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(holds).alias("n_current"), F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey"))).alias("x"))
    return rows.select("o_custkey", "n", "n_current", F.transform("x", lambda v: v["o_orderkey"]).alias("timeline"))


@query("a32_a33_review", "WITH s AS (SELECT lang, avg(quality) AS quality, 1 - avg(toxic) AS safety, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, round((quality + safety + 1.0) / 3, 6) AS score FROM s")
def a32(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), (1 - F.avg("toxic")).alias("s"), F.count("*").alias("n"))
    return s.select("lang", "n", F.round((F.col("q") + F.col("s") + 1.0) / 3, 6).alias("score"))


@query("w1_repeat_24h", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS repeats FROM events")
def w1(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return windows.repeats_before(e, "k", "ts").select("event_id", "repeats")


@query("w3_w4_last_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS last10, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS prior100 FROM events")
def w3(spark, d):
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(u.rowsBetween(-9, 0)), 4).alias("last10"), F.count("*").over(u.rowsBetween(-100, -1)).alias("prior100"))


@query("w11_running_stats", "SELECT event_id, count(*) OVER w AS running_n, min(value) OVER w AS running_min, max(value) OVER w AS running_max, round(avg(value) OVER w, 6) AS running_avg FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w11(spark, d):
    """Smallest, largest and mean duration of an operation up to each row."""
    rows = windows.running_stats(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "event_id", "value")
    return rows.select("event_id", "running_n", "running_min", "running_max", F.round("running_avg", 6).alias("running_avg"))


@query("w5_w8_newest", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def w5(spark, d):
    return windows.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "ts")


@query("w7_session_tail", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, substr(string_agg(substr(text, 1, 100), chr(10) ORDER BY turn), 1, 1000) AS tail FROM r WHERE n <= 6 GROUP BY conv_id")
def w7(spark, d):
    last = windows.newest(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 100).alias("x")))), lambda v: v["x"])
    return last.groupBy("conv_id").agg(F.substring(F.array_join(lines, "\n"), 1, 1000).alias("tail"))


@query("w10_minmax", "SELECT event_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS score FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def w10(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("event_id", "value", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"))
    return e.select("event_id", F.round(F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), 6).alias("score"))
