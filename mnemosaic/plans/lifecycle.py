"""Version records, the way a memory is stored, tiers, access state and session states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemosaic.functions import scoring, text
from mnemosaic.operators import history, search, windows
from mnemosaic.sources import io

from .registry import query
from .rules import _STRIP, DENOISE
from .views import MEM, NOW, memories, table

CHANGED = "TIMESTAMP '2024-01-25 00:00:00'"
_LEN = "length(content), length(new), 1"
VERSIONS = f"""c AS (SELECT id, type, content, importance, created_at FROM mem WHERE id % 2 = 0),
u AS (SELECT id, type, importance, content, CASE WHEN id % 4 = 0 THEN substr(content, 1, (length(content) // 2)::INT) ELSE substr(content, 1, (length(content) * 9 // 10)::INT) END AS new FROM mem WHERE id % 4 = 0 OR id % 6 = 0),
ur AS (SELECT *, abs(length(new) - length(content))::DOUBLE / greatest({_LEN}) AS ratio FROM u),
v AS (SELECT id::VARCHAR AS id, NULL::VARCHAR AS parent_id, type, content, importance, created_at, 'v1' AS version, substr(sha256(content), 1, 12) AS commit_hash, NULL::DOUBLE AS diff_ratio, 'CREATE' AS action, NULL::VARCHAR AS reason, 'MANUAL' AS trigger FROM c
UNION ALL SELECT CASE WHEN ratio >= 0.3 THEN id || '_v' || epoch({CHANGED})::BIGINT ELSE id::VARCHAR END, CASE WHEN ratio >= 0.3 THEN id::VARCHAR END, type, new, importance, {CHANGED}, 'v' || substr(sha256(new), 1, 4), substr(sha256(new), 1, 12), round(ratio, 4), CASE WHEN ratio >= 0.3 THEN 'CREATE_NEW_NODE' ELSE 'UPDATE' END, NULL, 'MANUAL' FROM ur
UNION ALL SELECT id::VARCHAR, NULL, NULL, NULL, NULL, TIMESTAMP '{NOW}', NULL, NULL, NULL, 'DELETED', 'expired', 'MANUAL' FROM mem WHERE id % 10 = 0)"""


def _versions(spark, d):  # noqa: ANN001, ANN202
    m, at = memories(spark, d), "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
    n = F.length("content")
    new = F.when(F.col("id") % 4 == 0, F.expr("substr(content, 1, cast(floor(length(content) / 2) AS int))")).otherwise(F.expr("substr(content, 1, cast(floor(length(content) * 9 / 10) AS int))"))
    changes = m.where("id % 4 = 0 OR id % 6 = 0").withColumns({"new": new, "at": F.expr(at), "n": n})
    gone = m.where("id % 10 = 0").withColumn("at", F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    return history.created(m.where("id % 2 = 0")).unionByName(history.updated(changes, "content", "new", "at")).unionByName(history.deleted(gone, "at", "expired"))


@query("r1_r3_version_records", f"WITH {MEM}, {VERSIONS} SELECT id, parent_id, type, md5(content) AS content, importance, created_at, version, commit_hash, diff_ratio, action, reason, trigger FROM v")
def r1(spark, d):
    """A row for each creation, update (a new node from a difference of .3 on) and deletion."""
    return _versions(spark, d).withColumn("content", F.md5("content"))


@query("r4_history", f"WITH {MEM}, {VERSIONS} SELECT id, action, created_at, version FROM v WHERE id = '60' OR parent_id = '60'")
def r4(spark, d):
    """One memory's versions, and the nodes that came of it."""
    v = _versions(spark, d)
    return history.history(v, "60").unionByName(v.where("parent_id = '60'")).select("id", "action", "created_at", "version")


@query("r4_recall_at", f"WITH {MEM}, {VERSIONS} SELECT id, md5(arg_max(content, (created_at, action))) AS content, max(created_at) AS created_at FROM v WHERE action <> 'DELETED' AND created_at <= TIMESTAMP '2024-01-26' GROUP BY id")
def r4_at(spark, d):
    at = F.expr("TIMESTAMP_NTZ '2024-01-26 00:00:00'")
    return history.recall_at(_versions(spark, d), at).select("id", F.md5("content").alias("content"), "created_at")


@query("r5_changelog", f"""WITH {MEM}, {VERSIONS} SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE action WHEN 'CREATE_NEW_NODE' THEN 'CREATE' WHEN 'DELETED' THEN 'DELETE' ELSE action END AS event_type, id AS memory_id, parent_id AS parent, printf('%.4f', diff_ratio) AS difference,
trim(regexp_replace(substr(content, 1, 80), '[\\n|]', ' ', 'g')) AS preview FROM v""")
def r5(spark, d):
    """The changelog written as Markdown and read again."""
    path = io.staging(spark, "changelog")
    history.changelog(_versions(spark, d)).select(F.to_json(F.struct("block")).alias("value")).write.text(path)
    back = spark.read.text(path).select(F.get_json_object("value", "$.block").alias("block"))
    cell = lambda k: F.element_at("fields", F.lit(k))
    return history.parsed_changelog(back).select("timestamp", "event_type", "memory_id", cell("Parent").alias("parent"), cell("Difference").alias("difference"), cell("Preview").alias("preview"))


@query("a33_version_stats", f"WITH {MEM}, {VERSIONS} SELECT count(*) AS versions, count(*) FILTER (action = 'DELETED') AS tombstones, count(DISTINCT id) AS memories FROM v")
def a33(spark, d):
    return _versions(spark, d).agg(F.count("*").alias("versions"), F.count_if(F.col("action") == "DELETED").alias("tombstones"), F.countDistinct("id").alias("memories"))


_CLEAN = r"regexp_replace(substr(content, 1, 50000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_SPLIT = r"list_distinct([x for x in regexp_split_to_array(lower({0}), '[ \t\n\r]+') if x <> ''])"
_COSINE = "list_dot_product(x.a, y.a) / nullif(sqrt(list_dot_product(x.a, x.a)) * sqrt(list_dot_product(y.a, y.a)), 0)"


@query("s5_store_chain", f"""WITH {MEM}, n AS (SELECT * REPLACE ({_CLEAN} AS content) FROM mem WHERE id % 10 = 3), old AS (SELECT * FROM mem WHERE id % 10 <> 3),
t AS (SELECT id, content, type, importance, created_at, {_STRIP.format('content')} AS t, 0 AS repeats FROM n), y AS (SELECT *, {DENOISE} AS reason FROM t),
rc AS (SELECT DISTINCT sha256(content) AS h FROM mem WHERE id % 30 = 3), k AS (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY created_at, id) AS copy FROM y),
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a FROM embeddings), near AS (SELECT x.id, y.id AS match, round(coalesce({_COSINE}, 0.0), 9) AS cosine FROM e x, e y WHERE x.id % 10 = 3 AND y.id IN (SELECT id FROM old)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, match) AS r FROM near) WHERE r = 1),
j AS (SELECT k.*, b.match, b.cosine, {_SPLIT.format('k.content')} AS wa, {_SPLIT.format('old.content')} AS wb FROM k LEFT JOIN best b ON b.id = k.id LEFT JOIN old ON old.id = b.match),
z AS (SELECT *, coalesce(len(list_intersect(wa, wb))::DOUBLE / nullif(len(list_distinct(list_concat(wa, wb))), 0), 0) AS o FROM j)
SELECT id, CASE WHEN reason IS NOT NULL THEN reason WHEN importance < 0.3 THEN 'discard' WHEN sha256(content) IN (SELECT h FROM rc) THEN 'recalled' WHEN copy > 1 THEN 'repeated' WHEN cosine >= 0.7 AND o > 0.9 THEN 'skip' WHEN cosine >= 0.7 AND o > 0.7 THEN 'merge' ELSE 'created' END AS outcome,
CASE WHEN importance > 0.5 THEN 'warm' WHEN importance >= 0.3 THEN 'cold' ELSE 'discard' END AS class, match FROM z""")
def s5_store(spark, d):
    """New memories on their way into the table: cleaned, judged, checked against what was recalled, told from their copies and from near ones."""
    m = memories(spark, d)
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector")
    recalled = m.where("id % 30 = 3").select(F.sha2("content", 256).alias("hash"))
    return search.admitted(m.where("id % 10 = 3"), m.where("id % 10 <> 3"), e, recalled).select("id", "outcome", "class", "match")


@query("s5_appended", None)
def s5_appended(spark, d):
    """The table after the chain: what was created is appended with its defaults, what was merged takes the new content."""
    m = memories(spark, d)
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector")
    recalled = m.where("id % 30 = 3").select(F.sha2("content", 256).alias("hash"))
    old = m.where("id % 10 <> 3")
    judged = search.stored(search.admitted(m.where("id % 10 = 3"), old, e, recalled))
    new = judged.where("outcome = 'created'").select("id", "type", "content", F.least(F.greatest("importance", F.lit(0.0)), F.lit(1.0)).alias("importance"), F.lit(1).alias("access_count"), F.col("importance").alias("decay_score"), F.lit(0.5).alias("decay_rate"))
    changes = judged.where("outcome = 'merge'").groupBy(F.col("match").alias("id")).agg(F.max_by("content", "id").alias("new"))
    kept = old.join(changes, "id", "left").select("id", "type", F.coalesce("new", "content").alias("content"), "importance", "access_count", F.col("importance").alias("decay_score"), F.lit(0.5).alias("decay_rate"))
    return kept.unionByName(new)


@query("f22_result_columns", f"WITH {MEM} SELECT id, type, content, importance, created_at, source FROM mem WHERE importance >= 0.8")
def f22(spark, d):
    """What a search gives out: no vector, no scope."""
    return search.result_columns(memories(spark, d).withColumn("vector", F.array(F.lit(0.0))).where("importance >= 0.8"))


@query("u5_sources", f"WITH {MEM} SELECT 'memory' AS origin, id::VARCHAR AS id, md5(content) AS hash FROM mem UNION ALL SELECT 'session', conv_id || '/' || turn, md5(text) FROM conversations UNION ALL SELECT 'page', page_id::VARCHAR, md5(html) FROM pages")
def u5(spark, d):
    """Three sources in one table; columns that a source lacks are null there."""
    m = memories(spark, d).select(F.lit("memory").alias("origin"), F.col("id").cast("string").alias("id"), "content", "importance")
    s = table(spark, d, "conversations").select(F.lit("session").alias("origin"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"))
    p = table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("content"))
    return m.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True).select("origin", "id", F.md5("content").alias("hash"))


_TIER = "CASE WHEN importance > 0.9 THEN 'HOT' WHEN importance > 0.7 THEN 'WARM' WHEN importance > 0.5 THEN 'COLD' ELSE 'ARCHIVED' END"
_NOW_IN = "CASE id % 4 WHEN 0 THEN 'HOT' WHEN 1 THEN 'WARM' WHEN 2 THEN 'COLD' ELSE 'ARCHIVED' END"


def _tiered(spark, d):  # noqa: ANN001, ANN202
    now = F.element_at(F.array(*map(F.lit, ("HOT", "WARM", "COLD", "ARCHIVED"))), (F.col("id") % 4 + 1).cast("int"))
    return memories(spark, d).select("id", "importance", now.alias("current"), scoring.tier(F.col("importance")).alias("tier"))


@query("f17_low_value", f"WITH {MEM} SELECT id, importance FROM (SELECT id, importance, {_NOW_IN} AS current FROM mem) WHERE importance < 0.3 AND current <> 'ARCHIVED' ORDER BY id LIMIT 50")
def f17(spark, d):
    """The next batch of fifty memories of low value that aren't archived yet."""
    return _tiered(spark, d).where("importance < 0.3 AND current <> 'ARCHIVED'").orderBy("id").limit(50).select("id", "importance")


RUNS = [("never", None, False), ("just now", "2024-01-31 23:30:00", False), ("an hour ago", "2024-01-31 23:00:00", False), ("forced", "2024-01-31 23:59:00", True)]


@query("f27_retier_due", "SELECT * FROM (VALUES ('never', true), ('just now', false), ('an hour ago', true), ('forced', true)) AS t(name, due)")
def f27(spark, d):
    rows = spark.createDataFrame(RUNS, "name string, last string, forced boolean")
    elapsed = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return rows.select("name", (F.col("forced") | F.col("last").isNull() | F.coalesce(elapsed >= 3600, F.lit(False))).alias("due"))


@query("r17_retier", f"WITH {MEM}, t AS (SELECT id, {_NOW_IN} AS current, {_TIER} AS tier, importance FROM mem) SELECT id, current, tier, CASE WHEN tier = 'ARCHIVED' THEN 'archived' WHEN current = 'ARCHIVED' THEN 'resurrected' ELSE 'moved' END AS change, CASE tier WHEN 'HOT' THEN importance > 0.9 WHEN 'WARM' THEN importance > 0.7 WHEN 'COLD' THEN importance > 0.5 ELSE true END AS fits FROM t WHERE current <> tier")
def r17(spark, d):
    """Memories that aren't in the tier they belong to, what their move is, and whether the tier's own check lets them in."""
    t = _tiered(spark, d).where("current <> tier")
    change = F.when(F.col("tier") == "ARCHIVED", "archived").when(F.col("current") == "ARCHIVED", "resurrected").otherwise("moved")
    fits = F.col("importance") > F.when(F.col("tier") == "HOT", 0.9).when(F.col("tier") == "WARM", 0.7).when(F.col("tier") == "COLD", 0.5).otherwise(-1.0)
    return t.select("id", "current", "tier", change.alias("change"), fits.alias("fits"))


@query("r18_get_tier", f"WITH {MEM} SELECT id, CASE WHEN id % 4 = 0 OR id % 5 = 0 THEN 'HOT' WHEN id % 4 = 1 THEN 'WARM' WHEN id % 4 = 2 THEN 'COLD' WHEN id % 7 <> 0 THEN 'ARCHIVED' END AS tier FROM mem")
def r18(spark, d):
    """The first tier that holds a memory, in the order of the tiers; null where none does."""
    m = memories(spark, d).select("id")
    held = {"HOT": "id % 4 = 0 OR id % 5 = 0", "WARM": "id % 4 = 1", "COLD": "id % 4 = 2", "ARCHIVED": "id % 4 = 3 AND id % 7 <> 0"}
    tiers = None
    for n, (name, rule) in enumerate(held.items()):
        rows = m.where(rule).select("id", F.struct(F.lit(n).alias("n"), F.lit(name).alias("name")).alias("t"))
        tiers = rows if tiers is None else tiers.unionByName(rows)
    return m.join(tiers.groupBy("id").agg(F.min("t").alias("t")), "id", "left").select("id", F.col("t.name").alias("tier"))


@query("r16_t9_promotions", """WITH s AS (SELECT conv_id, last(text ORDER BY turn) FILTER (role = 'assistant') AS decisions, last(text ORDER BY turn) FILTER (role = 'user') AS preferences, last(text ORDER BY turn) FILTER (role = 'system') AS facts, TIMESTAMP '2024-01-30 12:00:00' + to_hours(conv_id % 48) AS updated FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, unnest([{'type': 'decision', 'content': decisions, 'importance': 0.9::DOUBLE}, {'type': 'preference', 'content': preferences, 'importance': 0.8::DOUBLE}, {'type': 'fact', 'content': facts, 'importance': 0.7::DOUBLE}]) AS x FROM s WHERE updated <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 24 HOUR)
SELECT conv_id, x.type AS type, md5(x.content) AS content, x.importance AS importance FROM p WHERE x.content IS NOT NULL AND NOT contains(x.content, '[None]')""")
def r16(spark, d):
    """Session states older than a day: their decisions, preferences and facts become memories."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    s = table(spark, d, "conversations").groupBy("conv_id").agg(last("assistant").alias("decisions"), last("user").alias("preferences"), last("system").alias("facts"))
    s = s.withColumn("updated", F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' + make_dt_interval(0, cast(conv_id % 48 AS int))"))
    return search.promoted(s, F.expr(f"TIMESTAMP_NTZ '{NOW}'")).select("conv_id", "type", F.md5("content").alias("content"), "importance")


_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(used)) / 86400000000.0"


@query("t5_m5_access_state", f"""WITH {MEM}, a AS (SELECT event_id % 997 AS id, count(*) AS n, max(ts) AS used FROM events GROUP BY 1),
s AS (SELECT m.id, importance, n, CASE WHEN {_AGE} < 0 THEN 1.0 ELSE exp(-pow({_AGE} / 30, 0.5)) END AS s FROM mem m JOIN a ON a.id = m.id)
SELECT id, n AS accesses, round(least(1.0, importance * s + 0.1 * least(n, 10)), 6)::DOUBLE AS current FROM s""")
def t5(spark, d):
    """A memory's importance now, worked out from the log of accesses: what survived since the last one, and the boosts of the last ten."""
    log = table(spark, d, "events").select((F.col("event_id") % 997).alias("id"), "ts", "event_id")
    n, at = F.count("*").alias("accesses"), F.max("ts").alias("at")
    rows = memories(spark, d).select("id", "importance").join(log.groupBy("id").agg(n, at), "id")
    age = scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("at").cast("timestamp"))
    now = F.least(F.lit(1.0), F.col("importance") * scoring.survival(age) + F.least("accesses", F.lit(10)) * 0.1)
    return rows.select("id", "accesses", F.round(now, 6).alias("current"))


@query("r7_decay_registry", f"WITH {MEM}, s AS (SELECT id, importance AS current, last_accessed + INTERVAL 1 DAY AS next_check FROM mem WHERE id % 3 <> 0 UNION ALL SELECT id + 1000000000, 0.1, TIMESTAMP '2024-01-01' FROM mem WHERE id % 50 = 0) SELECT id, current, next_check <= TIMESTAMP '{NOW}' AND current < 0.2 AS cold FROM s WHERE id % 7 <> 0")
def r7(spark, d):
    """State of decay: memories registered, others removed, and those due for a check that are to go to cold storage."""
    m = memories(spark, d)
    state = m.where("id % 3 <> 0").selectExpr("id", "importance AS current", "last_accessed + INTERVAL 1 DAY AS next_check")
    new = m.where("id % 50 = 0").selectExpr("id + 1000000000 AS id", "0.1D AS current", "TIMESTAMP '2024-01-01 00:00:00' AS next_check")
    both = state.unionByName(new)
    gone = both.where("id % 7 = 0").select("id")
    return both.join(gone, "id", "left_anti").selectExpr("id", "current", f"next_check <= TIMESTAMP '{NOW}' AND current < 0.2 AS cold")


_B = "CASE WHEN age <= 0 THEN importance ELSE greatest(importance * exp(-pow(age / (CASE WHEN importance >= 0.9 THEN 60.0 WHEN importance >= 0.7 THEN 45.0 ELSE 30.0 END), 1.5)), importance * 0.3) END"


@query("r20_decay_info", f"WITH {MEM}, a AS (SELECT id, importance, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0 AS age FROM mem), b AS (SELECT *, {_B} AS current FROM a) SELECT id, importance AS original, round(current, 6)::DOUBLE AS current, round(age, 1) AS age_days, round(CASE WHEN importance > 0 THEN 1 - current / importance ELSE 0 END, 6)::DOUBLE AS rate, current < 0.2 AS should_forget FROM b")
def r20(spark, d):
    age = scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("created_at").cast("timestamp"))
    m = memories(spark, d).withColumns({"age": age, "current": scoring.protected_decay(F.col("importance"), age)})
    rate = F.when(F.col("importance") > 0, 1 - F.col("current") / F.nullif("importance", F.lit(0.0))).otherwise(0.0)
    return m.select("id", F.col("importance").alias("original"), F.round("current", 6).alias("current"), F.round("age", 1).alias("age_days"), F.round(rate, 6).alias("rate"), (F.col("current") < 0.2).alias("should_forget"))


@query("r14_pools", f"WITH {MEM}, r AS (SELECT event_id % 50 AS id, count(*) AS recalled FROM events WHERE event_type = 'click' GROUP BY 1), x AS (SELECT id, source FROM mem WHERE id < 200) SELECT x.id, coalesce(recalled, 0) AS recalled_count, recalled IS NULL AS admitted, recalled IS NOT NULL AND source = '' AS wrong FROM x LEFT JOIN r ON r.id = x.id")
def r14(spark, d):
    """The two pools: how often a memory was recalled, whether extraction takes it, and rows that carry the wrong mark."""
    r = table(spark, d, "events").where("event_type = 'click'").groupBy((F.col("event_id") % 50).alias("id")).agg(F.count("*").alias("recalled"))
    x = memories(spark, d).where("id < 200").select("id", "source").join(r, "id", "left")
    return x.select("id", F.coalesce("recalled", F.lit(0)).alias("recalled_count"), F.col("recalled").isNull().alias("admitted"), (F.col("recalled").isNotNull() & (F.col("source") == "")).alias("wrong"))
