"""Review scores and reports, feedback, explored weights, model seams, backups and the streaming hooks of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import scoring, seams, text
from mnemosaic.operators import review, search, windows
from mnemosaic.sources import io
from mnemosaic.streaming import jobs

from .registry import query
from .retrieval import _lists
from .views import MEM, memories, table

_PRONOUN = "regexp_matches(text, '他|她|它|这个|那个')"


@query("m21_review_scores", f"SELECT conv_id, turn, 1.0::DOUBLE AS entities, CASE WHEN {_PRONOUN} THEN 0.8 ELSE 1.0 END::DOUBLE AS references, (conv_id % 4 + 1)::INT AS hops, (CASE conv_id % 4 + 1 WHEN 1 THEN 0.85 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.55 END)::DOUBLE AS hop_score, conv_id % 4 + 1 IN (2, 3) AS passes FROM conversations".replace("references", "referents"))
def m21(spark, d):
    """Scores of a review: pronouns, and answers over several hops against their targets."""
    hops = (F.col("conv_id") % 4 + 1).cast("int")
    pronoun = F.col("text").rlike("他|她|它|这个|那个")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.lit(1.0).alias("entities"), F.when(pronoun, 0.8).otherwise(1.0).alias("referents"), hops.alias("hops"),
        F.round(scoring.hop_score(hops), 6).alias("hop_score"), (F.round(scoring.hop_score(hops), 6) >= scoring.hop_target(hops)).alias("passes"),
    )


@query("r19_review_report", """WITH s AS (SELECT lang AS name, 'quality' AS metric, round(avg(quality), 3) AS score, 0.8 AS target FROM labels JOIN documents USING (doc_id) GROUP BY lang UNION ALL SELECT lang, 'safety', round(1 - avg(toxic), 3), 0.85 FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT name, '# Review of ' || name || chr(10) || 'overall: ' || printf('%.3f', round(avg(score), 3)) || chr(10) || string_agg(CASE WHEN score >= target THEN 'PASS ' ELSE 'FAIL ' END || metric || ': ' || printf('%.3f', score) || ' (target ' || printf('%.3f', target) || ')', chr(10) ORDER BY metric) AS text FROM s GROUP BY name""")
def r19(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("name")), "doc_id").groupBy("name")
    both = rows.agg(F.round(F.avg("quality"), 3).alias("q"), F.round(1 - F.avg("toxic"), 3).alias("s"))
    cell = lambda metric, c, target: F.struct(F.lit(metric).alias("metric"), F.col(c).alias("score"), F.lit(target).alias("target"))
    return review.report(both.select("name", F.explode(F.array(cell("quality", "q", 0.8), cell("safety", "s", 0.85))).alias("x")).select("name", "x.*"))


@query("r8_feedback", "WITH s AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events), t AS (SELECT * FROM s WHERE rank <= 10), l AS (SELECT *, id % 5 = 0 AS clicked, max(CASE WHEN id % 5 = 0 THEN rank END) OVER (PARTITION BY qid) AS last FROM t) SELECT qid, id, rank AS position, CASE WHEN clicked THEN 'click' WHEN rank < last THEN 'skip' ELSE 'shown' END AS kind FROM l")
def r8(spark, d):
    """What was clicked at which position, and what was passed over; a reset starts from the default weights, with no rows."""
    e = table(spark, d, "events")
    shown = windows.newest(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), "value"), ["qid"], [F.desc("value"), F.col("id")], 10)
    rank = F.row_number().over(windows.Window.partitionBy("qid").orderBy(F.desc("value"), "id"))
    return review.feedback(shown.select("qid", "id", rank.alias("rank")), e.where("event_id % 5 = 0").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id")))


@query("r9_kept_clicks", "SELECT learner, count(*) AS kept, min(event_id) AS first_id FROM (SELECT user_id % 3 AS learner, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n <= 1000 GROUP BY learner")
def r9(spark, d):
    """A learner's clicks: the newest thousand are kept."""
    clicks = table(spark, d, "events").where("event_type = 'click'").selectExpr("user_id % 3 AS learner", "event_id", "ts")
    return windows.newest(clicks, ["learner"], [F.desc("ts"), F.desc("event_id")], 1000).groupBy("learner").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


@query("m18_explored_weights", None)
def m18(spark, d):
    """Weights that are moved at random for a tenth of the queries; a test holds share, bounds and sums."""
    start = F.array(*(F.lit(x) for x in (0.40, 0.25, 0.20, 0.15)))
    return table(spark, d, "events").select("event_id", scoring.explored(start).alias("weights"))


@query("m13_hash_embedding", f"WITH {MEM}, h AS (SELECT id, sha256(content) AS s FROM mem), v AS (SELECT id, list_transform(range(0, 32), lambda i: ('0x' || substr(s, (i * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE) AS v FROM h) SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last, 64 AS dims FROM v")
def m13(spark, d):
    """The stand-in vectors that texts have without an embedder."""
    v = memories(spark, d).select("id", seams.embedded(F.col("content")).alias("v"))
    return v.select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"), F.size("v").alias("dims"))


@query("r21_failover", None)
def r21(spark, d):
    """A provider that is down, one that takes its place, and the hash where both give nothing; a test holds the vectors."""
    def down(texts: list[str]) -> list[list[float] | None]:
        raise ConnectionError

    def second(texts: list[str]) -> list[list[float] | None]:
        return [[float(len(t))] if len(t) % 2 else None for t in texts]

    return memories(spark, d).select("id", F.length("content").alias("n"), seams.embedded(F.col("content"), down, second).alias("vector"))


@query("seam_rerank", None)
def seam_rerank(spark, d):
    """Result lists in the order of a model put in: here, the share of the query's letters."""
    def score(q: list[str], c: list[str]) -> list[float]:
        return [len(set(x) & set(y)) / max(1, len(set(x))) for x, y in zip(q, c)]

    rows = _lists(spark, d)
    return search.top(rows.select("qid", "id", F.round(seams.reranked(F.col("q"), F.col("content"), F.col("distance"), score), 6).alias("score")), 5)


ANSWERS = ["Sure: [{'type': 'fact', 'content': 'a'}] done".replace("'", '"'), "no list here", "[not json]", "", '[{"type": "goal", "content": "b"}, {"type": "x", "content": null}]']


@query("seam_answers", "SELECT * FROM (VALUES (0, ['fact:a']), (1, []), (2, []), (3, []), (4, ['goal:b', 'x:'])) AS t(n, found)")
def seam_answers(spark, d):
    """Lists out of a model's answers; what can't be read is an empty list. The expected rows are written by hand."""
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "n int, a string")
    found = seams.json_list(F.col("a"), "array<struct<type:string,content:string>>")
    return rows.select("n", F.transform(F.filter(found, lambda x: x["type"].isNotNull()), lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["content"], F.lit("")))).alias("found"))


@query("s12_backups", f"WITH {MEM} SELECT 'b' || (id % 3) AS name, count(*) AS n FROM mem WHERE id % 3 <> 1 GROUP BY 1")
def s12(spark, d):
    """Three backups made, one deleted, the others listed with their rows and one of them imported."""
    path = io.staging(spark, "backups")
    for n in range(3):
        io.backup(memories(spark, d).where(F.col("id") % 3 == n).select("id", "content", "type", "importance"), path, f"b{n}")
    io.delete_backup(spark, path, "b1")
    assert io.restore_backup(spark, path, "b0").count() >= 0
    return io.list_backups(spark, path).select("name", "n")


@query("s15_t10_scheduled_backup", f"WITH {MEM} SELECT id, importance FROM mem WHERE importance >= 0.5")
def s15(spark, d):
    """A stream that backs up what is there when it is triggered; a scheduler, or an interval, calls it."""
    src = jobs.source(spark, f"{d}/documents.parquet").selectExpr("doc_id AS id", "((doc_id * 37) % 101) / 100D AS importance").where("importance >= 0.5")
    return jobs.drained(src)


@query("t10_scheduled_tiers", f"WITH {MEM} SELECT CASE WHEN importance > 0.9 THEN 'HOT' WHEN importance > 0.7 THEN 'WARM' WHEN importance > 0.5 THEN 'COLD' ELSE 'ARCHIVED' END AS tier, count(*) AS n FROM mem GROUP BY 1")
def t10(spark, d):
    """The same for tiers: each batch writes its memories under the tier they belong to."""
    src = jobs.source(spark, f"{d}/documents.parquet").selectExpr("doc_id AS id", "((doc_id * 37) % 101) / 100D AS importance").withColumn("tier", scoring.tier(F.col("importance")))
    return jobs.tiered(src).groupBy("tier").agg(F.count("*").alias("n"))


@query("t8_session_extraction", None)
def t8(spark, d):
    """At a session's end, the facts of its last six messages by the user; a test holds them against a loop."""
    last = windows.newest(table(spark, d, "conversations").where("role IN ('user', 'human')"), ["conv_id"], [F.desc("turn")], 6)
    rows = last.where(~text.is_noise(F.col("text"))).select("conv_id", "turn", F.posexplode(text.quick_extract(F.col("text"))).alias("pos", "x")).select("conv_id", "turn", "pos", "x.*")
    rows = rows.withColumn("fingerprint", text.fingerprint(F.col("content")))
    return windows.newest(rows, ["conv_id", "fingerprint"], [F.col("turn"), F.col("pos")]).drop("pos")
