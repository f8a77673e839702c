"""Search: channels, fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import scoring, text
from mnemosaic.operators import search

from .registry import query
from .views import MEM, NAME_GRAPH, NOW, memories, name_graph, table


def _queries(spark, d):  # noqa: ANN001, ANN202
    """Every benchmark item, with its whole text as the query."""
    return table(spark, d, "benchmark").selectExpr("item_id AS qid", "text AS q")


QRY = "qry AS (SELECT item_id AS qid, text AS q FROM benchmark)"
BM25 = f"""{MEM}, {QRY}, tok AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM mem), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok), h AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM qry),
b AS (SELECT qid, id, sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN df USING (term) JOIN qt USING (term), st GROUP BY qid, id HAVING score > 0)"""


@query("a9_corpus_stats", f"WITH {MEM}, t AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM mem), st AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM t), p AS (SELECT DISTINCT id, unnest(t) AS term FROM t), c AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT term, df, n, avgdl FROM c, st")
def a9(spark, d):
    """df of every term, with the number of documents and their mean length beside it."""
    return search.corpus_stats(memories(spark, d))


_RANKED = "SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (SELECT qid, id, round(score, 4) AS score FROM b)"


def _bm25_top(spark, d, k: int = 30, variant: str = "module"):  # noqa: ANN001, ANN202
    return search.bm25_top(memories(spark, d), _queries(spark, d), k, variant=variant)


@query("a10_bm25", f"WITH {BM25}, r AS ({_RANKED}) SELECT qid, id, rank, score FROM r WHERE rank <= 30")
def a10(spark, d):
    """The best 30 of each query, which is what the channel gives."""
    return _bm25_top(spark, d).select("qid", "id", "rank", "score")


CORE = f"""{MEM}, {QRY}, tok AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS t FROM mem), st AS (SELECT count(*) AS n, avg(len(list_distinct(t))) AS avgdl FROM tok),
p AS (SELECT id, len(list_distinct(t)) AS dl, unnest(t) AS term FROM tok), h AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS term FROM qry),
b AS (SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN df USING (term) JOIN qt USING (term), st GROUP BY qid, id HAVING score > 0)"""


@query("a10_bm25_core", f"WITH {CORE}, r AS ({_RANKED}) SELECT qid, id, rank, score FROM r WHERE rank <= 30")
def a10_core(spark, d):
    """The variant whose document length is the number of different tokens."""
    return _bm25_top(spark, d, variant="core").select("qid", "id", "rank", "score")


_COS = "list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0)"
VEC = f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a FROM embeddings), vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 20 = 0), vs AS (SELECT qid, id, coalesce({_COS}, 0.0) AS score FROM e, vq)"


@query("k1_m1_vector_topk", f"WITH {VEC} SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank FROM vs) WHERE rank <= 10")
def k1(spark, d):
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector")
    return search.vector_top(e, e.where("id % 20 = 0").selectExpr("id AS qid", "vector AS v"), 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("k1_l2_distance", f"WITH {VEC}, l AS (SELECT e.id, qid, list_sum([(x - y) * (x - y) for x, y in list_zip(a, b)]) AS d2 FROM e, vq) SELECT qid, id, rank, round(1 - d2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(1 - d2, 9) DESC, id)::INT AS rank FROM l) WHERE rank <= 10".replace("[(x - y) * (x - y) for x, y in list_zip(a, b)]", "list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"))
def k1_l2(spark, d):
    """By distance, with the score 1 - distance, which has no lower bound."""
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector")
    return search.vector_top(e, e.where("id % 20 = 0").selectExpr("id AS qid", "vector AS v"), 10, metric="l2").select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _channels(spark, d, k: int = 30):  # noqa: ANN001, ANN202
    """Channels of the queries as (qid, id, score, rank): vector, text, importance, graph and time words. A memory's vector, and a query's, is the embedding of the same id."""
    m, q = search.spread(memories(spark, d)), _queries(spark, d)
    best = m.orderBy(F.desc("importance"), "id").limit(k).select("id", F.col("importance").alias("score"))
    vectors = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector")
    asked = q.select("qid").join(vectors.select(F.col("id").alias("qid"), F.col("vector").alias("v")), "qid")
    near = search.stored(search.vector_top(vectors.join(memories(spark, d).select("id"), "id", "left_semi"), asked, k, metric="l2"))
    words = search.stored(_bm25_top(spark, d, k))
    edges = name_graph(spark, d)
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    graph = search.graph_channel(q, edges, search.mentions(m, names).select("name", "id"), k)
    # Time words decide among what the query finds anyway.
    met = near.select("qid", "id").unionByName(words.select("qid", "id")).distinct().join(q.where(text.temporal_match(F.col("q"), F.lit("")).isNotNull()), "qid")
    timed = met.join(memories(spark, d).select("id", "content"), "id").select("qid", "id", text.temporal_match(F.col("q"), F.col("content")).alias("score")).where("score IS NOT NULL")
    return {"vector": near, "bm25": words, "importance": search.top(best.join(q.select("qid"), F.lit(True)), k), "kg": graph, "temporal": search.top(timed, k)}


_TOP = lambda src, name: f"SELECT qid, id, score, '{name}' AS channel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {src}"
_VALID = "length(content) >= 5 AND NOT (length(trim(lower(content))) < 30 AND regexp_matches(lower(content), 'high importance|importance上限|测试重要性|test|测试|placeholder|todo|tmp'))"
_TIMES = {"recent": "最近|近期|现在|目前|这周|这月|今天|昨天|当前|进行中|正在", "past": "以前|过去|之前|曾经|早些|当年|那时"}
_IS = lambda col, kind: f"regexp_matches(lower({col}), '{_TIMES[kind]}')"
TIMED = f"""CASE WHEN {_IS('q', 'recent')} AND {_IS('q', 'past')} THEN CASE WHEN {_IS('content', 'recent')} THEN 0.9 WHEN {_IS('content', 'past')} THEN 0.3 ELSE 0.5 END
WHEN {_IS('q', 'recent')} THEN CASE WHEN {_IS('content', 'recent')} THEN 1.0 WHEN {_IS('content', 'past')} THEN 0.1 ELSE 0.5 END WHEN {_IS('q', 'past')} THEN CASE WHEN {_IS('content', 'past')} THEN 1.0 WHEN {_IS('content', 'recent')} THEN 0.1 ELSE 0.5 END END"""
GRAPH = f"""{NAME_GRAPH}, gb AS (SELECT src, dst FROM ge UNION SELECT dst, src FROM ge), gn AS (SELECT DISTINCT src AS name FROM gb), gm AS (SELECT name, id FROM gn JOIN mem ON contains(lower(content), name)),
go AS (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY name) AS n FROM (SELECT DISTINCT qid, name FROM gn JOIN qry ON contains(lower(q), name))), gs AS (SELECT src, (1 + 2 * count(*))::DOUBLE AS size FROM gb GROUP BY src),
gr AS (SELECT qid, name, size * 0.1::DOUBLE AS score FROM go JOIN gs ON gs.src = name WHERE n <= 5 UNION ALL SELECT qid, gb.dst, size * 0.1::DOUBLE / 1.5 FROM go JOIN gs ON gs.src = name JOIN gb ON gb.src = name WHERE n <= 5),
kc AS (SELECT qid, id, round(max(score), 6) AS score FROM gr JOIN gm USING (name) GROUP BY qid, id)"""
CHANNELS = f"""WITH {BM25}, {GRAPH}, im AS (SELECT qid, id, importance AS score FROM (SELECT id, importance FROM mem ORDER BY importance DESC, id LIMIT 30), qry),
ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a FROM embeddings), qv AS (SELECT qid, a AS b FROM qry JOIN ev ON qid = ev.id),
vc AS (SELECT qid, ev.id, round(1 - list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS score FROM ev, qv WHERE ev.id IN (SELECT id FROM mem)),
r4 AS (SELECT * FROM ({_TOP('vc', 'vector')} UNION ALL {_TOP('(SELECT qid, id, round(score, 4) AS score FROM b)', 'bm25')} UNION ALL {_TOP('im', 'importance')} UNION ALL {_TOP('kc', 'kg')}) WHERE rank <= 30),
tc AS (SELECT qid, id, {TIMED} AS score FROM (SELECT DISTINCT qid, id FROM r4 WHERE channel IN ('vector', 'bm25')) JOIN mem USING (id) JOIN qry USING (qid)),
r AS (SELECT * FROM r4 UNION ALL SELECT * FROM ({_TOP('(SELECT * FROM tc WHERE score > 0.3)', 'temporal')}) WHERE rank <= 30)"""
RRF = f"""{CHANNELS}, f AS (SELECT qid, id, round(sum(0.25 / (60 + rank)), 6)::DOUBLE AS rrf, list_sort(list(channel)) AS channels, max(CASE WHEN channel = 'vector' THEN score END) AS near FROM r GROUP BY qid, id),
g AS (SELECT f.*, {_VALID} AS valid FROM f JOIN mem USING (id)), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY valid DESC, rrf DESC, id)::INT AS pos FROM g)"""


def _fused(spark, d, keep: int = 10):  # noqa: ANN001, ANN202
    """qid, id, pos, rrf, channels, distance of each query's best rows, valid ones first; the distance is .5 where the vector channel doesn't have the row."""
    ch = _channels(spark, d)
    fused = search.rrf(ch, dict.fromkeys(ch, 0.25))
    near = ch["vector"].select("qid", "id", (1 - F.col("score")).alias("distance"))
    valid = memories(spark, d).select("id", text.is_valid(F.col("content")).alias("valid"))
    fused = fused.join(near, ["qid", "id"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.5))).join(valid, "id")
    return search.best_lists(fused, [F.desc("valid"), F.desc("rrf"), F.col("id")], keep)


@query("search_rrf", f"{RRF} SELECT qid, id, pos, rrf, channels FROM o WHERE pos <= 10")
def search_rrf(spark, d):
    """Five channels, reciprocal rank fusion, valid memories first: the flagship."""
    return _fused(spark, d).select("qid", "id", "pos", "rrf", "channels")


NAMES = ("vector", "bm25", "importance", "kg", "temporal")


@query("a34_channel_hits", f"{RRF} SELECT qid, {', '.join(f"count(*) FILTER (list_contains(channels, '{c}')) AS {c}" for c in NAMES)} FROM o WHERE pos <= 10 GROUP BY qid")
def a34(spark, d):
    return _fused(spark, d).groupBy("qid").agg(*(F.count_if(F.array_contains("channels", c)).alias(c) for c in NAMES))


@query("j2_merged_scores", f"{CHANNELS} SELECT qid, id, {', '.join(f"round(max(CASE WHEN channel = '{c}' THEN score END), 4)::DOUBLE AS {c}" for c in NAMES)}, count(*) AS n_channels FROM r GROUP BY qid, id")
def j2(spark, d):
    """Each channel's own score beside the row."""
    m = search.merged(_channels(spark, d))
    return m.select("qid", "id", *(F.round(c, 4).alias(c) for c in NAMES), "n_channels")


_FUSED_SCORE = "sum(score * w) / 61 / sum(w)"
_MULTIPLIER = f"(CASE WHEN age < 7 THEN 1.2 WHEN age > 30 AND importance * s < 0.6 THEN 0.8 WHEN age > 90 THEN 0.5 ELSE 1.0 END) * (CASE WHEN access_count > 10 THEN 1.1 WHEN access_count > 5 THEN 1.05 ELSE 1.0 END)"
_SHARE = r"coalesce(len(list_intersect(a, w))::DOUBLE / nullif(len(a), 0), 0)"
_WORDS = r"list_distinct([x for x in regexp_split_to_array(lower({0}), '[ \t\n\r]+') if x <> ''])"


@query("r22_parallel_search", f"""{CHANNELS}, fs AS (SELECT qid, id, round(sum(score * 0.25) / 61 / sum(0.25), 6)::DOUBLE AS fused, max(CASE WHEN channel = 'vector' THEN score END) AS near FROM r GROUP BY qid, id),
t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS n FROM fs) WHERE n <= 20),
ag AS (SELECT t1.qid, t1.id, near, content, q, importance, access_count, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400000000.0 AS age FROM t1 JOIN mem USING (id) JOIN qry USING (qid)),
rr AS (SELECT *, CASE WHEN age < 0 THEN 1.0 ELSE exp(-pow(age / 30, 0.5)) END AS s, {_WORDS.format('q')} AS a, {_WORDS.format('content')} AS w FROM ag),
sc AS (SELECT qid, id, round((0.5 * (1 - coalesce(1 - near, 0.5)) + 0.3 * {_SHARE} + 0.2 * CASE WHEN length(content) < 400 THEN 1 - abs(length(content) - 200) / 400.0 ELSE 0.5 END) * {_MULTIPLIER}, 6)::DOUBLE AS score FROM rr)
SELECT qid, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= 5""")
def r22(spark, d):
    """Scores fused over the channels; the best 20 of a query are reranked with their distance, decayed, and the best 5 stay."""
    ch = {name: search.stored(df.select("qid", "id", "score", "rank")) for name, df in _channels(spark, d).items()}
    fused = search.best_lists(search.score_fusion({n: df.select("qid", "id", "score") for n, df in ch.items()}, dict.fromkeys(ch, 0.25)), [F.desc("fused"), F.col("id")], 20)
    rows = fused.select("qid", "id").join(ch["vector"].select("qid", "id", (1 - F.col("score")).alias("distance")), ["qid", "id"], "left").join(memories(spark, d), "id").join(_queries(spark, d), "qid")
    age = scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("last_accessed").cast("timestamp"))
    score = scoring.fallback_rerank(F.coalesce("distance", F.lit(0.5)), F.col("q"), F.col("content")) * scoring.decay_multiplier(age, F.col("importance") * scoring.survival(age), F.col("access_count"))
    return search.top(rows.select("qid", "id", F.round(score, 6).alias("score")), 5).select("qid", "id", "rank", "score")


@query("m22_intent_search", None)
def m22(spark, d):
    """Fusion with the weights of each query's intent where it is sure of it; the SQL of the parts is that of x13_x14_intent and search_rrf."""
    q = _queries(spark, d).withColumn("intent", text.intent(F.col("q")))
    sure = text.intent_confidence(F.col("q"), F.col("intent")) > 0.75
    weights = F.when(sure, text.weights_of(F.col("intent"))).otherwise(F.array(*(F.lit(0.25) for _ in NAMES)))
    table_ = q.select("qid", F.map_from_arrays(F.array(*map(F.lit, NAMES)), weights).alias("weights"))
    return search.best_lists(search.rrf(_channels(spark, d), table_), [F.desc("rrf"), F.col("id")], 10).select("qid", "id", "pos", "rrf")


@query("a12_score_fusion", f"WITH {BM25}, t AS (SELECT * FROM ({_RANKED}) WHERE rank <= 30), u AS (SELECT qid, id, 0.6 * score AS s, 0.6 AS w FROM t UNION ALL SELECT qid, id, 0.4 * importance, 0.4 FROM t JOIN mem USING (id)) SELECT qid, id, round(sum(s) / 61 / sum(w), 6)::DOUBLE AS fused FROM u GROUP BY qid, id")
def a12(spark, d):
    words = _bm25_top(spark, d).select("qid", "id", "score")
    imp = words.select("qid", "id").join(memories(spark, d).select("id", F.col("importance").alias("score")), "id").select("qid", "id", "score")
    return search.score_fusion({"bm25": words, "importance": imp}, {"bm25": 0.6, "importance": 0.4})


_W = r"list_distinct([x for x in regexp_split_to_array(lower({0}), '[ \t\n\r]+') if x <> ''])"


LISTS = rf"""{RRF}, c AS (SELECT qid, id, pos, near, content, {_W.format('q')} AS a, {_W.format('content')} AS b FROM o JOIN mem USING (id) JOIN qry USING (qid) WHERE pos <= 10)"""
_JACCARD = "coalesce(len(list_intersect(x.b, y.b))::DOUBLE / nullif(len(list_distinct(list_concat(x.b, y.b))), 0), 0)"
PAIRS = f"{LISTS}, lp AS (SELECT x.qid, y.id, y.pos, {_JACCARD} AS s FROM c x JOIN c y ON x.qid = y.qid AND x.pos < y.pos)"


def _lists(spark, d, keep: int = 10):  # noqa: ANN001, ANN202
    """Each query's best fused results with their texts."""
    return _fused(spark, d, keep).select("qid", "id", "pos", "distance").join(memories(spark, d).select("id", "content"), "id").join(_queries(spark, d), "qid")


def _list_pairs(spark, d):  # noqa: ANN001, ANN202
    """Pairs within a result list (45 at most, as a list has ten rows): the later row and its similarity to the earlier one. A list is gathered once and paired in its row."""
    row = F.struct("pos", "id", scoring.words(F.col("content")).alias("w"))
    lists = _lists(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    each = lists.select("qid", "rows", F.explode("rows").alias("y"))
    pairs = each.select("qid", "y", F.explode(F.filter("rows", lambda x: x["pos"] < F.col("y.pos"))).alias("x"))
    return pairs.select("qid", "y.id", "y.pos", scoring.jaccard(F.col("x.w"), F.col("y.w")).alias("s"))


@query("m12_rerank", f"""{LISTS}
SELECT qid, id, round(0.5 * (1 - coalesce(1 - near, 0.5)) + 0.3 * coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 0) + 0.2 * CASE WHEN length(content) < 400 THEN 1 - abs(length(content) - 200) / 400.0 ELSE 0.5 END, 6)::DOUBLE AS score FROM c""")
def m12(spark, d):
    return _lists(spark, d).select("qid", "id", F.round(scoring.fallback_rerank(F.col("distance"), F.col("q"), F.col("content")), 6).alias("score"))


@query("j4_a26_diversity", f"{PAIRS} SELECT qid, count(*) AS pairs, round(avg(s), 6) AS mean, round(max(s), 6) AS high, round(min(s), 6) AS low, count(*) FILTER (s > 0.85) AS near, round(1 - avg(s), 6) AS diversity FROM lp GROUP BY qid")
def j4(spark, d):
    """The diversity of every query's result list."""
    p = _list_pairs(spark, d).groupBy("qid")
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("high"), F.round(F.min("s"), 6).alias("low"), F.count_if(F.col("s") > 0.85).alias("near"), F.round(1 - F.avg("s"), 6).alias("diversity"))


@query("k10_mmr", None)
def k10(spark, d):
    """Greedy choice of ten among each query's thirty best fused results, in the order of the list."""
    return search.mmr(_lists(spark, d, 30).select("qid", "q", "id", "content", "pos"), 10, order="pos")


_CATEGORY = "['profile', 'events', 'cases', 'patterns'][id % 4 + 1]"


@query("m20_dedup_decision", f"""WITH {MEM}, {VEC}, n AS (SELECT qid AS id, id AS match, round(score, 9) AS cosine, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS k FROM vs WHERE id <> qid AND id IN (SELECT id FROM mem)),
p AS (SELECT n.id, match, cosine, {_W.format('x.content')} AS a, {_W.format('y.content')} AS b FROM n JOIN mem x ON x.id = n.id JOIN mem y ON y.id = match WHERE k = 1),
j AS (SELECT *, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS o, {_CATEGORY} AS category FROM p)
SELECT id, match, round(cosine, 6) AS cosine, CASE WHEN cosine < 0.7 THEN 'CREATE' WHEN o > 0.9 THEN 'SKIP' WHEN o > 0.7 THEN 'MERGE' ELSE 'CREATE' END AS decision,
CASE WHEN cosine < 0.7 THEN 'CREATE' WHEN o > 0.8 THEN 'SKIP' WHEN category = 'profile' THEN 'MERGE' WHEN category IN ('events', 'cases') THEN 'CREATE' WHEN cosine >= 0.85 THEN 'MERGE' ELSE 'CREATE' END AS heuristic FROM j""")
def m20(spark, d):
    """New memories against the nearest stored one, by the rule and by the variant that looks at the category."""
    m = memories(spark, d).select("id", "content")
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector").join(m.select("id"), "id", "left_semi")
    near = search.vector_top(e, table(spark, d, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id AS qid", "cast(embedding AS array<double>) AS v"), 2).where("id <> qid")
    best = search.best_lists(near.select("qid", "id", F.col("score").alias("cosine")), [F.desc("cosine"), F.col("id")], 1)
    pairs = best.join(m.withColumnRenamed("content", "other"), "id").select(F.col("qid").alias("id"), F.col("id").alias("match"), "cosine", "other").join(m, "id")
    overlap = scoring.jaccard(scoring.words(F.col("content")), scoring.words(F.col("other")))
    category = F.element_at(F.array(*map(F.lit, ("profile", "events", "cases", "patterns"))), (F.col("id") % 4 + 1).cast("int"))
    return pairs.select("id", "match", F.round("cosine", 6).alias("cosine"), search.dedup_decision(F.col("cosine"), overlap).alias("decision"), search.dedup_heuristic(F.col("cosine"), overlap, category).alias("heuristic"))


@query("f7_search_filter", f"WITH {MEM} SELECT id, type, importance FROM mem WHERE type IN ('decision', 'lesson', 'task_state') AND scope = 'project' AND importance >= 0.3 ORDER BY importance DESC, id LIMIT 25")
def f7(spark, d):
    return memories(spark, d).where("type IN ('decision', 'lesson', 'task_state') AND scope = 'project' AND importance >= 0.3").orderBy(F.desc("importance"), "id").limit(25).select("id", "type", "importance")


@query("x19_recall_text", f"WITH {MEM} SELECT scope_id, string_agg('[' || type || '] ' || content, chr(10) ORDER BY id) AS recall FROM mem GROUP BY scope_id")
def x19(spark, d):
    """Every memory of a scope with its whole content."""
    line = F.struct("id", F.concat(F.lit("["), F.col("type"), F.lit("] "), "content").alias("x"))
    return memories(spark, d).groupBy("scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["x"]), "\n").alias("recall"))


@query("k6_decay_sort", f"WITH {MEM} SELECT id, round(importance * exp(-pow(greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400000000.0) / 30, 0.5)), 6) AS decayed FROM mem ORDER BY decayed DESC, id")
def k6(spark, d):
    """All memories by their decayed importance."""
    age = scoring.days_between(F.lit(NOW).cast("timestamp"), F.col("last_accessed").cast("timestamp"))
    return memories(spark, d).select("id", F.round(F.col("importance") * scoring.survival(age), 6).alias("decayed")).orderBy(F.desc("decayed"), "id")


@query("m11_cross_encoder_blend", f"{RRF}, c AS (SELECT * FROM o WHERE pos <= 10) SELECT qid, id, round(0.3 * (1 - coalesce(1 - near, 0.5)) + 0.7 * coalesce((rrf - min(rrf) OVER w) / nullif(max(rrf) OVER w - min(rrf) OVER w, 0), 0.5), 6)::DOUBLE AS score FROM c WINDOW w AS (PARTITION BY qid)")
def m11(spark, d):
    """A model's score, put between 0 and 1 within a result list, with the similarity; the fused score stands in for a model."""
    return _fused(spark, d).select("qid", "id", F.round(scoring.blended_rerank(F.col("distance"), F.col("rrf"), "qid"), 6).alias("score"))


@query("j11_entity_memories", f"WITH {MEM}, en AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS name FROM benchmark) SELECT name, count(*) AS memories, min(id) AS first_id FROM en JOIN mem ON contains(lower(content), name) GROUP BY name")
def j11(spark, d):
    """Every name of every item."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("name")).distinct()
    return search.mentions(memories(spark, d), names).groupBy("name").agg(F.count("*").alias("memories"), F.min("id").alias("first_id"))
