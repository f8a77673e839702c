"""Ranked retrieval: channels of (qid, id, score), fused by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosaic.functions import scoring, text
from mnemosaic.sources.io import staging


#: Tokenizers and document lengths: words and runs with every occurrence counted, or with distinct tokens as the length.
VARIANTS = {"module": (text.bm25_tokens, F.size, 0.0), "core": (text.core_tokens, lambda t: F.size(F.array_distinct(t)), None)}


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly where its files are fewer than the cores, as a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """term, id, tf, dl: counted on the map side before the shuffle by (id, term)."""
    tokens = docs.select(F.col(id_col).alias("id"), text.bm25_tokens(F.col(text_col)).alias("t"))
    return tokens.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """term, df, n, avgdl: how many documents hold each term, and the totals of all documents, those without terms included."""
    totals = docs.select(F.size(text.bm25_tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"))
    return postings(docs, id_col, text_col).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))


def _hits(docs: DataFrame, terms: DataFrame, variant: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, dl, term, tf of the terms asked for, and one row of totals (n, avgdl). Texts are split into words once; only those terms, and a row for each text, leave that pass.

    The terms are broadcast only through Spark's own size check, so a large query table joins by sort-merge.
    """
    tokens_of, length, _ = VARIANTS[variant]
    tokens = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"))).select("id", tokens_of(F.col("x")).alias("t"))
    # What stands beside an explode is computed for every row that it makes, so the length comes before it: once for each text.
    tokens = tokens.withColumn("dl", F.greatest(length(F.col("t")), F.lit(0)))
    rows = tokens.select("id", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("t", F.array().cast("array<string>")))).alias("term"))
    asked = terms.select(F.col("term").alias("asked")).distinct()
    rows = rows.join(asked, F.col("term") == F.col("asked"), "left").where("term IS NULL OR asked IS NOT NULL")
    hits = stored(rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    return hits.where("term IS NOT NULL"), hits.where("term IS NULL").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _weight(variant: str, k1: float, b: float) -> Column:
    """What a term adds to the score of a document that has it, from tf, dl, df, n and avgdl."""
    floor = VARIANTS[variant][2]
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    idf = idf if floor is None else F.greatest(F.lit(floor), idf)
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, id_col: str = "id", text_col: str = "content", variant: str = "module") -> DataFrame:
    """qid, id, score of every pair above 0, for queries (qid, q).

    A term in many documents meets its queries in pieces of the documents' ids, so no task holds all of it.
    """
    terms = queries.select("qid", F.explode(F.array_distinct(VARIANTS[variant][0](F.col("q")))).alias("term"))
    hits, stats = _hits(docs, terms, variant, id_col, text_col)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.crossJoin(F.broadcast(stats)).select("term", "df", "n", "avgdl", F.ceil(F.col("df") / PIECE).alias("pieces"))
    each = terms.join(weighed, "term").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    placed = hits.join(weighed.select("term", F.col("pieces").alias("of")), "term").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("of")))
    return placed.join(each, ["term", "piece"]).groupBy("qid", "id").agg(F.sum(_weight(variant, k1, b)).alias("score")).where("score > 0")


#: Queries that are scored at once: a bound for what travels with the tasks.
QUERIES_AT_ONCE = 512


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, id_col: str = "id", text_col: str = "content", variant: str = "module", digits: int = 4) -> DataFrame:
    """qid, id, score (rounded), rank: the k best documents of each query; ties by id.

    A task holds the terms' weights of its own documents, and multiplies them with a lot of queries at a time; only its k best of each
    query are shuffled, so no pair of a query and a document is ever a row.
    """
    terms = stored(queries.select("qid", F.explode(F.array_distinct(VARIANTS[variant][0](F.col("q")))).alias("term")))
    hits, stats = _hits(docs, terms, variant, id_col, text_col)
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    weights = stored(hits.join(df, "term").select("id", "term", _weight(variant, k1, b).alias("w")).repartition("id").sortWithinPartitions("id"))
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("qid", terms), ("id", weights))}
    names, after, found = terms.select("qid").distinct(), None, None
    while lot := (names if after is None else names.where(F.col("qid") > after)).orderBy("qid").limit(QUERIES_AT_ONCE).collect():
        first, after = lot[0].qid, lot[-1].qid
        asked = terms.where(F.col("qid").between(first, after)).collect()
        part = _best_products(weights, [(r.qid, r.term) for r in asked], k, digits, f"qid {kinds['qid']}, id {kinds['id']}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = weights.select(F.lit(None).cast(kinds["qid"]).alias("qid"), "id", F.col("w").alias("score")).limit(0)
    return top(found, k)


def _best_products(weights: DataFrame, asked: list[tuple], k: int, digits: int, schema: str) -> DataFrame:
    """The k best (qid, id, score) of each partition of weights (id, term, w), whose rows of a document stand together."""
    qids, vocabulary = sorted({q for q, _ in asked}), sorted({t for _, t in asked})
    column, place = {t: n for n, t in enumerate(vocabulary)}, {q: n for n, q in enumerate(qids)}
    shared = weights.sparkSession.sparkContext.broadcast((qids, vocabulary, [(column[t], place[q]) for q, t in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        qids, vocabulary, cells = shared.value
        wanted = np.zeros((len(vocabulary), len(qids)))
        wanted[tuple(np.array(cells).T)] = 1
        known = pa.array(vocabulary, pa.string())
        best_ids, best = np.zeros((0, len(qids)), object), np.zeros((0, len(qids)))
        last, part = None, np.zeros(len(qids))  # a document that may go on in the next batch

        def merge(ids: list, scores: np.ndarray) -> None:
            nonlocal best_ids, best
            scores = np.round(scores, digits)
            every_id, every = np.concatenate([best_ids, np.repeat(np.array(ids, object)[:, None], len(qids), 1)]), np.concatenate([best, scores])
            number = {x: n for n, x in enumerate(sorted(set(every_id.ravel().tolist())))}
            rank = np.array([number[x] for x in every_id.ravel().tolist()], np.int64).reshape(every.shape)
            order = np.lexsort((rank, -every), axis=0)[:k]
            best_ids, best = np.take_along_axis(every_id, order, 0), np.take_along_axis(every, order, 0)

        for batch in batches:
            col = pc.index_in(batch.column(1), known)
            keep = np.flatnonzero(pc.is_valid(col).to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            ids = batch.column(0).take(pa.array(keep)).to_pylist()
            col, w = col.take(pa.array(keep)).to_numpy(), batch.column(2).take(pa.array(keep)).to_numpy()
            change = np.concatenate([[0], 1 + np.flatnonzero([x != y for x, y in zip(ids[1:], ids[:-1])])]).astype(np.int64)
            own = [ids[i] for i in change.tolist()]
            m = np.zeros((len(own), len(vocabulary)))
            m[np.repeat(np.arange(len(own)), np.diff(change, append=len(ids))), col] = w
            scores = m @ wanted
            if last is not None:
                if own[0] == last:
                    scores[0] += part
                else:
                    merge([last], part[None, :])
            last, part = own[-1], scores[-1].copy()
            if len(own) > 1:
                merge(own[:-1], scores[:-1])
        if last is not None:
            merge([last], part[None, :])
        i, j = np.nonzero(best > 0)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in j.tolist()]), pa.array(best_ids[i, j].tolist()), pa.array(best[i, j])], names=["qid", "id", "score"])

    return weights.mapInArrow(run, schema)


#: Documents of a term that meet its queries in one piece.
PIECE = 100_000


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so what it costs is paid once."""
    path = staging(df.sparkSession, "postings")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """ids and vectors, some `size` of a partition in a row: nothing is moved. Null vectors are left out."""
    ids = vectors.schema[id_col].dataType.simpleString()

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(i).to_pylist()], t) for i, t in ((0, pa.list_(part.column(0).type)), (1, pa.list_(pa.list_(pa.float64()))))], names=["ids", "vs"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    return rows.mapInArrow(pack, f"ids array<{ids}>, vs array<array<double>>")


def _matrices(vs: list, unit: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows' places and the vectors, at unit length unless told otherwise (zero ones stay zero; a null component counts as 0)."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vs):
        places.setdefault(len(v), []).append(i)
    found = {}
    for n, at in places.items():
        m = np.nan_to_num(np.array([vs[i] for i in at], np.float64).reshape(len(at), n), nan=0.0, posinf=0.0, neginf=0.0)
        norm = np.sqrt((m * m).sum(1, keepdims=True)) if unit else np.ones((len(m), 1))
        found[n] = np.array(at), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return found


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", block: int = 512, metric: str = "cosine") -> DataFrame:
    """qid, id, score, rank: the k best vectors of each query (qid, v) by cosine similarity, rounded to 9 digits; ties by id.

    metric l2: by the square of the distance instead; score is 1 less that. Vectors of another length are no candidates then.

    Blocks of queries meet blocks of vectors (a block pair is one matrix product), and only a pair's k best leave it, so the shuffle
    carries k rows for each query and block of vectors instead of every pair. Spark broadcasts the query blocks under its size check.
    Similarity is 0 where lengths differ or a norm is 0; a null or non-finite component counts as 0; null vectors take no part.
    """
    types = {name: df.schema[name].dataType.simpleString() for df, name in ((queries, "qid"),)} | {"id": vectors.schema[id_col].dataType.simpleString()}
    asked = _blocks(queries, "qid", "v", block).select(F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    met = _blocks(vectors, id_col, vector_col, 4 * block).join(asked, F.lit(True), "inner")

    def best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for i in range(batch.num_rows):
                ids, vs, qids, qs = (batch.column(c)[i].as_py() for c in ("ids", "vs", "qids", "qs"))
                rank = np.argsort(np.argsort(np.array(ids), kind="stable"), kind="stable")
                near = metric == "l2"
                score = np.full((len(qids), len(ids)), -np.inf if near else 0.0)
                mine = _matrices(vs, not near)
                for n, (at, q) in _matrices(qs, not near).items():
                    if n in mine:
                        product = q @ mine[n][1].T
                        if near:
                            product = 1 - ((q * q).sum(1)[:, None] + (mine[n][1] * mine[n][1]).sum(1)[None, :] - 2 * product)
                        score[np.ix_(at, mine[n][0])] = product
                score = np.round(score, 9) + 0.0
                row = np.lexsort((np.broadcast_to(rank, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, row, 1).ravel()
                found = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids), row.shape[1])[found]), pa.array(np.array(ids)[row].ravel()[found]), pa.array(best[found])], names=["qid", "id", "score"])

    return top(met.mapInArrow(best, f"qid {types['qid']}, id {types['id']}, score double"), k)


def mentions(docs: DataFrame, names: DataFrame, text_col: str = "content", most: int = 50_000) -> DataFrame:
    """docs with each name (of a table of names) that their text contains, whatever its case.

    Names come in lots of at most `most`; a lot is one Aho-Corasick automaton, so a text is read once for each lot, however many names it has.
    Null names and null texts match nothing; an empty name is in every text.
    """
    low = stored(names.select("name", F.lower("name").alias("low")).where("low is not null").groupBy("low").agg(F.collect_set("name").alias("names")))
    found, after = None, None
    while lot := (low if after is None else low.where(F.col("low") > after)).orderBy("low").limit(most).collect():
        after = lot[-1]["low"]
        part = _mentions_of(docs, {r["low"]: sorted(r["names"]) for r in lot}, text_col)
        found = part if found is None else found.unionByName(part)
    return docs.withColumn("name", F.lit(None).cast("string")).limit(0) if found is None else found


def _mentions_of(docs: DataFrame, by_low: dict[str, list[str]], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(by_low)

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for key, own in shared.value.items():
            if key:
                auto.add_word(key, (key, own))
        if len(auto):
            auto.make_automaton()
        always = shared.value.get("", [])
        for part in texts:
            yield pd.Series([None if t is None else always + [n for own in dict(v for _, v in (auto.iter(t) if len(auto) else ())).values() for n in own] for t in part])

    return docs.withColumn("name", F.explode(found(F.lower(text_col))))


def top(channel: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1; ties by id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return channel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _channel_rows(channels: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select("qid", "id", "rank", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel")) for name, df in channels.items()])


def rrf(channels: dict[str, DataFrame], weights: dict[str, float] | DataFrame, k: int = 60) -> DataFrame:
    """qid, id, rrf, channels: one shuffle over the union of ranked channels instead of outer joins.

    weights: of the channels, or a table (qid, weights as a map) of them by query.
    """
    both = _channel_rows(channels)
    if isinstance(weights, DataFrame):
        both = both.join(weights, "qid").withColumn("w", F.coalesce(F.element_at("weights", F.col("channel")), F.lit(0.0)))
    else:
        both = both.withColumn("w", F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("channel")))
    return both.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 6).alias("rrf"), F.array_sort(F.collect_list("channel")).alias("channels"))


def merged(channels: dict[str, DataFrame]) -> DataFrame:
    """qid, id and each channel's score (null where a channel doesn't have the row), the best of them and how many have it."""
    both = _channel_rows(channels)
    own = [F.max(F.when(F.col("channel") == name, F.col("score"))).alias(name) for name in channels]
    return both.groupBy("qid", "id").agg(*own, F.count("*").alias("n_channels"))


def best_lists(fused: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each query, with pos from 1."""
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("pos") <= keep)


def graph_channel(queries: DataFrame, edges: DataFrame, named: DataFrame, k: int, entities: int = 5) -> DataFrame:
    """qid, id, score, rank: memories that name an entity of the query, or a neighbour of one.

    edges (src, dst) link names, named (name, id) says which memories name them. A query's first `entities` names (by code point) each
    have a network of themselves and their neighbours; its size times .1, less at depth one, is the score of the memories of each.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    own = mentions(queries, names, "q").select("qid", "name").distinct()
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("name"))).where(F.col("n") <= entities).select("qid", F.col("name").alias("src"))
    size = both.groupBy("src").agg((F.lit(1) + 2 * F.count("*")).alias("size"))  # its nodes, and an edge to each neighbour
    start = own.join(size, "src")
    near = start.select("qid", F.col("src").alias("name"), (F.col("size") * 0.1).alias("score")).unionByName(start.join(both, "src").select("qid", F.col("dst").alias("name"), (F.col("size") * 0.1 / 1.5).alias("score")))
    best = near.groupBy("qid", "name").agg(F.max("score").alias("score"))
    return top(best.join(named, "name").groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score")), k)


def score_fusion(channels: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """The weighted mean of scores over 61: fusion at a fixed rank of one."""
    parts = [df.select("qid", "id", (F.col("score") * weights[name]).alias("s"), F.lit(weights[name]).alias("w")) for name, df in channels.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.round(F.sum("s") / 61 / F.sum("w"), 6).alias("fused"))


def mmr(candidates: DataFrame, k: int, balance: float = 0.5, limit: float = 0.85, similarity=None, order: str = "id") -> DataFrame:  # noqa: ANN001
    """Greedy choice of k rows of each query (qid, q, id, content): relevance against similarity to what is chosen; of equal values the first in the order of the column `order` wins.

    similarity: of two sets of words; Jaccard's by default. Candidates are few by construction (a top-k).
    """
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    sim = similarity or jaccard

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        sets = [set(str(c).lower().split()) for c in pdf["content"]]
        query = set(str(pdf["q"].iloc[0]).lower().split())
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < k:
            value = []
            for i in left:
                near = max((sim(sets[i], sets[j]) for j in chosen), default=0.0)
                v = balance * sim(query, sets[i]) + (1 - balance) * (1 - near)
                value.append(v / 2 if near > limit else v)
            best = left[value.index(max(value))]
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "id": pdf["id"].iloc[chosen].to_numpy(), "pos": range(1, len(chosen) + 1)})

    return candidates.groupBy("qid").applyInPandas(run, "qid long, id long, pos int")


def dedup_decision(cosine: Column, overlap: Column) -> Column:
    """By rule: nothing near, or a near text with other words, is a new row."""
    return F.when(cosine.isNull() | (cosine < 0.7), "CREATE").when(overlap > 0.9, "SKIP").when(overlap > 0.7, "MERGE").otherwise("CREATE")


def dedup_heuristic(cosine: Column, overlap: Column, category: Column) -> Column:
    """The variant that looks at the category: profiles are merged, events and cases are always new."""
    return (
        F.when(cosine.isNull() | (cosine < 0.7), "CREATE").when(overlap > 0.8, "SKIP").when(category == "profile", "MERGE")
        .when(category.isin("events", "cases"), "CREATE").when(cosine >= 0.85, "MERGE").otherwise("CREATE")
    )


def result_columns(rows: DataFrame) -> DataFrame:
    """What a caller sees of memories."""
    return rows.select("id", "type", "content", "importance", "created_at", "source")


def promoted(sessions: DataFrame, now: Column, hours: int = 24, forced: bool = False) -> DataFrame:
    """Memories out of session states (conv_id, decisions, preferences, facts, updated) that are older than the hours, or all if forced; empty parts give none."""
    old = sessions if forced else sessions.where(F.unix_micros(F.col("updated").cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) - hours * 3_600_000_000)
    part = lambda kind, column, weight: F.struct(F.lit(kind).alias("type"), F.col(column).alias("content"), F.lit(weight).alias("importance"))
    rows = old.select("conv_id", F.explode(F.array(part("decision", "decisions", 0.9), part("preference", "preferences", 0.8), part("fact", "facts", 0.7))).alias("x"))
    return rows.select("conv_id", "x.*", F.lit("session_state").alias("source")).where(F.col("content").isNotNull() & ~F.contains("content", F.lit("[None]")))


def admitted(new: DataFrame, kept: DataFrame, vectors: DataFrame, recalled: DataFrame) -> DataFrame:
    """new memories with outcome, class and match: what happens to each on its way into the table of those kept.

    Contents are cut to 50,000 characters and cleaned of control characters; then a rule may turn them away, then a low importance, then a
    recall of the same content (hashes in recalled), then an earlier copy among the new ones. The nearest kept memory by cosine of the
    vectors (id, vector) decides by the words in common whether the rest are skipped, merged into it or created.
    """
    c = F.regexp_replace(F.substring("content", 1, 50_000), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    rows = new.withColumn("content", c).withColumn("hash", F.sha2("content", 256))
    copy = F.row_number().over(Window.partitionBy("hash").orderBy("created_at", "id"))
    rows = rows.withColumns({"copy": copy, "reason": text.denoise_reason(F.col("content"), F.col("importance"), F.lit(1.0), F.lit(0)), "class": scoring.keep_class(F.col("importance"))})
    rows = rows.join(recalled.select("hash").distinct().withColumn("seen", F.lit(True)), "hash", "left")
    asked = new.select("id").join(vectors, "id").select(F.col("id").alias("qid"), F.col("vector").alias("v"))
    near = vector_top(vectors.join(kept.select("id"), "id", "left_semi"), asked, 1).select(F.col("qid").alias("id"), F.col("id").alias("match"), F.col("score").alias("cosine"))
    rows = rows.join(near, "id", "left").join(kept.select(F.col("id").alias("match"), F.col("content").alias("other")), "match", "left")
    decision = dedup_decision(F.col("cosine"), scoring.jaccard(scoring.words(F.col("content")), scoring.words(F.coalesce("other", F.lit("")))))
    outcome = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("class") == "discard", "discard").when(F.col("seen"), "recalled").when(F.col("copy") > 1, "repeated")
        .when(decision == "SKIP", "skip").when(decision == "MERGE", "merge").otherwise("created")
    )
    return rows.withColumn("outcome", outcome).drop("copy", "reason", "seen", "other", "hash")
