"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks of bounded size and stored once. Queries come in chunks of at most CHUNK_BLOCKS blocks of BLOCK_BYTES,
a bound of 16 MB; each chunk travels with the tasks, which read the stored candidates, so nothing is shuffled for a pair.
Round by round, every pair is scored and each query's scores in an interval are counted in bins; the counts are summed over all
tasks, and the bin with the kth best score becomes the next interval, until it is one integer wide. A last pass gives
each block's scores at or above the kth value, ties cut to the k smallest ids of a block (none of the others can be in the
result), and ties are broken by id. Bins below a block's own kth best score can't hold the global one, so a block counts
at most k scores a query: a vector that a third of all rows share adds no more.

Scores are inner products of integers, exact in doubles while dimension * largest**2 < 2**53; beyond it Python's integers are used, in blocks
of their own, so a few large vectors don't slow the others. Histograms run over an integer key that equals the score below 2**53
and goes on in the steps of doubles above it; equal keys are told apart by the exact score.

Edge cases: rows with a null id, a null or empty vector, or null or non-finite components take no part; vectors of another length than the
query's are not its candidates. Every finite component is taken, however large; a score outside of long is ranked exactly and given as the
nearest long. Repeated rows each count, as candidates and as queries with a result list each. With fewer than k candidates, all are given. A
query never finds rows of its own id. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import needed, shared_path, stored

BINS = 256
CANDIDATE_ROWS, QUERY_ROWS = 4096, 512
BLOCK_BYTES, CHUNK_BLOCKS = 1 << 18, 64
PACKED = "dim int, top double, ids binary, m binary"
#: Keys are exact scores below this; above, a key more is a double more.
EXACT = 1 << 53
_EXACT_BITS = int(np.float64(EXACT).view(np.int64))
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most `size` rows of one dimension: ids, the matrix of components as bytes, and the largest component. Large vectors have blocks of their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            dims = pdf["v"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                part = pdf[dims == dim]
                ids, m = part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.float64)
                with np.errstate(over="ignore"):
                    large = np.abs(m).max(1) * scale + 1 > np.sqrt(EXACT / dim)
                for which in (~large, large):
                    at = np.flatnonzero(which)
                    for i in range(0, len(at), step := max(1, min(size, size * BLOCK_BYTES // (QUERY_ROWS * 8 * dim)))):
                        lot = at[i : i + step]
                        yield pd.DataFrame({"dim": [dim], "top": [float(np.abs(m[lot]).max())], "ids": [ids[lot].tobytes()], "m": [m[lot].tobytes()]})

    return rows.mapInPandas(run, PACKED)


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = x.as_integer_ratio()
    return n * scale // d


def key_of(score: int) -> int:
    """A 64-bit key that never falls as the score grows, and equals it below EXACT."""
    size = abs(score)
    if size < EXACT:
        return score
    try:
        bits = int(np.float64(float(size)).view(np.int64))
    except OverflowError:
        bits = int(np.float64(np.inf).view(np.int64))
    key = EXACT + bits - _EXACT_BITS
    return key if score > 0 else -key


def sortable(score: int) -> bytes:
    """Bytes in the order of the scores; empty where the key says it all."""
    if abs(score) < EXACT:
        return b""
    size = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    head = len(size).to_bytes(4, "big") + size
    return b"\x01" + head if score > 0 else b"\x00" + bytes(255 - x for x in head)


class Block:
    """Ids and scaled integer vectors: as doubles, and as Python's integers when these are needed."""

    def __init__(self, dim: int, ids: bytes, m: bytes, scale: int):
        self.dim, self.ids, self.scale = dim, np.frombuffer(ids, np.int64), scale
        self.raw = np.frombuffer(m).reshape(-1, dim)
        with np.errstate(over="ignore"):
            self.m = np.floor(self.raw * scale)
        self.most = float(np.abs(self.m).max(initial=1))
        self._whole: np.ndarray | None = None

    def whole(self) -> np.ndarray:
        if self._whole is None:
            self._whole = np.array([[whole(x, self.scale) for x in row] for row in self.raw.tolist()], object).reshape(self.raw.shape)
        return self._whole


def _scores(c: Block, q: Block) -> tuple[np.ndarray, np.ndarray | None]:
    """(candidates, queries): keys, and the exact scores where keys don't say it all."""
    if c.most * q.most * c.dim < EXACT:
        return (c.m @ q.m.T).astype(np.int64), None
    s = c.whole() @ q.whole().T
    return np.array([[key_of(x) for x in row] for row in s.tolist()], np.int64).reshape(s.shape), s


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Whether each row is among the first k of its run of equal groups."""
    n = len(groups)
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    return np.arange(n) - np.repeat(begins, np.diff(begins, append=n)) < k


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for queries of id % every = 0. See the module for edge cases."""
    spark = vectors.sparkSession
    rows = needed(vectors, id=(id_col, "long"), v=(vector_col, "array<double>")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    cands = stored(_packed(rows, CANDIDATE_ROWS, scale), "topk-candidates")
    queries = stored(_packed(rows.where(F.pmod("id", F.lit(every)) == 0), QUERY_ROWS, scale).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    most = [df.agg(F.max("top").alias("t"), F.max("dim").alias("d")).first() for df in (cands, queries)]
    if most[0].t is None or most[1].t is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # No score is larger.
    reach = key_of(max(whole(most[0].t, scale) + 1, 1) * max(whole(most[1].t, scale) + 1, 1) * most[1].d)
    step0 = 1
    while BINS * step0 < 2 * reach + 1:
        step0 *= BINS
    path, after = shared_path(spark, "topk-found"), -1
    while chunk := queries.where(F.col("block") > after).orderBy("block").limit(CHUNK_BLOCKS).collect():
        after = chunk[-1].block
        _search(spark, cands, chunk, k, scale, -reach, step0).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("block", "pos").orderBy(F.desc("key"), F.desc("exact"), "vec_id"))
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


FOUND = "block long, pos int, query_id long, vec_id long, key long, exact binary, score long"


def _search(spark, cands: DataFrame, chunk: list, k: int, scale: int, low0: int, step: int) -> DataFrame:  # noqa: ANN001
    """The best candidates of each block for a chunk of queries; those of all blocks hold the result."""
    sizes = [len(r.ids) // 8 for r in chunk]
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    low, rest = np.full(starts[-1], low0, np.int64), np.full(starts[-1], k, np.int64)
    asked = spark.sparkContext.broadcast([(r.block, r.dim, bytes(r.ids), bytes(r.m)) for r in chunk])

    def each(batches: Iterator[pa.RecordBatch]):  # noqa: ANN202
        """Each candidate block with each query block of its dimension, and the place of its queries in the chunk."""
        blocks = [(n, Block(dim, ids, m, scale)) for n, dim, ids, m in asked.value]
        for batch in batches:
            for dim, ids, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                c = Block(dim, ids, m, scale)
                for (n, q), at in zip(blocks, starts):
                    if q.dim == dim:
                        yield c, n, q, at

    while True:
        now = spark.sparkContext.broadcast((low, step))

        def counted(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            low, step = now.value
            for c, _, q, at in each(batches):
                s, top = _scores(c, q)[0], min(k, len(c.ids))
                s -= low[at : at + len(q.ids)]
                s //= step
                s[(s < 0) | (s >= BINS) | (c.ids[:, None] == q.ids)] = -1
                bins = s.astype(np.int16)
                best = np.partition(bins, len(bins) - top, axis=0)[len(bins) - top :]
                which, n = np.unique((np.arange(len(q.ids)) * BINS + best)[best >= 0], return_counts=True)
                if len(which):
                    yield pa.RecordBatch.from_arrays([pa.array(which // BINS + at), pa.array(which % BINS), pa.array(n)], names=["q", "bin", "n"])

        counts = cands.mapInArrow(counted, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        left = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(rest)), "rest": rest}))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        located = counts.withColumn("upto", above).join(F.broadcast(left), "q").where(F.col("upto") >= F.col("rest"))
        located = located.groupBy("q").agg(F.max_by(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "bin").alias("x"))
        hits = located.select("q", "x.bin", "x.rest").collect()  # one row a query of the chunk at most
        none = np.ones(len(low), bool)
        for r in hits:
            none[r.q] = False
            low[r.q] += r.bin * step
            rest[r.q] = r.rest
        low[none] = LEAST  # fewer than k candidates: all are taken
        if step == 1:
            break
        step //= BINS
    bounds = spark.sparkContext.broadcast(low)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, n, q, at in each(batches):
            s, exact = _scores(c, q)
            i, j = np.nonzero((s >= bounds.value[at : at + len(q.ids)]) & (c.ids[:, None] != q.ids))
            if exact is None:
                order = np.lexsort((c.ids[i], -s[i, j], j))
            else:
                order = np.array(sorted(range(len(i)), key=lambda x: (j[x], -exact[i[x], j[x]], c.ids[i[x]])), np.int64)
            order = order[_first(j[order], k)]
            i, j = i[order], j[order]
            if len(i):
                key = s[i, j]
                said = key if exact is None else np.array([min(max(x, LEAST), MOST) for x in exact[i, j].tolist()], np.int64)
                more = [b""] * len(i) if exact is None else [sortable(x) for x in exact[i, j].tolist()]
                columns = (np.full(len(i), n), j.astype(np.int32), q.ids[j], c.ids[i], key, pa.array(more, pa.binary()), said)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["block", "pos", "query_id", "vec_id", "key", "exact", "score"])

    return cands.mapInArrow(last, FOUND)
