"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of k words (repeats included; a shorter
text is one shingle), XXH64 with seed 42; a bit is set if it is set in over half the hashes. A text without words
has fingerprint zero, which is linked like any other.

Links: distinct fingerprints (a text that a third of all rows share is one of them) go to blocks. If at most d
bits differ, at least blocks - d of the fingerprint's blocks are equal, so each pair meets in a block key; pivot
distances alone would have to look at all pairs, so they are used inside a key. There, a table of Hamming distances to
many reference fingerprints is computed once; every pair is discarded if its largest coordinate difference is over d
(triangle inequality), and survivors are verified on their bits. A key with more than `capacity` fingerprints is
split into chunks, and each pair of chunks is compared by a task of its own: exact, never capped, and never all in one
task. Only a spanning forest of a large comparison leaves it, so a dense group gives as many links as it has members.
pair_figures counts the pairs that meet, are discarded and are verified.

Components: distributed star contraction over those links. Edge cases: null text counts as empty; null doc_ids
stay, and are the component's smallest only where there is no other; repeated rows stay rows. An empty table gives
an empty result. Other columns are ignored. keep_one decides by row, not by doc_id, so null and repeated ids lose no other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, free_name, needed, stored, unsigned_hex

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of hash bits that are counted at once.
BITS_AT_ONCE = 8192


def fingerprint(text: bytes, k: int) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()[k - 1 :]
    n = len(stops)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BITS_AT_ONCE):
        part = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + BITS_AT_ONCE], stops[at : at + BITS_AT_ONCE])], np.uint64)
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, row_col: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; and row, if the rows have numbers."""
    more = {"row": (row_col, "long")} if row_col else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", k) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *more])

    source = needed(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **more)
    return source.select("doc_id", F.col("text").cast("binary").alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", row long" * len(more))


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: fixed, spread at random."""
    return np.random.default_rng(64).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, n, dtype=np.uint64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: (fingerprints, pivots) Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows i and j) whose distances to no pivot differ by more than d: pivot after pivot, over what the last one left."""
    for r in range(table.shape[1]):
        ok = np.abs(table[i, r] - table[j, r]) <= d
        i, j = i[ok], j[ok]
    return i, j


#: Cells of up to so many fingerprints are compared together.
SMALL_CELL = 16
PAIRS_AT_ONCE = 1 << 20


class Compared:
    """Links of the cells of a frame, and how many pairs met, were discarded by pivots and were verified."""

    def __init__(self, d: int, refs: np.ndarray):
        self.d, self.refs = d, refs
        self.met = self.verified = self.linked = 0

    def small(self, fp: np.ndarray, c: np.ndarray, same: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All pairs of all small cells at once. same: whether a row's cell compares a chunk with itself."""
        sizes, found = np.diff(bounds), []
        for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_CELL)]).tolist():
            begins = bounds[:-1][sizes == n]
            x, y = np.triu_indices(n, 1)
            for at in range(0, len(begins), step := max(1, PAIRS_AT_ONCE // len(x))):
                part = begins[at : at + step]
                i, j = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                ok = same[i] | (c[i] != c[j])
                found.append(self.pairs(fp, i[ok], j[ok]))
        return found

    def pairs(self, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.met += len(i)
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        p, q = survivors(distances(fp[rows], self.refs), at[: len(i)], at[len(i) :], self.d)
        self.verified += len(p)
        ok = np.bitwise_count(fp[rows[p]] ^ fp[rows[q]]) <= self.d
        self.linked += int(ok.sum())
        return fp[rows[p[ok]]], fp[rows[q[ok]]]

    def large(self, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between a and b, or within a."""
        parent = list(range(len(a) + (0 if same else len(b))))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        table = distances(a if same else np.concatenate([a, b]), self.refs)
        shift = 0 if same else len(a)
        left, right = [], []
        step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), step):
            part = np.arange(at, min(at + step, len(a)))
            near = np.abs(table[part, 0][:, None] - table[shift : shift + len(b), 0][None, :]) <= self.d
            if same:
                near &= np.arange(len(b))[None, :] > part[:, None]
                self.met += int((len(b) - 1 - part).sum())
            else:
                self.met += near.size
            i, j = np.nonzero(near)
            i, j = survivors(table, part[i], j + shift, self.d)
            self.verified += len(i)
            ok = np.bitwise_count(a[i] ^ b[j - shift]) <= self.d
            self.linked += int(ok.sum())
            for p, q in zip(i[ok].tolist(), j[ok].tolist()):
                u, w = find(p), find(q)
                if u != w:
                    parent[max(u, w)] = min(u, w)
                    left.append(p)
                    right.append(q - shift)
        return a[np.array(left, np.int64)], b[np.array(right, np.int64)]


def _cells(fps: DataFrame, d: int, blocks: int, capacity: int) -> DataFrame:
    """t, key, lo, hi, c, fp: the cells' fingerprints, in order within their partitions."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    offsets = [sum(widths[:i]) for i in range(blocks)]
    masks = [((1 << w) - 1) << o for w, o in zip(widths, offsets)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - d)]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in tables))).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes.withColumn("chunks", F.ceil(F.col("n") / capacity).cast("int")), ["t", "key"])
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # Chunk c takes part in the comparisons (c, 0..chunks-1), written with the smaller number first.
    cells = met.select("t", "key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = cells.select("t", "key", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "c", "fp")
    return cells.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")


def _compared(frames: Iterator[pd.DataFrame], state: Compared) -> Iterator[pd.DataFrame]:
    """Cells in order; those of a frame, and one that goes on in the next, are held."""

    def settle(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, c, lo, hi = (frame[x].to_numpy() for x in ("fp", "c", "lo", "hi"))
        fp, same = fp.view(np.uint64), lo == hi
        bounds = np.concatenate([_starts(frame), [len(frame)]])
        found = state.small(fp, c, same, bounds)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if y - x > SMALL_CELL:
                a, b = fp[x:y][c[x:y] == lo[x]], fp[x:y][c[x:y] == hi[x]]
                found.append(state.large(a, b, bool(same[x])))
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
        if len(a):
            yield pd.DataFrame({"a": a, "b": b})

    rest: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        cut = int(_starts(frame)[-1]) if len(frame) else 0
        if cut:
            yield from settle(frame.iloc[:cut])
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield from settle(rest)


def _starts(frame: pd.DataFrame) -> np.ndarray:
    """Where cells begin."""
    marks = frame[["t", "key", "lo", "hi"]].to_numpy()
    return np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1])


def links(fps: DataFrame, d: int = 4, blocks: int = 6, n_pivots: int = 24, capacity: int = 2048) -> DataFrame:
    """a, b: links between distinct fingerprints fp, enough to connect all that differ in at most d bits."""
    refs = pivots(n_pivots)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _compared(frames, Compared(d, refs))

    return _cells(fps, d, blocks, capacity).mapInPandas(compare, "a long, b long")


def pair_figures(fps: DataFrame, d: int = 4, blocks: int = 6, n_pivots: int = 24, capacity: int = 2048) -> DataFrame:
    """met, discarded (by the pivots), verified and linked: how many pairs, over all cells of distinct fingerprints fp."""
    refs = pivots(n_pivots)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Compared(d, refs)
        for _ in _compared(frames, state):
            pass
        yield pd.DataFrame({"met": [state.met], "verified": [state.verified], "linked": [state.linked]})

    sums = _cells(fps, d, blocks, capacity).mapInPandas(count, "met long, verified long, linked long")
    return sums.agg(F.sum("met").alias("met"), (F.sum("met") - F.sum("verified")).alias("discarded"), F.sum("verified").alias("verified"), F.sum("linked").alias("linked"))


def _component_of(rows: DataFrame, d: int) -> DataFrame:
    """fp, least (the smallest doc_id with it), root and component_id of each distinct fingerprint of rows (doc_id, fp)."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), d))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "least", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, d: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row. See the module for edge cases."""
    rows = stored(fingerprints(docs, id_col, text_col, k), "simhash-rows")
    ids = _component_of(rows, d).select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, d: int = 4) -> DataFrame:
    """docs with one row of each component, with docs' own columns: the smallest doc_id (nulls last), then the first row number.

    Row numbers are given once and stored beside the rows, so ids may be null or repeated.
    """
    number, other = free_name(docs, "row"), free_name(docs, "other_row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-docs", texts=True)
    rows = stored(fingerprints(numbered, id_col, text_col, k, number), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = rows.groupBy("fp").agg(F.min(first).alias("first"))
    roots = _component_of(rows, d).select("fp", "root")
    kept = best.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(other))
    return numbered.join(kept, numbered[number] == kept[other], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
