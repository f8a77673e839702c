"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when identical after deleting white space of ASCII. The index holds an entry for each
different text of each map task, keyed by the leading 63 bits of its SHA-256: equal texts are collapsed
before any shuffle, so a text that a third of all rows share weighs one row a task. A directory over the
leading bits doubles where a bucket holds more keys than its capacity; owner tasks each process the key range
of a bucket, in key order, chain the entries of a key and compare their bytes, so even equal hashes of
different texts are told apart.

Edge cases: a null text counts as empty, and empty texts equal each other and texts of white space only. A
null doc_id sorts after all others and can stay itself. Of rows that tie even in doc_id one stays,
the first in the scan's order. An empty table gives an empty result. Other columns are ignored, and may have any name. Rows get
numbers, and are stored with them before the two passes read them, so a task that runs again sees the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stored

WHITE = b" \t\n\x0b\x0c\r"
KEY_BITS = 63
#: A task gives out what it has collapsed when it holds so many bytes of text.
HELD_BYTES = 48 << 20

DOCS = "doc_id long, rid long, entry long"
ENTRIES = "entry long, h long, sha string, n_rows long, best_len long, best_id long, best_rid long"


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big") >> 1


def _best(a: tuple, b: tuple) -> tuple:
    """The better of two (length, doc_id, rid): more code points, then the smaller doc_id, nulls last, then scan order."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


def _collapse(batches: Iterator[pa.RecordBatch], emit_docs: bool, emit_text: bool) -> Iterator[pa.RecordBatch]:
    """Equal texts of this task become one entry; entry numbers repeat when the task is run again over the stored rows."""
    base = TaskContext.get().partitionId() << 38
    entries: list[list] = []
    chains: dict[bytes, list[int]] = {}
    made = held = 0

    def flush() -> pa.RecordBatch:
        cols = [[e[i] for e in entries] for i in range(8)]
        arrays = {"entry": pa.array(cols[0], pa.int64()), "h": pa.array(cols[1], pa.int64()), "sha": pa.array(cols[2], pa.string()), "n_rows": pa.array(cols[3], pa.int64())}
        arrays |= {k: pa.array([b[i] for b in cols[4]], pa.int64()) for i, k in enumerate(("best_len", "best_id", "best_rid"))}
        if emit_text:
            arrays["norm"] = pa.array(cols[5], pa.binary())
        if emit_docs:
            arrays = {"kind": pa.array([1] * len(entries), pa.int32()), "doc_id": pa.nulls(len(entries), pa.int64()), "rid": pa.nulls(len(entries), pa.int64())} | arrays
        return pa.RecordBatch.from_pydict(arrays)

    for batch in batches:
        ids, lengths, numbers, docs = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for doc_id, text, length, rid in zip(ids, batch.column(1), lengths, numbers):
            norm = (text.as_py() or b"").translate(None, WHITE)
            sha = hashlib.sha256(norm).digest()
            mine = (length or 0, doc_id, rid)
            for i in chains.get(sha, ()):
                if entries[i][5] == norm:
                    entries[i][3] += 1
                    entries[i][4] = _best(entries[i][4], mine)
                    break
            else:
                i = len(entries)
                chains.setdefault(sha, []).append(i)
                entries.append([base + made, _key(sha), sha.hex(), 1, mine, norm, None, None])
                made += 1
                held += len(norm) + 400
            docs.append((doc_id, rid, entries[i][0]))
            if held > HELD_BYTES:
                yield flush()
                entries, chains, held = [], {}, 0
        if emit_docs and docs:
            n = len(docs)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * n, pa.int32()), "doc_id": pa.array([d[0] for d in docs], pa.int64()), "rid": pa.array([d[1] for d in docs], pa.int64()), "entry": pa.array([d[2] for d in docs], pa.int64()), "h": pa.nulls(n, pa.int64()), "sha": pa.nulls(n, pa.string()), "n_rows": pa.nulls(n, pa.int64()), "best_len": pa.nulls(n, pa.int64()), "best_id": pa.nulls(n, pa.int64()), "best_rid": pa.nulls(n, pa.int64())})
    if entries:
        yield flush()


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _collapse(batches, True, False)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _collapse(batches, False, True)


def directory(counts: dict[int, int], depth: int, max_depth: int, capacity: int) -> tuple[int, list[int]]:
    """Global depth and the bucket of each slot, from the keys counted by their leading max_depth bits.

    It starts with 2**depth buckets. A bucket over its capacity is split by one more bit; where it was
    as deep as the directory, the directory doubles. Buckets at max_depth overflow: they are read in key order
    anyway, so they need no more memory.
    """
    summed = [counts.get(i, 0) for i in range(1 << max_depth)]
    levels = [summed]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
    levels.reverse()
    buckets, todo, deepest = [], [(depth, i) for i in reversed(range(1 << depth))], depth
    while todo:
        d, i = todo.pop()
        if levels[d][i] > capacity and d < max_depth:
            todo += [(d + 1, 2 * i + 1), (d + 1, 2 * i)]
            deepest = max(deepest, d + 1)
        else:
            buckets.append((d, i))
    slots: list[int] = []
    for n, (d, _) in enumerate(buckets):
        slots += [n] * (1 << (deepest - d))
    return deepest, slots


OWNED = "entry long, keep_id long, keep_rid long, group_size long, sha string"


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of h: chains those of one h, compares bytes, and settles each different text."""
    chains: list[list] = []  # [norm, sha, rows, best, entries]
    last: int | None = None
    out: list[tuple] = []

    def settle() -> None:
        for _, sha, rows, best, members in chains:
            out.extend((e, best[1], best[2], rows, sha) for e in members)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.string() if k == "sha" else pa.int64()) for i, k in enumerate(("entry", "keep_id", "keep_rid", "group_size", "sha"))})

    for batch in batches:
        get = {n: batch.column(batch.schema.get_field_index(n)) for n in ("entry", "h", "sha", "n_rows", "best_len", "best_id", "best_rid")}
        rows = zip(*(get[n].to_pylist() for n in get))
        for (entry, h, sha, n, length, best_id, rid), norm in zip(rows, batch.column(batch.schema.get_field_index("norm"))):
            if h != last:
                settle()
                chains, last = [], h
            text, best = norm.as_py(), (length, best_id, rid)
            for c in chains:
                if c[0] == text:
                    c[2] += n
                    c[3] = _best(c[3], best)
                    c[4].append(entry)
                    break
            else:
                chains.append([text, sha, n, best, [entry]])
        if out:
            yield batch_of(out)
            out = []
    settle()
    if out:
        yield batch_of(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 8, max_depth: int = 16, capacity: int = 20_000, row_col: str | None = None) -> DataFrame:
    """Each row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256. See the module for edge cases.

    row_col: the name of row numbers that are stored beside the rows; the result then has them too, as row.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`").cast("long")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), number.alias("rid"))
    source = stored(source, "exact-rows", texts=True) if row_col is None else source
    source = source.select("doc_id", F.col("text").cast("binary").alias("text"), F.length("text").cast("long").alias("n"), "rid")
    narrow = stored(source.mapInArrow(_narrow, f"kind int, doc_id long, rid long, {ENTRIES}"), "exact-index")
    rows = narrow.where("kind = 0").select("doc_id", "rid", "entry")
    prefix = narrow.where("kind = 1").select(F.shiftrightunsigned("h", KEY_BITS - max_depth).alias("p"), "h").groupBy("p").agg(F.approx_count_distinct("h").alias("n"))
    deepest, slots = directory({r.p: r.n for r in prefix.collect()}, depth, max_depth, capacity)
    # At most 2**max_depth slots: a proven bound for the broadcast.
    table = F.broadcast(spark.createDataFrame(list(enumerate(slots)), "slot long, bucket int"))
    entries = source.mapInArrow(_wide, f"{ENTRIES}, norm binary").withColumn("slot", F.shiftrightunsigned("h", KEY_BITS - deepest)).join(table, "slot")
    owned = stored(entries.repartition("bucket").sortWithinPartitions("h", "entry").mapInArrow(_own, OWNED), "exact-owned")
    made = rows.join(owned, "entry").select(F.col("rid").alias("row"), "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return made if row_col else made.drop("row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, with docs' own columns. Each row is kept or dropped by its own number."""
    row, other = free_name(docs, "row"), free_name(docs, "other_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "exact-docs", texts=True)
    gone = exact_dedup(rows, id_col, text_col, row_col=row).where("not kept").select(F.col("row").alias(other))
    return rows.join(gone, rows[row] == gone[other], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
