"""Fuzzy line dedup by MinHash: one line of each group of near-equal lines stays.

Lines are split at newlines; blank ones always stay. One pass over the texts stores every line's place and, once a task, each
different line with its MinHash values over shingles of k characters, in bands. Lines that share a band's values meet, and the
exact Jaccard similarity of their shingle sets (as 64-bit hashes) decides on a link. A band's key with more than `capacity` lines is split into
chunks, and each pair of chunks is compared by a task of its own. Pairs already connected within a comparison are skipped, so
only a spanning forest leaves it, and a pair is compared in the first band it shares only. Distributed star contraction gives
the components; of a component's lines (equal and near-equal ones, in all documents) the first by (doc_id, line number, row) stays.

A line with fewer than k characters is one shingle, so it has no near-equal line but its equals. With bands of 3 values
and 6 bands a pair of similarity 0.8 is found with probability 0.987, of 0.9 with 0.9996. Lines are told apart by 64-bit
XXH3 of their bytes. A line that is more than 1/512 of all lines is judged by a broadcast of at most 512 rows, others by a join.

Edge cases: a null text has no lines, an empty one a blank line; both have a row with n_lines 0. A null doc_id sorts after all others. Rows are
told apart by a number of their own, so rows that repeat a doc_id have results of their own. Other columns are ignored, and may
have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .shared import components, free_name, sifted, stored

K, ROWS, BANDS, SIMILARITY = 8, 3, 6, 0.8
_rng = np.random.default_rng(29)
MULTIPLY = (_rng.integers(1, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
#: Bytes of text whose signatures are computed at once.
TILE = 1 << 18
SEEN = 200_000


def shingle_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of K code points of the lines laid end to end, and each line's first shingle.

    ends: where each line ends in bytes. A line shorter than K code points has one shingle of all it has. K code points
    have 8 to 32 bytes, so their first and last two words of 8 bytes, and their length, tell them apart.
    """
    raw = np.frombuffer(data + bytes(32), np.uint8)
    size = len(data)
    chars = np.flatnonzero((raw[:size] & 0xC0) != 0x80)  # first bytes of code points
    stops = np.searchsorted(chars, ends) if len(chars) < size else ends
    begins = np.concatenate([[0], stops[:-1]])
    short = np.flatnonzero(stops - begins < K)
    begun = np.ones(len(chars), bool)
    for j in range(1, K):
        begun[np.maximum(stops - j, 0)] = False
    begun[begins[short]] = True
    first = np.flatnonzero(begun)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    edge = np.append(chars, size)
    a = chars[first]
    n = edge[np.minimum(first + K, len(chars))] - a
    h = word[a]
    wide = np.flatnonzero(n > 8)
    if len(wide):
        at, m = a[wide], n[wide]
        more = (word[at + m - 8] + m.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        long = np.flatnonzero(m > 16)
        if len(long):
            at, m = at[long], m[long]
            more[long] += (word[at + 8] ^ (word[at + m - 16] >> np.uint64(23)) ^ (word[at + m - 16] << np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h[wide] ^= more ^ (more >> np.uint64(31))
    starts = np.searchsorted(first, begins)
    if len(short):
        edges = np.concatenate([[0], ends])
        h[starts[short]] = [xxh3_64_intdigest(data[edges[i] : edges[i + 1]]) for i in short.tolist()]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h, starts


def sections(line: bytes) -> list[bytes]:
    """A line in parts of about TILE bytes that share K - 1 code points, so their shingles are those of the line."""
    parts, at = [], 0
    while len(line) - at > 2 * TILE:
        cut = at + TILE
        while line[cut] & 0xC0 == 0x80:
            cut += 1
        back, seen = cut, 0
        while seen < K - 1:
            back -= 1
            seen += line[back] & 0xC0 != 0x80
        parts.append(line[at:cut])
        at = back
    return [*parts, line[at:]]


def _lows(lines: list[bytes]) -> np.ndarray:
    """(lines, ROWS * BANDS) least values."""
    h, starts = shingle_hashes(b"".join(lines), np.cumsum([len(x) for x in lines]))
    top = (h >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(top * MULTIPLY[i] + SHIFT[i], starts) for i in range(ROWS * BANDS)], axis=1)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys, with the band's number in the last three bits. A lot has about TILE bytes, or is one longer line."""
    if len(lines) == 1:
        lows = np.min([_lows([x])[0] for x in sections(lines[0])], axis=0)[None, :]
    else:
        lows = _lows(lines)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for i in range(ROWS * BANDS):
        band = i // ROWS
        keys[:, band] = (keys[:, band] ^ lows[:, i].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        keys[:, band] ^= keys[:, band] >> np.uint64(29)
    return (keys & ~np.uint64(7) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def shingles(line: bytes) -> np.ndarray:
    """The set of a line's shingles, as sorted hashes."""
    return np.unique(np.concatenate([shingle_hashes(x, np.array([len(x)]))[0] for x in sections(line)]))


KEYS = [f"k{b}" for b in range(BANDS)]
#: kind 0: a line's place (line_no and lid are null where a row has no lines); kind 1: a line that is new to its task.
INDEX = "kind int, row long, doc_id long, line_no int, lid long, line binary, " + ", ".join(f"{k} long" for k in KEYS)


def _signed(lids: list[int | None]) -> pa.Array:
    none = np.array([x is None for x in lids], bool)
    return pa.array(np.array([x or 0 for x in lids], np.uint64).view(np.int64), mask=none)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the lines that aren't blank, and lots of about TILE bytes of new lines with their bands' keys."""
    seen: set[int] = set()
    lids: list[int] = []
    lines: list[bytes] = []
    size, number = 0, TaskContext.get().partitionId() << 33

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "line_no": pa.int32(), "lid": pa.int64(), "line": pa.binary()} | {k: pa.int64() for k in KEYS}
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    def settle() -> pa.RecordBatch:
        nonlocal lids, lines, size
        keys = band_keys(lines)
        made = batch_of(len(lids), kind=pa.array([1] * len(lids), pa.int32()), lid=pa.array(np.array(lids, np.uint64).view(np.int64)), line=pa.array(lines, pa.binary()), **{k: pa.array(keys[:, b]) for b, k in enumerate(KEYS)})
        lids, lines, size = [], [], 0
        return made

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows, ids, nos, own = [], [], [], []
            numbers = batch.column(2).slice(at, 256).to_pylist()
            for doc_id, text, row in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256), numbers):
                if row is None:
                    row, number = number, number + 1
                before = len(own)
                for n, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if not line.strip():
                        continue
                    lid = xxh3_64_intdigest(line)
                    nos.append(n)
                    own.append(lid)
                    if lid in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(lid)
                    if size and size + len(line) > 2 * TILE:
                        yield settle()
                    lids.append(lid)
                    lines.append(line)
                    size += len(line)
                    if size >= TILE:
                        yield settle()
                if len(own) == before:
                    nos.append(None)
                    own.append(None)
                rows += [row] * (len(own) - before)
                ids += [doc_id] * (len(own) - before)
            yield batch_of(len(own), kind=pa.array([0] * len(own), pa.int32()), row=pa.array(rows, pa.int64()), doc_id=pa.array(ids, pa.int64()), line_no=pa.array(nos, pa.int32()), lid=_signed(own))
    if lids:
        yield settle()


def similar(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lines a and b of each pair have a Jaccard similarity of SIMILARITY. values: each line's distinct shingles, as numbers below 2**32."""
    said = np.minimum(counts[a], counts[b]) >= SIMILARITY * np.maximum(counts[a], counts[b])
    todo = np.flatnonzero(said)
    step, at = 1 << 21, 0
    sizes = np.cumsum(counts[a[todo]] + counts[b[todo]])
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + step)))
        part = todo[at:end]
        both = np.stack([a[part], b[part]], axis=1).ravel()
        n = counts[both]
        begin = np.cumsum(n) - n
        index = np.arange(n.sum()) + np.repeat(starts[both] - begin, n)
        key = np.sort(np.repeat(np.arange(len(part), dtype=np.uint64), n.reshape(-1, 2).sum(1)) << np.uint64(32) | values[index])
        common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(part))
        union = n.reshape(-1, 2).sum(1) - common
        said[part] = common >= SIMILARITY * union
        at = end
    return said


def numbered(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's distinct shingles as numbers of this lot, end to end; and their starts and counts."""
    if sum(map(len, lines)) <= 4 * TILE:
        h, starts = shingle_hashes(b"".join(lines), np.cumsum([len(x) for x in lines]))
        line = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(starts, append=len(h)))
    else:
        sets = [shingles(x) for x in lines]
        h = np.concatenate(sets)
        line = np.repeat(np.arange(len(lines), dtype=np.uint64), [len(x) for x in sets])
    order = np.argsort(h)
    ranks = h[order]
    number = np.empty(len(h), np.uint64)
    number[order] = np.cumsum(np.concatenate([[False], ranks[1:] != ranks[:-1]]))
    key = np.sort(line << np.uint64(32) | number)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    counts = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(lines))
    return key & np.uint64(0xFFFFFFFF), np.cumsum(counts) - counts, counts


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


#: Cells of up to so many lines are compared together, all pairs at once.
SMALL_CELL = 8


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole cells (t, key, lo, hi), which come in order."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        marks = np.stack([table[x].to_numpy() for x in ("t", "key", "lo", "hi")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
        if len(cuts):
            yield table.slice(0, int(cuts[-1]))
            rest = table.slice(int(cuts[-1]))
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of the similar lines of each cell.

    A pair that also meets in an earlier band was compared there, so each pair is compared once.
    """
    for table in _whole_cells(batches):
        t, lo, hi, c, lid = (table[x].to_numpy() for x in ("t", "lo", "hi", "c", "lid"))
        key, bands = table["key"].to_numpy(), np.stack([table[k].to_numpy() for k in KEYS], axis=1)
        marks = np.stack([t, key, lo, hi])
        bounds = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [len(lid)]])
        length = pa.compute.binary_length(table["line"]).to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs of rows that are to be compared here: of the right chunks, and in no earlier band."""
            ok = (lid[i] != lid[j]) & ((lo[i] == hi[i]) | (c[i] != c[j]))
            for u in range(BANDS - 1):
                ok &= (bands[i, u] != bands[j, u]) | (t[i] <= u)
            return ok

        def settle_small(cells: list[tuple[int, int]]) -> None:
            i, j = (np.array(x, np.int64) for x in zip(*((x, y) for a, b in cells for x in range(a, b) for y in range(a, x))))
            ok = wanted(i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                return
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            same, which = np.unique(lid[rows], return_index=True)
            values, starts, counts = numbered(table["line"].take(pa.array(rows[which])).to_pylist())
            x, y = np.searchsorted(same, lid[i]), np.searchsorted(same, lid[j])
            ok = similar(values, starts, counts, x, y)
            found.append((lid[i[ok]], lid[j[ok]]))

        def settle_large(a: int, b: int) -> None:
            forest, sets, held = _Forest(b - a), {}, 0
            whole = length[a:b].sum() <= 8 * TILE
            if whole:
                values, starts, counts = numbered(table["line"].slice(a, b - a).to_pylist())
            for x in range(1, b - a):
                top = forest.find(x)
                y = np.array([y for y in range(x) if forest.find(y) != top], np.int64)
                y = y[wanted(np.full(len(y), a + x), a + y)]
                while len(y):
                    # A few at a time: those that a link connects need no comparison.
                    part, y = y[:16], y[16:]
                    if whole:
                        ok = similar(values, starts, counts, np.full(len(part), x), part)
                    else:
                        for n in (x, *part.tolist()):
                            if n not in sets:
                                if held > 8 * TILE:
                                    sets, held = {k: v for k, v in sets.items() if k == x}, 0
                                sets[n] = shingles(table["line"][a + n].as_py())
                                held += len(sets[n])
                        ok = np.array([_jaccard(sets.get(x), sets[n] if n in sets else shingles(table["line"][a + n].as_py())) >= SIMILARITY for n in part.tolist()])
                    for n in part[ok].tolist():
                        if forest.join(x, n):
                            found.append((lid[a + x : a + x + 1], lid[a + n : a + n + 1]))
                    if ok.any() and len(y):
                        top = forest.find(x)
                        y = y[[forest.find(n) != top for n in y.tolist()]]

        lot: list[tuple[int, int]] = []
        size = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            held = int(length[a:b].sum())
            if b - a < 2:
                continue
            if b - a > SMALL_CELL or held > TILE:
                settle_large(a, b)
                continue
            lot.append((a, b))
            size += held
            if size > TILE:
                settle_small(lot)
                lot, size = [], 0
        if lot:
            settle_small(lot)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], names=["a", "b"])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _links(lines: DataFrame, capacity: int) -> DataFrame:
    """a, b: links between different lines (lid, line and the bands' keys), enough to connect all similar ones that met."""
    keyed = lines.select("lid", F.explode(F.array(*KEYS)).alias("key"))
    # Keys of two lines or more; then lines by those keys, once each, and how many there are of a key.
    shared = stored(keyed.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).where("low < high").select("key"), "line-keys")
    met = stored(sifted(keyed, "key", shared, "key").distinct(), "line-keyed")
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    band = (F.col("key").bitwiseAND(F.lit(7))).cast("int")
    met = met.join(sizes, "key").select("lid", "key", band.alias("t"), F.ceil(F.col("n") / capacity).cast("int").alias("chunks"))
    # A band where a line met none has no key here; lid stands for it, which equals no other line's.
    mine = lambda i, c: F.max(F.when(F.col("t") == i, F.col(c)))
    bands = met.groupBy("lid").agg(*(F.coalesce(mine(i, "key"), F.col("lid")).alias(k) for i, k in enumerate(KEYS)), *(F.coalesce(mine(i, "chunks"), F.lit(0)).alias(f"n{i}") for i in range(BANDS)))
    bands = stored(bands, "line-meetings")
    once = bands.join(sifted(lines.select("lid", "line"), "lid", bands, "lid"), "lid").groupBy("lid", *bands.columns[1:]).agg(F.first("line").alias("line"))
    cells = once.select("lid", "line", *KEYS, F.posexplode(F.array(*(F.struct(F.col(k).alias("key"), F.col(f"n{i}").alias("chunks")) for i, k in enumerate(KEYS)))).alias("t", "x"))
    cells = cells.where("x.chunks > 0").select("t", "x.key", "lid", "line", *KEYS, "x.chunks", F.pmod(F.xxhash64("lid"), F.col("x.chunks")).cast("int").alias("c"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("t", "key", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "c", "lid", "line", *KEYS)
    return cells.repartition("key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi").mapInArrow(_compare, "a long, b long")


def _indexed(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    row = F.lit(None) if row_col is None else F.col(f"`{row_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), row.cast("long").alias("row"))
    return stored(source.mapInArrow(_index, INDEX), "line-index", texts=True)


def line_links(docs: DataFrame, text_col: str = "text", capacity: int = 256) -> DataFrame:
    """a, b: links between different lines, by the XXH3 of their bytes."""
    return _links(_indexed(docs, text_col, text_col, None).where("kind = 1"), capacity)


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, capacity: int = 256) -> DataFrame:
    """row, doc_id, line_no and kept of every line that isn't blank; line_no and kept are null for a row without such lines."""
    index = _indexed(docs, id_col, text_col, row_col)
    places = index.where("kind = 0").select("row", "doc_id", "line_no", "lid")
    lined = places.where("lid is not null")
    roots = components(_links(index.where("kind = 1"), capacity))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "row")
    # A line in no link is judged among its equals, others among their component; equals are summed before the join.
    least = lined.groupBy("lid").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    named = stored(least.join(roots, least.lid == roots.node, "left").select("lid", F.coalesce("root", "lid").alias("root"), "least", "n"), "line-named")
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    judged = stored(named.join(best, "root").select("lid", "best", "n"), "line-judged")
    total = judged.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * 512 > F.lit(total)  # so there are at most 511 of them
    hot = F.broadcast(judged.where(often))
    verdict = lambda df: df.select("row", "doc_id", "line_no", (place == F.col("best")).alias("kept"))
    said = verdict(lined.join(hot, "lid")).unionByName(verdict(lined.join(F.broadcast(judged.where(often).select("lid")), "lid", "left_anti").join(judged.where(~often), "lid")))
    return said.unionByName(places.where("lid is null").select("row", "doc_id", "line_no", F.lit(None).cast("boolean").alias("kept")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, capacity: int = 256) -> DataFrame:
    """doc_id, n_lines (not blank), n_kept and dropped (line numbers, in order) of each row; and row, if the rows have numbers."""
    gone = F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))))
    found = line_verdicts(docs, id_col, text_col, row_col, capacity).groupBy("row", "doc_id").agg(F.count("line_no").alias("n_lines"), F.count_if("kept").alias("n_kept"), gone.alias("dropped"))
    return found if row_col else found.drop("row")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of the text, each row its own. Rows get numbers, which are stored beside them."""
    row, other, gone = (free_name(docs, x) for x in ("row", "other_row", "gone"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs", texts=True)
    lost = dedup_lines(rows, id_col, text_col, row).where(F.size("dropped") > 0).select(F.col("row").alias(other), F.col("dropped").alias(gone))
    joined = rows.join(lost, rows[row] == lost[other], "left")
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
