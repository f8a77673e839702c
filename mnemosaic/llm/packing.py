"""Best-fit packing into bins of several permitted lengths.

Pieces (a text longer than the largest length gives several) are packed in shards of bounded size, dealt by hash;
the number of shards grows with the table, so no task holds more than its share, whatever the skew. Within a shard,
longest first, a piece goes to the open bin it fills best. Where none has room, a bin is opened: of the permitted
lengths that hold the piece, the one of least cost for each word it can be expected to hold, given all that is still
to be placed and the room in open bins. At last each bin is downsized to the smallest length that holds its contents.

Edge cases: null and empty texts are pieces of length 0 and are packed like others. Null doc_ids and repeated rows are
packed as rows of their own. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import free_name, stored

LENGTHS = (512, 1024, 2048, 4096)
#: What a bin costs beyond its length: the work for each sequence.
OVERHEAD = 32


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's final length. Pieces are at most the largest permitted length."""
    permitted = tuple(sorted(permitted))
    left, room = sum(lengths), 0
    bins_by_room: dict[int, list[int]] = {}
    mask = 0  # bit r: some open bin has room r
    size: list[int] = []
    used: list[int] = []
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = bins_by_room[r].pop()
            if not bins_by_room[r]:
                mask &= ~(1 << r)
        else:
            to_come = max(0, left - n - room)
            c = min((c for c in permitted if c >= n), key=lambda c: ((c + overhead) / max(1, min(c, n + to_come)), c))
            b, r = len(size), c
            size.append(c)
            used.append(0)
            room += c
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        left -= n
        room -= n
        bins_by_room.setdefault(r - n, []).append(b)
        mask |= 1 << (r - n)
    return bin_of, offset, [next(c for c in permitted if c >= u) for u in used]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_pieces: int = 2048, row_col: str | None = None) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, bin_id, offset, capacity, bin_used; and row, if the rows have numbers."""
    most = max(permitted)
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`").cast("long")
    size = word_count(F.col(f"`{text_col}`").cast("string")) if length is None else length
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.cast("long").alias("n"), number.alias("row"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("long") - 1)
    pieces = rows.select("row", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = stored(pieces.select("row", "doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("length")), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    # The row's number tells rows apart that are alike, so a hot id is spread too.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "row"], kind="stable", ignore_index=True)
        bins, offsets, sizes = pack(pdf["length"].tolist(), permitted, overhead)
        out = pdf[["row", "doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = (int(pdf["shard"].iloc[0]) << 24) + pd.Series(bins)
        out["offset"], out["capacity"] = offsets, [sizes[b] for b in bins]
        out["bin_used"] = out.groupby("bin_id")["length"].transform("sum")
        return out

    made = dealt.groupBy("shard").applyInPandas(run, "row long, doc_id long, piece long, start long, length int, bin_id long, offset int, capacity int, bin_used int")
    return made if row_col else made.drop("row")


def packed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """best_fit's pieces with row (a number for each row of docs, so repeated and cut documents are told apart) and text: the piece's own words, as they stand.

    The pieces of a row, in order, are the row's text.
    """
    row, other = free_name(docs, "row"), free_name(docs, "other_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "packed-docs", texts=True)
    found = best_fit(rows, id_col, text_col, None, permitted, overhead, row_col=row)
    texts = rows.select(F.col(row).alias(other), F.col(f"`{text_col}`").cast("string").alias("whole"))
    both = found.join(texts, F.col("row") == F.col(other))
    words = F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    last = F.regexp_extract("whole", r"([\x20\x09-\x0D]*+)$", 1)
    cut = F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("length")), "")
    # The row's last piece keeps what white space the text ends in.
    whole = F.col("length") < max(permitted)
    text = F.when((F.col("piece") == 0) & whole, F.coalesce("whole", F.lit(""))).when(whole, F.concat(cut, last)).otherwise(cut)
    return both.select("row", "doc_id", "piece", "start", "length", "bin_id", "offset", "capacity", "bin_used", text.alias("text"))
