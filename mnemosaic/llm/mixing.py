"""Mixing sources to target weights, exactly.

Every row gets a hash-random key; rows are ranged by key within their source; prefix sums of the word counts are
computed in a distributed way, and each source is cut where its budget ends. Ranges are slices of the uniform
keys' leading bits, so a source with a third of all rows is spread like any other: sums by slice, prefix sums over the
slices (their number is bounded), then running sums within a slice. A source whose budget exceeds its size is
repeated by whole epochs, then cut in a last one.

Edge cases: null and empty texts have size 0 and are never taken. A null source is a source, last in order. Rows
without words in all of a source give it target 0. Repeated rows count each and are told apart by their number among their equals,
which is part of the key, so they spread over the slices; ties of the key are broken by doc_id (nulls first), then size. Other columns are
ignored, and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, stored

WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0: by code point, null last. Sorted by ranges and numbered within them, so many sources aren't in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = stored(sources.orderBy(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def _numbered_repeats(rows: DataFrame) -> DataFrame:
    """rows with again: the number of a row among those that equal it in doc_id, source and size.

    Equals are numbered within a partition of the scan, after the sums of the partitions before it, so a group of any size is
    spread over as many tasks as hold it. row's high bits are the scan's partition.
    """
    same = ["doc_id", "source", "size"]
    repeated = stored(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-repeats")
    if repeated.isEmpty():
        return rows.withColumn("again", F.lit(0).cast("long"))
    r = repeated.withColumnsRenamed({c: f"{c}_2" for c in same})
    found = rows.join(r, [rows[c].eqNullSafe(r[f"{c}_2"]) for c in same], "left_semi").withColumn("part", F.shiftright("row", 33))
    found = stored(found, "mix-repeated")
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = found.groupBy(*same, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    parts = parts.select(*(F.col(c).alias(f"{c}_2") for c in same), F.col("part").alias("part_2"), "before")
    place = F.row_number().over(Window.partitionBy(*same, "part").orderBy("row"))
    on = [found[c].eqNullSafe(parts[f"{c}_2"]) for c in (*same, "part")]
    numbers = found.withColumn("place", place).join(parts, on).select("row", (F.col("before") + F.col("place") - 1).alias("again"))
    return rows.join(numbers, "row", "left").withColumn("again", F.coalesce("again", F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (source, source_size) with target: shares by weight, stopped at `most` times the size, the excess reshared.

    Only sums come to the driver, once a round; each round stops at least one more source, or is the last.
    """
    numbered = _ranked(sources)
    weighed = stored(numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double")).drop("rank"), "mix-sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    stop = F.col("source_size").cast("double") * most
    while True:
        over = F.col("w") * F.lit(share) >= stop
        row = weighed.agg(F.sum(F.when(over, stop)).alias("fixed"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        new = (total - (row.fixed or 0.0)) / row.w if row.w else share
        now = F.col("w") * F.lit(new) >= stop
        if not row.w or not weighed.where(now & ~over).limit(1).count():
            return weighed.withColumn("target", F.when(now, stop).otherwise(F.col("w") * F.lit(new))).drop("w")
        share = new


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, slices: int = 1024, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row; and row, if the rows have numbers. A row at the cut is taken in part. See the module."""
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`").cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(number.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"))
    rows = _numbered_repeats(stored(rows, "mix-sizes"))
    key = F.xxhash64(F.lit(seed), "doc_id", "source", "size", "again")
    bits = max(1, (slices - 1).bit_length())
    rows = stored(rows.withColumn("key", key).withColumn("slice", F.shiftrightunsigned("key", 64 - bits).cast("int")), "mix-rows")
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_slice.withColumn("offset", F.coalesce(before, F.lit(0))).drop("slice_size")
    offsets = offsets.join(sources, offsets.source.eqNullSafe(sources.source)).drop(sources.source)
    offsets = offsets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    offsets = offsets.withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    in_slice = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "again").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("prior", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    both = run.join(offsets.withColumnsRenamed({"source": "s2", "slice": "slice2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("slice2")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("offset") - F.col("prior")))
    made = both.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    return made if row_col else made.drop("row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row is repeated as often as it is taken whole, and cut to its first words where it is taken in part.

    Each row follows its own plan, by a number that is stored beside it.
    """
    row, other, size, taken, copy = (free_name(docs, x) for x in ("row", "other_row", "size", "taken", "copy"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", texts=True)
    plan = mix(rows, id_col, text_col, source_col, row_col=row).where("taken > 0")
    plan = plan.select(F.col("row").alias(other), F.col("size").alias(size), F.col("taken").alias(taken))
    times = F.ceil(F.col(taken) / F.col(size)).cast("int")
    out = rows.join(plan, rows[row] == plan[other]).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    text = F.col(f"`{text_col}`")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), 1, left.cast("int")), "")
    cut = {text_col: F.when(left >= F.col(size), text).otherwise(head)}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.when(left >= F.col(size), F.col("n_chars")).otherwise(F.length(head)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns))
