"""Window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosaic.functions import text

DAY_MICROS = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def repeats_before(df: DataFrame, key: str, ts: str, span: int = DAY_MICROS) -> DataFrame:
    """repeats: earlier rows of the same key within the span.

    Rows of one key and time are summed first. A key's times are cut into slices as long as the span, and a row needs its own slice and the
    one before it alone, so a key that many rows share is as many tasks as it has slices.
    """
    at = micros(F.col(ts))
    sums = df.select(F.col(key).alias("repeat_key"), at.alias("repeat_time")).groupBy("repeat_key", "repeat_time").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("repeat_time") / span))
    # A slice's rows stand in their own slice, and as history in the next.
    both = sums.withColumn("own", F.lit(True)).unionByName(sums.withColumn("slice", F.col("slice") + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("repeat_key", "slice").orderBy("repeat_time").rangeBetween(-span, -1)
    counts = both.withColumn("repeats_found", F.coalesce(F.sum("n").over(w), F.lit(0))).where("own").select("repeat_key", "repeat_time", "repeats_found")
    joined = df.withColumn("repeat_at", at).join(counts, F.col(key).eqNullSafe(F.col("repeat_key")) & F.col("repeat_at").eqNullSafe(F.col("repeat_time")), "left")
    return joined.select(*(F.col(c) for c in df.columns), F.coalesce("repeats_found", F.lit(0)).alias("repeats"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by the order: deterministic, and Spark limits each task's group first."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def version_chain(df: DataFrame, keys: list[str], ts: str, id_col: str) -> DataFrame:
    """version, supersedes, superseded_by, valid_until of each row within its key."""
    w = Window.partitionBy(*keys).orderBy(ts, id_col)
    return df.withColumns({"version": F.row_number().over(w), "supersedes": F.lag(id_col).over(w), "superseded_by": F.lead(id_col).over(w), "valid_until": F.lead(ts).over(w)})


def as_of(versions: DataFrame, ts: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    return versions.where((F.col(start) <= ts) & (F.col(end).isNull() | (F.col(end) > ts)))


def contradictions(df: DataFrame, keys: list[str], order: str, content: str, last: int = 100) -> DataFrame:
    """contradicts: the latest of the `last` rows before it with the words that a row's negation speaks against.

    Each pair of words carries the order value of its last statement, so the frame holds one value for each pair and no texts.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-last, -1)
    found = [
        F.when(F.contains(content, F.lit(no)), F.last(F.when(F.contains(F.lower(content), F.lit(yes)), F.col(order)), ignorenulls=True).over(w))
        for no, yes in text.CONTRADICTIONS
    ]
    return df.withColumns({"contradicts": F.coalesce(*found), "corrects": F.col(content).rlike(f"(?i){text.any_of(text.CORRECTIONS)}")})


def running_stats(df: DataFrame, key: str, ts: str, row_id: str, value: str, slices: int = 64) -> DataFrame:
    """running_n, running_min, running_max and running_avg of value up to each row of a key.

    A key's rows are cut into slices of time; sums over the slices, of which each key has `slices` at most, give what came before, so a
    key with any share of the rows is spread over as many tasks.
    """
    at = micros(F.col(ts))
    span = df.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    cut = df.crossJoin(F.broadcast(span)).withColumn("part", F.least(F.lit(slices - 1), F.floor((at - F.col("low")) * slices / (F.col("high") - F.col("low") + 1)))).drop("low", "high")
    v = F.col(value)
    sums = cut.groupBy(key, "part").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("k2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.min("lo").over(before).alias("lo0"), F.max("hi").over(before).alias("hi0"))
    w = Window.partitionBy(key, "part").orderBy(ts, row_id).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({"n1": F.count(v).over(w), "s1": F.sum(v).over(w), "lo1": F.min(v).over(w), "hi1": F.max(v).over(w)})
    both = run.join(sums, F.col(key).eqNullSafe(F.col("k2")) & (F.col("part") == F.col("p2")))
    n, total = F.col("n0") + F.col("n1"), F.col("s0") + F.coalesce("s1", F.lit(0.0))
    return both.select(*df.columns, n.alias("running_n"), F.least("lo0", "lo1").alias("running_min"), F.greatest("hi0", "hi1").alias("running_max"), (total / F.nullif(n, F.lit(0))).alias("running_avg"))


def click_weights(clicks: DataFrame, key: str, ts: str, row_id: str, scores: str, start: tuple[float, ...] = (0.40, 0.25, 0.20, 0.15), rate: float = 0.1, low: float = 0.05, high: float = 0.8) -> DataFrame:
    """key, weights after all of a key's clicks in their order. Rows of a key stream through one task; only the weights are held."""
    import numpy as np
    import pandas as pd

    rows = clicks.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.col(row_id).alias("r"), F.col(scores).cast("array<double>").alias("x"))
    kind = rows.schema["k"].dataType.simpleString()

    def fold(frames):  # noqa: ANN001, ANN202
        now, w = None, None
        for frame in frames:
            out = []
            for k, x in zip(frame["k"].tolist(), frame["x"]):
                if w is None or k != now:
                    if w is not None:
                        out.append((now, w.tolist()))
                    now, w = k, np.array(start)
                total = np.sum(x) if x is not None else 0
                if total:
                    w = np.clip(w + (np.array(x) / total - w) * rate, low, high)
                    w = w / w.sum()
            if out:
                yield pd.DataFrame(out, columns=[key, "weights"])
        if w is not None:
            yield pd.DataFrame([(now, w.tolist())], columns=[key, "weights"])

    return rows.repartition("k").sortWithinPartitions("k", "t", "r").mapInPandas(fold, f"{key} {kind}, weights array<double>")
