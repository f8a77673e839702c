"""Structured Streaming forms of the per-message hooks, run to the end of what is there (AvailableNow)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemosaic.functions import text
from mnemosaic.sources.io import staging


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives for what its source holds, as a table in the shared folder."""
    spark, out, state = stream.sparkSession, staging(stream.sparkSession, "stream-out"), staging(stream.sparkSession, "stream-state")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tiered(stream: DataFrame) -> DataFrame:
    """Batches written by tier, to the end of what is there."""
    spark, out, state = stream.sparkSession, staging(stream.sparkSession, "tiers"), staging(stream.sparkSession, "stream-state")
    q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").partitionBy("tier").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table that is one file or a folder of files: as a glob, a path may be either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def capture(messages: DataFrame) -> DataFrame:
    """The facts that each message which isn't noise gives, a row each, with the message's fingerprint and its first 200 characters as transcript; stateless."""
    kept = messages.where(~text.is_noise(F.col("text"))).withColumn("fact", F.explode(text.quick_extract(F.col("text"))))
    return kept.select("conv_id", "turn", text.fingerprint(F.col("text")).alias("fingerprint"), "fact.type", "fact.content", "fact.importance", F.substring("text", 1, 200).alias("transcript"), text.fingerprint(F.col("fact.content")).alias("fact_fingerprint"))


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(ts.alias("ts"), "event_type", "value").withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def recall_guard(events: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """ts, user_id, event_type of the admitted rows: those later than a key's last admitted one by more than the TTL, or its first.

    It is the limiter below with one row in the span. Only admitted times count, as in the reference, and rows without a time are turned away.
    """
    keys = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ("user_id", "event_type"))
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.to_json(F.struct("user_id", "event_type")).alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("at"))
    admitted = repeat_limiter(rows, "key", "ts", "at", 1, ttl_seconds).where("admitted")
    return admitted.select(F.timestamp_micros("row_id").alias("ts"), F.from_json("key", keys).alias("k")).select("ts", "k.*")


def repeat_limiter(messages: DataFrame, key: str, ts: str, row_id: str, most: int = 3, span_seconds: int = 86_400) -> DataFrame:
    """key, row_id, admitted: at most `most` admitted rows of a key within the span; rows that are turned away don't count.

    The state of a key is its last admitted times, `most` at most, and it goes when the span has passed in event time. Rows
    of one batch are taken in the order of their time, then row_id; equal times count as earlier. Null times are turned away.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "row_id"], kind="stable", ignore_index=True)
        times = list(state.get[0]) if state.exists else []
        admitted = []
        for at in rows["at"]:
            ok = not pd.isna(at) and sum(at - t <= span_seconds * 1_000_000 for t in times) < most
            if ok:
                times = [*times, int(at)][-most:]
            admitted.append(ok)
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(times[-1] // 1000 + span_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "row_id": rows["row_id"], "admitted": admitted})

    t = F.col(ts).cast("timestamp")
    rows = messages.select(F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("row_id"), t.alias("ts"), F.unix_micros(t).alias("at")).withWatermark("ts", f"{span_seconds} seconds")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, row_id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
