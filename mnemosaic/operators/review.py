"""A review of answers, as scores and as a report, and feedback on searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def report(scores: DataFrame) -> DataFrame:
    """name, text: a report of each name out of its metrics (name, metric, score, target), those that pass first marked."""
    line = F.concat(F.when(F.col("score") >= F.col("target"), "PASS ").otherwise("FAIL "), F.col("metric"), F.lit(": "), F.format_string("%.3f", "score"), F.lit(" (target "), F.format_string("%.3f", "target"), F.lit(")"))
    rows = scores.groupBy("name").agg(F.round(F.avg("score"), 3).alias("overall"), F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))).alias("x"))
    return rows.select("name", F.concat(F.lit("# Review of "), "name", F.lit("\noverall: "), F.format_string("%.3f", "overall"), F.lit("\n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("text"))


def feedback(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """qid, id, position, kind of search results (qid, id, rank) and clicks (qid, id): a click on a row that was shown counts with its position from 1, rows shown before the last click of a search without one are skips."""
    shown = searches.join(clicks.select("qid", "id").distinct().withColumn("clicked", F.lit(True)), ["qid", "id"], "left")
    last = F.max(F.when(F.col("clicked"), F.col("rank"))).over(Window.partitionBy("qid"))
    rows = shown.withColumn("last", last)
    kind = F.when(F.col("clicked"), "click").when(F.col("rank") < F.col("last"), "skip").otherwise("shown")
    return rows.select("qid", "id", F.col("rank").alias("position"), kind.alias("kind"))
