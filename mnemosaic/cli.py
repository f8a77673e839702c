"""Command line over a folder of memories (Parquet: id, content, type, importance, created_at, ...).

python -m mnemosaic.cli stats|list|search|export|import|delete FOLDER ...
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosaic.operators import search
from mnemosaic.sources import io


def stats(memories: DataFrame) -> DataFrame:
    """type, count, average importance and how many are in each band; one row for each type and one for all."""
    imp = F.col("importance")
    return memories.rollup("type").agg(
        F.count("*").alias("memories"), F.round(F.avg(imp), 4).alias("importance"), F.count_if(imp >= 0.8).alias("high"), F.count_if((imp >= 0.5) & (imp < 0.8)).alias("medium"), F.count_if(imp < 0.5).alias("low"),
    ).orderBy(F.col("type").asc_nulls_first())


def recent(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy(F.desc("created_at"), "id").limit(n)


def find(memories: DataFrame, words: str, n: int) -> DataFrame:
    asked = memories.sparkSession.createDataFrame([(0, words)], "qid long, q string")
    return search.top(search.bm25(memories, asked), n).join(memories, "id").orderBy("rank").select("rank", "id", F.round("score", 4).alias("score"), "content")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="mnemosaic", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="what", required=True)
    for name, extra in {"stats": (), "list": ("-n",), "search": ("words", "-n"), "export": ("to",), "import": ("source",), "delete": ("id", "to")}.items():
        one = sub.add_parser(name)
        one.add_argument("folder")
        for a in extra:
            one.add_argument(a, **({"type": int, "default": 10} if a == "-n" else {}))
        if name in ("export", "import"):
            one.add_argument("--md", action="store_true", help="notes with a front matter instead of JSON lines")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("mnemosaic").getOrCreate()
    if a.what == "import":
        kept = spark.read.parquet(a.folder)
        rows = io.read_cold(spark, a.source) if a.md else spark.read.schema(kept.schema).json(a.source)
        io.append(io.shaped(rows, kept.schema), a.folder)
        return 0
    memories = spark.read.parquet(a.folder)
    if a.what == "export":
        io.write_cold(memories, a.to) if a.md else memories.write.json(a.to)
    elif a.what == "delete":  # to a new folder: a table can't be overwritten while it is read
        memories.where(F.col("id").cast("string") != a.id).write.parquet(a.to)
    else:
        {"stats": stats, "list": lambda m: recent(m, a.n), "search": lambda m: find(m, a.words, a.n)}[a.what](memories).show(a.n if a.what != "stats" else 20, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main())
