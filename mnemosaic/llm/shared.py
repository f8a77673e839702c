"""What several operators of this subpackage need: tables in the shared folder, and graph components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, gets a folder of its own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = f"{tempfile.gettempdir()}/mnemosaic-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/mnemosaic/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, and survives lost executors. texts: most of it is text that hardly repeats."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not texts).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def needed(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Just the named input columns, cast: needed(df, doc_id=("id", "long")). Extra columns can't clash then."""
    return df.select(*(F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in columns.items()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def unsigned_hex(col: Column) -> Column:
    """16 lowercase hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


FILTER_BITS = 27


def sifted(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """rows whose value is in wanted, and few others: all but the former can be told by a join, which then has little to move.

    A filter of 2**27 bits, however large the tables are: at most 2**21 words of it are broadcast, some 64 MB. Where it is too
    full to keep much out, all rows still pass that must.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.col("bit_place")
    words = wanted.select(place(wanted_column).alias("bit_place")).groupBy(F.shiftright(bit, 6).alias("bit_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit_place & 63 AS int))")).alias("bit_mask"))
    met = rows.withColumn("bit_place", place(column)).withColumn("bit_word", F.shiftright(bit, 6)).join(F.broadcast(words), "bit_word")
    return met.where(F.expr("shiftright(bit_mask, cast(bit_place & 63 AS int)) & 1 = 1")).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, root): root is the smallest node of node's component.

    edges has columns a and b; loops, repeats and both directions are allowed; nodes without a real edge
    may be missing in the result. Large-star and small-star rounds alternate: every node's edges are moved
    to its smallest neighbour, until only stars are left. Minima are pre-aggregated before each shuffle, hot
    nodes are joined by sort-merge joins, which AQE splits, and nothing comes to the driver but a count.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: a's larger neighbours move to the smallest node near a, and so does a itself.
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.where("m < a").select("a", F.col("m").alias("b"))
        return moved.unionByName(own).where("a > b").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Done when each larger node has one edge, and no root has an edge to something smaller.
        facts = now.groupBy("a").agg(F.count("*").alias("n"))
        if not facts.where("n > 1").limit(1).count() and not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = stored(small(star(now)), "edges")
