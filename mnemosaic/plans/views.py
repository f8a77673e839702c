"""The memory model over the test tables: a DataFrame and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that counts as now, so results don't change from day to day.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """documents as memories: id, content, type, importance, times, access_count, scope, scope_id, source, lang."""
    return table(spark, d, "documents").selectExpr(
        "doc_id AS id", "text AS content", "lang",
        "element_at(array('fact','preference','decision','lesson','entity','task_state'), cast(doc_id % 6 + 1 AS int)) AS type",
        "((doc_id * 37) % 101) / 100D AS importance",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 AS int)) AS created_at",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 + doc_id % 48 AS int)) AS last_accessed",
        "cast(doc_id % 15 AS int) AS access_count",
        "element_at(array('global','user','project'), cast(doc_id % 3 + 1 AS int)) AS scope",
        "concat('s', doc_id % 7) AS scope_id",
        "CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source",
    )


MEM = """mem AS (SELECT doc_id AS id, text AS content, lang,
  ['fact','preference','decision','lesson','entity','task_state'][doc_id % 6 + 1] AS type,
  ((doc_id * 37) % 101)::DOUBLE / 100 AS importance,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720 + doc_id % 48) AS last_accessed,
  (doc_id % 15)::INT AS access_count, ['global','user','project'][doc_id % 3 + 1] AS scope,
  's' || (doc_id % 7) AS scope_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source FROM documents)"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, relation: customers in nations, nations in regions, suppliers in nations."""
    c = table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst", "'lives_in' AS relation")
    n = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst", "'part_of' AS relation")
    s = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst", "'based_in' AS relation")
    return c.unionByName(n).unionByName(s)


def name_graph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: words of six letters or more that follow each other in a benchmark item, each pair once."""
    names = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))
    pairs = table(spark, d, "benchmark").select(names.alias("n")).where("size(n) > 1")
    pairs = pairs.select(F.explode(F.zip_with("n", F.slice("n", 2, F.size("n") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("x"))
    return pairs.select("x.src", "x.dst").where("dst IS NOT NULL AND src <> dst").distinct()


NAME_GRAPH = """nm AS (SELECT regexp_extract_all(lower(text), '[a-z]{6,}') AS ns FROM benchmark),
ge AS (SELECT DISTINCT ns[i] AS src, ns[i + 1] AS dst FROM nm, range(1, 10000) t(i) WHERE i < len(ns) AND ns[i] <> ns[i + 1])"""


EDGES = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS relation FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in' FROM supplier)"""


def literals(spark: SparkSession, values: list[str]) -> DataFrame:
    """q: one row for each text."""
    return spark.createDataFrame([(v,) for v in values], "q string")


def said(spark: SparkSession, d: str, values: list[str]) -> DataFrame:
    """q: literals and every message's text, each once."""
    return literals(spark, values).unionByName(table(spark, d, "conversations").select(F.col("text").alias("q")).where("q IS NOT NULL")).distinct()


def said_sql(values: list[str]) -> str:
    return literal_sql(values)[:-1].replace("SELECT * FROM (VALUES", "SELECT q FROM (VALUES", 1) + " UNION SELECT text FROM conversations WHERE text IS NOT NULL)"


def literal_sql(values: list[str]) -> str:
    return "l AS (SELECT * FROM (VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + ") AS t(q))"

