"""Sources and sinks beyond plain Parquet."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemosaic.functions import files as fileinfo


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local master, as in tests, gets one of its own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "mnemosaic-checkpoints")
    return where.rstrip("/")


def staging(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/mnemosaic/{name}-{uuid.uuid4().hex}"


def json_roundtrip(df: DataFrame) -> DataFrame:
    """A backup as JSON lines, and its restoration with the same schema."""
    path = staging(df.sparkSession, "backup")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines."""
    df.write.mode("append").json(path)


def tail(rows: DataFrame, n: int, at: str = "timestamp") -> DataFrame:
    """The last n rows of a log."""
    return rows.orderBy(F.desc(at)).limit(n)


#: Side files, as JSON: the graph, decay states, feedback, versions, recalls and pools.
SIDE_FILES = {
    "kg_nodes": "name string, type string, properties map<string,string>, mention_count int, created_at string, last_seen string",
    "kg_edges": "src string, dst string, relation string, weight double, created_at string",
    "decay_states": "id string, initial_importance double, current_importance double, memory_type string, access_count int, created_at string, last_access string, next_decay_check string, boost_events array<struct<timestamp:string,days_elapsed:double,survival_before:double,decayed_importance:double,boost_applied:double,new_importance:double>>",
    "feedback": "memory_id string, query string, position int, timestamp string, channel_scores map<string,double>",
    "versions": "memory_id string, type string, valid_from string, valid_until string, version int, supersedes string, superseded_by string",
    "recalls": "content_hash string, memory_id string, ts string, preview string",
    "pools": "id string, pool string, source string, recalled_count int",
}


def read_side_file(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(SIDE_FILES[name]).json(path)


def write_side_file(df: DataFrame, name: str, path: str) -> None:
    """df with the columns of the side file, cast to its types; what it lacks is null."""
    kinds = df.sparkSession.createDataFrame([], SIDE_FILES[name]).schema
    df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds)).write.mode("overwrite").json(path)


# The parts of a session file, in order.
SECTIONS = (("current_task", "Current Task"), ("key_context", "Key Context"), ("pending_actions", "Pending Actions"), ("recent_decisions", "Recent Decisions"), ("user_preferences", "User Preferences"), ("important_facts", "Important Facts"))
EMPTY = {"current_task": "[None]", "pending_actions": "- [ ] None"}


def session_text(sessions: DataFrame) -> DataFrame:
    """path, value: a session file of each row (path and a column for each section)."""
    parts = [F.concat(F.lit(f"## {title}\n"), F.coalesce(F.col(name), F.lit(EMPTY.get(name, "[None yet]"))), F.lit("\n")) for name, title in SECTIONS]
    return sessions.select("path", F.concat(F.lit("# Session\n\n"), F.concat_ws("\n", *parts), F.lit("\n---\n")).alias("value"))


def parsed_sessions(files: DataFrame) -> DataFrame:
    """path and a column for each section of files (path, value); a section that is missing has the empty state's text."""
    found = lambda title: F.trim(F.regexp_extract("value", rf"(?s)## {title}\s*\n(.*?)(?=\n## |\n?---)", 1))
    has = lambda title: F.col("value").rlike(rf"(?s)## {title}\s*\n(.*?)(?=\n## |\n?---)")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return files.select("path", *(F.when(has(title), strip(found(title))).otherwise(F.lit(EMPTY.get(name, "[None yet]"))).alias(name) for name, title in SECTIONS))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, value of the Markdown files of a folder, each whole."""
    return spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as attachments: name, bytes, hash, and what attached() says of them."""
    files = spark.read.format("binaryFile").load(path)
    return attached(files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash_sha256")))


def attached(files: DataFrame) -> DataFrame:
    """files (filename, size_bytes) with type, MIME type, size as text, and why a file isn't taken: its type, or its size."""
    kind = fileinfo.file_type(F.col("filename"))
    refused = F.when(F.col("file_type").isNull(), "type").when(F.col("size_bytes") > fileinfo.most_bytes(F.col("file_type")), "size")
    return files.withColumn("file_type", kind).withColumns({"mime_type": fileinfo.mime_type(F.col("filename")), "size_text": fileinfo.size_text(F.col("size_bytes")), "refused": refused})


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, n, title, body: parts of (path, value) at headings; parts under 10 characters are left out."""
    parts = files.select("path", F.posexplode(F.split("value", r"(?m)^#{1,3}\s+")).alias("n", "part")).where(F.length(F.trim("part")) >= 10)
    return parts.select("path", "n", F.substring(F.element_at(F.split("part", "\n"), 1), 1, 100).alias("title"), F.substring(F.regexp_replace("part", r"^\s+|\s+$", ""), 1, 500).alias("body"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, operation string, action string, record_count int").json(path)


def write_by_tier(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("tier").json(path)


def write_cold(df: DataFrame, path: str) -> None:
    """One text for each memory (id, content, type, importance, created_at), as a front matter and its content, by day."""
    head = F.format_string("---\nid: %s\ntype: %s\nimportance: %s\ncreated_at: %s\n---\n", F.col("id").cast("string"), "type", F.col("importance").cast("string"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    df.select(F.to_json(F.struct(F.concat(head, F.coalesce("content", F.lit(""))).alias("note"))).alias("value"), F.to_date("created_at").alias("day")).write.mode("append").partitionBy("day").text(path)


def read_cold(spark: SparkSession, path: str) -> DataFrame:
    """Memories out of cold storage, whole texts included; notes without a front matter are left out."""
    note = F.get_json_object("value", "$.note")
    of = lambda name: F.regexp_extract(note, rf"(?m)^{name}: (.*)$", 1)
    rows = spark.read.text(path).where(note.rlike(r"^---\n(?s:.*?)\n---\n"))
    return rows.select(of("id").alias("id"), F.regexp_replace(note, r"^---\n(?s:.*?)\n---\n", "").alias("content"), of("type").alias("type"), of("importance").cast("double").alias("importance"), of("created_at").cast("timestamp_ntz").alias("created_at"))


def anonymized(rows: DataFrame, which: Column) -> DataFrame:
    """Memories whose content and summary are taken out where the condition holds, and whose transcript is null there."""
    return rows.withColumns({"content": F.when(which, "[removed]").otherwise(F.col("content")), "summary": F.when(which, "[removed]").otherwise(F.col("summary")), "transcript": F.when(~which, F.col("transcript"))})


def backup(df: DataFrame, path: str, name: str) -> None:
    """df as JSON lines under the name, all of it."""
    df.write.mode("overwrite").json(f"{path}/name={name}")


def list_backups(spark: SparkSession, path: str) -> DataFrame:
    """name, n: the backups under a path and their rows."""
    return spark.read.json(path).groupBy("name").agg(F.count("*").alias("n"))


def restore_backup(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.json(f"{path}/name={name}")


def delete_backup(spark: SparkSession, path: str, name: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/name={name}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: The table of memories.
MEMORIES = (
    "id string, type string, content string, summary string, importance double, source string, transcript string, tags array<string>, scope string, scope_id string, vector array<float>, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, last_accessed timestamp_ntz, access_count int, revision_chain array<string>, superseded_by string, decay_score double, decay_rate double"
)


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The table of memories at a path, which is made, empty, where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], MEMORIES).write.parquet(path)
    return spark.read.schema(MEMORIES).parquet(path)


def shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with the columns of a schema: cast where they are there, null where they aren't."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
