"""Records of memories: creations, updates, deletions, their history and the changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "parent_id", "type", "content", "importance", "created_at", "version", "commit_hash", "diff_ratio", "action", "reason", "trigger")


def commit_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict.fromkeys(COLUMNS, "string") | {"importance": "double", "created_at": "timestamp_ntz", "diff_ratio": "double"}
    return df.select(*(columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS))


def created(df: DataFrame, at: str = "created_at", trigger: str = "MANUAL") -> DataFrame:
    """The first version of each memory (id, type, content, importance)."""
    own = {c: F.col(c) for c in ("id", "type", "content", "importance")}
    return _rows(df, **own, created_at=F.col(at), version=F.lit("v1"), commit_hash=commit_hash(F.col("content")), action=F.lit("CREATE"), trigger=F.lit(trigger))


def diff_ratio(old: Column, new: Column) -> Column:
    """The difference of lengths against the longer one."""
    return F.abs(F.length(new) - F.length(old)) / F.greatest(F.length(old), F.length(new), F.lit(1))


def updated(df: DataFrame, old: str, new: str, at: str, trigger: str = "MANUAL", limit: float = 0.3) -> DataFrame:
    """A version of each update: the same id under the limit; from it on a new node, whose parent keeps the old content."""
    ratio = diff_ratio(F.col(old), F.col(new))
    node = F.concat(F.col("id").cast("string"), F.lit("_v"), F.unix_seconds(F.col(at).cast("timestamp")).cast("string"))
    big = ratio >= limit
    code = commit_hash(F.col(new))
    return _rows(
        df, id=F.when(big, node).otherwise(F.col("id").cast("string")), parent_id=F.when(big, F.col("id").cast("string")), type=F.col("type"), content=F.col(new), importance=F.col("importance"), created_at=F.col(at),
        version=F.concat(F.lit("v"), F.substring(code, 1, 4)), commit_hash=code, diff_ratio=F.round(ratio, 4), action=F.when(big, "CREATE_NEW_NODE").otherwise("UPDATE"), trigger=F.lit(trigger),
    )


def deleted(df: DataFrame, at: str, reason: str = "MANUAL", trigger: str = "MANUAL") -> DataFrame:
    """Tombstones."""
    return _rows(df, id=F.col("id"), created_at=F.col(at), action=F.lit("DELETED"), reason=F.lit(reason), trigger=F.lit(trigger))


def history(versions: DataFrame, memory_id: str) -> DataFrame:
    """All versions of one memory, in order; ids are compared whole."""
    return versions.where(F.col("id") == memory_id).orderBy("created_at", "action")


def recall_at(versions: DataFrame, at: Column) -> DataFrame:
    """Each memory's newest version at a time; tombstones are passed over."""
    rows = versions.where((F.col("created_at") <= at) & (F.col("action") != "DELETED"))
    newest = F.max_by(F.struct("content", "version", "created_at"), F.struct("created_at", "action"))
    return rows.groupBy("id").agg(newest.alias("x")).select("id", "x.*")


def changelog(versions: DataFrame) -> DataFrame:
    """One Markdown block for each row: a heading with time, event and id, and a table of what is known."""
    event = F.when(F.col("action") == "CREATE_NEW_NODE", "CREATE").when(F.col("action") == "DELETED", "DELETE").otherwise(F.col("action"))
    cells = [("Type", F.col("type")), ("Importance", F.col("importance").cast("string")), ("Parent", F.col("parent_id")), ("Difference", F.format_string("%.4f", "diff_ratio")), ("Reason", F.col("reason")), ("Preview", F.regexp_replace(F.substring("content", 1, 80), r"[\n|]", " "))]
    known = {"Difference": "diff_ratio", "Preview": "content"}
    lines = [F.when(F.col(known[k]).isNotNull() if k in known else v.isNotNull(), F.concat(F.lit(f"| **{k}** | "), v, F.lit(" |"))) for k, v in cells]
    head = F.concat(F.lit("## ["), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), event, F.lit(" - "), F.col("id"))
    trigger = F.concat(F.lit("| **Trigger** | "), F.col("trigger"), F.lit(" |"))
    return versions.select("created_at", "id", "action", F.concat_ws("\n", head, trigger, *lines, F.lit("---")).alias("block"))


def parsed_changelog(blocks: DataFrame) -> DataFrame:
    """timestamp, event_type, memory_id and fields (a map of the table's cells) of blocks; others are left out."""
    head = r"(?m)^## \[([^\]]*)\] (\w+) - (.*)$"
    cells = lambda n: F.transform(F.regexp_extract_all("block", F.lit(r"(?m)^\| \*\*([^*]*)\*\* \| (.*) \|$"), F.lit(n)), lambda x: F.trim(x))
    rows = blocks.where(F.col("block").rlike(head))
    return rows.select(*(F.regexp_extract("block", head, n).alias(c) for n, c in enumerate(("timestamp", "event_type", "memory_id"), 1)), F.map_from_arrays(cells(1), cells(2)).alias("fields"))
