"""Sources, sinks, version chains, joins on records and maintenance of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import files, scoring, temporal
from mnemosaic.operators import windows
from mnemosaic.sources import io
from mnemosaic.sources.transactions import SnapshotTable

from .registry import query
from .views import MEM, NOW, literals, memories, table

CHAIN = "v AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS valid_from, row_number() OVER w AS version, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderdate) OVER w AS valid_until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _chain(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS key", "o_orderdate AS valid_from")
    return windows.version_chain(o, ["key"], "valid_from", "id")


@query("w6_r6_versions", f"WITH {CHAIN} SELECT * FROM v")
def w6(spark, d):
    return _chain(spark, d)


@query("j15_w9_asof", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, max(o_orderdate) AS valid_from FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01' GROUP BY o_custkey")
def j15(spark, d):
    o = table(spark, d, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1998-06-01 00:00:00'")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("id"), F.max("o_orderdate").alias("valid_from"))


@query("q25_as_of_interval", f"WITH {CHAIN} SELECT key, id, version FROM v WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01')")
def q25(spark, d):
    return windows.as_of(_chain(spark, d), F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'")).select("key", "id", "version")


@query("j16_history_walk", f"WITH RECURSIVE {CHAIN}, h AS (SELECT id, key, supersedes, 0 AS step FROM v WHERE superseded_by IS NULL UNION ALL SELECT v.id, v.key, v.supersedes, h.step + 1 FROM h JOIN v ON v.id = h.supersedes) SELECT key, id, step FROM h")
def j16(spark, d):
    """Every version of each chain: its position replaces a recursive walk."""
    w = windows.Window.partitionBy("key").orderBy(F.desc("version"))
    return _chain(spark, d).withColumn("step", F.row_number().over(w) - 1).select("key", "id", "step")


@query("k8_u6_changelog", f"WITH {CHAIN} SELECT id, 'created' AS event, valid_from AS at FROM v WHERE valid_from >= TIMESTAMP '2001-06-01' UNION ALL SELECT id, 'superseded', valid_until FROM v WHERE valid_until >= TIMESTAMP '2001-06-01'")
def k8(spark, d):
    v, since = _chain(spark, d), F.expr("TIMESTAMP_NTZ '2001-06-01 00:00:00'")
    made = v.where(F.col("valid_from") >= since).select("id", F.lit("created").alias("event"), F.col("valid_from").alias("at"))
    return made.unionByName(v.where(F.col("valid_until") >= since).select("id", F.lit("superseded").alias("event"), F.col("valid_until").alias("at")))


@query("f26_prune_versions", f"WITH {CHAIN} SELECT count(*) AS kept FROM v WHERE valid_until IS NULL OR valid_until >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY")
def f26(spark, d):
    return _chain(spark, d).where("valid_until IS NULL OR valid_until >= TIMESTAMP_NTZ '2001-08-01 00:00:00' - INTERVAL 90 DAY").agg(F.count("*").alias("kept"))


@query("s4_point_lookup", f"WITH {MEM} SELECT id, content, type FROM mem WHERE id = 7 LIMIT 1")
def s4(spark, d):
    return memories(spark, d).where("id = 7").limit(1).select("id", "content", "type")


@query("s6_s7_delete_update", f"WITH {MEM} SELECT id, CASE WHEN id % 10 = 1 THEN access_count + 1 ELSE access_count END AS access_count FROM mem WHERE NOT contains(content, 'clown') AND id % 97 <> 5")
def s6(spark, d):
    m = memories(spark, d)
    touched = m.where("id % 10 = 1").selectExpr("id", "access_count + 1 AS new_count")
    kept = m.where(~F.contains("content", F.lit("clown")) & (F.col("id") % 97 != 5))
    return kept.join(touched, "id", "left").select("id", F.coalesce("new_count", "access_count").alias("access_count"))


@query("s3_k7_recent", f"WITH {MEM} SELECT id, type FROM mem ORDER BY created_at DESC, id LIMIT 20")
def s3(spark, d):
    return memories(spark, d).orderBy(F.desc("created_at"), "id").limit(20).select("id", "type")


@query("s13_s14_incremental_backup", f"WITH {MEM} SELECT type, id FROM mem WHERE last_accessed > TIMESTAMP '2024-01-20'")
def s13(spark, d):
    """Every row changed since then."""
    return memories(spark, d).where("last_accessed > TIMESTAMP '2024-01-20 00:00:00'").select("type", "id")


@query("s14_backup_retention", f"WITH {MEM}, b AS (SELECT DISTINCT last_accessed::DATE AS backup FROM mem) SELECT backup, row_number() OVER (ORDER BY backup DESC) <= 7 AS kept FROM b")
def s14(spark, d):
    """The newest seven of the daily backups stay, the others go; a day with changed rows has a backup."""
    made = memories(spark, d).select(F.to_date("last_accessed").alias("backup")).distinct()
    return made.withColumn("kept", F.row_number().over(windows.Window.orderBy(F.desc("backup"))) <= 7)


@query("s5_s8_s12_roundtrip", f"WITH {MEM} SELECT id, type, importance FROM mem WHERE importance >= 0.3")
def s5(spark, d):
    """Append, back up as JSON and restore."""
    return io.json_roundtrip(memories(spark, d).where("importance >= 0.3").select("id", "type", "importance"))


@query("s10_sections", "SELECT * FROM (VALUES ('a.md', 1, 'Facts', 'Facts' || chr(10) || 'likes tea and long walks'), ('a.md', 2, 'Tasks', 'Tasks' || chr(10) || 'write the report today')) AS t(path, n, title, body)")
def s10(spark, d):
    """Parts of a note; short ones are left out. The expected rows are written by hand."""
    text = "# Facts\nlikes tea and long walks\n## Tasks\nwrite the report today\n### x\nno"
    return io.markdown_sections(spark.createDataFrame([("a.md", text)], "path string, value string"))


@query("s16_cold_sink", f"WITH {MEM} SELECT id, strftime(created_at, '%Y-%m-%d') || '_' || substr(sha256(id::VARCHAR), 1, 8) || '.md' AS name FROM mem WHERE importance <= 0.5")
def s16(spark, d):
    return memories(spark, d).where("importance <= 0.5").select("id", F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit("_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), F.lit(".md")).alias("name"))


@query("s18_anonymize", f"WITH {MEM} SELECT id, CASE WHEN scope_id = 's2' THEN '[removed]' ELSE content END AS content, scope FROM mem WHERE scope_id <> 's4'")
def s18(spark, d):
    return memories(spark, d).where("scope_id <> 's4'").select("id", F.when(F.col("scope_id") == "s2", "[removed]").otherwise(F.col("content")).alias("content"), "scope")


_EXT = "lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1))"
_KIND = f"CASE WHEN {_EXT} IN ('png','jpg','jpeg','gif','webp','bmp') THEN 'image' WHEN {_EXT} IN ('pdf','doc','docx','txt','md') THEN 'document' WHEN {_EXT} IN ('py','js','ts','java','cpp','go','rs','sh','yaml','json') THEN 'code' END"


@query("s19_a25_attachments", f"WITH f AS (SELECT page_id, regexp_replace(url, '.*/', '') || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.py' WHEN 2 THEN '.exe' ELSE '.png' END AS url, strlen(html) * CASE WHEN page_id % 7 = 0 THEN 3000 ELSE 1 END AS size FROM pages), k AS (SELECT {_KIND} AS file_type, size FROM f) SELECT coalesce(file_type, 'other') AS file_type, count(*) AS n, count(*) FILTER (file_type IS NULL OR size > CASE file_type WHEN 'image' THEN 20 WHEN 'document' THEN 50 ELSE 5 END * 1048576) AS refused, sum(size)::BIGINT AS bytes FROM k GROUP BY 1")
def s19(spark, d):
    """Files by type, with those that aren't taken."""
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".py", ".exe", ".png"))), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, d, "pages").select(F.concat(F.regexp_replace("url", ".*/", ""), ending).alias("filename"), (F.octet_length("html") * F.when(F.col("page_id") % 7 == 0, 3000).otherwise(1)).cast("long").alias("size_bytes"))
    rows = io.attached(files)
    return rows.groupBy(F.coalesce("file_type", F.lit("other")).alias("file_type")).agg(F.count("*").alias("n"), F.count_if(F.col("refused").isNotNull()).alias("refused"), F.sum("size_bytes").alias("bytes"))


NAMES = [("Report.PDF", 512), ("a.tar.gz", 1280), ("photo.jpeg", 1048576), ("noext", 1024), ("x.py", 6 * 1024 * 1024), ("v.mp4", 5 * 1024**4), ("m.unknown", 1023)]


@query("x21_file_facts", "SELECT * FROM (VALUES ('Report.PDF', 'document', 'application/pdf', '512.0B', NULL), ('a.tar.gz', 'archive', 'application/gzip', '1.2KB', NULL), ('photo.jpeg', 'image', 'image/jpeg', '1.0MB', NULL), ('noext', NULL, 'application/octet-stream', '1.0KB', 'type'), ('x.py', 'code', 'text/x-python', '6.0MB', 'size'), ('v.mp4', 'video', 'video/mp4', '5.0TB', 'size'), ('m.unknown', NULL, 'application/octet-stream', '1023.0B', 'type')) AS t(filename, file_type, mime_type, size_text, refused)")
def x21(spark, d):
    """The expected rows are written by hand."""
    return io.attached(spark.createDataFrame(NAMES, "filename string, size_bytes long")).select("filename", "file_type", "mime_type", "size_text", "refused")


@query("x20_uuids", "SELECT event_id, regexp_full_match(CASE WHEN event_id % 3 = 0 THEN substr(md5(event_id::VARCHAR), 1, 8) || '-' || substr(md5(event_id::VARCHAR), 9, 4) || '-' || substr(md5(event_id::VARCHAR), 13, 4) || '-' || substr(md5(event_id::VARCHAR), 17, 4) || '-' || upper(substr(md5(event_id::VARCHAR), 21, 12)) ELSE md5(event_id::VARCHAR) || '-' END, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS ok FROM events")
def x20(spark, d):
    m = F.md5(F.col("event_id").cast("string"))
    made = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.upper(F.substring(m, 21, 12)))
    return table(spark, d, "events").select("event_id", files.is_uuid(F.when(F.col("event_id") % 3 == 0, made).otherwise(F.concat(m, F.lit("-")))).alias("ok"))


ERRORS = ["Connection refused", "ollama is down", "LanceDB: no table", "database locked", "read timeout", "division by zero", "Connection timeout"]


@query("x22_error_classes", "SELECT * FROM (VALUES ('Connection refused', 'not_connected'), ('ollama is down', 'not_connected'), ('LanceDB: no table', 'not_initialized'), ('database locked', 'not_initialized'), ('read timeout', 'search_failed'), ('division by zero', 'unknown'), ('Connection timeout', 'not_connected')) AS t(q, class)")
def x22(spark, d):
    return literals(spark, ERRORS).select("q", files.error_class(F.col("q")).alias("class"))


@query("s21_sessions", "SELECT * FROM (VALUES ('a.md', 'write', 'k: v', '- [ ] one\n- [ ] two', '[None yet]', 'tea', 'fact one'), ('b.md', '[None]', '[None yet]', '- [ ] None', 'spark', '[None yet]', '[None yet]')) AS t(path, current_task, key_context, pending_actions, recent_decisions, user_preferences, important_facts)".replace("\\n", "' || chr(10) || '"))
def s21(spark, d):
    """Session files written and read again; the expected rows are written by hand."""
    rows = [("a.md", "write", "k: v", "- [ ] one\n- [ ] two", None, "tea", "fact one"), ("b.md", None, None, None, "spark", None, None)]
    made = io.session_text(spark.createDataFrame(rows, "path string, current_task string, key_context string, pending_actions string, recent_decisions string, user_preferences string, important_facts string"))
    return io.parsed_sessions(made)


@query("s8_side_files", f"WITH {MEM} SELECT id::VARCHAR AS id, importance AS initial_importance, importance / 2 AS current_importance, type AS memory_type, access_count FROM mem")
def s8(spark, d):
    """States of decay in their side file, written and read."""
    path = io.staging(spark, "side")
    io.write_side_file(memories(spark, d).selectExpr("id", "importance AS initial_importance", "importance / 2 AS current_importance", "type AS memory_type", "access_count"), "decay_states", path)
    return io.read_side_file(spark, "decay_states", path).select("id", "initial_importance", "current_importance", "memory_type", "access_count")


@query("s9_audit_tail", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '/' || event_id AS timestamp, event_type AS operation, 'add' AS action, (event_id % 100)::INT AS record_count FROM events ORDER BY 1 DESC LIMIT 20")
def s9(spark, d):
    """A log that is added to twice, and its last twenty rows."""
    path = io.staging(spark, "audit")
    e = table(spark, d, "events").select(F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id").cast("string")).alias("timestamp"), F.col("event_type").alias("operation"), F.lit("add").alias("action"), (F.col("event_id") % 100).cast("int").alias("record_count"), "event_id")
    for part in (0, 1):
        io.append_lines(e.where(F.col("event_id") % 2 == part).drop("event_id"), path)
    return io.tail(io.audit_log(spark, path), 20)


@query("s18_export_delete", f"WITH {MEM} SELECT id, type, CASE WHEN scope_id = 's2' THEN '[removed]' ELSE substr(content, 1, 30) END AS content, CASE WHEN scope_id = 's2' THEN '[removed]' ELSE lang END AS summary, CASE WHEN scope_id <> 's2' THEN source END AS transcript FROM mem WHERE scope_id <> 's4' AND id <> 12")
def s18_more(spark, d):
    """What a person may ask for: rows of s4 deleted, one memory deleted, those of s2 made anonymous, and the rest given out."""
    m = memories(spark, d).withColumns({"summary": F.col("lang"), "transcript": F.col("source")}).where("scope_id <> 's4' AND id <> 12")
    return io.anonymized(m, F.col("scope_id") == "s2").select("id", "type", F.when(F.col("scope_id") == "s2", F.col("content")).otherwise(F.substring("content", 1, 30)).alias("content"), "summary", "transcript")


@query("s4_checked_lookup", "SELECT '0b7a3c10-1111-4222-8333-944445555666' AS id, true AS found")
def s4_checked(spark, d):
    """Lookups by id: what isn't a UUID finds nothing, whatever it says."""
    rows = spark.createDataFrame([("0b7a3c10-1111-4222-8333-944445555666",), ("x' OR 1=1",), ("0b7a3c10",)], "id string")
    asked = spark.createDataFrame([("0b7a3c10-1111-4222-8333-944445555666",), ("x' OR 1=1",)], "id string")
    return rows.join(asked.where(files.is_uuid(F.col("id"))), "id").select("id", F.lit(True).alias("found"))


@query("j20_m19_recall", f"WITH {MEM}, r AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY importance DESC, id) AS rank FROM mem), g AS (SELECT doc_id AS id FROM labels WHERE quality = 1), x AS (SELECT lang, count(*) FILTER (g.id IS NOT NULL) AS relevant, count(*) AS results, count(*) FILTER (g.id IS NOT NULL AND rank <= 10) AS hits FROM r LEFT JOIN g ON g.id = r.id GROUP BY lang UNION ALL VALUES ('none', 0, 5, 0), ('nothing', 0, 0, 0)) SELECT lang, round(CASE WHEN relevant = 0 THEN CASE WHEN results = 0 THEN 1.0 ELSE 0.0 END ELSE hits::DOUBLE / relevant END, 6)::DOUBLE AS recall10 FROM x")
def j20_recall(spark, d):
    """Recall in the first ten; without relevant rows it is 1 if nothing was found, else 0."""
    best = windows.newest(memories(spark, d).select("lang", "id", "importance"), ["lang"], [F.desc("importance"), F.col("id")], 10).select("id", F.lit(True).alias("first"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    m = memories(spark, d).select("lang", "id").join(good, "id", "left").join(best, "id", "left")
    x = m.groupBy("lang").agg(F.count_if("good").alias("relevant"), F.count("*").alias("results"), F.count_if(F.col("good") & F.col("first")).alias("hits"))
    x = x.unionByName(spark.createDataFrame([("none", 0, 5, 0), ("nothing", 0, 0, 0)], "lang string, relevant long, results long, hits long"))
    return x.select("lang", F.round(scoring.recall(F.col("hits"), F.col("relevant"), F.col("results")), 6).alias("recall10"))


@query("j12_f25_decay_state", f"WITH {MEM}, s AS (SELECT id, max(importance) * 0.5 AS current FROM mem WHERE id % 3 = 0 GROUP BY id) SELECT m.id, coalesce(s.current, m.importance) AS current, coalesce(s.current, m.importance) < 0.2 AS cold FROM mem m LEFT JOIN s ON m.id = s.id")
def j12(spark, d):
    m = memories(spark, d)
    s = m.where("id % 3 = 0").groupBy("id").agg((F.max("importance") * 0.5).alias("current"))
    now = F.coalesce("current", "importance")
    return m.join(s, "id", "left").select("id", now.alias("current"), (now < 0.2).alias("cold"))


@query("j13_recall_guard", "WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30 00:00:00') SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND r.event_type = e.event_type)")
def j13(spark, d):
    e, at = table(spark, d, "events"), "TIMESTAMP_NTZ '2024-01-30 00:00:00'"
    r = e.where(f"ts > {at} - INTERVAL 24 HOUR AND ts <= {at}").select("user_id", "event_type")
    return e.join(r, ["user_id", "event_type"], "left_anti").select("event_id")


@query("j14_a27_pools", f"WITH {MEM}, r AS (SELECT DISTINCT event_id % 50 AS id FROM events WHERE event_type = 'click') SELECT type, count(*) AS admitted FROM mem WHERE id NOT IN (SELECT id FROM r) GROUP BY type")
def j14(spark, d):
    r = table(spark, d, "events").where("event_type = 'click'").selectExpr("event_id % 50 AS id")
    return memories(spark, d).join(r, "id", "left_anti").groupBy("type").agg(F.count("*").alias("admitted"))


@query("j20_m19_mrr", f"WITH {MEM}, r AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY importance DESC, id) AS rank FROM mem), g AS (SELECT doc_id AS id FROM labels WHERE quality = 1) SELECT lang, round(1.0 / min(CASE WHEN g.id IS NOT NULL THEN rank END), 6)::DOUBLE AS mrr, count(*) FILTER (rank <= 10 AND g.id IS NOT NULL) AS hits10 FROM r LEFT JOIN g ON r.id = g.id GROUP BY lang")
def j20(spark, d):
    """The rank of each language's best relevant row is one more than the rows before it: counted, not numbered."""
    m = memories(spark, d).select("lang", "id", F.struct((-F.col("importance")).alias("i"), F.col("id").alias("k")).alias("place"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    relevant = m.join(good, "id", "left_semi")
    first = relevant.groupBy(F.col("lang").alias("l")).agg(F.min("place").alias("first"))
    before = m.join(first, m.lang.eqNullSafe(first["l"]), "left").groupBy("lang").agg(F.count_if(F.col("place") <= F.col("first")).alias("rank"))
    top10 = windows.newest(m, ["lang"], [F.col("place")], 10).join(good, "id", "left_semi").groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("hits10"))
    both = before.join(top10, before.lang.eqNullSafe(top10["l"]), "left")
    return both.select("lang", F.round(1.0 / F.nullif("rank", F.lit(0)), 6).alias("mrr"), F.coalesce("hits10", F.lit(0)).alias("hits10"))


@query("j21_r8_clicks", f"WITH {MEM}, c AS (SELECT event_id, event_id % 100 AS id, event_id % 8 + 1 AS position FROM events WHERE event_type = 'click') SELECT c.event_id, c.position, m.type FROM c JOIN mem m ON m.id = c.id")
def j21(spark, d):
    c = table(spark, d, "events").where("event_type = 'click'").selectExpr("event_id", "event_id % 100 AS id", "event_id % 8 + 1 AS position")
    return c.join(memories(spark, d).select("id", "type"), "id").select("event_id", "position", "type")


@query("r10_session_items", "SELECT conv_id, role AS section, count(DISTINCT text) AS items FROM conversations GROUP BY conv_id, role")
def r10(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("role").alias("section"), "text").distinct().groupBy("conv_id", "section").agg(F.count("text").alias("items"))


@query("r11_batch", f"WITH {MEM} SELECT id, importance FROM mem WHERE id % 11 <> 0 UNION ALL SELECT id + 1000000000, 0.5 FROM mem WHERE id % 13 = 0")
def r11(spark, d):
    """A batch: deletions by anti-join, insertions by union, staged and then swapped in by one write."""
    m = memories(spark, d).select("id", "importance")
    gone, made = m.where("id % 11 = 0").select("id"), m.where("id % 13 = 0").selectExpr("id + 1000000000 AS id", "0.5D AS importance")
    return m.join(gone, "id", "left_anti").unionByName(made)


@query("r11_a24_transaction", f"WITH {MEM} SELECT id, CASE WHEN id % 5 = 0 THEN 0.25 ELSE importance END AS importance FROM mem WHERE id % 11 <> 0 UNION ALL SELECT id + 1000000000, 0.5 FROM mem WHERE id % 13 = 0")
def r11_a24(spark, d):
    """A table of snapshots after a committed batch (deletions, updates, insertions), a batch rolled back, and one undone by a restore."""
    m = memories(spark, d).select("id", "importance")
    t = SnapshotTable.create(m, io.staging(spark, "transactions"))
    kept = t.begin().delete(m.where("id % 11 = 0")).update(m.where("id % 5 = 0").selectExpr("id", "0.25D AS importance")).store(m.where("id % 13 = 0").selectExpr("id + 1000000000 AS id", "0.5D AS importance")).commit()
    t.begin().delete(m).rollback()
    t.begin().delete(m.where("id % 2 = 0")).commit()
    t.restore(kept)
    return t.read()


@query("s17_cold_roundtrip", f"WITH {MEM} SELECT id::VARCHAR AS id, content, type, importance, created_at FROM mem WHERE importance <= 0.5")
def s17(spark, d):
    """Archived memories written to cold storage and brought back."""
    path = io.staging(spark, "cold")
    io.write_cold(memories(spark, d).where("importance <= 0.5"), path)
    return io.read_cold(spark, path)


@query("s1_open_or_create", f"WITH {MEM} SELECT id::VARCHAR AS id, type, importance, 1 AS access_count, NULL::DOUBLE AS decay_rate FROM mem WHERE id % 4 = 0")
def s1(spark, d):
    """A table that is made on the first call, opened on the second, and added to."""
    path = io.staging(spark, "memories")
    schema = io.open_or_create(spark, path).schema
    io.append(io.shaped(memories(spark, d).where("id % 4 = 0").select("id", "type", "content", "importance", F.lit(1).alias("access_count")), schema), path)
    return io.open_or_create(spark, path).select("id", "type", "importance", "access_count", "decay_rate")


TIMES = ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00+02:00", "2024-01-15 10:30:00", "2024-01-15", "1705314600000", "not a time", "", "12"]


@query("date_parsing", "SELECT * FROM (VALUES ('2024-01-15T10:30:00Z', TIMESTAMP '2024-01-15 10:30:00', 1705314600000), ('2024-01-15T10:30:00+02:00', TIMESTAMP '2024-01-15 08:30:00', 1705307400000), ('2024-01-15 10:30:00', TIMESTAMP '2024-01-15 10:30:00', 1705314600000), ('2024-01-15', TIMESTAMP '2024-01-15 00:00:00', 1705276800000), ('1705314600000', TIMESTAMP '2024-01-15 10:30:00', 1705314600000), ('not a time', NULL, NULL), ('', NULL, NULL), ('12', NULL, NULL)) AS t(q, parsed, millis)")
def dates(spark, d):
    """Times as text, in UTC; the expected rows are written by hand."""
    at = temporal.parsed_time(F.col("q"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    return literals(spark, TIMES).select("q", F.to_utc_timestamp(at, F.lit(zone)).cast("timestamp_ntz").alias("parsed") if zone != "UTC" else at.cast("timestamp_ntz").alias("parsed"), temporal.to_millis(at).alias("millis"))
