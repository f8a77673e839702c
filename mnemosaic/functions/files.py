"""Files: types, MIME types, sizes as text and classes of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension, the most megabytes of each type, and MIME types.
TYPES = {
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp"), "document": ("pdf", "doc", "docx", "txt", "md"), "code": ("py", "js", "ts", "java", "cpp", "go", "rs", "sh", "yaml", "json"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac"), "video": ("mp4", "webm", "mov", "avi"), "archive": ("zip", "tar", "gz", "rar"),
}
MOST_MB = {"image": 20, "document": 50, "code": 5, "audio": 30, "video": 200, "archive": 100}
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "py": "text/x-python", "js": "text/javascript", "ts": "text/typescript",
    "java": "text/x-java", "cpp": "text/x-c++src", "go": "text/x-go", "rs": "text/x-rust", "sh": "application/x-sh", "yaml": "text/yaml", "json": "application/json", "mp3": "audio/mpeg",
    "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4", "flac": "audio/flac", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "rar": "application/vnd.rar",
}
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(F.lower(name), r"\."), -1)).otherwise("")


def file_type(name: Column) -> Column:
    """image, document, code, audio, video or archive; null for others, which aren't taken."""
    kinds = F.create_map(*(F.lit(x) for kind, found in TYPES.items() for e in found for x in (e, kind)))
    return F.element_at(kinds, extension(name))


def mime_type(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension(name)), F.lit("application/octet-stream"))


def most_bytes(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MOST_MB.items() for x in kv)), kind).cast("long") * 1024 * 1024


def size_text(size: Column) -> Column:
    """Bytes with one digit, in steps of 1024; halves go to the even digit."""
    out = F.lit(None).cast("string")
    for n, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        value = size.cast("double") / 1024**n
        out = F.when((value < 1024) | (F.lit(unit) == "TB"), F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(unit))).otherwise(out)
    return out


def error_class(message: Column) -> Column:
    """By words of a message; the words are fixed values, as messages of the services they name have them."""
    low = F.lower(message)
    return F.when(low.rlike("ollama|connection"), "not_connected").when(low.rlike("database|lance"), "not_initialized").when(low.contains("timeout"), "search_failed").otherwise("unknown")


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID)
