"""Evidence folders: files and the members of their archives as rows, what could not be read kept as rows too, and the search through them."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from changeproof.operators.privacy import line_of

# The largest file that is read, names searched for unless others are given, endings of files that have lines, and what a preview shows.
MOST_BYTES = 64 * 1024 * 1024
FORBIDDEN = ("Authorization", "Cookie", "Set-Cookie", "apikey")
TEXT_NAMES = r"(?i)\.(?:css|csv|html?|js|json|jsonl|md|mjs|network|trace|txt|xml|yaml|yml)$"
AROUND, MARK, SHOWN = 28, "[MATCH]", 72

MEMBER = "path string, place int, member string, method int, size long, crc long, data binary, problem string"
CONTENT = "path string, place int, member string, content binary, problem string"
#: Bytes after which a batch of rows is handed on.
BATCH = 8 * 1024 * 1024


def read_evidence(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All files below a folder as (path, bytes, content, problem), paths relative to it.

    Of a larger file only its size is read: content is null and problem says so. Spark lists neither names that begin with _ or a dot nor files without bytes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_extract("path", f"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?{re.escape(whole)}/(.*)$", 1).alias("path")
    small = found.where(F.col("length") <= most_bytes).select(inner, F.col("length").alias("bytes"), "content", F.lit(None).cast("string").alias("problem"))
    why = F.concat(F.lit("file is "), "length", F.lit(f" bytes, max is {most_bytes}"))
    large = found.where(F.col("length") > most_bytes).select(inner, F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"), why.alias("problem"))
    return small.unionByName(large)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH bytes, by the length of the value at a place."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + len(row[weigh] or b"")
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _members(path: str, content: bytes, most_bytes: int) -> Iterator[tuple]:
    """An archive's members, still packed; one row with a problem where the archive itself cannot be read."""
    try:
        listed = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except (zipfile.BadZipFile, ValueError, struct.error, NotImplementedError, UnicodeDecodeError):
        yield path, 0, None, None, None, None, None, "not a zip archive"
        return
    for place, m in enumerate(listed):
        head, data, problem = content[m.header_offset : m.header_offset + 30], None, None
        start = m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 else len(content) + 1
        if m.flag_bits & 1:
            problem = "encrypted member"
        elif m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            problem = "unsupported method"
        elif m.file_size > most_bytes:
            problem = f"member is {m.file_size} bytes, max is {most_bytes}"
        elif head[:4] != b"PK\x03\x04" or start + m.compress_size > len(content):
            problem = "member outside the archive"
        else:
            data = content[start : start + m.compress_size]
        yield path, place, m.filename, m.compress_type, m.file_size, m.CRC, data, problem


def _unpacked(row: dict) -> tuple[bytes | None, str | None]:
    """(content, problem) of a packed member; never more than one byte beyond its stated size is made."""
    if row["problem"] is not None:
        return None, row["problem"]
    content = row["data"]
    if row["method"] == zipfile.ZIP_DEFLATED:
        try:
            content = zlib.decompressobj(-zlib.MAX_WBITS).decompress(content, row["size"] + 1)
        except zlib.error:
            return None, "member cannot be inflated"
    if len(content) != row["size"]:
        return None, "wrong size"
    if zlib.crc32(content) != row["crc"]:
        return None, "wrong checksum"
    return content, None


def explode_archives(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files(path, content, problem) to (path, place, member, content, problem): archives (.zip) give a row for each member, other files one.

    Members are cut out of their archive packed, dealt over the cluster and unpacked there, so one archive with many members
    is not one task's work. A member that cannot be unpacked keeps its row with a problem, an archive that cannot be read has
    one row. Repeated names in an archive are told apart by place.
    """
    files = files.select("path", "content", "problem")
    packed = F.coalesce(F.rlike("path", F.lit(r"(?i)\.zip$")), F.lit(False)) & F.col("problem").isNull() & F.col("content").isNotNull()
    others = files.where(~packed).select("path", F.lit(0).alias("place"), F.lit(None).cast("string").alias("member"), "content", "problem")
    inner = pa.schema([("path", pa.string()), ("place", pa.int32()), ("member", pa.string()), ("method", pa.int32()), ("size", pa.int64()), ("crc", pa.int64()), ("data", pa.binary()), ("problem", pa.string())])
    outer = pa.schema([("path", pa.string()), ("place", pa.int32()), ("member", pa.string()), ("content", pa.binary()), ("problem", pa.string())])

    def cut(batches):
        rows = ((b["path"][i].as_py(), b["content"][i].as_py()) for b in batches for i in range(b.num_rows))
        yield from _batches((m for path, content in rows for m in _members(path, content, most_bytes)), inner, 6)

    def unpack(batches):
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        yield from _batches(((r["path"], r["place"], r["member"], *_unpacked(r)) for r in rows), outer, 3)

    members = files.where(packed).select("path", "content").mapInArrow(cut, MEMBER)
    return others.unionByName(members.repartition("path", "place").mapInArrow(unpack, CONTENT))


def _preview(text: Column, at: Column, length: Column) -> Column:
    start = F.greatest(at - AROUND, F.lit(1))
    shown = F.concat(text.substr(start, at - start), F.lit(MARK), text.substr(at + length, F.lit(AROUND)))
    return F.substring(F.regexp_replace(shown, "\r?\n", r"\\n"), 1, SHOWN)


def scan_evidence(evidence: DataFrame, names: tuple[str, ...] = FORBIDDEN, patterns: tuple[str, ...] = (), literals: tuple[str, ...] = ()) -> DataFrame:
    """evidence(path, place, member, content, problem) to (path, member, line, pattern, preview): each pattern's first hit in each file or member.

    ``names`` count in any case and ``patterns`` are regular expressions, both reported as they are given; ``literals`` count as they stand
    and are reported as ``literal``, one row for each that is found. Only names of text files have lines. What could not be read is told
    by a row UNSCANNED; an archive with such a member has the first of them alone, as nothing of it counts as searched.
    Bytes that are no UTF-8 are searched as replacement characters. A path's hits meet in one task: they are as many as its members times the patterns at most.
    """
    if any(not x for x in (*names, *patterns, *literals)):
        raise ValueError("names, patterns and literals must not be empty")
    text = F.col("text")
    # Quoting ends at \E, so that one is written apart.
    quoted = lambda s: r"\Q" + s.replace("\\E", r"\E\\E\Q") + r"\E"
    checks = [(n, "(?i)" + quoted(n)) for n in names] + [(p, p) for p in patterns] + [("literal", quoted(x)) for x in literals]
    hits = []
    for label, pattern in checks:
        at = F.regexp_instr(text, F.lit(pattern))
        hits.append(F.when(at > 0, F.struct(F.lit(label).alias("pattern"), at.alias("at"), F.length(F.regexp_extract(text, pattern, 0)).alias("length"))))
    unread = F.struct(F.lit("UNSCANNED").alias("pattern"), F.lit(0).alias("at"), F.lit(0).alias("length"))
    read = F.make_valid_utf8(F.coalesce(F.col("content").cast("string"), F.lit("")))
    found = evidence.select("path", "place", "member", read.alias("text"), "problem").withColumn(
        "hit", F.explode(F.when(F.col("problem").isNotNull(), F.array(unread)).otherwise(F.array_compact(F.array(*hits, F.lit(None)))))
    )
    at, length = F.col("hit.at"), F.col("hit.length")
    lined = F.rlike(F.coalesce("member", "path"), F.lit(TEXT_NAMES)) & F.col("problem").isNull()
    shown = found.select(
        "path", "place", F.when(F.col("problem").isNull(), F.col("member")).alias("member"), F.when(lined, line_of(text, at)).alias("line"), F.col("hit.pattern").alias("pattern"),
        F.coalesce("problem", _preview(text, at, length)).alias("preview"), F.col("problem").isNotNull().alias("unread"),
    )
    first = F.min(F.when(F.col("unread"), F.col("place"))).over(Window.partitionBy("path"))
    kept = shown.withColumn("first", first).where(F.col("first").isNull() | (F.col("unread") & (F.col("place") == F.col("first"))))
    return kept.select("path", "member", "line", "pattern", "preview")
