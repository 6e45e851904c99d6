"""WARC archives: writing by Spark's text writer, reading by a Python data source.

A record is header lines, an empty line, a block of Content-Length bytes and two line ends.  The
block is an HTTP response: header lines, an empty line, the payload; a revisit's block ends before
the payload.  Records are strings in UTF-8, so Spark's own text writer with two line ends as its
separator writes them on any file system, with its commit protocol.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .common import file_system, list_files

END = "\r\n"
#: Fixed: the digits of base 32, in both of its alphabets.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("content_length", T.LongType()), T.StructField("date", T.StringType()), T.StructField("payload", T.BinaryType()),
])
#: Columns that a record's own header lines give; filters on these are decided before its block is read.
HEADER_OF = {
    "record_type": b"warc-type", "record_id": b"warc-record-id", "refers_to": b"warc-refers-to", "target_uri": b"warc-target-uri",
    "payload_digest": b"warc-payload-digest", "content_length": b"content-length", "date": b"warc-date",
}
ID_HEAD = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: 40 hex digits are eight groups of 20 bits, each four base-32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def _header_text(value: Column) -> Column:
    """A value for one header line: control characters and outer white space are percent-encoded."""
    for code in (10, 13):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def archive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record per row as the string column ``value``.

    Of the rows with equal payloads (null: empty) of at least ``min_revisit_bytes`` bytes, those
    with the smallest page_id are responses and the others revisit it; null ids come last, and where
    a payload has no other ids, all its rows are responses.  Smaller payloads are all responses.
    Payloads are compared by digest: the shuffle that finds the first page of a payload holds
    digests and ids, pre-aggregated, and only digests that occur twice are joined back.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), _header_text(F.col(url).cast("string")).alias("_url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"))
    rows = rows.withColumn("_bytes", F.octet_length("_html").cast("long")).withColumn("_digest", base32_sha1(F.col("_html")))
    first = (
        rows.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_digest").alias("_of"), "_first")
    )
    rows = rows.join(first, F.col("_digest") == F.col("_of"), "left")
    revisit = F.coalesce(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_bytes") >= min_revisit_bytes), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    ident = lambda c: F.concat(F.lit(f"<{ID_HEAD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("_bytes").cast("string")), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "_html"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", ident(F.col("_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("_url")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("_first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_warc(records: DataFrame, path: str, *, records_per_file: int = 200_000, compress: bool = False) -> None:
    """Write ``value`` records as ``.warc`` files (whole-file gzip members with ``compress``)."""
    (
        records.select("value").write.option("lineSep", END + END).option("compression", "gzip" if compress else "none")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the files below ``path``.  Only the named columns are built: without ``payload``
    the rest of a block is skipped.  Filters on header columns are decided before the block."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns:
        reader = reader.schema(T.StructType([f for f in SCHEMA if f.name in columns]))
    return reader.load(path)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``bytes_per_task`` and ``batch_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


class FilePart(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    """Plans whole files, small ones together; each record's header lines are parsed first."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADER_OF and type(f) in _TESTS:
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        most, parts, have = int(self.options.get("bytes_per_task", 64 << 20)), [], 0
        for path, size in list_files(self.options["path"], (".warc", ".warc.gz", ".txt", ".txt.gz")):
            if not parts or have + size > most:
                parts, have = [*parts, []], 0
            parts[-1].append(path)
            have += size
        return [FilePart(p) for p in parts] or [FilePart([])]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        names, most = [f.name for f in self.schema], int(self.options.get("batch_bytes", 8 << 20))
        types = {f.name: pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in self.schema}
        pick = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[n]) for k, n in enumerate(names)], names)
        rows, held = [], 0
        for path in partition.files:
            for record in read_records(path, set(names), self.tests):
                rows.append([record.get(n) for n in names])
                held += 200 + len(record.get("payload") or b"")
                if held >= most:
                    yield pick(rows)
                    rows, held = [], 0
        if rows:
            yield pick(rows)


_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x is not None and x in v, IsNotNull: lambda x, v: x is not None,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v), GreaterThan: lambda x, v: x is not None and x > v, GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v, LessThanOrEqual: lambda x, v: x is not None and x <= v,
}
_BY_NAME = {k.__name__: f for k, f in _TESTS.items()}


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    """Header lines by lower-case name; a line that starts with white space continues the last."""
    out, last = {}, None
    for x in lines:
        if x[:1] in (b" ", b"\t") and last:
            out[last] += b" " + x.strip()
        elif b":" in x:
            name, _, value = x.partition(b":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _until_empty(f) -> tuple[list[bytes], int]:
    lines, size = [], 0
    while True:
        x = f.readline()
        size += len(x)
        if not x or not x.strip(b"\r\n"):
            return lines, size
        lines.append(x.rstrip(b"\r\n"))


def _plain(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def read_records(path: str, names: set[str], tests: list[tuple]) -> Iterator[dict]:
    """The records of a file that meet the tests.  Blocks are decoded only as far as the named columns need."""
    system, at = file_system(path)
    raw = system.open_input_file(at)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if at.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
    with raw, f:
        while True:
            version = f.readline()
            while version in (b"\r\n", b"\n"):
                version = f.readline()
            if not version:
                return
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{path}: a record starts with {version[:40]!r}")
            lines, _ = _until_empty(f)
            head = _fields(lines)
            length = int(head.get(b"content-length", b"0"))
            record = {n: v.decode("utf-8", "replace") if (v := head.get(h)) is not None else None for n, h in HEADER_OF.items()}
            record |= {"content_length": length, "record_id": _plain(record["record_id"]), "refers_to": _plain(record["refers_to"])}
            if record["payload_digest"] and record["payload_digest"].lower().startswith("sha1:"):
                record["payload_digest"] = record["payload_digest"][5:].upper()
            left = length
            if all(_BY_NAME[kind](record[n], v) for n, kind, v in tests):
                if names & {"payload", "payload_bytes"}:
                    http = head.get(b"content-type", b"").startswith(b"application/http")
                    block_lines, used = _until_empty(f) if http and left else ([], 0)
                    left -= used
                    stated = _fields(block_lines).get(b"content-length")
                    record["payload_bytes"] = int(stated) if record["record_type"] == "revisit" and stated else left
                    if "payload" in names and record["record_type"] != "revisit":
                        record["payload"], left = f.read(left), 0
                yield record
            _skip(f, left)


def _skip(f, n: int) -> None:
    if n > 0 and not isinstance(f.raw, gzip.GzipFile):
        f.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


def page_number(record_id: Column) -> Column:
    """The page_id in an identifier that ``archive_records`` wrote, null if it has none."""
    return F.when(record_id.startswith(ID_HEAD), F.substring(record_id, len(ID_HEAD) + 1, 40)).try_cast("long")


def warc_round_trip(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Write the pages' records below ``path``, read them back, and digest what was read: a
    response's length and digest are those of the payload bytes in the archive, a revisit's those of
    its header lines.  One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and url as archived (line ends percent-encoded).  Empty tables give no rows."""
    write_warc(archive_records(pages), path, compress=True)
    read = read_warc(spark, path, ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"])
    held = F.col("payload").isNotNull()
    return read.select(
        page_number(F.col("record_id")).alias("page_id"),
        F.when(held, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(held, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page_number(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"),
    )
