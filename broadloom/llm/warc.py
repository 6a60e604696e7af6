"""WARC archives as a Spark data source, and archives without repeated payloads.

``spark.read.format("warc")`` plans partitions of whole files up to ``partition_bytes`` each (option), reads the
header block of every record first, tests the pushed predicates on it, and seeks past the blocks of records that
fail or whose payload the requested schema leaves out. Equality, membership, comparison, prefix and null tests on
header columns are pushed; the rest is left to Spark. Plain and per-record gzip files are read; gzip blocks have to
be inflated to be skipped, but are not parsed or handed on. ``df.write.format("warc")`` writes records: tasks write
files under attempt names, and only the commit gives them the suffix that readers look for.

Columns are those of ``SCHEMA``; a reader may ask for some of them with ``schema(...)``. A record without a field
has null there. For HTTP records the payload is what follows the HTTP headers, and ``payload_length`` comes from
the HTTP ``Content-Length`` where given, so a revisit record, which has no payload, still tells its length.

Null payloads are written as empty ones. An empty folder or table gives no rows. Other columns are refused by the
writer by name.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from broadloom.llm.common import utf8
from broadloom.llm.files import attempt_name, join, opened

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length bigint, payload_length bigint, payload binary"
)
#: Header columns and the named fields they hold.
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_length": "content-length",
}
_LABELS = {"warc-record-id": "WARC-Record-ID", "warc-type": "WARC-Type", "warc-target-uri": "WARC-Target-URI", "warc-date": "WARC-Date", "warc-refers-to": "WARC-Refers-To", "warc-payload-digest": "WARC-Payload-Digest"}
HTTP = "application/http;msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in one Arrow batch, bytes of one written file and of the files of one read task.
BATCH_BYTES, FILE_BYTES, PARTITION_BYTES = 8 << 20, 256 << 20, 64 << 20
#: Payloads shorter than this are always stored.
LEAST_SHARED = 100

_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    IsNotNull: lambda v, f: True,
}


def passes(record: dict, filters: list[Filter]) -> bool:
    """Whether a parsed header passes; as in SQL, a null passes nothing but the test for null."""
    for f in filters:
        value = record.get(f.attribute[0])
        if value is None:
            if not isinstance(f, IsNull):
                return False
        elif isinstance(f, IsNull) or not _TESTS[type(f)](value, f):
            return False
    return True


def read_records(source: io.BufferedReader, filters: list[Filter], payloads: bool, seekable: bool) -> Iterator[dict]:
    """The records of an open archive, headers first; blocks nobody wants are passed over."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {line[:40]!r}")
        fields: dict[str, str] = {}
        last = None
        while (line := source.readline()) and line.strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            fields[last] = value.strip().decode("utf-8", "replace")
        record: dict = {c: fields.get(f) for c, f in FIELDS.items()}
        left = record["content_length"] = int(fields.get("content-length", 0))
        wanted = passes(record, filters)
        record["payload_length"] = left
        if wanted and (record["content_type"] or "").replace(" ", "").lower().startswith("application/http"):
            record["payload_length"] = None
            while left and (line := source.readline(left)):
                left -= len(line)
                if not line.strip():
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    record["payload_length"] = int(value)
            if record["payload_length"] is None:
                record["payload_length"] = left
        if wanted and payloads:
            record["payload"] = source.read(left)
            if len(record["payload"]) < left:
                raise ValueError(f"record {record['record_id']} is cut off")
        elif seekable:
            source.seek(left, io.SEEK_CUR)
        else:
            while left and (got := source.read(min(left, 1 << 20))):
                left -= len(got)
        if wanted:
            yield record


@dataclass
class FileGroup(InputPartition):
    paths: tuple[str, ...] = ()


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.path = to_arrow_schema(schema), options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []
        unknown = set(self.schema.names) - set(_names())
        if unknown:
            raise ValueError(f"not columns of an archive: {sorted(unknown)}")

    def pushFilters(self, filters):  # noqa: N802
        header = set(FIELDS)
        for f in filters:
            if getattr(f, "attribute", ("",))[0] in header and len(f.attribute) == 1 and (type(f) in _TESTS or type(f) is IsNull):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, at = opened(self.path)
        if system.get_file_info(at).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        groups: list[list[str]] = []
        room = 0
        for f in sorted((f for f in files if f.path.endswith((".warc", ".warc.gz"))), key=lambda f: (-f.size, f.path)):
            if f.size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(f.path)
            room -= f.size
        return [FileGroup(tuple(g)) for g in groups] or [FileGroup()]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        names = self.schema.names
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            with io.BufferedReader(system.open_input_file(path), 1 << 20) as raw:
                zipped = path.endswith(".gz")
                source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if zipped else raw
                for record in read_records(source, self.filters, "payload" in names, not zipped):
                    rows.append(record)
                    held += len(record.get("payload", b"")) + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, self.schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...] = ()


def record_bytes(row: dict) -> bytes:
    """One record; HTTP records get an HTTP header that states the payload's length."""
    payload = row.get("payload") or b""
    block = payload
    kind = row.get("content_type") or HTTP
    if kind.startswith("application/http"):
        length = row.get("payload_length")
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length) + payload
    lines = ["WARC/1.1"]
    lines += [f"{_LABELS[f]}: {' '.join(str(row[c]).split())}" for c, f in FIELDS.items() if f in _LABELS and row.get(c) is not None]
    if row.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {SAME_PAYLOAD}")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.zipped = options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        unknown = set(schema.names) - set(_names())
        if unknown:
            raise ValueError(f"not columns of an archive: {sorted(unknown)}")
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, at = opened(self.path)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                data = record_bytes({n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)})
                data = gzip.compress(data, 6) if self.zipped else data
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    paths.append(join(at, attempt_name("part", TaskContext.get().partitionId(), ".warc.gz" if self.zipped else ".warc")))
                    out, size = system.open_output_stream(paths[-1] + ".open", buffer_size=1 << 20), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.move(path + ".open", path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.delete_file(path + ".open")


def _names() -> list[str]:
    return [f.split()[0] for f in SCHEMA.split(", ")]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let its filters be pushed."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record per page. Of equal payloads of ``LEAST_SHARED`` bytes or more the one with the smallest key is the
    response and the others revisit it; rows that repeat that key are responses as well.

    Digests are counted before the exchange, so the side that tells the first key has a row per repeated digest;
    the join on the digest has a key of its own for every short payload, and large groups of copies are split by
    adaptive execution.
    """
    page = pages.select(F.col(key).alias("key"), F.col(uri).alias("target_uri"), utf8(F.coalesce(F.col(html), F.lit(""))).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload").cast("bigint"))
    firsts = page.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1").select(F.col("digest").alias("group"), "first")
    grouped = page.withColumn("group", F.when(F.col("n") >= LEAST_SHARED, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return grouped.join(firsts, "group", "left").select(
        urn(F.col("key")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit(HTTP).alias("content_type"),
        F.col("n").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages and read them back: the columns of query ``op2_warc``.

    Length and digest of a response are those of the payload read back, of a revisit those its header states.
    """
    spark = pages.sparkSession
    register(spark)
    records_of(pages).write.format("warc").option("compression", "gzip").mode("append").save(path)
    got = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_length bigint, payload binary").load(path)
    response = F.col("record_type") == "response"
    id_in = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return got.select(
        id_in("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        id_in("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
