"""WARC archives: records of transactions are written, read back and assembled into captures.

Every page becomes a transaction of a request, a response (or a revisit, where an equal payload
is archived elsewhere) and a metadata record. The request and the metadata name the response they
belong to in WARC-Concurrent-To. Captures are written once as a table, with identifiers of their own
and by classes of size, and each class becomes archives of a bounded number of records; a record is found by its
Content-Length, so payloads may hold anything. Ids may be of any type that text can stand for.

Assembly joins request and metadata records to the response by that identifier, and emits one
nested row per capture. Records whose identifier matches no response make no capture.

Defined cases: a null html is an empty payload; a null url is an empty target; payloads of less
than REVISIT_BYTES are always responses; rows that repeat a page_id are captures of their own, and
all of them are responses where that page is the one to refer to; rows with a null page_id come
after all others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, kind, remove, route_mark

REVISIT_BYTES = 100
#: Bytes of payload that an archive file holds at most, or one capture; and sizes of payloads up to which pages share files.
FILE_BYTES = 64 << 20
SIZES = (64 << 10, 1 << 20, 16 << 20)
#: Records of a capture.
RECORDS = 3
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _record(kind: Column | str, record_id: Column, target: Column, content_type: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as text: version, named fields, an empty line and the block; fields of null are left out."""
    fields = [
        ("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", target),
        *headers,
        ("Content-Type", F.lit(content_type)),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in fields]
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF), block)


def transactions(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, digest, again, first_id, capture, group) for each row of pages(page_id, url, html): ids as text, what it refers to, an identifier and a class of size."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F]", " ").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")).filter(f"bytes >= {REVISIT_BYTES}")
    first = long.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id")).alias("first"), F.count(F.lit(1)).alias("rows"))
    many = cut(first.filter("rows > 1").select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_id")))
    # Payloads that can't occur again pass by; only the others are shuffled.
    marked = route_mark(rows, F.col("digest"), many, F.col("_digest"))
    alone = marked.filter("not routed").select("row.*").select("page_id", "url", "payload", "digest", F.lit(False).alias("again"), F.lit(None).cast(kind(pages, "page_id")).alias("first_id"))
    joined = marked.filter("routed").select("row.*").join(many, F.col("digest") == F.col("_digest"), "left")
    again = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = alone.unionByName(joined.select("page_id", "url", "payload", "digest", again.alias("again"), "first_id"))
    page, first = (F.url_encode(F.col(c).cast("string")) for c in ("page_id", "first_id"))
    capture = F.concat(F.coalesce(page, F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    # A revisit has no payload, and is small.
    size = F.octet_length("payload")
    group = F.when(F.col("again"), 0).otherwise(sum((size > limit).cast("int") for limit in SIZES))
    return rows.select(page.alias("page_id"), "url", F.when(~F.col("again"), F.col("payload")).alias("payload"), size.cast("long").alias("bytes"), "digest", "again", first.alias("first_id"), capture.alias("capture"), group.alias("group"))


def records(rows: DataFrame) -> DataFrame:
    """(record): RECORDS records for each of the transactions."""

    def urn(role: str, page: Column = F.col("capture")) -> Column:
        return F.concat(F.lit(f"<urn:capture:{role}:"), page, F.lit(">"))

    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    page_field = ("X-Page-Id", F.col("page_id"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "X-Payload-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    refers = F.when(F.col("again"), F.concat(F.lit("<urn:page:"), F.coalesce("first_id", F.lit("")), F.lit(">")))
    response = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        urn("response"),
        F.col("url"),
        "application/http; msgtype=response",
        [digest, page_field, ("WARC-Refers-To", refers), ("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE)))],
        F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload"))),
    )
    joint = ("WARC-Concurrent-To", urn("response"))
    request = _record("request", urn("request"), F.col("url"), "application/http; msgtype=request", [joint], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)))
    metadata = _record("metadata", urn("metadata"), F.col("url"), "application/warc-fields", [joint], F.concat(F.lit("fetchTimeMs: 0" + CRLF + "charset: utf-8" + CRLF)))
    return rows.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages in a folder: text parts whose line end is the two CRLF that end a record.

    Spark ends a file after so many records. So that files are bounded in bytes, pages of like
    sizes go into files of their own, with as many captures as FILE_BYTES has room for. A payload
    of more than the last of SIZES is a file of its own. Each file is one gzip member.
    """
    spark = pages.sparkSession
    scratch = [fresh_path(spark, "captures")]
    found = transactions(pages)
    found.write.partitionBy("group").parquet(scratch[0])
    rows = spark.read.schema(found.schema).parquet(scratch[0])
    groups = sorted(r.group for r in rows.select("group").distinct().collect())
    # Files of less than a partition stay whole: a part of one may hold no rows, and would be an archive without records.
    parts = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(parts, None)
    spark.conf.set(parts, "1")
    try:
        for group in groups or [0]:
            captures = FILE_BYTES // SIZES[group] if group < len(SIZES) else 1
            own = records(rows.filter(F.col("group") == group))
            own.write.mode("append").options(**{"lineSep": CRLF + CRLF, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": RECORDS * captures}).text(path)
    finally:
        spark.conf.unset(parts) if before is None else spark.conf.set(parts, before)
        remove(spark, scratch)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*?)[ \t]*\r\n")
FIELDS = "type string, record_id string, concurrent_to string, target string, page_id string, digest string, refers_to string, content_type string, payload binary, payload_bytes long, head string"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive file, in the order of FIELDS."""
    at, end = 0, len(data)
    while at < end:
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        at = data.index(b"\r\n", at) + 2
        fields: dict[str, str] = {}
        while not data.startswith(b"\r\n", at):
            m = _FIELD.match(data, at)
            if not m:
                raise ValueError(f"no field at byte {at}")
            fields[m[1].decode().lower()] = m[2].decode("utf-8", "surrogatepass")
            at = m.end()
        at += 2
        size = int(fields["content-length"])
        block = data[at : at + size]
        if len(block) < size or not data.startswith(b"\r\n\r\n", at + size):
            raise ValueError(f"the record that ends at byte {at + size} is cut")
        at += size + 4
        kind, payload, length, head = fields["warc-type"], None, None, None
        if kind in ("response", "revisit"):
            top, _, payload = block.partition(b"\r\n\r\n")
            head = top.decode()
            m = re.search(rb"(?m)^X-Payload-Length: (\d+)", top)
            length = int(m[1]) if m else len(payload)
            if kind == "revisit":
                payload = None
            elif fields.get("warc-payload-digest", "") != "sha256:" + hashlib.sha256(payload).hexdigest():
                raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
        page = fields.get("x-page-id")
        refers = re.fullmatch(r"<urn:page:(.*)>", fields.get("warc-refers-to", ""))
        yield (
            kind,
            fields["warc-record-id"],
            fields.get("warc-concurrent-to"),
            fields.get("warc-target-uri"),
            unquote_plus(page) if page is not None else None,
            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            unquote_plus(refers[1]) if refers else None,
            fields.get("content-type"),
            payload,
            length,
            head if head is not None else block.decode("utf-8", "replace"),
        )


def read(spark: SparkSession, path: str, payloads: bool = True, ids: str = "long") -> DataFrame:
    """The records of the archives in a folder, as FIELDS with ids of a type; without payloads these are null, and still checked."""
    import gzip

    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parse(gzip.decompress(content.as_buffer())))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                arrays = [pa.nulls(len(c), pa.binary()) if n == "payload" and not payloads else pa.array(c, types[t]) for c, (n, t) in zip(cols, names, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(run, FIELDS)
    return found.withColumns({c: F.col(c).cast(ids) for c in ("page_id", "refers_to")})


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture from records: page_id, target, response, request and metadata.

    Request and metadata records meet their response by identifier: all carry it as capture key,
    and meet in one aggregate, in which a transaction's records are few.
    """
    main = F.col("type").isin("response", "revisit")
    keyed = found.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture is not null")
    response = F.struct("type", "record_id", "digest", "payload_bytes", "refers_to", "content_type", "head", "payload")
    side = F.struct("record_id", "content_type", "head")
    return (
        keyed.groupBy("capture")
        .agg(
            F.first(F.when(main, F.col("page_id")), ignorenulls=True).alias("page_id"),
            F.first(F.when(main, F.col("target")), ignorenulls=True).alias("target"),
            F.first(F.when(main, response), ignorenulls=True).alias("response"),
            F.first(F.when(F.col("type") == "request", side), ignorenulls=True).alias("request"),
            F.first(F.when(F.col("type") == "metadata", side), ignorenulls=True).alias("metadata"),
        )
        .filter("response is not null")
    )


def archive_and_assemble(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages(page_id, url, html), by way of archives."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    done = captures(read(spark, path, payloads=False, ids=kind(pages, "page_id")))
    return done.select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )
