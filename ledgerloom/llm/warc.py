"""WARC archives with revisit records: written, resolved and read back.

Headers (id, digest, size) are shuffled by payload digest to find the original of every repeated
payload; only digests that repeat go on. Then records are written as text whose lines end in the
two blank lines that end a WARC record, in gzip files that Spark's own writer commits, so a lost task leaves nothing behind.
A revisit record has fresh headers, names its original and has no payload. Reading takes one archive
at a time, inflates it as a stream and follows Content-Length, so nothing in a payload can be taken for a header.
Revisits find their originals by a join on the record id.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; line ends, tabs and blanks of a url are percent-encoded;
a null id is written as "-" and read back as null; rows that repeat id and payload of an original are responses too; a payload
below `smallest` bytes is always a response.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.skew import key_counts, lookup_join
from ledgerloom.plans.workspace import checkpointed, run_folder

SMALLEST = 1000
RECORDS_PER_FILE = 4000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts: tuple[str, str | Column]) -> Column:
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in parts])


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that follows from page and payload, so a task that runs again writes the same one."""
    h = F.md5(F.concat_ws("|", page_id, digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, payload, digest, size of each page and original, the id of the page it revisits (else null)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    records = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    headers = records.select("page_id", "digest", "size").where(F.col("size") >= smallest)
    originals = (headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
                 .where("copies > 1"))
    counts = originals.select("digest", F.col("copies").alias("n_rows"))
    other = ~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull()
    # A payload that very many pages have is dealt to pieces.
    found = lookup_join(records, originals.drop("copies"), ["digest"], ["page_id"], counts=counts)
    return found.withColumn("original", F.when(other, F.col("original")))


def now() -> str:
    """The time in the form of a WARC date."""
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def as_records(pages: DataFrame, date: str | None = None) -> DataFrame:
    """One column `record`: a WARC record without the two line ends that close it. The date of all records is that of the
    run, fixed while the plan is made, so that a task that runs again writes the same one."""
    date = date or now()
    end = F.lit("\r\n\r\n")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    # Line ends would break a header line, outer blanks would be lost.
    safe = F.col("url")
    for code in (0, 9, 10, 13, 32):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    target = F.coalesce(F.when(safe != "", safe), F.concat(F.lit("urn:page:"), name))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), end)
    body = F.when(F.col("original").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    revisit = F.col("original").isNotNull()
    common = _lines(
        ("WARC-Record-ID", record_id(name, F.col("digest"))), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("X-Page-ID", name))
    origin = _lines(
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(F.col("original").cast("string"), F.col("digest"))),
        ("WARC-Refers-To-Date", date))
    kind = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"))
    tail = F.concat(F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), end)
    return pages.select(F.concat(
        kind, common, F.when(revisit, F.concat(F.lit("\r\n"), origin)).otherwise(F.lit("")), tail, body).alias("record"))


def write_archives(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, date: str | None = None) -> None:
    """Writes resolved pages as gzip archives below a new folder."""
    (as_records(pages, date).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("an archive ends inside a record")
        yield headers, block


READ = "record_id string, page_id string, type string, url string, payload_bytes long, payload_digest string, refers_to_id string"


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below a folder. Size and digest of a response are computed from its
    payload and compared with its headers; a revisit has the digest of its header and no size.
    With `payloads` there is a binary column payload."""
    schema = READ + (", payload binary" if payloads else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string()) for f in schema.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as file:
                    for headers, block in parse(io.BufferedReader(file, 1 << 18)):
                        _, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = None
                        if headers["warc-type"] == "response":
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
                        page = headers.get("x-page-id", "-")
                        row = (headers["warc-record-id"], None if page == "-" else page, headers["warc-type"],
                               headers["warc-target-uri"], size, digest, headers.get("warc-refers-to"))
                        rows.append((*row, payload) if payloads else row)
                        held += len(payload) if payloads else 0
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with size and page of its original: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    originals = (records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("original_bytes")))
    # Responses pass; only revisits look for an original, and those of one original are dealt to pieces when they are very many.
    revisits = records.where("type = 'revisit'")
    found = lookup_join(revisits, originals, ["refers_to_id"], ["record_id"], counts=key_counts(revisits, ["refers_to_id"]))
    passed = records.where("type <> 'revisit'").withColumns({
        "refers_to": F.lit(None).cast("string"), "original_bytes": F.lit(None).cast("long")})
    return passed.unionByName(found).select(
        "page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest",
        F.col("type").alias("record_type"), "refers_to", "url")


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """Writes the pages to deduplicated archives in the shared folder and gives what is read back from there."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_archives(resolved(pages, page_id, url, html, smallest), folder)
    # Read and verified once; what is left of a record is its header.
    found = resolve_revisits(checkpointed(read_archives(spark, folder)))
    kind = dict(pages.dtypes)[page_id]
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
