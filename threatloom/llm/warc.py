"""WARC archives with revisit resolution.

Pages are read once, into a numbered copy by classes of payload length. Headers (page id, payload digest, length) are shuffled
by digest; of equal payloads of at least ``min_bytes`` the smallest id becomes the response and the others are joined to it as
revisits. A record's id is made of the page's id and its number in the copy, so it is unique. The records are written with fresh
headers by Spark's own text writer (the record separator is the writer's line separator), gzipped, so files are
committed and retried like any output and no executor's local folder is used. Files are bounded by bytes: classes of
larger payloads get fewer records a file. A reader resolves ``WARC-Refers-To``: length and digest of a revisit are those of
the block that its original has.

Cases: page ids are whole numbers; a null payload is empty; a null url is an empty target; blanks and control characters of a
url are percent-encoded, each as what it is; a null id sorts after all others; of rows that repeat the smallest id one is
the response, the others revisit it; an empty table gives no records; further columns are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, shared_dir, sized_broadcast

MIN_BYTES = 100
CRLF = "\r\n"
#: Records and payload bytes of one archive file at most (one larger record has a file of its own): bounds what a task reads.
RECORDS_PER_FILE, FILE_BYTES = 2000, 64 << 20
#: Rows of the table of originals up to which it is broadcast.
BROADCAST_ROWS = 50_000
DATE = "1970-01-01T00:00:00Z"


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers (page_id, nth, payload_digest, payload_bytes, ...) plus ``original``: the record id of the response for revisits, else null.

    Counting is combined before the shuffle, and only digests that occur again are joined back, as a table of one row
    each: a payload shared by a third of all pages is one row there, and its pages are split by the skewed-join rule.
    """
    groups = (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "nth")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("payload_digest").alias("__digest"), record_id(F.col("first.page_id"), F.col("first.nth")).alias("first"))
    )
    firsts = sized_broadcast(materialize(groups, "originals"), BROADCAST_ROWS)
    joined = headers.join(firsts, headers["payload_digest"] == F.col("__digest"), "left").drop("__digest")
    return joined.withColumn("original", F.when(F.col("first") != record_id(F.col("page_id"), F.col("nth")), F.col("first"))).drop("first")


def record_id(page_id: Column, nth: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), nth.cast("string"), F.lit(">"))


def with_headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """A written copy of the pages: page_id, nth (a number of its own), url, payload, its digest and length, and per_file: the
    records of a file of that length's class, whose folder the record is in."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    n = F.octet_length(body).cast("long")
    per_file, classes = records_per_file, []
    while per_file > 1:
        classes.append((file_bytes // per_file, per_file))
        per_file = max(1, per_file // 16)
    per_file = F.lit(1)
    for most, k in reversed(classes):
        per_file = F.when(n <= most, k).otherwise(per_file)
    records = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.monotonically_increasing_id().alias("nth"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        body.alias("payload"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
        n.alias("payload_bytes"),
        per_file.alias("per_file"),
    )
    return materialize(records, "pages", "per_file")


#: Characters of a url that can't stand in a header line, with their percent-encoding.
_ENCODED = {chr(k): f"%{k:02X}" for k in [*range(0x21), 0x7F]}


def target_uri(url: Column) -> Column:
    """A url with each blank and control character percent-encoded."""
    table = F.create_map(*(F.lit(x) for kv in _ENCODED.items() for x in kv))
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def _write(records: DataFrame, path: str, date: str, records_per_file: int) -> None:
    """Write records (page_id, nth, url, payload, payload_digest, payload_bytes, original) as gzipped WARC files.

    A record is its header, an empty line and its block; revisits have no block. Pages get an id of their own in the
    record id, so a reader needs no other table.
    """
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    none = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target_uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(none),
        F.when(revisit, line("WARC-Refers-To", F.col("original"))).otherwise(none),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(date))).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha256:"), "payload_digest"))),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    rows = records.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def write_archives(records: DataFrame, path: str, date: str = DATE, min_bytes: int = MIN_BYTES) -> None:
    """Write the records of with_headers(); the classes' folders are read and written one by one, each once."""
    classes = sorted(r[0] for r in records.select("per_file").distinct().collect())  # a handful
    resolved = resolve(records, min_bytes)
    for k in classes:
        _write(resolved.where(F.col("per_file") == k), f"{path}/upto-{k}", date, k)
    if not classes:
        _write(resolved, f"{path}/none", date, 1)


def parse(archive: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive given as chunks, by Content-Length; holds one record at a time."""
    buf, at = bytearray(), 0  # what is before at has been read
    chunks = iter(archive)

    def more() -> bool:
        nonlocal at
        got = next(chunks, None)
        if got is None:
            return False
        if at:
            del buf[:at]
            at = 0
        buf.extend(got)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(buf) > at:
                    raise ValueError("an archive ends inside a header")
                return
        lines = buf[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        head = dict(x.split(": ", 1) for x in lines[1:])
        at, size = end + 4, int(head["Content-Length"])
        while len(buf) < at + size + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield head, bytes(buf[at : at + size])
        at += size + 4


def _gunzip(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed chunks of gzip members."""
    while data:
        z = zlib.decompressobj(31)
        while not z.eof:
            out = z.decompress(data, step)
            data = z.unconsumed_tail or z.unused_data
            if out:
                yield out
            elif not data and not z.eof:
                raise ValueError("an archive is cut off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, target_uri, block_bytes, record_id of each record.

    Length and digest are taken from the block that was read; of a revisit from its original's, found by id and digest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "target_uri", "block_bytes", "rid", "original"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def number(rid: str | None) -> int | None:
        page = "null" if rid is None else rid.split(":")[2]
        return None if page == "null" else int(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for head, block in parse(_gunzip(data.as_py())):
                    again = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if again else hashlib.sha256(block).hexdigest()
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Type"], number(head.get("WARC-Refers-To")), None if again else len(block), digest, head["WARC-Target-URI"], len(block), head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = files.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string, block_bytes long, rid string, original string")
    rows = materialize(rows, "records")
    again = rows.where("record_type = 'revisit'")
    wanted = again.groupBy("original", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    blocks = rows.where("record_type = 'response'").select(F.col("rid").alias("original"), "payload_digest", F.col("payload_bytes").alias("__n"))
    originals = materialize(wanted.join(blocks, ["original", "payload_digest"]), "originals")
    resolved = join_groups(again, originals, ["original", "payload_digest"], "left").withColumn("payload_bytes", F.col("__n")).drop("__n", "n")
    return rows.where("record_type = 'response'").unionByName(resolved).withColumnRenamed("rid", "record_id").drop("original")


def deduplicate(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages' deduplicated archives to path (default: the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/threatloom-warc-{uuid.uuid4().hex}"
    write_archives(with_headers(pages), path, min_bytes=min_bytes)
    return read_archives(spark, path)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM f
"""
