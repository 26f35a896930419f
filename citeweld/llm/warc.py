"""WARC archives with revisit records.

Payload headers (id, digest, length) are grouped by digest; pages whose payload was already stored become revisit records
that refer to the response, all others responses. Records are written by Spark's text writer, whose line end is the
two line breaks that close a WARC record: a part file is a WARC 1.1 file, compressed as a whole, and is committed as
all of Spark's output is, on any file system that Spark can write. Archives are read back by the records' lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark import cut, remove, shared_folder
from ._spark import read

LEAST = 100  # bytes of a payload from which on a copy becomes a revisit
FILE_RECORDS = 4000  # records of an archive file
END = "\r\n\r\n"
#: Fixed value: the profile that WARC 1.1 names for payloads that were stored before.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(digest: Column) -> Column:
    """A record id from 32 hex digits."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, bytes, original): original is the page that holds the payload, if another one does.

    Of equal payloads of at least ``least`` bytes the smallest id holds it; rows that repeat that id with that payload hold
    it too. Null payloads are empty. A null id never holds a payload that a page with an id has.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    heads = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = p.join(heads, "digest", "left")
    return joined.withColumn("original", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_archives(resolved: DataFrame, path: str, software: str = "citeweld") -> None:
    """Writes a record for each row of ``resolve_revisits`` under path, with headers of its own."""
    record_id = lambda page, digest: _uuid(F.md5(F.concat_ws("|", F.lit("page"), page.cast("string"), digest)))
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), crlf,
        F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest")), crlf,
        F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), crlf,
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"), crlf)).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), crlf,
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("original"), F.col("digest")), crlf)).otherwise(F.lit("")),
        F.lit(f"Software: {software}\r\n"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("Page-ID: "), F.col("page_id").cast("string"), crlf)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit("\r\n\r\n"),
    )
    records = resolved.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))
    records.write.mode("error").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    with io.BufferedReader(raw, 1 << 20) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields: dict[str, str] = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            n = int(fields["content-length"])
            block = f.read(n)
            if len(block) != n:
                raise ValueError("a record ends early")
            yield fields, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "url", "digest", "bytes", "refers_to", "http", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    for b in batches:
        for content in b["content"]:
            rows, held = [], 0
            for f, block in records_of(content.as_buffer()[:].to_pybytes()):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = f["warc-payload-digest"].removeprefix("sha256:")
                if f["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"payload of {f['warc-record-id']} is damaged")
                else:
                    size, digest, payload = int(http.rpartition(b"Content-Length:")[2]), stated, None
                page = f.get("page-id")
                rows.append((f["warc-record-id"], f["warc-type"], None if page is None else int(page), f.get("warc-target-uri"), digest, size, f.get("warc-refers-to"), http.decode(), payload))
                held += len(block)
                if held > 4 << 20:
                    yield pack(rows)
                    rows, held = [], 0
            yield pack(rows)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record under path; digests of responses are computed anew and have to agree with the headers."""
    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(_parse, "record_id string, record_type string, page_id long, url string, digest string, bytes long, refers_to string, http string, payload binary")
    return out if payloads else out.drop("payload")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives in the shared folder, reads them back and removes them; one row for each page.

    An empty table gives an empty result; columns other than page_id, url and html are not looked at.
    """
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(read(spark, sf_dir, "pages")), path)
    records = read_archives(spark, path, payloads=False)
    stored = records.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("_page"))
    out = records.join(stored.withColumnRenamed("record_id", "refers"), F.col("refers_to") == F.col("refers"), "left")
    result = cut(out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to")))
    remove(spark, path)
    return result


ORACLE = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS o FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND o <> page_id THEN o END AS refers_to FROM f
"""
