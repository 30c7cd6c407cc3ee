"""WARC as a content-addressed archive.

Payload bytes are stored once under their SHA-256, which is verified when they are read; exact record headers are a table of
their own, and records are put together again by a join. Of records with equal payloads the one with the largest page_id is
the response, the others are revisits of it. The query reads its columns from the bytes of the records put together, a revisit's
length from the response it refers to. export_warc() writes records as standard WARC files, parse_warc() reads such files.

Edge cases: null html: an empty payload, archived like others. Null url: no WARC-Target-URI line; white space and control characters
in a url are percent-encoded, and such a record has the url's exact bytes in a further field. Null page_id: a record of its own
that others can't refer to, response if all of its payload's ids are null. Rows that repeat a page_id and its payload are the
same capture and share its type, but each has an id of its own. Payloads below min_bytes are all responses. An empty table gives
no rows; further columns are ignored; very long payloads stay whole (to the 2 GB of a value, files in parse_warc likewise).
Records of files that can't be read (no version line, no length, cut off) give a row with an error, and reading goes on at the
next version line.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, map_batches, new_path, settle, table

MIN_BYTES, DATE = 0, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The field with a url's bytes in hexadecimal digits where the url itself isn't fit for a header.
EXACT_URL = "X-Target-URI-Hex"


def base32(hexadecimal: Column) -> Column:
    """Base32 of the 40 hexadecimal digits of a SHA-1."""
    out = []
    for k in range(0, 40, 5):
        twenty = F.conv(F.substring(hexadecimal, k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(twenty, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: Column, serial: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), serial.cast("string"), F.lit(">"))


def header(kind: Column, refers_to: Column) -> Column:
    """The exact header of a record, blank line included, then the HTTP header of a response."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise("")
    unfit = F.col("url").rlike(r"[\x00-\x20\x7F]")
    encoded = reduce(lambda u, k: F.replace(u, F.lit(chr(k)), F.lit(f"%{k:02X}")), (*range(33), 127), F.col("url"))
    response = kind == "response"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("serial"))),
        line("WARC-Date", F.lit(DATE)),
        maybe("WARC-Target-URI", F.when(unfit, encoded).otherwise(F.col("url"))),
        maybe(EXACT_URL, F.when(unfit, F.hex(F.col("url").cast("binary")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(response, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", refers_to))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.when(response, F.col("bytes") + len(HTTP)).otherwise(0).cast("string")),
        F.lit("\r\n"),
        F.when(response, HTTP).otherwise(""),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes folder/payloads (digest, payload) and folder/headers (digest, whole, header) for page_id, url, html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("serial"))
    slim = settle(slim, "captures")
    newest = slim.groupBy("digest").agg(F.max(F.struct("page_id", "serial")).alias("newest"), F.count("*").alias("n"))
    typed = join_unique(slim, newest, "digest", slim.count())
    response = F.col("page_id").eqNullSafe(F.col("newest.page_id")) | (F.col("bytes") < min_bytes)
    typed = typed.withColumn("kind", F.when(response, "response").otherwise("revisit"))
    made = header(F.col("kind"), record_id(F.col("newest.page_id"), F.col("newest.serial")))
    typed.select("digest", (F.col("kind") == "response").alias("whole"), made.alias("header")).write.parquet(f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """record, the bytes of each whole record up to the blank lines that end it. Only responses take their payload along.

    A payload that isn't what its digest says ends the job.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    damaged = F.raise_error(F.concat(F.lit("payload is damaged: "), F.col("digest"))).cast("binary")
    stored = stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged).alias("payload"))
    headers = spark.read.parquet(f"{folder}/headers")
    bare = headers.where(~F.col("whole")).select(F.col("header").cast("binary").alias("record"))
    return headers.where("whole").join(stored, "digest").select(F.concat(F.col("header").cast("binary"), F.col("payload")).alias("record")).unionByName(bare)


class BadRecord(ValueError):
    """Bytes that are no WARC record."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields of the record at a place, by their names in lower case, its block, and where the block ends."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not re.match(rb"WARC/\d", data[at : at + 6]):
        raise BadRecord("no version line" if end >= 0 else "no end of the header")
    fields = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadRecord("no length")
    block = data[end + 4 : end + 4 + int(size)]
    if len(block) < int(size):
        raise BadRecord("cut off")
    return fields, block, end + 4 + int(size)


def url_of(fields: dict[str, str]) -> str | None:
    """The exact url of a record."""
    exact = fields.get(EXACT_URL.lower())
    return bytes.fromhex(exact).decode() if exact is not None else fields.get("warc-target-uri")


def described(records: DataFrame) -> DataFrame:
    """id, page_id, url, kind, refers, refers_to, bytes, digest of records, from their bytes alone; bytes is null for revisits.

    A response whose payload isn't what its header says ends the job.
    """
    page_of = lambda urn: int(m[1]) if urn and (m := re.fullmatch(r"<urn:page:(-?\d+):\d+>", urn)) else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for record in batch.column(0):
            fields, block, _ = parse_record(record.as_py())
            said, kind, size = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest != said:
                    raise BadRecord(f"a header names another payload: {said}")
            refers = fields.get("warc-refers-to")
            out.append((fields["warc-record-id"], page_of(fields["warc-record-id"]), url_of(fields), kind, refers, page_of(refers), size, said))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "page_id", "url", "kind", "refers", "refers_to", "bytes", "digest"])

    return map_batches(records, run, "id string, page_id long, url string, kind string, refers string, refers_to long, bytes long, digest string")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of an archive, from the records' bytes."""
    read = settle(described(read_records(spark, folder)), "records")
    revisits = read.where("kind = 'revisit'")
    asked = revisits.groupBy(F.col("refers").alias("id")).agg(F.count("*").alias("n"))
    of = read.where("kind = 'response'").select("id", F.col("bytes").alias("size"), F.col("digest").alias("same")).join(asked, "id").withColumnRenamed("id", "refers")
    joined = join_unique(revisits, of, "refers", revisits.count())
    digest = F.when(F.col("digest") == F.col("same"), F.col("digest")).otherwise(F.raise_error(F.lit("a revisit names another payload")).cast("string"))
    names = lambda size, digest: ["page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"]
    return read.where("kind = 'response'").select(*names(F.col("bytes"), F.col("digest"))).unionByName(joined.select(*names(F.col("size"), digest)))


def export_warc(spark: SparkSession, folder: str, out: str, compression: str = "none", file_records: int = 10_000) -> None:
    """Writes the archive's records as WARC files of file_records at most; what ends a record is the writer's line end."""
    lines = read_records(spark, folder).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", file_records).text(out)


def records_in(data: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """Header, block and error of every record of a file."""
    at = 0
    while at < len(data):
        try:
            _, block, end = parse_record(data, at)
            yield data[at : data.index(b"\r\n\r\n", at)].decode("utf-8", "replace"), block, None
            at = end + 4 if data[end : end + 4] == b"\r\n\r\n" else end
        except BadRecord as e:
            yield None, None, f"{e} at byte {at}"
            at = data.find(b"\r\nWARC/1.", at + 1) + 2
            if at < 2:
                return


def parse_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, block and error of every record of uncompressed WARC files; a file is read by one task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for content in batch.column(0) for x in records_in(content.as_py())]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.string()))], ["header", "block", "error"])

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, "header string, block binary, error string")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archive(spark, folder)


_TWENTY = "CAST('0x' || substr(h, {0} * 5 + 1, 5) AS BIGINT)"
_CHARS = " || ".join(f"substr('{BASE32}', 1 + CAST(({_TWENTY.format(k)} >> {shift}) & 31 AS INTEGER), 1)" for k in range(8) for shift in (15, 10, 5, 0))
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS digest FROM pages
), n AS (SELECT digest, max(page_id) AS newest FROM p GROUP BY digest)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM newest THEN NULL ELSE newest END AS refers_to
FROM p JOIN n USING (digest)
"""
