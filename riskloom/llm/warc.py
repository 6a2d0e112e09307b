"""Content-addressed WARC archive.

``archive`` turns rows into WARC records and keeps them in two tables of one
folder: ``payloads`` holds the bytes of every distinct payload once, under their
SHA-256, and ``records`` holds each record's exact WARC and HTTP header bytes with
the digest of its payload. ``read`` verifies every stored payload against its
digest once and joins the verified sizes to the parsed headers; ``records`` joins
the bytes back and gives the original records, and ``export`` writes them as
ordinary .warc files. Bytes are shuffled once to be stored; everything else works
on digests and sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.linking import saved
from riskloom.session import scratch_dir

#: Payloads below this size are kept as responses even if equal.
LEAST_BYTES = 100
END = "\r\n\r\n"
# The profile name of WARC 1.1 for revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOADS = "digest string, payload binary"
RECORDS = "record long, page_id long, digest string, payload_bytes long, warc binary, http binary"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _name(page: Column, record: Column) -> Column:
    """A record's id: of its page, and of the row among rows with one page id or none."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), record.cast("string"), F.lit(">"))


def _uri(url: Column) -> Column:
    """The target without characters that would end or part the header line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), " ", "%20")


def headers(spark: SparkSession, pages: DataFrame, date: str, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """RECORDS rows of all pages, without their payload bytes.

    Of records with one digest, the one of the smallest page id (null ids last,
    equal ids by row) is the response that the others refer to.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    # numbered when written, so that rows with one id are told apart the same way ever after
    slim = saved(spark, slim.withColumn("record", F.monotonically_increasing_id()), "headers")
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("record").alias("record"))
    firsts = slim.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # read back, so that the join has an exchange of its own and a payload with very many records can be split
    both = slim.join(saved(spark, firsts, "firsts"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), _line("WARC-Record-ID", _name(F.col("page_id"), F.col("record"))),
        _line("WARC-Date", F.lit(date)), F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", _uri(F.col("url")))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _name(F.col("first.id"), F.col("first.record"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", block.cast("string")), F.lit("\r\n"))
    return both.select("record", "page_id", "digest", "payload_bytes", warc.cast("binary").alias("warc"), http.cast("binary").alias("http"))


def archive(spark: SparkSession, pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES,
            id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row: distinct payloads under ``path``/payloads, headers under ``path``/records.

    The payload is the text in UTF-8 (null: no bytes); a null url has no target
    line; null and repeated ids are records of their own; an empty table makes
    an empty archive; other columns are not read. Two payloads with one digest
    but other bytes (other size or second hash) stop the run.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    check = F.struct(F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("other"))
    # equal payloads meet in the task that reads them first, so a copied one is shuffled once a task
    held = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload", check.alias("check")) \
        .groupBy("digest").agg(F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    held.select("digest", one.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers(spark, pages, date, least_bytes, id_col, url_col, html_col).write.option("compression", "zstd").parquet(f"{path}/records")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of the archive; bytes that do not have their digest stop the run."""
    held = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return held.select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")).alias("payload"))


def _field(head: Column, name: str, value: str = r"([^\r\n]*)") -> Column:
    found = F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id.

    All but the size come from the stored header bytes; the size is that of the
    verified payload. A header whose Content-Length is not that of its block, or
    whose payload is not held, stops the run.
    """
    # sizes only: the bytes stay where they are stored
    sizes = payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("held"))
    head, page = F.col("warc").cast("string"), r"<urn:x-page:(-?\d+):\d+>"
    rows = spark.read.schema(RECORDS).parquet(f"{path}/records").select(
        _field(head, "WARC-Record-ID", page).cast("long").alias("page_id"), _field(head, "WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        _field(head, "WARC-Type").alias("record_type"), _field(head, "WARC-Refers-To", page).cast("long").alias("refers_to"), _field(head, "WARC-Target-URI").alias("url"),
        _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "Content-Length").cast("long").alias("block"), F.octet_length("http").cast("long").alias("http"))
    joined = rows.join(saved(spark, sizes, "sizes"), "digest", "left")
    right = F.col("block") == F.col("http") + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("held"))
    size = F.when(F.coalesce(right, F.lit(False)), F.col("held")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")).cast("long"))
    return joined.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url", "record_id")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, page_id, bytes): every original record, its end marker included, rebuilt from headers and payload."""
    rows = spark.read.schema(RECORDS).parquet(f"{path}/records")
    own = F.instr(F.col("warc").cast("string"), "\r\nWARC-Type: response\r\n") > 0
    whole = rows.withColumn("own", own)
    joined = whole.where("own").join(payloads(spark, path), "digest").select("record", "page_id", F.concat("warc", "http", "payload", F.lit(END.encode())).alias("bytes"))
    return joined.unionByName(whole.where("not own").select("record", "page_id", F.concat("warc", "http", F.lit(END.encode())).alias("bytes")))


def export(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """The archive as WARC 1.1 files, one a task; records end as the format asks, by the writer's line end."""
    rebuilt = records(spark, path).select(F.expr("substring(bytes, 1, octet_length(bytes) - 4)").cast("string").alias("value"))
    rebuilt.write.option("lineSep", END).option("compression", compression).text(out)


def parse(files: DataFrame) -> DataFrame:
    """(warc, http, payload) of the records of uncompressed WARC files (``spark.read.format("binaryFile")``)."""
    schema = pa.schema([("warc", pa.binary()), ("http", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                view, at, rows, size = data.as_py(), 0, [], 0
                while at < len(view):
                    body = view.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(b": ", 1) for line in view[at:body].split(b"\r\n")[1:-2])
                    end = body + int(fields[b"Content-Length"])
                    http = view.index(b"\r\n\r\n", body) + 4
                    rows.append({"warc": view[at:body], "http": view[body:http], "payload": view[http:end]})
                    size, at = size + end - at, end + 4
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(run, "warc binary, http binary, payload binary")


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive all pages in a fresh folder and read it back."""
    path = scratch_dir(spark, "warc")
    archive(spark, pages, path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
