"""Content-addressed archive (5): payload bytes once per digest, record headers apart, records by a join.

``write_archive`` makes two Parquet tables below a path:

* ``payloads`` (sha256, packed): each distinct payload once, zstandard-compressed
  before it is moved;
* ``headers`` (page_id, sha256, header, http): a row per record, its WARC and
  HTTP header to the byte.

``read_archive`` joins them back into whole records and verifies every payload
against its digest and its length.  Only the header rows of a digest repeat, so
a payload of a third of all pages is stored and moved once per reading task;
adaptive execution splits its rows in the join.  ``export_warc`` and
``import_warc`` turn records into plain ``.warc`` files and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, staged

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` below ``path``.

    Of records with equal payloads of ``min_bytes`` or more, that with the
    largest page_id is the response and the others revisit it; all else is a
    response.  Null html is an empty payload, a null url leaves out its header.
    Rows that repeat the response's page_id are responses too; a null page_id
    never is the one that others refer to.  Other columns are not read.
    """
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                     F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    d = d.withColumn("sha256", F.sha2("payload", 256))
    slim = staged(d.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"),
                           F.octet_length("payload").cast("long").alias("size")), "warc_digests")
    owners = slim.groupBy("sha256").agg(
        F.max("page_id").alias("owner"), F.min("sha1").alias("a"), F.max("sha1").alias("b"),
        F.min("size").alias("m"), F.max("size").alias("n"))
    # an equal SHA-256 with another SHA-1 or length would be a collision: stop rather than lose a payload
    owners = owners.select("sha256", F.when((F.col("a") == F.col("b")) & (F.col("m") == F.col("n")), F.col("owner")).otherwise(
        F.raise_error(F.concat(F.lit("payloads collide on "), F.col("sha256")))).alias("owner"))
    # written, so that the join below is dealt out on its own and the rows of a frequent payload can be split
    owners = staged(owners, "warc_owners")
    revisit = (F.col("size") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha256"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("owner")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(CRLF))
    slim.join(owners, "sha256").select("page_id", "sha256", F.col("size").alias("payload_bytes"), header.alias("header"),
                                       F.lit(HTTP).alias("http")).write.parquet(f"{path}/headers")
    packed = d.select("sha256", "payload").mapInArrow(_pack, "sha256 string, packed binary")
    packed.groupBy("sha256").agg(F.first("packed").alias("packed")).write.parquet(f"{path}/payloads")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([packer.compress(x.as_py()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["sha256", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column from packed to plain; null where a payload is missing or can't be unpacked."""
    unpacker = zstandard.ZstdDecompressor()

    def plain(x: bytes | None) -> bytes | None:
        try:
            return None if x is None else unpacker.decompress(x)
        except zstandard.ZstdError:
            return b""  # fails the digest, which says so

    for batch in batches:
        got = pa.array([plain(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*batch.schema.names[:-1], "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, url, payload, record: the records as they were written, verified.

    ``payload`` is the full payload, of a revisit too; ``record`` the bytes of
    the record, which for a revisit end with the HTTP header.
    """
    h = spark.read.parquet(f"{path}/headers")
    p = spark.read.parquet(f"{path}/payloads")
    d = h.join(p, "sha256", "left").select(*h.columns, "packed")
    d = d.mapInArrow(_unpack, T.StructType([*h.schema.fields, T.StructField("payload", T.BinaryType())]))
    sound = (F.octet_length("payload") == F.col("payload_bytes")) & (F.sha2("payload", 256) == F.col("sha256"))
    d = d.withColumn("payload", F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("sha256"))).cast("binary")))
    kind = F.regexp_extract("header", r"\r\nWARC-Type: ([a-z]+)\r\n", 1)
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    uri = F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1)
    return d.select(
        "page_id", kind.alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
        F.when(F.contains("header", F.lit("\r\nWARC-Target-URI: ")), uri).alias("url"), "payload",
        F.concat(F.encode(F.concat("header", "http"), "UTF-8"),
                 F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")),
                 F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Write the records as plain WARC files; each ends with two line ends, which is the writer's separator here."""
    text = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8")
    (records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", rows_per_file).text(path))


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of each record in the files below ``path``, cut by Content-Length; a file is one task's at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, heads, blocks = content.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end]
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    heads.append(head)
                    blocks.append(data[end:end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(blocks, pa.binary())],
                                                 names=["header", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "header binary, block binary")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to from records that were read back."""
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                          F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


ship(__name__)
