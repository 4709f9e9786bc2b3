"""WARC archives of pages: request, response or revisit, and metadata records, written and read.

A page's three records are one transaction: request and metadata name the capture in
WARC-Concurrent-To. Of equal payloads, by SHA-1 and length, that with the largest page_id is the
response and the others are revisits of it, without a payload. Spark's text writer writes the
archives below the shared folder, as gzip with at most RECORDS_PER_FILE pages each; readers go by
Content-Length. Assembling joins the records on the capture's id and gives one nested row a capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaestor.llm.common import map_arrow, shared_folder, small, written

RECORDS_PER_FILE = 2_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the formats
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE, END = "\r\n", "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 160 bits are 8 times 5 hexadecimal digits, each 4 characters."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for j in (3, 2, 1, 0):
            place = F.floor(bits / 32**j).cast("int") % 32
            out.append(F.substr(F.lit(ALPHABET), place + 1, F.lit(1)))
    return F.concat(*out)


def record_id(kind: str, *parts: Column) -> Column:
    """A name made of what the record is about, so that writing again gives the same."""
    h = F.md5(F.to_json(F.array(F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts])))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def record(kind: Column, fields: dict[str, Column], block: Column) -> Column:
    """One record without the blank lines that end it; null fields are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(LINE, *lines), F.lit(END), block)


def transactions(pages: DataFrame) -> DataFrame:
    """value: the three records of each page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace("url", "[\r\n]+", " ").alias("url"),
        payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    shared = written(
        own.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"))
        .filter("n > 1").select("digest", "bytes", "first_id", F.lit(True).alias("several"))
    )
    first_id = F.when(F.col("several"), F.col("first_id")).otherwise(F.col("page_id"))
    placed = own.join(small(shared), ["digest", "bytes"], "left").withColumn("first_id", first_id)
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def named(kind: str) -> Column:
        return record_id(kind, F.col("page_id"), F.col("url"), F.col("digest"))

    # the response may have had another address, so its name leaves that out
    response = record_id("response", F.col("first_id"), F.col("digest"))
    capture = F.when(revisit, named("revisit")).otherwise(response)
    uri = {"WARC-Target-URI": F.col("url")}
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1)
    asked = F.concat(
        F.lit("GET "), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path),
        F.lit(f" HTTP/1.1{LINE}Host: "), F.coalesce(host, F.lit("")), F.lit(END),
    )
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(END),
    )
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE))
    request = record(
        F.lit("request"),
        {"WARC-Record-ID": named("request"), "WARC-Concurrent-To": capture, **uri,
         "Content-Type": F.lit("application/http; msgtype=request")}, asked,
    )
    answer = record(
        F.when(revisit, "revisit").otherwise("response"),
        {"WARC-Record-ID": capture, **uri, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
         "WARC-Profile": F.when(revisit, PROFILE), "WARC-Refers-To": F.when(revisit, response),
         "Content-Type": F.lit("application/http; msgtype=response")},
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    metadata = record(
        F.lit("metadata"),
        {"WARC-Record-ID": named("metadata"), "WARC-Concurrent-To": capture, **uri,
         "Content-Type": F.lit("application/warc-fields")}, about,
    )
    return placed.select(F.concat_ws(END, request, answer, metadata).alias("value"))


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """The folder with the archives of the pages; by default a new one that all executors share."""
    folder = folder or shared_folder(pages.sparkSession)
    transactions(pages).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(folder)
    return folder


RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, payload binary, intact boolean, fields map<string,string>"
)


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of a gzipped archive, as rows of RECORDS, one in memory at a time."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) as stream:
        while version := stream.readline():
            if version == b"\r\n":
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {version[:40]!r}")
            head = {}
            while line := stream.readline().strip():
                name, _, value = line.decode(errors="replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError(f"record {head.get('warc-record-id')} ends early")
            kind = head.get("warc-type")
            digest, length, payload, intact, fields = head.get("warc-payload-digest"), None, None, None, None
            if kind in ("response", "revisit"):
                digest = digest.removeprefix("sha1:") if digest else None
                top, _, payload = block.partition(b"\r\n\r\n")
                stated = [x.split(b":")[1] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                length = int(stated[0]) if stated else len(payload)
                if kind == "response":
                    length, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    intact, digest = digest in (None, found), found
                else:
                    payload = None
            elif kind == "metadata":
                pairs = (x.partition(":") for x in block.decode(errors="replace").splitlines() if x)
                fields = [(k.strip(), v.strip()) for k, _, v in pairs]
            yield (
                kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
                head.get("warc-target-uri"), digest, length, payload, intact, fields,
            )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder; a damaged archive stops the query."""
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_(), pa.map_(pa.string(), pa.string())]
    names = [part.split()[0] for part in RECORDS.replace("map<string,string>", "map").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), kinds, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=names)

        for batch in batches:
            for archive in batch.column("content"):
                rows, held = [], 0
                for row in parse(archive.as_py()):
                    rows.append(row)
                    held += len(row[7] or b"") + 500
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return map_arrow(files, run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, response (or revisit), request and metadata, each nested.

    Records that were read twice count once. A capture without a request or metadata has null
    there; those of no capture are left out. Records may come without their payload.
    """
    captures = records.filter(F.col("record_type").isin("response", "revisit")).dropDuplicates(["record_id"])

    def others(kind: str, *columns: str) -> DataFrame:
        own = records.filter(F.col("record_type") == kind).filter(F.col("concurrent_to").isNotNull())
        return own.dropDuplicates(["record_id"]).select(
            F.col("concurrent_to").alias("capture"), F.struct("record_id", *columns).alias(kind)
        )

    parts = ("record_type", "target_uri", "payload_digest", "payload_bytes", "payload", "intact", "refers_to")
    answer = F.struct(*[c for c in parts if c in records.columns]).alias("response")
    rows = captures.select("record_id", answer)
    for other in (others("request", "target_uri"), others("metadata", "target_uri", "fields")):
        rows = rows.join(other, rows["record_id"] == other["capture"], "left").drop("capture")
    return rows


def captures_of(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, refers_to (a page_id), payload, intact, of
    pages written to archives and read back.

    A null html is an empty payload, a null url leaves the address out. A null page_id is smaller than
    all. Rows that repeat id, url and html are one capture, as are those that repeat id and html of a
    response. Other columns are ignored.

    Archives are read once for all but the payloads, and once more only where these are asked for.
    """
    records = read_records(pages.sparkSession, write_archives(pages, folder))
    rows = assemble(written(records.drop("payload")))
    named = rows.withColumn("page_id", F.col("metadata.fields")["page_id"].try_cast("long"))
    responses = named.filter("response.record_type = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("page_id").alias("referred")
    ).dropDuplicates(["response_id"])
    # what refers to nothing has a key of its own, or all of it would meet in one task
    refers = F.coalesce("response.refers_to", F.concat(F.lit("-"), F.col("record_id")))
    joined = named.join(responses, refers == F.col("response_id"), "left")
    # one row an id, so Spark leaves this join out where the payload isn't selected
    payloads = records.filter("record_type = 'response'").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("payload_id"), "payload"
    )
    return joined.join(payloads, joined["record_id"] == F.col("payload_id"), "left").select(
        "page_id", "response.record_type", "response.payload_digest", "response.payload_bytes",
        F.col("referred").alias("refers_to"), "payload", "response.intact",
    )
