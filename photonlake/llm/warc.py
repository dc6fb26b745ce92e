"""WARC archives with revisit resolution.

One pass over the pages takes each payload's digest and puts the payload aside in a spool file; from there on only
headers are shuffled. Of records with equal digests the one with the largest page_id is the response; the others become
revisit records, which carry headers only. Headers then go back to the spool file that they came from, and a task
writes one archive of gzip members, one member a record, reading the payloads of responses where they stand. Reading
back yields one row of headers for each record; revisits find their response by the record ID that they name, and from
it their payload's length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, Workspace, filesystem, mapped

#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

HEADERS = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_id string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(file: str, at: int) -> str:
    """The ID of the record of the payload at a place of a spool file: no other record's, and the same in a task that runs again."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{file}:{at}')}>"


def clean(url: str | None) -> str | None:
    """A URL that can stand on a header line."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, original: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record with the ID `original`."""
    url = clean(url)
    length = f"Content-Length: {len(payload)}\r\n" if original is None else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{length}\r\n".encode() + payload
    lines = [VERSION, f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The header row of a record; a response's length and digest are those of the payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record begins here")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if len(block) != int(h["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n" or "sha1:" + sha1_base32(block) != h["WARC-Block-Digest"]:
        raise ValueError("a record's block is damaged")
    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and sha1_base32(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": int(h["WARC-Page-ID"]) if "WARC-Page-ID" in h else None, "url": h.get("WARC-Target-URI"), "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"],
        "payload_digest": digest, "payload_bytes": None if payload is None else len(payload), "refers_to_id": h.get("WARC-Refers-To"),
    }


def members(stream, chunk_bytes: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    inflate, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk_bytes)):
        out.append(inflate.decompress(data))
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends inside a record")


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield tuple(batch.column(c)[k].as_py() for c in range(batch.num_columns))


SPOOLED = "page_id long, url string, digest string, file string, at long, size long"


def spooled(pages: DataFrame, root: str) -> DataFrame:
    """The header row of every page, and where its payload stands in the spool files under root.

    A file belongs to one attempt of a task and so do the rows that name it; files of attempts that failed are read by
    none and go with root.
    """

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"{uuid.uuid4().hex}.spool", None
        for batch in batches:
            out = out or AtomicFile(f"{root}/{name}")
            digests, places, sizes = [], [], []
            for x in batch.column("payload"):
                payload = x.as_py() or b""
                data = zlib.compress(payload, 1)
                digests.append(sha1_base32(payload))
                places.append(out.size)
                sizes.append(len(data))
                out.write(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(digests, pa.string()), pa.array([name] * len(sizes), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                names=["page_id", "url", "digest", "file", "at", "size"],
            )
        if out:
            out.commit()

    return mapped(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")), spool, SPOOLED)


#: Parts of a digest's headers in joins, so that a payload of very many pages is no single key.
SALTS = 8


def with_originals(headers: DataFrame) -> DataFrame:
    """headers (page_id, digest, file, at and more) with original_file and original_at, the place of the payload of the
    largest page_id of their digest, for those with a smaller one. Of rows with the largest, the last in the files."""
    top = headers.groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "file", "at"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "top")
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("file", "at"), F.lit(SALTS)).cast("int")
    joined = headers.withColumn("salt", salt).join(salted, ["digest", "salt"], "left")
    revisits = F.col("page_id") < F.col("top.page_id")
    return joined.withColumns({"original_file": F.when(revisits, F.col("top.file")), "original_at": F.when(revisits, F.col("top.at"))}).drop("top", "salt")


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Writes every page to the archives under root; the manifest has a row for each archive."""
    spark = pages.sparkSession
    work = Workspace(spark, "spool")
    payloads = work.path("payloads")
    headers = work.stage(spooled(pages, payloads), "headers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n, opened, spool = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0, None, None
        for batch in batches:
            for page_id, url, digest, file, at, size, original_file, original_at in _records(batch):
                out = out or AtomicFile(f"{root}/{name}")
                if file != opened:
                    where, path = filesystem(f"{payloads}/{file}")
                    opened, spool = file, where.open_input_file(path)
                payload = b""
                if original_file is None:
                    spool.seek(at)
                    payload = zlib.decompress(spool.read(size))
                deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                original = None if original_file is None else record_id(original_file, original_at)
                out.write(deflate.compress(record(record_id(file, at), page_id, url, payload, digest, original)) + deflate.flush())
                n += 1
        if out:
            out.commit()
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [n], "bytes": [out.size]})

    n_files = max(1, headers.select("file").distinct().count())
    rows = with_originals(headers).select("page_id", "url", "digest", "file", "at", "size", "original_file", "original_at").repartitionByRange(n_files, "file").sortWithinPartitions("file", "at")
    mapped(rows, write, "name string, records long, bytes long").write.mode("overwrite").parquet(f"{root}/manifest")
    work.clear()
    return spark.read.schema("name string, records long, bytes long").parquet(f"{root}/manifest")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """The header rows of all records of the archives under root."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "record_id", "record_type", "payload_digest")), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string())])
        for batch in batches:
            for name, n in _records(batch):
                where, path = filesystem(f"{root}/{name}")
                rows, seen = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        rows.append(parsed(data))
                        seen += 1
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows = []
                if seen != n:
                    raise ValueError(f"{name} has other records than its manifest says")
                yield pa.RecordBatch.from_pylist(rows, fields)

    manifest = spark.read.schema("name string, records long, bytes long").parquet(f"{root}/manifest")
    n = max(1, manifest.count())
    return mapped(manifest.select("name", "records").repartitionByRange(n, "name"), read, HEADERS)


def resolved(headers: DataFrame) -> DataFrame:
    """headers with refers_to and payload_bytes of revisits, from the record whose ID they name.

    A revisit that names no response, or one of another payload, raises.
    """
    responses = headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest"))
    revisit = F.col("record_type") == "revisit"
    joined = headers.where(revisit).drop("payload_bytes").join(responses, "refers_to_id", "left")
    wrong = F.raise_error(F.concat(F.lit("revisit "), "record_id", F.lit(" refers to no response with its payload: "), F.coalesce("refers_to_id", F.lit("none"))))
    checked = F.when(F.col("original_digest") == F.col("payload_digest"), F.col("original_bytes")).otherwise(wrong.cast("long"))
    own = headers.where(~revisit).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(joined.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to")))


def archive_pages(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes all pages and gives page_id, payload_bytes, payload_digest, record_type, refers_to as read back.

    Null html is an empty payload; a page without page_id is a response of its own that none revisits; of repeated
    rows with the largest page_id each is a response; rows of one page_id with different html are records of their own,
    each resolved by its own payload; a very long payload is one record, in memory once; an empty table gives no rows;
    further columns are ignored.
    """
    spark, work = pages.sparkSession, Workspace(pages.sparkSession, "warc")
    root = root or work.path("archives")
    write_archives(pages.select("page_id", "url", "html"), root)
    return resolved(work.stage(read_archives(spark, root), "headers"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL: dict[str, str] = {}
