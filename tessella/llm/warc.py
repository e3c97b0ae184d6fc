"""WARC archives: written as whole gzip streams, normalised to one gzip member a record with a sidecar offset index, read by offset.

`write` makes one monolithic .warc.gz after another in each task. `normalise` inflates each file once, a block at a time,
rewrites every record as its own member and writes a tab-separated index beside it. `read` fetches records by offset. Files are
written under names of their own in the shared folder; only those that a task's manifest row lists count. The pages are shuffled once, by payload digest.

Equal payloads (length and SHA-1): the row with the smallest page_id is the response, others revisit it; rows that repeat that
page_id are responses too. A null page_id is larger than any; where all are null, all are responses. A null html is an empty payload, a null url
has no target URI. An empty table has no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import HOT_ROWS, column, materialise, shared_dir, slices

BLOCK = 1 << 20
MAX_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, record long, offset long, length long, type string, record_id string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to. Payloads of more than a 10,000th of the rows, of which there are fewer than 10,000, are looked up by broadcast and their pages dealt evenly."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html")).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    groups = materialise(keyed.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    rows = groups.agg(F.sum("n")).first()[0] or 0
    groups = groups.where("n > 1 and first is not null")
    often = F.col("n") > max(HOT_ROWS, rows // 10_000)
    hot = groups.where(often).select("digest", "size", F.col("first").alias("hot"))
    marked = keyed.join(F.broadcast(hot), ["digest", "size"], "left")
    rest = groups.where(~often).select("digest", "size", F.lit(0).alias("salt"), "first")
    salted = marked.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)))).join(rest, ["digest", "size", "salt"], "left")
    first = F.coalesce("hot", "first")
    return salted.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(first), F.lit(None)).otherwise(first).alias("refers_to"))


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20) -> DataFrame:
    """Monolithic archives of all pages, each one gzip stream; the manifest of their files."""
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        out = None
        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(column(batch, x).to_pylist() for x in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, size, n, gz = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                blob = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date)
                out.write(gz.compress(blob))
                size, n = size + len(blob), n + 1
                if size >= roll_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], names=["file", "records"])
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], names=["file", "records"])

    return materialise(with_revisits(pages).mapInArrow(run, "file string, records long"), "warc-manifest")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its members, a block at a time."""
    gz, fresh = zlib.decompressobj(31), True
    while block := source.read(BLOCK):
        while block:
            fresh = False
            yield gz.decompress(block, BLOCK)
            while gz.unconsumed_tail:
                yield gz.decompress(gz.unconsumed_tail, BLOCK)
            block = gz.unused_data
            if gz.eof:
                gz, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the gzip stream is cut off")


def records(source) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of a WARC file in gzip."""
    held = bytearray()
    stream = inflated(source)

    def more() -> bool:
        for x in stream:
            held.extend(x)
            if x:
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record is cut off")
                return
        head = bytes(held[:end])
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        size = int(headers(head)["content-length"])
        while len(held) < end + size + 8:
            if not more():
                raise ValueError("a record is cut off")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + size + 8]


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite each archive in column `file` with a member for each record and an index beside it; the manifest of both."""
    folder = shared_dir(files.sparkSession, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            for uri in column(batch, "file").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                source_system, path = fs.FileSystem.from_uri(uri)
                with source_system.open_input_stream(path, compression=None) as source, system.open_output_stream(f"{root}/{name}", compression=None) as out, system.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    at = n = 0
                    for head, block in records(source):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()
                        out.write(member)
                        h = headers(head)
                        index.write("\t".join((name, str(n), str(at), str(len(member)), h["warc-type"], h["warc-record-id"])).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{folder}/{name}"]), pa.array([f"{folder}/{name}.idx"]), pa.array([n])], names=["archive", "file", "index", "records"])

    tasks = max(1, min(files.count(), MAX_TASKS))  # named, else Spark would merge these short rows into few tasks
    return materialise(files.select("file").repartition(tasks, "file").mapInArrow(run, "archive string, file string, index string, records long"), "warc-members-manifest")


def index_of(manifest: DataFrame) -> DataFrame:
    """The index rows of all archives that the manifest lists, with the archive's file."""
    spark = manifest.sparkSession
    one = manifest.select("index").first()
    if one is None:
        return spark.createDataFrame([], INDEX).withColumn("file", F.lit("").cast("string"))
    rows = spark.read.schema(INDEX).option("sep", "\t").option("pathGlobFilter", "*.idx").csv(one["index"].rpartition("/")[0])
    return rows.join(manifest.select("archive", "file"), "archive")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(manifest: DataFrame, block: int = 512) -> DataFrame:
    """Every record fetched by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(column(batch, x).to_pylist() for x in ("file", "offset", "length"))):
                if uri != opened:
                    system, path = fs.FileSystem.from_uri(uri)
                    opened, source = uri, system.open_input_file(path)
                whole = zlib.decompress(source.read_at(length, offset), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                h = headers(head)
                http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
                size, digest = int(headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{uri}: the payload at {offset} doesn't match its digest")
                rows.append((_page(h["warc-record-id"]), size, digest, h["warc-type"], _page(h.get("warc-refers-to"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    records = manifest.agg(F.sum("records")).first()[0] or 0
    tasks = max(1, min(records // (4 * block), MAX_TASKS))
    placed = index_of(manifest).repartition(tasks, "file", F.floor(F.col("record") / block)).sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(run, RESULT)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS size, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY size, hex) AS first FROM h)
SELECT page_id, size::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, i // 8 * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
