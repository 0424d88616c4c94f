"""WARC archives: monolithic gzip files, normalised to a gzip member for each record with an offset index.

``write_archives`` writes a record for each page into whole-file gzip streams. ``normalise`` inflates such
a stream once, in pieces, rewrites every record as its own gzip member and writes a sidecar index of lines
"offset length type record-id". ``read_archives`` seeks to each record by the index.

Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the largest page_id is a
response and the others are revisits that refer to it; a revisit keeps the HTTP header, with the payload's
length, and no payload.

Tasks write files under names of their own attempt in the shared folder, and only files that tasks reported
are read. Cases: null html: empty payload. Null url: the record's own urn. Null page_id: written without a
number; never referred to, a revisit where an equal payload has a page_id. Rows with equal page_id: each
gets a record, none revisits another of the same id, and all with the largest one are responses. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.shared import cut, join_checked, join_rows, new_folder

REVISIT_BYTES = 1000
LEVEL = 6
#: Bytes that are inflated or read at once.
PIECE = 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; refers_to: the page of the response that this one revisits."""
    name = f"urn:page:{'' if page_id is None else page_id}"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else name}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    return headers, rest[: int(headers["content-length"])]


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, a piece at a time."""
    member = zlib.decompressobj(31)
    for data in chunks:
        while data:
            yield member.decompress(data, PIECE)
            data = member.unconsumed_tail
            if member.eof:
                data = member.unused_data
                member = zlib.decompressobj(31)


def split_records(plain: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a plain stream."""
    held, want = bytearray(), 0
    for data in plain:
        held += data
        while True:
            if not want:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                want = end + 4 + int(_headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < want:
                break
            yield bytes(held[:want])
            del held[:want]
            want = 0
    if held:
        raise ValueError("the archive ends within a record")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, gz, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    store, name = _store(path)
                    out, gz = store.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(gz.compress(record(page_id, url, (html or "").encode(), refers)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])

    return run


def normalise_file(source: str, target: str) -> int:
    """Rewrite the archive ``source`` with a gzip member for each record as ``target``, with the index
    ``target``.idx beside it; the number of records."""
    (store, name), (out_store, out_name) = _store(source), _store(target)
    at, index = 0, []
    with store.open_input_stream(name, compression=None) as data, out_store.open_output_stream(out_name, compression=None) as out:
        for one in split_records(inflate(iter(lambda: data.read(PIECE), b""))):
            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = gz.compress(one) + gz.flush()
            out.write(member)
            headers = _headers(one.partition(b"\r\n\r\n")[0])
            index.append(f"{at} {len(member)} {headers['warc-type']} {headers['warc-record-id']}\n")
            at += len(member)
    with out_store.open_output_stream(f"{out_name}.idx", compression=None) as out:
        out.write("".join(index).encode())
    return len(index)


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                n = normalise_file(path, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "n"])

    return run


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a normalised archive, found by its index."""
    store, name = _store(path)
    with store.open_input_stream(f"{name}.idx", compression=None) as index:
        lines = index.read().decode().splitlines()
    with store.open_input_file(name) as data:
        for line in lines:
            offset, length, _ = line.split(" ", 2)
            yield parse(zlib.decompress(data.read_at(int(length), int(offset)), 31))


def _page(name: str) -> int | None:
    digits = name.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[tuple] = []
            for headers, block in read_file(path):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["warc-type"]
                digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                size = int(_headers(head)["content-length"])
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"a record of {path} does not hold its payload")
                rows.append((_page(headers["warc-record-id"]), size, digest, kind, _page(headers["warc-refers-to"]) if kind == "revisit" else None))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_FIELDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], list(_FIELDS))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page of larger id has too."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    ids = pages.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.sha1(payload).alias("digest"))
    ids = cut(ids, "digests")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    hit = join_rows(ids, last, "digest").where("page_id is null or page_id < refers_to")
    return hit.select("page_id", "digest", "refers_to").distinct()


def _on_tasks(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, n long").repartition(max(1, len(rows)))


def write_archives(pages: DataFrame, folder: str | None = None) -> list[tuple[str, int]]:
    """Write all pages (page_id, url, html) as monolithic archives; (path, records) of each."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    again = cut(revisits(pages), "revisits")
    keyed = pages.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    keyed = keyed.withColumn("page_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    again = again.withColumn("page_key", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).drop("page_id")
    marked = join_checked(keyed, again, ["page_key", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return [tuple(r) for r in marked.mapInArrow(_write(folder), "path string, n long").collect()]


def normalise(spark, archives: list[tuple[str, int]], folder: str | None = None) -> list[tuple[str, int]]:
    """Normalise archives, a task for each; (path, records) of each result."""
    if not archives:
        return []
    made = _on_tasks(spark, archives).mapInArrow(_normalise(folder or new_folder(spark, "members")), "path string, n long")
    return [tuple(r) for r in made.collect()]


def read_archives(spark, archives: list[tuple[str, int]]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    return _on_tasks(spark, archives).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages."""
    spark = pages.sparkSession
    return read_archives(spark, normalise(spark, write_archives(pages)))
