"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of how many bits follow.

A file holds the ids of documents in ascending doc_id order: blocks of up to BLOCK_IDS ids, then a
footer with the blocks' byte offsets and the documents' ids and token counts, then the footer's length
and a magic. A value of 60 bits or more is an escape: its word holds the largest 60-bit number, and the
value follows in the block's list of escapes. Blocks decode alone and without a loop over values.

A task writes one file under a name of its own attempt, and only files that tasks reported are read, so
retried or speculative tasks leave no wrong rows.

Cases: null or empty text: the end id alone. Null doc_id: first. Repeated rows: written each, equal
doc_ids in the order of their texts. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K
from ruleweave.llm.shared import new_folder
from ruleweave.llm.tokens import encoder

#: Fixed values of Simple-8b: ids in a word, bits of an id, by selector.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

BLOCK_IDS = 1 << 16
MAGIC = b"S8BTOK01"
U = np.uint64
_ESCAPE = (1 << 60) - 1


def _steps(values: np.ndarray) -> np.ndarray:
    """Selector of the word that would start at each value."""
    n = len(values)
    sel = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        count, wide = COUNTS[s], values >> U(BITS[s]) != 0
        if n < count or n - np.count_nonzero(wide) < count:
            continue
        before = np.zeros(n + 1, np.int32)
        np.cumsum(wide, out=before[1:])
        sel[: n - count + 1][before[count:] == before[:-count]] = s
    return sel


def encode_block(values: np.ndarray) -> bytes:
    """count, escapes and words of a block: u32, u32, then u64 each."""
    values = np.asarray(values, U)
    escaped = values >= U(_ESCAPE)
    escapes = values[escaped]
    body = np.where(escaped, U(_ESCAPE), values)
    sel = _steps(body)
    step = np.array(COUNTS)[sel].tolist()
    starts, i, n = [], 0, len(body)
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    chosen = sel[at] if n else np.zeros(0, np.uint8)
    words = chosen.astype(U) << U(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s] if BITS[s] else 0):
            words[mine] |= body[at[mine] + j] << U(j * BITS[s])
    return np.array([n, len(escapes)], "<u4").tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    n, k = np.frombuffer(data, "<u4", 2).tolist()
    words = np.frombuffer(data, "<u8", offset=8)
    escapes, words = words[:k], words[k:]
    sel = (words >> U(60)).astype(np.int64)
    counts = np.array(COUNTS)[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(n, U)
    for s in np.unique(sel).tolist():
        if BITS[s]:
            mine = sel == s
            place = np.arange(COUNTS[s])
            got = words[mine][:, None] >> (place * BITS[s]).astype(U)[None, :] & U((1 << BITS[s]) - 1)
            out[at[mine][:, None] + place[None, :]] = got
    out[out == U(_ESCAPE)] = escapes
    return out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_ids(path: str, documents: Iterator[tuple[int | None, np.ndarray]]) -> int:
    """Write (doc_id, ids) pairs as one file; the number of ids."""
    store, name = _filesystem(path)
    names, counts, blocks, waiting, held, at = [], [], [], [], 0, 0
    with store.open_output_stream(name) as out:

        def flush(all_of_it: bool) -> None:
            nonlocal waiting, held, at
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            a = 0
            while len(ids) - a >= BLOCK_IDS or all_of_it and a < len(ids):
                data = encode_block(ids[a : a + BLOCK_IDS])
                out.write(data)
                blocks.append(at)
                at += len(data)
                a += BLOCK_IDS
            waiting = [ids[a:]]
            held = len(waiting[0])

        for doc_id, ids in documents:
            names.append(doc_id)
            counts.append(len(ids))
            waiting.append(ids)
            held += len(ids)
            if held >= 4 * BLOCK_IDS:
                flush(False)
        flush(True)
        footer = zlib.compress(json.dumps({"blocks": [*blocks, at], "doc_ids": names, "counts": counts}).encode())
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    return sum(counts)


def read_ids(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) pairs of a file, a block at a time."""
    store, name = _filesystem(path)
    with store.open_input_file(name) as data:
        end = data.size()
        tail = data.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int.from_bytes(tail[:8], "little")
        footer = json.loads(zlib.decompress(data.read_at(size, end - 16 - size)))
        spans = iter(zip(footer["blocks"], footer["blocks"][1:], strict=False))
        have = np.zeros(0, np.uint32)
        for doc_id, n in zip(footer["doc_ids"], footer["counts"], strict=True):
            parts, short = [have], n - len(have)
            while short > 0:
                a, b = next(spans)
                parts.append(decode_block(data.read_at(b - a, a)).astype(np.uint32))
                short -= len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]


def _writer(folder: str, tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.s8b"

        def documents():
            for batch in batches:
                for run in K.slices(batch, "text"):
                    for doc_id, text in zip(run.column("doc_id").to_pylist(), run.column("text").to_pylist(), strict=True):
                        yield doc_id, np.frombuffer(encode(text or "") + end, "<u4")

        n = write_ids(path, documents())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([n], pa.int64())], ["part", "path", "n"])

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> list[tuple[str, int]]:
    """Encode ``docs`` into files; (path, ids of all files before it) in doc_id order."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part long, path string, n long").collect())
    before, out = 0, []
    for _, path, n in rows:
        out.append((path, before))
        before += n
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids in read_ids(path):
                rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    df = spark.createDataFrame(files, "path string, before long").repartition(max(1, len(files)))
    return df.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
