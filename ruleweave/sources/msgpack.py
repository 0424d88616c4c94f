"""MessagePack documents and schemas: a reader of the format's types and a writer of JSON's."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.sources.session import importable

#: Fixed values of the format: first byte of a number, its struct code; of texts, bytes, arrays and maps with a length,
#: the code of the length.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
SIZED = {
    0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"),
    0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"),
}
CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ValueError("the MessagePack data end within a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> Any:
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    def value(self) -> Any:
        b = self.take(1)[0]
        if b < 0x80 or b >= 0xE0:
            return b if b < 0x80 else b - 256
        if b in CONSTANTS:
            return CONSTANTS[b]
        if b in NUMBERS:
            return self.number(NUMBERS[b])
        if b in SIZED:
            return self.sized(SIZED[b][0], self.number(SIZED[b][1]))
        if b < 0xC0:
            return self.sized("map" if b < 0x90 else "list" if b < 0xA0 else "str", b & (0x1F if b >= 0xA0 else 0x0F))
        raise ValueError(f"no value of JSON's kinds starts with byte {b:#x}")

    def sized(self, kind: str, n: int) -> Any:
        if kind == "str":
            return bytes(self.take(n)).decode()
        if kind == "bin":
            return bytes(self.take(n)).hex()
        if kind == "list":
            return [self.value() for _ in range(n)]
        return {str(self.value()): self.value() for _ in range(n)}


def unpack(data: bytes) -> Any:
    """The one value that ``data`` hold; bytes become hexadecimal texts."""
    return next(unpack_all(data))


def unpack_all(data: bytes) -> Iterator[Any]:
    """The values that follow one another in ``data``."""
    reader = _Reader(data)
    while reader.at < len(reader.data):
        yield reader.value()


def pack(x: Any) -> bytes:
    """A JSON value; numbers without a fraction are integers."""
    if x is None or isinstance(x, bool):
        return bytes([next(k for k, v in CONSTANTS.items() if v is x)])
    if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
        x = int(x)
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack(">b", x) if x < 0 else bytes([x])
        return b"\xd3" + struct.pack(">q", x) if -(2**63) <= x < 2**63 else b"\xcb" + struct.pack(">d", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return (bytes([0xA0 | len(data)]) if len(data) < 32 else b"\xdb" + struct.pack(">I", len(data))) + data
    if isinstance(x, (list, tuple)):
        return (bytes([0x90 | len(x)]) if len(x) < 16 else b"\xdd" + struct.pack(">I", len(x))) + b"".join(map(pack, x))
    if isinstance(x, dict):
        head = bytes([0x80 | len(x)]) if len(x) < 16 else b"\xdf" + struct.pack(">I", len(x))
        return head + b"".join(pack(str(k)) + pack(v) for k, v in x.items())
    raise TypeError(f"no JSON value: {type(x).__name__}")


def _texts(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [json.dumps(v) for data in batch.column("content").to_pylist() for v in unpack_all(data)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["j"])


def read_msgpack(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files of MessagePack values, a document each; a file is read by one task."""
    files = importable(spark).read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_texts, "j string").select(F.from_json("j", schema).alias("d")).select("d.*")


def read_packed_schema(spark: SparkSession, path: str) -> Any:
    """A schema file."""
    return unpack(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
