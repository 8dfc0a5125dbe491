"""Binary model containers: a JSON header, a table of sections, their bytes, a checksum.

Files are read with Spark's binaryFile source, so many containers are parsed in parallel; a parsed
file becomes one row per section. A file that is no container gives one row with an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: leading bytes, size of a section entry, kinds of data.
MAGIC = b"BLMF\x00\x01\x00\x00"
ENTRY = 56
KINDS = ["u8", "u16", "i32", "f32", "u64", "str", "raw"]
SCHEMA = "path string, header string, name string, kind string, shape array<int>, data binary, error string"


def build(header: dict, sections: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """Bytes of a container. ``sections``: (name, kind, shape of up to four, data)."""
    text = json.dumps(header).encode()
    head = MAGIC + struct.pack("<II", 1, 0)
    size = -(-(20 + len(text) + 1) // 512) * 512
    out = bytearray(head + struct.pack("<I", size) + text).ljust(size, b"\0")
    names_at = size + 4 + ENTRY * len(sections)
    names, data, entries = bytearray(), bytearray(), bytearray()
    data_at = names_at + sum(2 + len(n.encode()) for n, *_ in sections)
    for name, kind, shape, raw in sections:
        if len(shape) > 4:
            raise ValueError("a section has four dimensions at most")
        encoded = name.encode()
        entry = struct.pack("<IIQQII", names_at + len(names), len(encoded), data_at + len(data), len(raw), KINDS.index(kind), len(shape))
        entries += (entry + struct.pack(f"<{len(shape)}I", *shape)).ljust(ENTRY, b"\0")
        names += struct.pack("<H", len(encoded)) + encoded
        data += raw
    out += struct.pack("<I", len(sections)) + entries + names + data
    out += b"\0" * (-len(out) % 8)
    return bytes(out) + hashlib.sha256(out).digest()[:8]


def parse(blob: bytes) -> tuple[str, list[tuple[str, str, list[int], bytes]]]:
    """Header text and sections of a container; ValueError says what is wrong with it."""
    if len(blob) < 24:
        raise ValueError(f"too short: {len(blob)} bytes")
    if blob[:4] != MAGIC[:4]:
        raise ValueError("not a container")
    (size,) = struct.unpack_from("<I", blob, 16)
    if size + 4 > len(blob):
        raise ValueError("the header ends beyond the file")
    header = blob[20:size].split(b"\0", 1)[0].decode()
    json.loads(header)
    (count,) = struct.unpack_from("<I", blob, size)
    found = []
    for i in range(count):
        at = size + 4 + i * ENTRY
        if at + ENTRY > len(blob):
            raise ValueError(f"section entry {i} lies beyond the file")
        name_at, name_len, data_at, data_len, kind, rank = struct.unpack_from("<IIQQII", blob, at)
        if name_at + 2 + name_len > len(blob) or data_at + data_len > len(blob) or kind >= len(KINDS) or rank > 4:
            raise ValueError(f"section {i} is out of bounds")
        name = blob[name_at + 2 : name_at + 2 + name_len].decode()
        found.append((name, KINDS[kind], list(struct.unpack_from(f"<{rank}I", blob, at + 32)), blob[data_at : data_at + data_len]))
    return header, found


def sections(files: DataFrame) -> DataFrame:
    """One row per section of every container of ``files`` (path, content)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    header, found = parse(blob)
                    rows += [(p, header, n, k, s, d, None) for n, k, s, d in found]
                except (ValueError, struct.error) as e:
                    rows.append((p, None, None, None, None, None, str(e)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per section of every container at ``path`` (a file, folder or pattern)."""
    return sections(spark.read.format("binaryFile").load(path))


def checked(files: DataFrame) -> DataFrame:
    """(path, header, bytes, valid) of ``files`` (path, content): whether the last eight bytes are those
    of the hash of the rest. In the JVM."""
    body, end = F.expr("substring(content, 1, length(content) - 8)"), F.expr("substring(content, length(content) - 7, 8)")
    header = F.expr("regexp_extract(decode(substring(content, 21, 492), 'ISO-8859-1'), '^([^\\\\x00]*)', 1)")
    return files.select("path", header.alias("header"), F.length("content").alias("bytes"), (F.substring(F.sha2(body, 256), 1, 16) == F.lower(F.hex(end))).alias("valid"))


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, valid) of every container at ``path``."""
    return checked(spark.read.format("binaryFile").load(path)).drop("header")


def write(files: DataFrame, path: str) -> None:
    """Containers (path, content) through Spark's own writer, so that any shared file system will do:
    a table with one container a row."""
    files.select("path", "content").write.mode("overwrite").parquet(path)
