"""Token ids in files of shuffled bit or byte planes, written and read by Spark tasks.

Documents are range-partitioned by id; each partition encodes its sorted texts and writes one file.
A file holds blocks of ``block_ids`` 32-bit ids. A block's ids are transposed into 4 byte planes (or
32 bit planes), each compressed with zstandard. The footer holds the chunk index (place and size of
every plane) and the document index, so a reader can fetch single blocks.

    magic, planes of block 0, planes of block 1, ..., footer (JSON, zstandard), footer size, magic

Files get their final name by a rename once complete; a task that runs again writes the same bytes.
The driver sees one small row per file.

Defined results: a null text is empty and has the end id alone. Documents with a null id come first.
Rows of one id follow in the order of their text's hash. An empty table makes no files. Other columns
are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import new_path
from .common import give_back, qualified, slices
from .tokens import encoder, ended

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of 32-bit ids, least significant first."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(columns[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(columns, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        columns = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes]
        columns = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(columns).view("<u4").reshape(-1)


class Writer:
    """Writes one file; ids and documents may come in any pieces."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.place = [], 0, len(MAGIC)
        self.blocks, self.keys, self.lengths = [], [], []
        stream.write(MAGIC)

    def add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.keys += keys
        self.lengths += lengths.tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        sizes = []
        for plane in to_planes(ids, self.kind):
            packed = self.press.compress(plane)
            self.stream.write(packed)
            sizes.append(len(packed))
        self.blocks.append([self.place, len(ids), sizes])
        self.place += sum(sizes)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = {"kind": self.kind, "blocks": self.blocks, "keys": self.keys, "lengths": self.lengths}
        packed = self.press.compress(json.dumps(footer).encode())
        self.stream.write(packed + struct.pack("<q", len(packed)) + MAGIC)


def footer(stream, size: int) -> dict:
    """The chunk index and document index of an open file of ``size`` bytes."""
    stream.seek(size - 8 - len(MAGIC))
    tail = stream.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a complete file of id planes")
    n = struct.unpack("<q", tail[:8])[0]
    stream.seek(size - 8 - len(MAGIC) - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(stream.read(n)))


def read_block(stream, index: dict, i: int) -> np.ndarray:
    place, n, sizes = index["blocks"][i]
    stream.seek(place)
    packed, open_, at, planes = stream.read(sum(sizes)), zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        planes.append(open_.decompress(packed[at : at + size]))
        at += size
    return from_planes(planes, n, index["kind"])


def documents(stream, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The key and ids of every document, one block in memory at a time besides a document in the making."""
    index = footer(stream, size)
    parts, block, at = [], np.empty(0, "<u4"), 0
    blocks = iter(range(len(index["blocks"])))
    for key, length in zip(index["keys"], index["lengths"]):
        need, parts = length, []
        while need:
            if at == len(block):
                block, at = read_block(stream, index, next(blocks)), 0
            piece = block[at : at + need]
            parts.append(piece)
            at, need = at + len(piece), need - len(piece)
        yield key, np.concatenate(parts) if parts else np.empty(0, "<u4")


def write(
    docs: DataFrame,
    tokenizer: str,
    end: int = 0,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
) -> list[tuple[str, int, int]]:
    """Write files below ``folder`` (default: a new one of the shared folder); path, documents and ids of each, in order."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "planes"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        writer = stream = temporary = None
        for batch in batches:
            for piece in slices(batch, "text", 1 << 23):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    temporary = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(temporary)
                    writer = Writer(stream, kind, block_ids)
                ids, offsets = ended(*encoder(tokenizer).encode(piece.column("text")), end)
                writer.add(piece.column("key").to_pylist(), ids, np.diff(offsets))
        if writer is not None:
            writer.close()
            stream.close()
            store.move(temporary, f"{base}/{part:06d}.ids")
            row = [part], [f"{base}/{part:06d}.ids"], [len(writer.keys)], [sum(writer.lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], names=["part", "name", "docs", "ids"])
        give_back()

    read = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    placed = read.repartitionByRange(*order).sortWithinPartitions(*order)
    made = placed.mapInArrow(run, "part int, name string, docs bigint, ids bigint").collect()  # one row per file
    scheme = folder.partition("://")[0] + "://"
    return [(scheme + r["name"], r["docs"], r["ids"]) for r in sorted(made)]


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """A row per document from the files alone: doc_id, start, n_tokens, ids_crc32. A task reads a file."""
    starts, upto = [], 0
    for name, _, ids in files:
        starts.append((qualified(spark, name), upto))
        upto += ids

    def run(batches):
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("name", "start"))):
                store, path = fs.FileSystem.from_uri(name)
                size, rows = store.get_file_info(path).size, []
                with store.open_input_file(path) as stream:
                    for key, ids in documents(stream, size):
                        rows.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    listed = spark.createDataFrame(starts, "name string, start bigint")
    spread = listed.repartition(max(1, len(starts)), "name") if starts else listed
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=names)
