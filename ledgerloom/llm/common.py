"""Helpers the operators share: table access, document keys, bounded batches, word units."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: white space that ends a word, \x20 and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from where the driver did.

    For workers on the driver's machine; a cluster has the package installed or gets it by --py-files.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``max_bytes`` per piece; one long text may be more."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the offset of each; null counts as empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return held, offsets - offsets[0]


def _binaries(held: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    edges = np.append(starts, end).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(held))])


def spaced_units(held: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut texts where white space follows other letters. Units keep their leading white space.

    Returns the units and, per text, the number of units before it.
    """
    space = _SPACE[held]
    cut = np.zeros(len(held), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[first] = True
    starts = np.flatnonzero(cut)
    return _binaries(held, starts, len(held)), np.searchsorted(starts, offsets)


def words(held: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and per text the number of words before it."""
    space = _SPACE[held]
    inner = np.zeros(len(held) + 1, dtype=bool)
    inner[offsets] = True  # texts end words
    begins = ~space
    begins[1:] &= space[:-1] | inner[1:-1]
    after = np.append(space[1:], True) | inner[1:]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(~space & after) + 1
    # words and gaps alternate; every other piece is a word
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[0::2], edges[1::2] = starts, ends
    pieces = _binaries(held, edges, len(held))
    return pieces.take(pa.array(np.arange(0, len(edges), 2))), np.searchsorted(starts, offsets)


def lowered(held: np.ndarray) -> np.ndarray:
    """A-Z made lower case, all other bytes as they are."""
    return np.where((held >= 65) & (held <= 90), held + 32, held).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return free memory to the system at the end of a task, as a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, so that every executor finds the same folder."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = store.makeQualified(location).toString()
    return f"file://{named[5:]}" if named.startswith("file:/") and not named.startswith("file://") else named


def sized(n: int, per_part: int) -> int:
    """Partitions for ``n`` units of work at ``per_part`` each."""
    return max(1, -(-n // per_part))
