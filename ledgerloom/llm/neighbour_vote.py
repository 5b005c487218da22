"""Text quality by a vote of the nearest labelled texts in a latent-semantic space.

A text becomes frequencies of words (lower-cased, hashed to a fixed width), of runs of three letter classes
(white space, line end, lower, upper, digit, ends of sentences, separators, quotes and brackets, other signs), of
word kinds (length, case, same as the word before), and of repeated lines, as square roots, weighted by
inverse document frequency. A truncated singular value decomposition of labelled
texts gives the latent space. Labelled vectors are broadcast; every document's cosines with all of
them are computed in blocks, and the labels of its ``neighbours`` nearest vote, weighted by a power of
the cosine.

The fit takes labelled rows only, at most ``fit_rows`` (those of smallest hash of their id), which
bounds the broadcast and the one task that fits: fit_rows x (terms + dimensions) numbers. The driver gets
weights, basis and vectors only. The rest covers all rows. Labels, languages, sources and ids are not part of the features.

Defined results: a text without letters (null, empty) has no direction and gets the labelled rows'
mean. Without any labelled row every score is one half. Repeated labels of an id count once, as the
lower one; null labels are none. Repeated rows are scored each. Ties at the last neighbour go to the
earlier labelled row. Other columns pass through; a column named like the score is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, text_bytes, words

# letter classes: white space, line end, lower case and letters beyond ASCII, upper case, digits, sentence ends, separators, quotes and brackets
_CLASSES = (b" \t\r\x0b\x0c", b"\n", b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:", b"'\"`()[]{}<>-")
_OTHER = len(_CLASSES)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
_CLASS[97:123] = _CLASS[128:] = 2
for _i, _letters in enumerate(_CLASSES):
    _CLASS[list(_letters)] = _i
_KINDS = _OTHER + 1
RUNS = _KINDS**3
_LENGTHS = np.array([3, 6, 10, 15, 24])
WORD_KINDS = (len(_LENGTHS) + 1) * 3 * 2
HASHED = 1024
TERMS = RUNS + WORD_KINDS + HASHED + 2


def _shares(owner: np.ndarray, code: np.ndarray, n: int, width: int) -> np.ndarray:
    counts = np.bincount(owner * width + code, minlength=n * width).reshape(n, width)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def features(texts: pa.Array) -> np.ndarray:
    """A row of term weights per text, before idf."""
    held, offsets = text_bytes(texts)
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, TERMS), dtype=np.float32)
    if not len(held):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[held]
    same = owner[2:] == owner[:-2]
    runs = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
    out[:, :RUNS] = _shares(owner[:-2][same], runs[same], n, RUNS)
    units, at = words(held, offsets)
    if len(units):
        coded = units.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        named = np.array([xxhash.xxh64_intdigest(w.lower()) % HASHED for w in coded.dictionary.to_pylist()], dtype=np.int64)
        edges = np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], dtype=np.uint8)
        first, second = _CLASS[data[edges[:-1]]], _CLASS[data[np.minimum(edges[:-1] + 1, edges[1:] - 1)]]
        shape = np.where(first != 3, 0, np.where(second == 3, 2, 1))
        length = np.searchsorted(_LENGTHS, np.diff(edges))
        whose = np.repeat(np.arange(n), np.diff(at))
        again = np.zeros(len(codes), dtype=np.int64)
        again[1:] = (codes[1:] == codes[:-1]) & (whose[1:] == whose[:-1])
        out[:, RUNS : RUNS + WORD_KINDS] = _shares(whose, (length * 3 + shape) * 2 + again, n, WORD_KINDS)
        out[:, RUNS + WORD_KINDS : -2] = _shares(whose, named[codes], n, HASHED)
    for i, text in enumerate(texts.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        if lines:
            fresh = len(set(lines)) / len(lines)
            out[i, -2:] = np.sqrt(fresh), np.sqrt(1 - fresh)
    return out


@dataclass
class Voters:
    """Term weights, the latent basis, and labelled unit vectors with their labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.weights) @ self.basis
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 1e-9)

    def vote(self, rows: np.ndarray, neighbours: int, power: float, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        latent, out = self.project(rows), np.full(len(rows), float(self.labels.mean()))
        k = min(neighbours, len(self.labels))
        for start in range(0, len(latent), block):
            part = latent[start : start + block]
            cosines = part @ self.vectors.T
            last = np.partition(cosines, -k, axis=1)[:, -k, None]
            tied = cosines == last
            chosen = tied & (np.cumsum(tied, axis=1) <= k - (cosines > last).sum(axis=1, keepdims=True))
            near = np.nonzero(chosen | (cosines > last))[1].reshape(len(part), k)
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** power
            total = weight.sum(axis=1)
            share = (weight * self.labels[near]).sum(axis=1)
            some = (total > 0) & part.any(axis=1)
            out[start : start + block][some] = share[some] / total[some]
        return out


def learn(rows: np.ndarray, labels: np.ndarray, dimensions: int, block: int = 512) -> Voters:
    """Idf weights and the leading singular directions of labelled rows, taken some rows at a time."""
    parts = [slice(i, i + block) for i in range(0, len(rows), block)]
    seen = sum(((rows[p] > 0).sum(axis=0) for p in parts), np.zeros(TERMS, dtype=np.int64))
    weights = (np.log((1 + len(rows)) / (1 + seen)) + 0.3).astype(np.float32)
    model = Voters(weights, np.zeros((TERMS, dimensions), np.float32), np.zeros((0, dimensions), np.float32), labels)
    if not parts:
        return model
    products = np.zeros((TERMS, TERMS), dtype=np.float32)
    for p in parts:
        weighted = rows[p].astype(np.float32) * weights
        products += weighted.T @ weighted
    model.basis = np.ascontiguousarray(np.linalg.eigh(products)[1][:, ::-1][:, :dimensions]).astype(np.float32)
    model.vectors = np.concatenate([model.project(rows[p].astype(np.float32)) for p in parts])
    return model


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = 6000, dimensions: int = 48,
) -> Voters:
    """Learn from labelled documents whose label row meets ``usable``."""
    rows = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull())
    known = rows.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(fit_rows)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most fit_rows rows of two numbers are broadcast
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                made = [r.tobytes() for r in features(piece.column("text")).astype(np.float16)]
                columns = [piece.column("id"), piece.column("label"), pa.array(made, pa.binary()), pa.array(np.zeros(len(made), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "terms", "one"])
        give_back()

    def one(table: pa.Table) -> pa.Table:
        held = table.sort_by("id")
        terms = text_bytes(held.column("terms"))[0].view(np.float16).reshape(-1, TERMS)
        model = learn(terms, np.asarray(held.column("label")).astype(np.int64), dimensions)
        parts = [x.tobytes() for x in (model.weights, model.basis, model.vectors, model.labels)]
        give_back()
        return pa.table({n: pa.array([p], pa.binary()) for n, p in zip(_PARTS, parts)})

    kind = known.schema["id"].dataType.simpleString()
    rows = found.mapInArrow(run, f"id {kind}, label int, terms binary, one int")
    # at most fit_rows rows meet in one task
    made = rows.groupBy("one").applyInArrow(one, ", ".join(f"{n} binary" for n in _PARTS)).first()
    if made is None:
        return learn(np.zeros((0, TERMS), np.float16), np.zeros(0, np.int64), dimensions)
    weights, basis, vectors = (np.frombuffer(made[n], np.float32) for n in _PARTS[:3])
    return Voters(weights, basis.reshape(TERMS, -1), vectors.reshape(-1, dimensions), np.frombuffer(made["labels"], np.int64))


_PARTS = ("weights", "basis", "vectors", "labels")


def score(docs: DataFrame, voters: Voters, text: str = "text", name: str = "score", neighbours: int = 25, power: float = 8.0) -> DataFrame:
    """All columns of ``docs`` and the score."""
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                votes = shared.value.vote(features(piece.column(text)), neighbours, power)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [pa.array(votes)], names=[*kept, name])
        give_back()

    rows = docs.select(kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{name}` double")
