"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by a squared distance of 1 or
2. The alphabet is dealt into four groups, and an edit touches letters of at most two, so near words agree in
all counts of some two groups: each word enters the six blocks that its counts in two groups name. Inside a
block a NumPy product of the count rows gives all squared distances at once; pairs of at most 2 whose lengths
are equal or adjacent go on, and their letters decide. A pair counts in the first block that holds both.

Words are counted per task before they are shuffled. Blocks share tasks of bounded size by a hash; a block of
more than ``block_words`` words is cut into lots, and a task takes a pair of lots, so no block is gathered
whole. Tasks return a count and the best partner per word, not the pairs. Variants point to a word at least
ten times as frequent, so chains are short; pointers are doubled until they rest.

Defined results: null and empty texts hold no words. A null id counts as empty text in the hash of a run.
Rows are texts of their own, repeated ones too. Ties of n go to the smaller word by code points. An empty table gives
no rows. Other columns are ignored. Code points beyond U+00FF and signs end words, so a word has one byte a
letter in Latin-1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .common import _binaries, give_back, lowered, mixed, slices, text_bytes

# fixed value: letters by frequency in European prose, dealt into groups in turn
_BY_USE = "etaoinshrdlcumwfgypbvkjxqz"
_GROUP = np.arange(256) % 4
for _i, _c in enumerate(_BY_USE):
    _GROUP[ord(_c)] = (_i % 4) if _i // 4 % 2 == 0 else 3 - _i % 4
_STEPS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_GROUP_STEPS = np.where(_GROUP[None, :] == np.arange(4)[:, None], _STEPS[None, :], 0).astype(np.uint64)
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
BLOCK_WORDS, TASK_WORDS, HELD_WORDS = 4096, 1 << 15, 1 << 20


def letter_runs(held: np.ndarray, offsets: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z, U+00C0 to U+00FF with at least ``least`` letters: bytes, letters in each, its text."""
    letter = ((held >= 97) & (held <= 122)) | ((held >= 65) & (held <= 90)) | (held == 0xC3)
    letter[1:] |= (held[:-1] == 0xC3)
    edge = np.zeros(len(held) + 1, dtype=bool)
    edge[offsets] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    after = np.append(~letter[1:], True) | edge[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(letter & after) + 1
    points = np.concatenate([[0], np.cumsum((held & 0xC0) != 0x80)])
    size = points[ends] - points[starts]
    long = size >= least
    starts, ends, size = starts[long], ends[long], size[long]
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[0::2], edges[1::2] = starts, ends
    pieces = _binaries(held, edges, len(held))
    return pieces.take(pa.array(np.arange(0, len(edges), 2))), size, np.searchsorted(offsets, starts, side="right") - 1


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(word, n) of runs whose letter at ``h % length`` is lost where ``every`` divides the crc32 h of ``id:run``."""

    def counts(piece: pa.RecordBatch) -> pa.Table:
        held, offsets = text_bytes(piece.column("text"))
        runs, size, owner = letter_runs(lowered(held), offsets, least)
        prefix = [zlib.crc32(f"{k}:".encode()) for k in piece.column("id").to_pylist()]
        crcs = np.array([zlib.crc32(r, prefix[o]) for r, o in zip(runs.to_pylist(), owner.tolist())], dtype=np.int64)
        hit = crcs % every == 0
        lost = []
        for i in np.flatnonzero(hit & (size > least)).tolist():
            word, at = runs[i].as_py().decode(), int(crcs[i] % size[i])
            lost.append((word[:at] + word[at + 1 :]).encode())
        words = pa.concat_arrays([runs.filter(pa.array(~hit)), pa.array(lost, pa.large_binary())])
        tally = words.value_counts()
        return pa.table({"word": tally.field("values"), "n": tally.field("counts")})

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                parts.append(counts(piece))
                rows += len(parts[-1])
                if rows > HELD_WORDS:
                    parts = [_merged(parts)]
                    rows = len(parts[0])
                    if rows > HELD_WORDS // 2:  # mostly new words: hand them on
                        yield from _out(parts[0])
                        parts, rows = [], 0
        if parts:
            yield from _out(_merged(parts))
        give_back()

    def _out(table: pa.Table):
        kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])
        yield from table.set_column(0, "word", table.column("word").cast(pa.large_string())).cast(kinds).to_batches(max_chunksize=1 << 16)

    read = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return read.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter of all words, and the offset of each."""
    joined = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in joined])]).astype(np.int64)


def group_hashes(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per word and group a linear hash of its letter counts in the group."""
    sums = np.concatenate([np.zeros((4, 1), np.uint64), np.cumsum(_GROUP_STEPS[:, letters], axis=1, dtype=np.uint64)], axis=1)
    return (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).T


def blocks(words: DataFrame) -> DataFrame:
    """Six rows per word: block, pair (which groups name it), word, n."""

    def run(batches):
        for batch in batches:
            hashes = group_hashes(*_letters(batch.column("word")))
            for k, (a, b) in enumerate(PAIRS):
                block = mixed(hashes[:, a] + mixed(hashes[:, b] + np.uint64(k + 1))).view(np.int64)
                columns = [pa.array(block), pa.array(np.full(len(block), k, np.int32)), batch.column("word"), batch.column("n")]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "pair", "word", "n"])

    return words.mapInArrow(run, "block bigint, pair int, word string, n bigint")


def _alphabet(letters: np.ndarray) -> tuple[np.ndarray, int]:
    used = np.unique(letters)
    code = np.zeros(256, dtype=np.int64)
    code[used] = np.arange(len(used))
    return code, len(used)


def near_by_counts(counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of squared distance 1 or 2 and lengths that differ by one at most, from a product of the count rows."""
    gram = counts @ counts.T
    own = gram.diagonal()
    distance = own[:, None] + own[None, :] - 2 * gram
    close = np.triu((distance <= 2.5) & (distance >= 0.5), 1)
    i, j = np.nonzero(close)
    fits = np.abs(lengths[i] - lengths[j]) <= 1
    return i[fits], j[fits]


def one_edit(letters: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j differ by exactly one inserted, deleted or replaced letter."""
    sizes = np.diff(offsets)
    swap = sizes[i] > sizes[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros(len(a), dtype=bool)
    for size in np.unique(sizes[a]).tolist():
        rows = np.flatnonzero(sizes[a] == size)
        step = max(1, (1 << 22) // max(size, 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            place = np.arange(size)
            one = letters[offsets[a[part], None] + place]
            head = one == letters[offsets[b[part], None] + place]
            longer = sizes[b[part]] > size
            tail = one == letters[offsets[b[part], None] + place + 1 * longer[:, None]]
            prefix = np.cumprod(head, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            suffix = np.cumprod(tail[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            out[part] = np.where(longer, prefix + suffix >= size, (~head).sum(axis=1) == 1)
    return out


def _best(words: list, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Per word the number of its partners and the best of them."""
    whose, other = np.concatenate([i, j]), np.concatenate([j, i])
    names = np.array(words, dtype=object)
    order = np.lexsort((_ranks(names)[other], -n[other], whose))
    whose, other = whose[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])) if len(whose) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(whose)))
    columns = [pa.array(names[whose[first]], pa.string()), pa.array(count, pa.int64()), pa.array(names[other[first]], pa.string()), pa.array(n[other[first]], pa.int64())]
    return pa.Table.from_arrays(columns, names=["word", "n_near", "best", "best_n"])


def _ranks(names: np.ndarray) -> np.ndarray:
    out = np.empty(len(names), dtype=np.int64)
    out[np.argsort(names, kind="stable")] = np.arange(len(names))
    return out


def near(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word with near words."""
    rows = materialize(blocks(words), "blocks")
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_words)
    large = materialize(large.select("block", F.ceil(2 * F.col("size") / block_words).cast("int").alias("cuts")), "large")
    placed = rows.join(large, "block", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    placed = placed.withColumn("lot", F.expr("cast(pmod(xxhash64(word), cuts) as int)"))
    bins = max(1, -(-6 * words.count() // TASK_WORDS))
    small = F.struct(F.expr(f"pmod(xxhash64(block, 7), {bins})").alias("bin"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    lots = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda k: F.struct(F.col("block").alias("bin"), F.least("lot", k).alias("low"), F.greatest("lot", k).alias("high")),
    )
    tasks = placed.withColumn("task", F.explode(F.when(F.col("cuts") == 1, F.array(small)).otherwise(lots)))
    tasks = tasks.select(F.col("task.bin").alias("bin"), F.col("task.low").alias("low"), F.col("task.high").alias("high"), "block", "pair", "lot", "word", "n")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        words_, n, lot = table.column("word").combine_chunks(), np.asarray(table.column("n")), np.asarray(table.column("lot"))
        block, pair = np.asarray(table.column("block")), np.asarray(table.column("pair"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        letters, offsets = _letters(words_)
        sizes, (code, width) = np.diff(offsets), _alphabet(letters)
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        i, j = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a < 2:
                continue
            owner = np.repeat(np.arange(b - a), sizes[a:b])
            flat = owner * width + code[letters[offsets[a] : offsets[b]]]
            counts = np.bincount(flat, minlength=(b - a) * width).reshape(b - a, width)
            # a product of counts must be exact in the type's fraction
            counts = counts.astype(np.float32 if sizes[a:b].max() <= 2048 else np.float64)
            x, y = near_by_counts(counts, sizes[a:b])
            i.append(x + a)
            j.append(y + a)
        i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (i, j))
        if low != high:
            keep = lot[i] != lot[j]
            i, j = i[keep], j[keep]
        # the first two groups in which both agree name the block that counts the pair
        hashes = group_hashes(letters, offsets)
        same = hashes[i] == hashes[j]
        agree = np.stack([same[:, a] & same[:, b] for a, b in PAIRS], axis=1) if len(i) else np.zeros((0, 6), bool)
        keep = agree.argmax(axis=1) == pair[i] if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        keep = one_edit(letters, offsets, i, j)
        out = _best(words_.to_pylist(), n, i[keep], j[keep])
        give_back()
        return out

    schema = "word string, n_near bigint, best string, best_n bigint"
    found = tasks.groupBy("bin", "low", "high").applyInArrow(run, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following the forms ends. A form is much more frequent, so there are no cycles."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("far"))
        held = materialize(held.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far"), "roots")
        moved = held.where("far IS NOT NULL").isEmpty()
        held = held.drop("far")
        if moved:
            return held


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, least_n: int = 2, times: int = 10, every: int = 31,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n."""
    words = materialize(counted(docs, key, text, least, every).where(F.col("n") >= least_n), "words")
    beside = near(words, block_words)
    fits: Column = F.col("best_n") >= times * F.col("n")
    whole = words.join(beside, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    whole = materialize(whole, "variants")
    roots = _roots(whole.where("form IS NOT NULL"))
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
