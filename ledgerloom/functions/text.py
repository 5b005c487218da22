"""Reference texts: normal form, edit similarity, and the candidate keys of the fuzzy match."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: characters dropped from a reference before it is compared: dash, underscore, white space
SEPARATORS = (
    "-_ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# fixed value: subsequences listed per text before the keys switch to text pieces
MAX_SUBSEQUENCES = 5000

# fixed value: letters that one machine word has bits for
_WORD_BITS = 64


def normalize_reference(ref: Column) -> Column:
    return F.upper(F.translate(F.coalesce(ref.cast("string"), F.lit("")), SEPARATORS, ""))


def common_subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, counted in letters."""
    return _counter()(a, b)


def _counter() -> Callable[[Column, Column], Column]:
    """One bit per letter of ``b``; a letter of ``a`` clears the next bit it can extend a subsequence by.

    Texts of up to a machine word's bits are counted a batch at a time, letter by letter. Of longer ones the letters that both
    begin or end with are in every longest subsequence, so bits are needed for the rest alone.
    """

    def common(a: str, b: str) -> int:
        size, head, tail = min(len(a), len(b)), 0, 0
        while head < size and a[head] == b[head]:
            head += 1
        while tail < size - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        places: dict[str, int] = {}
        for i, letter in enumerate(b):
            places[letter] = places.get(letter, 0) | 1 << i
        full = left = (1 << len(b)) - 1
        for letter in a:
            hit = left & places.get(letter, 0)
            left = (left + hit | left - hit) & full
        return head + tail + len(b) - left.bit_count()

    def letters(texts: pd.Series, sizes: np.ndarray, width: int, nothing: int) -> np.ndarray:
        codes = np.array(texts, dtype=f"<U{width}").view("<u4").reshape(len(texts), width)
        return np.where(np.arange(width) < sizes[:, None], codes, np.uint32(nothing))

    def common_short(a: pd.Series, b: pd.Series, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        bits = next(w for w in (8, 16, 32, _WORD_BITS) if w >= lb.max())
        # past the end of a text stand codes that no letter has, and that differ
        x, y = letters(a, la, max(int(la.max()), 1), 0xFFFFFFFF), letters(b, lb, bits, 0xFFFFFFFE)
        left = full = np.where(lb > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (_WORD_BITS - np.maximum(lb, 1)).astype(np.uint64), np.uint64(0))
        for i in range(x.shape[1]):
            places = np.packbits((y == x[:, i : i + 1]).reshape(-1), bitorder="little").view(f"<u{bits // 8}")
            hit = left & places
            left = (left + hit | left - hit) & full
        return lb - np.bitwise_count(left)

    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        la, lb = (np.array([0 if t is None else len(t) for t in s], dtype=np.int64) for s in (a, b))
        short = known & (la <= _WORD_BITS) & (lb <= _WORD_BITS)
        found = np.zeros(len(a), dtype=np.int32)
        if short.any():
            found[short] = common_short(a[short], b[short], la[short], lb[short])
        long = known & ~short
        if long.any():
            found[long] = [common(x, y) for x, y in zip(a[long], b[long], strict=True)]
        return pd.Series(pd.arrays.IntegerArray(found, ~known))

    # a filter on the length is not moved below it then, where it would be counted a second time
    return F.pandas_udf(count, T.IntegerType()).asNondeterministic()


def similarity(a: Column, b: Column) -> Column:
    """1 - (insertions + deletions) / total length."""
    total = F.length(a) + F.length(b)
    score = (F.lit(1.0) - (total - 2 * common_subsequence_length(a, b)) / total) * 100.0 / 100.0
    return F.when(total == 0, F.lit(1.0)).otherwise(score)


def shared_needed(la: Column, lb: Column, threshold: float) -> Column:
    """Fewest common letters two texts of these lengths need to reach ``threshold``."""
    return F.ceil((la + lb) * (threshold / 2.0) - 1e-9).cast("int")


def can_reach(la: Column, lb: Column, threshold: float) -> Column:
    return F.least(la, lb) >= shared_needed(la, lb, threshold)


def listable(la: Column, drops: Column) -> Column:
    """Whether a text of this length has few enough subsequences with ``drops`` letters left out."""
    two, three = la * (la - 1) / 2, la * (la - 1) * (la - 2) / 6
    return (
        F.when(drops == 0, F.lit(True))
        .when(drops == 1, la <= MAX_SUBSEQUENCES)
        .when(drops == 2, two <= MAX_SUBSEQUENCES)
        .when(drops == 3, three <= MAX_SUBSEQUENCES)
        .otherwise(F.lit(False))
    )


def subsequences(text: Column, drops: Column) -> Column:
    """All texts left when exactly ``drops`` (0 to 3) letters are taken out of ``text``."""
    start = F.array(F.struct(text.alias("s"), F.lit(1).alias("p")))

    def take_one(options: Column) -> Column:
        def cuts(x: Column) -> Column:
            size = F.length(x["s"])
            spots = F.when(x["p"] <= size, F.sequence(x["p"], size)).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(
                spots,
                lambda i: F.struct(
                    F.concat(
                        F.substring(x["s"], F.lit(1), i - 1),
                        F.substring(x["s"], i + 1, size),
                    ).alias("s"),
                    i.alias("p"),
                ),
            )

        return F.flatten(F.transform(options, cuts))

    one = take_one(start)
    two = take_one(one)
    three = take_one(two)
    chosen = (
        F.when(drops == 0, start).when(drops == 1, one).when(drops == 2, two).otherwise(three)
    )
    return F.array_distinct(F.transform(chosen, lambda x: x["s"]))


def pieces(text: Column, count: Column) -> Column:
    """``text`` cut into ``count`` even pieces: structs of piece number and piece."""
    size = F.length(text)

    def cut(i: Column) -> Column:
        begin = F.floor(size * i / count).cast("int")
        end = F.floor(size * (i + 1) / count).cast("int")
        return F.struct(i.alias("i"), F.substring(text, begin + 1, end - begin).alias("t"))

    return F.transform(F.sequence(F.lit(0), count - 1), cut)


def shifted_pieces(text: Column, other: Column, count: Column, back: Column, ahead: Column) -> Column:
    """Where the pieces of a text of length ``other`` may lie in ``text`` when letters move."""

    def cut(i: Column) -> Column:
        begin = F.floor(other * i / count).cast("int")
        size = F.floor(other * (i + 1) / count).cast("int") - begin
        low = F.greatest(F.lit(0), begin - back)
        high = F.least(F.length(text) - size, begin + ahead)
        spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            spots, lambda s: F.struct(i.alias("i"), F.substring(text, s + 1, size).alias("t"))
        )

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), cut)))
