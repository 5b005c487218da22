"""Token ids by the ``tokenizers`` library, each distinct word of a batch encoded once.

Both public vocabularies split texts at white space before they merge, so a text's ids are those of
its space-led units in order. Texts with rarer white space are encoded whole. Units already met stay
in a bounded memory of the worker.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import spaced_units, text_bytes

# fixed values: white space other than \x20 and \x09-\x0D, as RE2 writes it
RARE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_PLAIN_BYTES = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")
_PLAIN_WORDS = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_SIMPLE = re.compile(rb" ?[!-&(-~]+")  # printable, without the apostrophe of contractions
_OPEN: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, remembered: int = 400_000) -> "Encoder":
    """This worker's encoder of a vocabulary file."""
    if (path, remembered) not in _OPEN:
        _OPEN[path, remembered] = Encoder(path, remembered)
    return _OPEN[path, remembered]


class Encoder:
    def __init__(self, path: str, remembered: int):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.drops_space = self.whole.normalizer is not None
        self.pieces = _PLAIN_WORDS if self.drops_space else _PLAIN_BYTES
        self.remembered, self.new, self.old = remembered, {}, {}

    def _unit(self, unit: bytes) -> bytes:
        """The ids of one unit as 32-bit integers."""
        if _SIMPLE.fullmatch(unit):
            text = unit.decode()
            text = text.lower() if self.drops_space else text
            pieces = self.pieces.findall(text)
            if pieces != [text] or text.encode() != unit:  # its pieces may be known as units of their own
                return b"".join(self._known(p.encode()) for p in pieces)
            ids = [t.id for t in self.whole.model.tokenize(text.replace(" ", "Ġ"))]
        else:
            ids = self.whole.encode(unit.decode(errors="replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _known(self, unit: bytes) -> bytes:
        found = self.new.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is None:
                found = self._unit(unit)
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[unit] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offset of each text's ids."""
        texts = texts.cast(pa.large_string())
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(texts, RARE_SPACE), False))
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        units, at = spaced_units(*text_bytes(plain))
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.drops_space:
            distinct = [u.strip(b" \t\n\r\x0b\x0c") for u in distinct]
        met = self.new.get
        ids = [met(u) or self._known(u) for u in distinct]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        codes = np.asarray(coded.indices)
        counts = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        begin = (np.cumsum(lengths) - lengths)[codes] - ends[:-1]
        out = flat[np.repeat(begin, counts) + np.arange(ends[-1])]
        offsets = ends[at]
        if odd.any():
            parts, sizes = [], []
            for i, whole in enumerate(odd):
                own = out[offsets[i] : offsets[i + 1]]
                if whole:
                    own = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
                parts.append(own)
                sizes.append(len(own))
            out, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return out, offsets


def ended(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to the ids of each text."""
    return np.insert(ids, offsets[1:], end).astype("<u4"), offsets + np.arange(len(offsets))
