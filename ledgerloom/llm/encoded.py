"""Words of many texts as numbers: equal numbers are equal words, without hashing that could err.

The bytes of all words are laid side by side and dictionary-encoded in Arrow, so the numbers of one run of texts are exact.
Runs of words are numbered from the numbers of their first words and of their last word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Encoded:
    ids: np.ndarray  # of each word, in order
    text_of: np.ndarray  # the text each word lies in
    piece_of: np.ndarray  # the piece each word lies in; pieces of different texts differ
    vocabulary: pa.LargeBinaryArray  # the words by number

    def runs(self, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to `longest` words: the first word's place and the number of each run inside a piece, and how many
        distinct numbers there are below. Numbers are dense."""
        size = max(1, len(self.vocabulary))
        at, number = np.arange(len(self.ids)), self.ids
        out = [(at, number, len(self.vocabulary))]
        for width in range(2, longest + 1):
            last = at + width - 1
            fits = last < len(self.ids)
            at, number, last = at[fits], number[fits], last[fits]
            fits = self.piece_of[at] == self.piece_of[last]
            at, number, last = at[fits], number[fits], last[fits]
            distinct, number = np.unique(number * size + self.ids[last], return_inverse=True)
            out.append((at, number, len(distinct)))
        return out


def places_of(data: np.ndarray, breaks: bytes) -> np.ndarray:
    """True at the bytes of words: all but the given ones."""
    inside = np.ones(256, dtype=bool)
    inside[list(breaks)] = False
    return inside[data]


def encode_lines(texts: list[bytes]) -> Encoded:
    """The lines of each text, split at line feeds, as its words; empty lines too."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    encoded = pa.array([y for x in lines for y in x], type=pa.large_binary()).dictionary_encode()
    text_of = np.repeat(np.arange(len(texts)), counts)
    return Encoded(encoded.indices.to_numpy().astype(np.int64), text_of, text_of, encoded.dictionary)


def encode(texts: list[bytes], blanks: bytes = BLANKS, breaks: bytes = b"", lower: bool = False) -> Encoded:
    """Words are runs of bytes outside `blanks` and `breaks`; a byte of `breaks`, or the text's end, ends a piece.
    Both hold ASCII bytes, so characters beyond ASCII stay whole. `lower` turns A-Z into a-z."""
    between = (blanks or breaks)[:1]
    data = np.frombuffer(between.join(texts) + between, dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    word = np.zeros(len(data) + 1, dtype=np.int8)
    word[:-1] = places_of(data, blanks + breaks)
    edges = np.flatnonzero(np.diff(word, prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    flat = data[word[:-1].view(bool)]
    if lower:
        flat = _LOWER[flat]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    encoded = words.dictionary_encode()
    text_of = np.searchsorted(ends_of, starts, side="right")
    piece_of = text_of
    if breaks:
        piece_of = np.cumsum(~places_of(data, breaks), dtype=np.int64)[starts] + text_of
    return Encoded(encoded.indices.to_numpy().astype(np.int64), text_of, piece_of, encoded.dictionary)
