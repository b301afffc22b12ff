"""Words of whole texts as 64-bit hashes, computed for many texts at once.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and all characters
beyond ASCII, which in UTF-8 is a rule on bytes. Equal words have equal hashes;
whoever needs certainty compares the words of the few places that hash alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

WINDOW = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


@dataclass
class Words:
    """Words of a run of texts in order: hash, first byte and end in the joined
    bytes, and the text each lies in."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray
    offsets: np.ndarray  # where each text begins in data; one more at the end

    def counts(self) -> np.ndarray:
        return np.bincount(self.text_of, minlength=len(self.offsets) - 1)



def plain_words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes, spread evenly over 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def find_words(texts: list[bytes]) -> Words:
    """Words of all texts. Memory beside the result is bounded by WINDOW and the longest word."""
    data = b"\n".join(texts) + b"\n"
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    whole = np.frombuffer(data, dtype=np.uint8)
    found, begin = [], 0
    while begin < len(whole):
        end = min(begin + WINDOW, len(whole))
        while end < len(whole) and _IS_WORD[whole[end - 1]]:
            end += 1
        part = whole[begin:end]
        inside = np.zeros(len(part) + 1, dtype=np.int8)
        inside[:-1] = _IS_WORD[part]
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = _power_tables(max(WINDOW, len(part)) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[part] * up[:len(part)], out=total[1:])
            hashes = (total[ends] - total[starts]) * down[starts]
            found.append((mixed(hashes), starts + begin, ends + begin))
        begin = end
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none.astype(np.uint64), none, none, none, offsets)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(data, hashes, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, offsets)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of `width` words, repeats included; a text with
    fewer words has its whole sequence as its only one."""
    h, text = words.hashes, words.text_of
    if not len(h):
        return h, text
    n = len(h) - width + 1
    rolled, kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        rolled = h[:n].copy()
        for j in range(1, width):
            rolled = rolled * _STEP + h[j:j + n]
        same = text[:n] == text[width - 1:]
        rolled, kept = rolled[same], text[:n][same]
    counts = words.counts()
    first = np.concatenate([[0], np.cumsum(counts)])
    short, owners = [], []
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        value = 0
        for x in h[first[t]:first[t + 1]]:
            value = (value * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF
        short.append((value * 0x2545F4914F6CDD1D + int(counts[t])) & 0xFFFFFFFFFFFFFFFF)
        owners.append(t)
    if owners:
        rolled = np.concatenate([rolled, np.array(short, dtype=np.uint64)])
        kept = np.concatenate([kept, np.array(owners, dtype=np.int64)])
        order = np.argsort(kept, kind="stable")
        rolled, kept = rolled[order], kept[order]
    return mixed(rolled), kept


def plain_shingles(text: bytes, width: int) -> set[bytes]:
    """The distinct shingles themselves, space-joined."""
    found = plain_words(text)
    if len(found) < width:
        return {b" ".join(found)} if found else set()
    return {b" ".join(found[i:i + width]) for i in range(len(found) - width + 1)}
