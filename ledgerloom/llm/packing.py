"""Packing of tokenised documents into sequences, balanced by the cost of attention.

A piece of n tokens costs n + n^2 / (8 x length): a linear part and the attention inside the piece. Runs of
`length` tokens of a document fill sequences of their own. What is left of each document is packed
in groups of GROUP documents, longest first: each goes to the sequence of lowest cost that has room for it, and is cut only
when no sequence has room for the whole. The sequences of a group have exactly as much room as it has tokens: full ones, and
for the rest sequences whose sizes are powers of two, which need no padding.

Every task packs what it reads: nothing is shuffled, and a group's tokens are all that is held in memory.
Sequence ids hold the task's number in their upper bits.

Token ids are those that tokenizers gives with the vocabulary file, without special tokens added. The file's vocabulary is
encoded by tiktoken, which is several times as fast; texts with a run of blanks that tiktoken's stack can't hold are encoded by
tokenizers. A test compares both.

Defined results: null text is empty text; an empty text has only the closing id; the name of a special token in
a text is that token, as tokenizers has it; repeated rows are packed again; a null id stays null.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GROUP, END = 1024, 2048, 0
# Fixed value: how the vocabulary's tokenizer cuts a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# tiktoken keeps a state for each blank of a run and gives up at a million.
MOST_BLANKS = 100_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids with the vocabulary file, loaded once in each Python worker."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special, letters = {t["content"]: t["id"] for t in content["added_tokens"]}, byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plain, blanks = Tokenizer.from_file(path), re.compile(rf"\s{{{MOST_BLANKS}}}")

    def encode(text: str) -> list[int]:
        if len(text) >= MOST_BLANKS and blanks.search(text):
            return plain.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cost(tokens: int, length: int = LENGTH) -> float:
    return tokens + tokens * tokens / (8 * length)


def capacities(tokens: int, length: int) -> list[int]:
    """Sizes of sequences that hold exactly so many tokens: full ones, then powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of each piece of documents shorter than `length`."""
    room = capacities(sum(sizes), length)
    filled, spent = [0] * len(room), [0.0] * len(room)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
    cheapest = np.full(length + 1, np.inf)

    def put(s: int) -> None:
        left = room[s] - filled[s]
        if left:
            heapq.heappush(heaps[left], (spent[s], s))
            cheapest[left] = heaps[left][0][0]

    for s in range(len(room)):
        put(s)
    out = []
    for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):
        start, todo = 0, sizes[d]
        while todo:
            left = todo + int(np.argmin(cheapest[todo:]))
            if cheapest[left] == np.inf:  # no sequence has room for all of it
                left = int(np.argmin(cheapest))
            _, s = heapq.heappop(heaps[left])
            cheapest[left] = heaps[left][0][0] if heaps[left] else np.inf
            n = min(todo, left)
            out.append((d, start, n, s, filled[s]))
            filled[s] += n
            spent[s] += cost(n, length)
            put(s)
            start, todo = start + n, todo - n
    return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    group: int = GROUP, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with
    `with_ids` also its ids. `vocabulary` is the path of the vocabulary file on every machine."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(vocabulary), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tokens_of: list[np.ndarray] = []
        rest: list[tuple] = []

        def piece(doc, start: int, ids: np.ndarray, tokens: int, sequence_id: int, offset: int) -> None:
            own = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence_id, offset)
            rows.append(own)
            if with_ids:
                tokens_of.append(ids)

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            names = ["doc_id", *(f.split()[0] for f in PIECE.split(", "))]
            kinds = [kind] + [pa.int64()] * 6
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *map(len, tokens_of)], dtype=np.int32)
                values = np.concatenate([np.zeros(0, np.uint32), *tokens_of]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                names.append("ids")
            rows.clear()
            tokens_of.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def pack_rest() -> int:
            placed = assign([len(ids) for _, _, ids, _ in rest], length)
            for d, start, n, s, offset in placed:
                doc, before, ids, tokens = rest[d]
                piece(doc, before + start, ids[start:start + n], tokens, sequence + s, offset)
            rest.clear()
            return 1 + max((p[3] for p in placed), default=-1)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(content.as_py() or "")
                ids.append(END)
                ids, tokens, doc = np.array(ids, dtype=np.uint32), len(ids), doc.as_py()
                whole = tokens - tokens % length
                for at in range(0, whole, length):
                    piece(doc, at, ids[at:at + length], tokens, sequence, 0)
                    sequence += 1
                if whole < tokens:
                    rest.append((doc, whole, ids[whole:].copy(), tokens))
                if len(rest) >= group:
                    sequence += pack_rest()
                if len(rows) >= 8192:
                    yield flush(kind)
            yield flush(kind)
        if rest:
            pack_rest()
            yield flush(kind)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, {PIECE}" + ", ids array<int>" * with_ids)
