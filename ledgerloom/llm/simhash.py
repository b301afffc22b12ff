"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints that differ in at most `bits` bits agree in one of bits + 1 blocks of bits. For each
block there is a trie with that block on top, so every link is found below a node that both fingerprints share. The tries
are cut at these nodes and dealt to tasks. A node with more than NODE_LIMIT fingerprints is cut again
below: its children pairs whose prefixes differ in no more bits than allowed become the units of work, so
no task gets an unbounded node. In a task all node pairs are traversed together, level by level: each pair
carries its differing bits so far and is dropped when they exceed the budget; pairs of single
fingerprints are compared at once. A task hands on a spanning forest of the links it finds, which keeps
every connection and at most one link for each fingerprint.

Equal fingerprints are one node from the start, so exact copies never meet in pairs.

Defined results: null or empty text and text of blanks have fingerprint 0, which is linked like any other;
a null id is a document whose component is the smallest id that is not null there (null if there is none); repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import texts_of
from ledgerloom.plans.skew import lookup_join
from ledgerloom.plans.workspace import checkpointed, run_folder

WIDTH, BITS, SEED = 3, 2, 42
NODE_LIMIT = 50_000
MOST_PAIRS = 1 << 20
MOST_DEEPER = 16
MOST_SENT = 1_000_000  # keys that are broadcast, some 50 MB


def fingerprints_of(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A fingerprint for each text; its bit is 1 where over half of the shingle hashes, repeats included, have it."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            out[i] = digest(joined, SEED)
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begin = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, ends[width - 1:].tolist(), strict=True)], dtype=np.uint64)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(hashes[at:at + (1 << 16)].astype("<u8"))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _column_of(texts: pa.Array, width: int) -> pa.Array:
    parts = [fingerprints_of(texts_of(texts.slice(at, 256)), width) for at in range(0, len(texts), 256)]
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of each row."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _column_of(batch.column(1), width)], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {dict(docs.dtypes)[doc_id]}, fingerprint long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def traverse(values: np.ndarray, pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of values within the budget. `values` are sorted in each node; `pairs` has rows
    (depth, begin, end, begin, end, differing bits) of node pairs whose values agree above depth but for these bits.
    Large frontiers are worked off in parts, depth first, so memory stays bounded."""
    stack = [pairs]
    while stack:
        work = stack.pop()
        if len(work) > MOST_PAIRS:
            stack += [work[MOST_PAIRS:], work[:MOST_PAIRS]]
            continue
        single = (work[:, 2] - work[:, 1] == 1) & (work[:, 4] - work[:, 3] == 1)
        if single.any():
            a, b = work[single, 1], work[single, 3]
            near = (a != b) & (_popcount(values[a] ^ values[b]) <= budget)
            if near.any():
                yield a[near], b[near]
            work = work[~single]
        if not len(work):
            continue
        # Split both nodes at the bit that is as deep as the pair.
        bit = np.uint64(1) << (np.uint64(63) - work[:, 0].astype(np.uint64))
        middle = [_split(values, work[:, 1 + 2 * s], work[:, 2 + 2 * s], bit) for s in (0, 1)]
        same = (work[:, 1] == work[:, 3]) & (work[:, 2] == work[:, 4])
        children = []
        for left in (0, 1):
            for right in (0, 1):
                child = work.copy()
                child[:, 0] += 1
                child[:, 1 if left else 2] = middle[0]
                child[:, 3 if right else 4] = middle[1]
                child[:, 5] += left != right
                keep = (child[:, 1] < child[:, 2]) & (child[:, 3] < child[:, 4]) & (child[:, 5] <= budget)
                if (left, right) == (1, 0):
                    keep &= ~same  # the same two nodes as left and right
                if left == right:
                    keep &= ~(same & (child[:, 2] - child[:, 1] == 1))
                children.append(child[keep])
        work = np.concatenate(children)
        if len(work):
            stack.append(work)


def _split(values: np.ndarray, begin: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position in [begin, end) whose value has the bit, by a binary search over all ranges at once."""
    low, high = begin.copy(), end.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        has = np.zeros(len(low), dtype=bool)
        has[open_] = (values[middle[open_]] & bit[open_]) != 0
        high = np.where(open_ & has, middle, high)
        low = np.where(open_ & ~has, middle + 1, low)


class Forest:
    """Smallest position each position is connected with."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _blocks(budget: int) -> list[tuple[int, int]]:
    """Offset and size of the budget + 1 blocks of 64 bits."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _turned(value: np.ndarray, offset: int) -> np.ndarray:
    """The bits from `offset` on moved to the top."""
    if not offset:
        return value
    return (value << np.uint64(offset)) | (value >> np.uint64(64 - offset))


def near_links(prints: DataFrame, fingerprint: str = "fingerprint", budget: int = BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Pairs a, b of distinct fingerprints whose components are those of all pairs within `budget` bits. A pair may
    join two that are connected through others."""
    blocks = _blocks(budget)
    value = F.col("value")
    units = prints.select(F.col(fingerprint).alias("value")).select("value", F.explode(F.array(*[
        F.struct(F.lit(i).alias("trie"),
                 F.shiftrightunsigned(F.shiftleft(value, offset), 64 - size).alias("node")) for i, (offset, size) in enumerate(blocks)
    ])).alias("at")).select("value", "at.trie", "at.node")
    crowded = (units.groupBy("trie", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_limit)
               .select("trie", "node", F.least(F.lit(MOST_DEEPER), F.ceil(F.log2(F.col("n") / node_limit)) + 2).cast("int").alias("deeper")))
    units = units.join(crowded, ["trie", "node"], "left").withColumn("deeper", F.coalesce("deeper", F.lit(0)))
    # The bits below the node: a crowded node's children are paired within the budget.
    below = F.lit(None).cast("long")
    for i, (offset, size) in enumerate(blocks):
        at = (offset + size) % 64
        rotated = value if at == 0 else F.shiftleft(value, at).bitwiseOR(F.shiftrightunsigned(value, 64 - at))
        below = F.when(F.col("trie") == i, rotated).otherwise(below)
    units = units.withColumn("below", below)
    none = F.lit(0).cast("long")
    whole = units.where("deeper = 0").select("value", "trie", "node", "deeper", none.alias("low"), none.alias("high"))
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << MOST_DEEPER) if m.bit_count() <= budget])
    split = (units.where("deeper > 0").withColumn("child", F.expr("shiftrightunsigned(below, 64 - deeper)"))
             .withColumn("mask", F.explode(masks)).where("mask < shiftleft(1L, deeper)")
             .withColumn("other", F.col("child").bitwiseXOR(F.col("mask")))
             .select("value", "trie", "node", "deeper", F.least("child", "other").alias("low"), F.greatest("child", "other").alias("high")))
    dealt = whole.unionByName(split).repartition("trie", "node", "low", "high")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[] for _ in range(6)]
        for batch in batches:
            for held, column in zip(columns, batch.columns, strict=True):
                held.append(column.to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        value, trie, node, deeper, low, high = (np.concatenate(c) for c in columns)
        value = value.view(np.uint64)
        turned = np.zeros_like(value)
        for i, (offset, _) in enumerate(blocks):
            turned[trie == i] = _turned(value[trie == i], offset)
        order = np.lexsort([turned, high, low, node, trie])
        value, trie, node, deeper, low, high, turned = (x[order] for x in (value, trie, node, deeper, low, high, turned))
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (trie[1:] != trie[:-1]) | (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(value))
        size = np.array([s for _, s in blocks])[trie[begin]]
        depth = size + deeper[begin]
        # The first value of the higher child, where two children meet.
        two = low[begin] != high[begin]
        shift = (64 - depth).astype(np.uint64)
        middle = begin.copy()
        for g in np.flatnonzero(two):
            prefix = (turned[begin[g]:end[g]] >> shift[g]) & np.uint64((1 << int(deeper[begin[g]])) - 1)
            middle[g] += np.count_nonzero(prefix == np.uint64(low[begin[g]]))
        pairs = np.stack([depth, begin, np.where(two, middle, end), np.where(two, middle, begin), end,
                          np.where(two, _popcount(low[begin] ^ high[begin]), 0)], axis=1).astype(np.int64)
        pairs = pairs[(pairs[:, 1] < pairs[:, 2]) & (pairs[:, 3] < pairs[:, 4]) & (end - begin > 1)]
        forest = Forest(len(value))
        for a, b in traverse(turned, pairs, budget):
            forest.unite(a, b)
        linked = np.flatnonzero(forest.root != np.arange(len(value)))
        signed = value.view(np.int64)
        yield pa.RecordBatch.from_pydict({"a": signed[linked], "b": signed[forest.root[linked]]})

    return dealt.mapInArrow(join, "a long, b long")


def _rooted(prints: DataFrame, budget: int) -> DataFrame:
    """doc_id, fingerprint, root (the smallest fingerprint of the class), component_id; `prints` is read several times."""
    nodes = checkpointed(prints.groupBy("fingerprint").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_rows")))
    roots = components(near_links(nodes, "fingerprint", budget), "a", "b")
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fingerprint"))
    leaders = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(leaders, "root").select("fingerprint", "root", "component_id")
    # A fingerprint that very many documents have is dealt to pieces.
    return lookup_join(prints, named, ["fingerprint"], ["doc_id"], "inner", counts=nodes).select(
        "doc_id", "fingerprint", "root", "component_id")


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, budget: int = BITS,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id."""
    return _rooted(checkpointed(fingerprints(docs, doc_id, text, width)), budget).drop("root")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, budget: int = BITS,
) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id, of several
    texts with that id the one with the smallest fingerprint, of several rows with both any one.

    Each text is fingerprinted once and written with its fingerprint below the shared folder. Rows that stay are not shuffled as long as
    the keys of those that leave, or are there twice, are at most MOST_SENT; more of them meet the rows in a join.
    """
    spark, folder, at = docs.sparkSession, run_folder(docs.sparkSession, "prints"), docs.columns.index(text)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("__print", _column_of(batch.column(at), width))

    schema = T.StructType([*docs.schema.fields, T.StructField("__print", T.LongType())])
    docs.mapInArrow(marked, schema).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    found = _rooted(rows.select(F.col(doc_id).alias("doc_id"), F.col("__print").alias("fingerprint")), budget)
    own = (found.groupBy("root", "component_id", "doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n_rows")))
    first = (own.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
             .agg(F.min("fingerprint").alias("stays")))
    # One row per key that does not simply stay: it leaves, or is there more than once.
    keys = own.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fingerprint") == F.col("stays")))
    keys.where(~F.col("stays") | (F.col("n_rows") > 1)).select(_key("doc_id", "fingerprint").alias("__key"), "stays").write.parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys")
    keys = F.broadcast(keys) if keys.count() <= MOST_SENT else keys
    told = rows.withColumn("__key", _key(doc_id, "__print")).join(keys, "__key", "left")
    single = told.where(F.col("stays").isNull()).select(*docs.columns)
    return single.unionByName(told.where("stays").dropDuplicates(["__key"]).select(*docs.columns))


def _key(doc_id: str, fingerprint: str) -> Column:
    return F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), fingerprint)
