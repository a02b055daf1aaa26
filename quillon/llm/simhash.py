"""SimHash fingerprints, linked within a Hamming radius by forests of BK-trees.

Fingerprints within r bits agree wholly on one of any r + 1 blocks of bits, so
each distinct fingerprint goes to one shard for each block, keyed by the first
bits of it: as few of them as leave about `tree_nodes` fingerprints to a shard, however
many there are in all. A shard's BK-tree has children keyed by their
distance to the parent; a search follows only edges within the radius of the
query's own distance. Each task holds the trees of its shards, so nothing that
grows with the corpus is broadcast, and a shard with more than `tree_limit`
fingerprints is split again by blocks of the bits that its key leaves open.
Without `tree_nodes` shards are keyed by whole pairs of r + 2 blocks, two of
which must agree: small trees, for callers that have other candidates as well.

A shard yields, for each of its linked fingerprints, one edge to the smallest
document of its linked group there: never all pairs. A distributed search for
connected components joins these edges.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, and one with fewer words than a shingle has its whole
sequence as the only shingle; a component is named by its smallest id, null only
if all of its ids are null; equal rows are listed each; an empty table gives an
empty result. `simhash_dedup` keeps one row of each component: the one with the
smallest id, nulls last, and of rows with that id one by a hash of the row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import materialize, maybe_broadcast, row_hash, text_or_empty

#: Queries that search a forest together, and open pairs of query and node that they may have.
SEARCH_ROWS, SEARCH_PAIRS = 50_000, 1_000_000
#: Nodes, one for each shard that it goes to, of a task on average.
TASK_NODES = 20_000
#: Fingerprints of a shard on average, at most.
TREE_NODES = 8000


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of width words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def bits_of(hashes: list[int] | np.ndarray) -> int:
    """64 bits; a bit is set if over half of the hashes set it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], np.uint64).astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return bits_of(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int, seed: int, text_col: str) -> DataFrame:
    """docs (its other columns must be longs) with fp (64 bits as a long) in place of the text."""
    names = [c for c in docs.columns if c != text_col]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width, seed) for t in batch[text_col]], np.uint64).view(np.int64)
            yield pa.record_batch([*[batch[c] for c in names], pa.array(fp)], [*names, "fp"])

    return docs.mapInArrow(of, ", ".join(f"{c} long" for c in [*names, "fp"]))


# A forest of BK-trees as arrays -------------------------------------------


class Forest:
    """BK-trees of the values in each group; values are distinct within a group.

    Levels are built for all trees at once: every value that is not yet placed
    stands at a node; of those with the same node and distance to it the first
    becomes that node's child at this distance, and the others move there.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray) -> None:
        self.value = value
        _, first, own = np.unique(group, return_index=True, return_inverse=True)
        at = first[own]
        self.root_of = at.copy()
        rest = np.setdiff1d(np.arange(len(value)), first, assume_unique=True)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rest):
            node = at[rest]
            code = node * 65 + np.bitwise_count(value[node] ^ value[rest]).astype(np.int64)
            keys, first, back = np.unique(code, return_index=True, return_inverse=True)
            child = rest[first]
            edges.append((keys, child))
            at[rest] = child[back]
            rest = np.delete(rest, first)
        keys = np.concatenate([e[0] for e in edges]) if edges else np.empty(0, np.int64)
        child = np.concatenate([e[1] for e in edges]) if edges else np.empty(0, np.int64)
        order = np.argsort(keys)
        #: Sorted node * 65 + distance, and the child there.
        self.keys, self.child = keys[order], child[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, value) of places, within radius; each query searches its own group's tree."""
        stack = [(queries, self.root_of[queries])]
        while stack:
            q, node = stack.pop()
            if len(q) > SEARCH_PAIRS:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (node != q)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            if total := int(n.sum()):
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.child[np.repeat(low, n) + step]))


def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b; a set is named by its smallest member."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        x, y = parent[a], parent[b]
        if np.array_equal(x, y):
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def linked_groups(group: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """For each value the place of the first value that it is linked to within its group. Sorted by group."""
    forest, parent = Forest(group, value), np.arange(len(value))
    for at in range(0, len(value), SEARCH_ROWS):
        for a, b in forest.near(np.arange(at, min(at + SEARCH_ROWS, len(value))), radius):
            link(parent, a, b)
    return parent


# Shards -------------------------------------------------------------------


def _block_masks(bits: list[int], radius: int) -> list[int]:
    """Masks of all pairs of radius + 2 blocks of the given bits: two values within radius agree on one of them."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), radius + 2)]
    return [sum(c) for c in combinations(blocks, 2)]


def _prefix_masks(n: int, radius: int, tree_nodes: int) -> list[int]:
    """Masks of the first bits of radius + 1 blocks, so many that n values leave at most about tree_nodes to a key."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / tree_nodes)))
    blocks = [part.tolist()[:bits] for part in np.array_split(np.arange(64), radius + 1)]
    return sorted({sum(1 << b for b in block) for block in blocks})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """nodes once for each mask, with _mask (its number) and _key (their bits there)."""
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    return nodes.withColumn("_s", F.explode(keys)).select("*", F.col("_s.m").alias("_mask"), F.col("_s.k").alias("_key")).drop("_s")


def _edges_of_shards(shards: DataFrame, by: list[str], radius: int, parts: int) -> DataFrame:
    """(a, b): of each linked node the smallest node of its linked group in the shard; shards are dealt to so many tasks."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"fp": [], "node": [], "_g": []}, dtype=np.int64), *frames])
        rows = rows.sort_values(["_g", "node"], ignore_index=True)
        if len(rows):
            to = linked_groups(rows["_g"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), radius)
            node = rows["node"].to_numpy()
            own = to != np.arange(len(to))
            yield pd.DataFrame({"a": node[own], "b": node[to[own]]})

    return shards.select("fp", "node", F.xxhash64(*by).alias("_g")).repartition(parts, "_g").mapInPandas(of, "a long, b long")


def near_edges(nodes: DataFrame, radius: int = 2, tree_limit: int = 200_000, tree_nodes: int | None = None) -> DataFrame:
    """Edges that connect all nodes (columns node, fp; distinct fp; a table that is cheap to count) within radius bits."""
    n = nodes.count()
    masks = _prefix_masks(n, radius, tree_nodes) if tree_nodes else _block_masks(list(range(64)), radius)
    parts = 1 + n * len(masks) // TASK_NODES
    shards = shard_keys(nodes, masks)
    large = materialize(shards.groupBy("_mask", "_key").count().filter(F.col("count") > tree_limit).select("_mask", "_key"), "simhash-large")
    if large.isEmpty():
        return _edges_of_shards(shards, ["_mask", "_key"], radius, parts)
    large = maybe_broadcast(large, 32)
    out = _edges_of_shards(shards.join(large, ["_mask", "_key"], "left_anti"), ["_mask", "_key"], radius, parts)
    hot = shards.join(large, ["_mask", "_key"], "left_semi").withColumnsRenamed({"_mask": "_m0", "_key": "_k0"})
    for i, mask in enumerate(masks):
        inner = _block_masks([b for b in range(64) if not mask >> b & 1], radius)
        again = shard_keys(hot.filter(F.col("_m0") == i), inner)
        out = out.unionByName(_edges_of_shards(again, ["_m0", "_k0", "_mask", "_key"], radius, parts))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (a, b).

    Alternates between linking each node's neighbours to its smallest neighbour
    on the larger side and on the smaller side, until nothing changes; each
    round is one pass over the edges and is written to the shared folder.
    """
    one = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(small.filter("a <> b").distinct(), "cc-small")
        count = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count(new) == count(one):
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        one = new


def _roots(nodes: DataFrame, radius: int, tree_limit: int) -> DataFrame:
    """fp and root (the smallest fingerprint that it is linked to) of all fingerprints (column fp, distinct) that are linked to others."""
    edges = near_edges(nodes.select(F.col("fp").alias("node"), "fp"), radius, tree_limit, TREE_NODES)
    found = materialize(connected_components(edges), "simhash-members")
    return found.select(F.col("node").alias("fp"), F.col("component").alias("root")).unionByName(found.select(F.col("component").alias("fp"), F.col("component").alias("root")).distinct())


def simhash_components(
    docs: DataFrame, *, width: int = 3, radius: int = 2, seed: int = 42, tree_limit: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    prints = materialize(fingerprints(own, width, seed, "_text"), "simhash-prints")
    # A node is a distinct fingerprint; ids are attached to linked ones afterwards, so any id may occur.
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-nodes")
    roots = materialize(_roots(nodes, radius, tree_limit), "simhash-roots")
    rooted = nodes.join(maybe_broadcast(roots, 16), "fp", "left")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("_least").alias("_name"))
    least = materialize(least, "simhash-least")
    named = rooted.join(maybe_broadcast(least, 24), "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("_name")).alias("component_id"))
    named = materialize(named, "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(
    docs: DataFrame, *, width: int = 3, radius: int = 2, seed: int = 42, tree_limit: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, all columns, with one row left of each component."""
    # A row is named by 128 bits of a hash of all of its columns.
    key = [row_hash(docs, seed) for seed in (1, 2)]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"), key[0].alias("h1"), key[1].alias("h2"))
    prints = materialize(fingerprints(own, width, seed, "_text"), "simhash-prints")
    roots = materialize(_roots(materialize(prints.select("fp").distinct(), "simhash-distinct"), radius, tree_limit), "simhash-roots")
    rooted = prints.join(maybe_broadcast(roots, 16), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    groups = rooted.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups.select("root", "best.h1", "best.h2"), "simhash-groups").withColumnsRenamed({"h1": "b1", "h2": "b2"})
    marked = rooted.join(maybe_broadcast(groups, 24), "root").groupBy("h1", "h2").agg(F.min((F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = materialize(marked.filter("n > 1 or not stays").select("h1", "h2", "stays"), "simhash-marked")
    keyed = docs.select(F.struct("*").alias("row"), key[0].alias("h1"), key[1].alias("h2"))
    left = keyed.join(maybe_broadcast(marked, 24), ["h1", "h2"], "left_anti").select("row.*")
    # Of rows that are equal in all columns one stays.
    equal = keyed.join(maybe_broadcast(marked.filter("stays"), 24), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return left.unionByName(equal.select("row.*"))
