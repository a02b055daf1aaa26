"""Sharding by minimax contiguous partition of ordered atomic groups.

An atom is the set of documents with equal texts (by a hash of the text), in
order of the hash, and the capacity found is the smallest feasible one for these
groups. The driver never sees all of them: it holds the sizes of at most some
hundred thousand ranges of hashes. A range may hold many groups, so a search on
ranges gives a bound from below, as if ranges could be cut anywhere, and one from
above, as if they could not. Ranges in which a shard may end between the bounds
are split, all in one job, until the bounds meet; that takes a few rounds.

Defined results: a null text counts as empty, so its size is the overhead; null
ids sort first; repeated rows are placed each on its own; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

import numpy as np

from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.common import materialize, row_position, text_or_empty


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Shards that a greedy pass opens if none may exceed capacity, which no single size does."""
    shards, room = 0, -1
    for s in sizes:
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def minimax_cuts(sizes: list[int], n_shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which the ordered sizes fit n_shards contiguous shards, and where each shard begins."""
    ends = list(accumulate(sizes))
    total = ends[-1] if ends else 0

    def cuts(capacity: int) -> list[int]:
        begins, at, before = [], 0, 0
        while at < len(sizes):
            begins.append(at)
            at = bisect_right(ends, before + capacity)
            before = ends[at - 1]
        return begins

    low, high = max([0, *sizes, -(-total // n_shards)]), max(total, 0)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(cuts(mid)) <= n_shards else (mid + 1, high)
    return low, cuts(low)


class Piece(NamedTuple):
    """Groups whose hashes, signed, agree in their first `depth` bits: these bits, the groups' size, whether there is one group only."""

    depth: int
    bits: int
    size: int
    single: bool

    @property
    def start(self) -> int:
        """The least hash that belongs here."""
        return self.bits << (64 - self.depth)


#: Bits of hashes by which ranges are told apart at first, and ranges that a round asks for at most.
FIRST_BITS, ROUND_PIECES = 16, 1 << 18


def _ends(ends: np.ndarray, single: np.ndarray, capacity: int, n_shards: int, cut: bool) -> tuple[list[int], bool]:
    """Where shards end, as sums of sizes, and whether n_shards hold all. cut: ranges of many groups may be cut anywhere."""
    at, out, total = 0, [], int(ends[-1])
    for _ in range(n_shards):
        if at + capacity >= total:
            return [*out, total], True
        i = int(np.searchsorted(ends, at + capacity, "right"))
        to = at + capacity if cut and not single[i] else int(ends[i - 1]) if i else 0
        if to <= at:
            break
        at = to
        out.append(at)
    return out, False


def _least(low: int, high: int, fits: Callable[[int], bool]) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def refined_cuts(pieces: list[Piece], n_shards: int, split: Callable[[list[Piece], int], list[Piece]]) -> tuple[int, list[int]]:
    """The smallest capacity over all groups, and the least hash of each shard but the first.

    split: gives the parts of pieces, told apart by so many more bits, in order.
    """
    while pieces:
        sizes = np.array([p.size for p in pieces], np.int64)
        ends, single = np.cumsum(sizes), np.array([p.single for p in pieces])
        total = int(ends[-1])
        low = _least(-(-total // n_shards), total, lambda c: _ends(ends, single, c, n_shards, True)[1])
        high = _least(low, total, lambda c: _ends(ends, single, c, n_shards, False)[1])
        # A shard ends between where it does at the lower bound at least and at the upper one at most.
        first, last = _ends(ends, single, low, n_shards, False)[0], _ends(ends, single, high, n_shards, True)[0]
        first += [first[-1] if first else 0] * (len(last) - len(first))
        asked = np.zeros(len(pieces) + 1, np.int64)
        for a, b in zip(first, last, strict=False):
            asked[np.searchsorted(ends, min(a, b), "right").clip(max=len(pieces) - 1)] += 1
            asked[int(np.searchsorted(ends, max(a, b), "left").clip(max=len(pieces) - 1)) + 1] -= 1
        open_ = (np.cumsum(asked)[:-1] > 0) & ~single
        if low == high or not open_.any():
            begins = [i for i in np.searchsorted(ends, _ends(ends, single, high, n_shards, False)[0], "right").tolist() if i < len(pieces)]
            return high, [pieces[i].start for i in begins]
        more = max(1, int(np.log2(ROUND_PIECES / open_.sum())))
        parts = split([p for p, o in zip(pieces, open_, strict=True) if o], more)
        pieces = sorted([*[p for p, o in zip(pieces, open_, strict=True) if not o], *parts], key=lambda p: p.start)
    return 0, []


def _parts(meta: DataFrame, pieces: list[Piece] | None, bits: int) -> list[Piece]:
    """Sizes of all ranges of so many bits, or of the parts of pieces with so many bits more."""

    def grouped(rows: DataFrame, depth: int) -> list[Piece]:
        found = rows.groupBy(F.shiftright("_hash", 64 - depth).alias("b")).agg(F.sum("size").alias("s"), (F.min("_hash") == F.max("_hash")).alias("one"))
        return [Piece(depth, r["b"], r["s"], r["one"]) for r in found.collect()]  # ROUND_PIECES rows or so at most

    if pieces is None:
        return sorted(grouped(meta, bits), key=lambda p: p.start)
    out = []
    for depth in sorted({p.depth for p in pieces}):
        own = meta.sparkSession.createDataFrame([(p.bits,) for p in pieces if p.depth == depth], "_bits long")
        rows = meta.withColumn("_bits", F.shiftright("_hash", 64 - depth)).join(F.broadcast(own), "_bits", "left_semi")  # as many rows as there are pieces
        out += grouped(rows, min(64, depth + bits))
    return out


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    overhead: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every document."""
    text = text_or_empty(text_col)
    meta = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_hash"),
        ),
        "shard-meta",
    )
    _, begins = refined_cuts(_parts(meta, None, FIRST_BITS), n_shards, lambda pieces, more: _parts(meta, pieces, more))
    shard = F.lit(0)
    for least in begins:
        shard = shard + (F.col("_hash") >= least).cast("int")
    placed = materialize(
        meta.withColumn("shard", shard.cast("int"))
        .repartitionByRange("shard", "_hash", "doc_id", "text_crc32")
        .sortWithinPartitions("shard", "_hash", "doc_id")
        .select("doc_id", "size", "text_crc32", "shard", *row_position()),
        "shard-placed",
    )
    # One row for each partition and shard that meet: partitions + shards at most.
    runs = placed.groupBy("_part", "shard").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    runs = runs.select("_part", "shard", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(runs), ["_part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_pos") + F.col("_shift")).alias("slot")
    )
