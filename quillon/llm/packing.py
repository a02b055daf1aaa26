"""Packing documents into windows of fixed length by best-fit decreasing.

A document of more ids than a window is first cut into full windows and a rest.
The rests, longest first, go each to the open window with the least room that
still fits it; a segment tree over the remaining capacities finds that window
in log2(window) steps. Only lengths and checksums are shuffled, in groups of
about GROUP_PIECES pieces, each packed in one task; what a group wastes is a
window or so of the thousands that it fills. Groups come from a hash of the
piece and the counted number of pieces, so the sequences don't depend on how
rows are partitioned; pieces that repeat wholly are numbered and spread.

Defined results: a null text has the end id alone; equal rows are packed each;
an empty table gives an empty result; extra columns are ignored; an id that is
null stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import bounded_batches, give_back, materialize, text_or_empty
from quillon.llm.tokens import CACHE_PIECES, SLICE_BYTES, encoder, with_end

#: Pieces of a group on average.
GROUP_PIECES = 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


class RoomTree:
    """A segment tree over remaining capacities 0..size that counts the open windows at each."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the tightest window with room for need; its room and number."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:  # right children have nothing larger beside them
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room, up = at - self.leaves, at
        while up:
            self.count[up] -= 1
            up >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, which must come longest first and be at most window."""
    tree, out, opened = RoomTree(window), [], 0
    for n in lengths:
        if found := tree.take(n):
            room, at = found
        else:
            room, at, opened = window, opened, opened + 1
        out.append((at, window - room))
        if room > n:
            tree.add(room - n, at)
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] = (CACHE_PIECES, SLICE_BYTES)) -> DataFrame:
    """Pieces of every document: full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, *sizes)
        for batch in batches:
            rows = []
            for place, ids in enumerate(with_end(enc, batch["_text"], end_id)):
                for start in range(0, len(ids), window):
                    part = ids[start : start + window].astype("<u4")
                    rows.append((place, start, len(part), zlib.crc32(part), len(ids)))
            place, *columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch([batch["doc_id"].take(pa.array(place)), *map(pa.array, columns)], [c.split()[0] for c in PIECE.split(", ")])
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text")).mapInArrow(cut, PIECE)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_pieces: int = CACHE_PIECES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; cache_pieces and slice_bytes weigh a task's memory against its time."""

    bounded_batches(docs.sparkSession)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        at = np.array(best_fit_decreasing(rows["length"].to_pylist(), window), np.int64).reshape(-1, 2)
        # Windows of a group are numbered within the group's own range.
        rows = rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(at[:, 0] + (key[0].as_py() << 40)))
        return rows.append_column("offset", pa.array(at[:, 1]))

    names = [c.split()[0] for c in PIECE.split(", ")]
    pieces = materialize(token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col, (cache_pieces, slice_bytes)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "pieces")
    n_groups = max(1, -(-(pieces.agg(F.sum("_n")).first()[0] or 0) // GROUP_PIECES))
    each = pieces.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    grouped = each.select(*names, F.pmod(F.xxhash64(*names, "_k"), F.lit(n_groups)).alias("_group"))
    return grouped.groupBy("_group").applyInArrow(pack, PACKED)
