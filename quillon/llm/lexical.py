"""Ranked lexical search: a set of query texts against all documents, as products of dense tiles.

One pass over the texts counts each document's terms, and, of those terms alone
that some query has, how often each occurs. From these counts come the weights of
the queries' terms, and each document's impact for each of them. Tiles of queries
over their own compact vocabulary are multiplied with tiles of documents by BLAS
in float64. Weights, impacts and products are whole numbers, and a tile's
vocabulary is cut where a query's sums could reach 2^53, so every sum is exact;
the tiles' sums are added as 64-bit integers. Each task keeps the best of each
query, cuts a tie by the smaller id alone, and the tasks' lists are merged in
two steps.

The queries are dealt to blocks of about BLOCK_BYTES of text, each with a pass of
its own over the documents, so what is sent to the tasks is bounded however many
queries there are.

Defined results: a text without terms, or null, ranks nowhere and counts in no
statistic; a query without terms, or of terms that no document has, gets no
rows; repeated documents are ranked each, and so are repeated queries; ids that are null
come last among equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.common import bounded_batches, materialize

#: Bytes of queries that are asked together; bytes of a text that are cut into terms together.
BLOCK_BYTES, CHUNK = 4 << 20, 1 << 20
#: Queries, terms and documents of a tile.
QUERY_TILE, TERM_TILE, DOC_TILE = 256, 2048, 512
#: An impact is below this.
MOST_IMPACT = 1_000_000
#: Lists that meet in a first merge.
MERGE = 64
_KEPT = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TERMS = bytes(b if b in _KEPT else 32 for b in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists: runs of ASCII letters (A-Z in lower case), ASCII digits and all that is not ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + CHUNK) if len(raw) > at + CHUNK else -1
        yield raw[at : to if to >= 0 else len(raw)].split()
        at = to if to >= 0 else len(raw)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Tile:
    """Some queries over some of their terms: places of the queries, the terms, and weights (queries x terms)."""

    queries: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def query_tiles(queries: list[Counter], weights: list[int]) -> list[list[Tile]]:
    """For each tile of queries its tiles of terms; no sum of a product with impacts reaches 2^53."""
    room, out = (1 << 53) // MOST_IMPACT - 1, []
    for at in range(0, len(queries), QUERY_TILE):
        own = queries[at : at + QUERY_TILE]
        columns: list[tuple[int, dict[int, int]]] = []
        for term in sorted({t for q in own for t in q}):
            each = {i: q[term] * weights[term] for i, q in enumerate(own) if q[term] * weights[term]}
            while each:  # a weight beyond the room takes several columns
                columns.append((term, {i: min(v, room) for i, v in each.items()}))
                each = {i: v - room for i, v in each.items() if v > room}
        tiles, first, sums = [], 0, Counter()
        for place, (_, each) in enumerate(columns):
            if place - first == TERM_TILE or any(sums[i] + v > room for i, v in each.items()):
                tiles.append(columns[first:place])
                first, sums = place, Counter()
            sums.update(each)
        if columns:
            tiles.append(columns[first:])
        made = []
        for part in tiles:
            matrix = np.zeros((len(own), len(part)))
            for j, (_, each) in enumerate(part):
                for i, v in each.items():
                    matrix[i, j] = v
            made.append(Tile(np.arange(at, at + len(own)), np.array([t for t, _ in part]), matrix))
        if made:
            out.append(made)
    return out


class Best:
    """The k best of each query so far; equal scores by the smaller id, null ids last."""

    def __init__(self, k: int, n_queries: int) -> None:
        self.k, self.least = k, np.ones(n_queries, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: queries x documents."""
        bar = self.least[queries]
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero(scores >= bar[:, None])  # a tie with the last one stays
        self.parts.append((queries[q], scores[q, d], ids[d], null[d]))
        self.held += len(q)
        if self.held > 64 * self.k * len(self.least):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, s, d, z = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((d, z, -s, q))
        q, s, d, z = q[order], s[order], d[order], z[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        keep = place < self.k
        self.parts = [(q[keep], s[keep], d[keep], z[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms and tfs of each document that has a term; terms are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch["_text"]:
                size, found = 0, Counter()
                for part in terms_of(text.as_py()):
                    size += len(part)
                    found.update(filter(known.__contains__, part))
                n.append(size)
                terms.append([known[t] for t in found])
                tfs.append(list(found.values()))
            yield pa.record_batch(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"]
            )

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0")


def _ranked(counted: DataFrame, names: list, queries: list[Counter], weights: list[int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    tiles = query_tiles(queries, weights)
    shared = counted.sparkSession.sparkContext.broadcast((names, tiles))
    width = len(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tiles = shared.value
        best, place = Best(top, len(names)), np.empty(width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids, null = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_null().to_numpy(zero_copy_only=False)
                n, tf = part["n"].to_numpy(), part["tfs"].flatten().to_numpy()
                own = np.repeat(np.arange(part.num_rows), part["terms"].value_lengths().to_numpy())
                term = part["terms"].flatten().to_numpy()
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[own])
                for group in tiles:
                    total = np.zeros((len(group[0].queries), part.num_rows), np.int64)
                    for tile in group:
                        # A term that fills several columns has its impact in each.
                        uses = np.split(np.arange(len(tile.terms)), np.flatnonzero(np.diff(tile.terms)) + 1)
                        dense = np.zeros((len(tile.terms), part.num_rows))
                        for k in range(max(map(len, uses))):
                            place.fill(-1)
                            columns = np.array([u[k] for u in uses if len(u) > k])
                            place[tile.terms[columns]] = columns
                            to = place[term]
                            hit = to >= 0
                            dense[to[hit], own[hit]] = impact[hit]
                        total += (tile.weights @ dense).astype(np.int64)
                    best.add(group[0].queries, total, ids, null)
        if best.parts:
            q, s, d, z = best.cut()
            item = pa.array(names, pa.int64()).take(pa.array(q))
            yield pa.record_batch([pa.array(q.astype(np.int64)), item, pa.array(s), pa.array(d, mask=z)], ["_query", "item_id", "score", "doc_id"])

    found = counted.mapInArrow(search, "_query long, item_id long, score long, doc_id long").withColumn("_part", F.spark_partition_id() % MERGE)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["_query", "_part"], ["_query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(
    docs: DataFrame, items: DataFrame, *, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    asked = materialize(items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("_text")), "search-items")
    n_blocks = 1 + (asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // BLOCK_BYTES
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "_text"), F.lit(n_blocks)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        rows = sorted(dealt.filter(F.col("_block") == block).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["_text"]))
        named = [Counter(t for part in terms_of(r["_text"]) for t in part) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for q in named for t in q}))}
        if not vocabulary:
            continue
        counted = materialize(_counted(texts, vocabulary), "search-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [weight(n_docs, found[i]) if i in found else 0 for i in range(len(vocabulary))]
        queries = [Counter({vocabulary[t]: c for t, c in q.items()}) for q in named]
        if n_terms:
            out = out.unionByName(_ranked(counted, [r["item_id"] for r in rows], queries, weights, n_docs, n_terms, top))
    return out
