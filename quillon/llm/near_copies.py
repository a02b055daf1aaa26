"""SimHash near-dedup by a similarity: candidates from fingerprints and minima, checked on whole shingle sets.

BK-trees over the 64-bit fingerprints find what lies within a small radius. Pairs
of a Jaccard similarity of 0.8 lie up to 17 bits apart, too far for any tree, so
further candidates come from bands of minima of the shingles' hashes, as the module
of odd sketches has them: stars about the least member of a bucket first, then
what its members' components leave open, by blocks within tasks. Every link is
confirmed on the whole shingle sets, and what is written grows with
the documents, not with pairs in a bucket.

Defined results: a text without words is no copy of anything; one with fewer
words than a shingle has its whole sequence as the only shingle; rows equal in
id and text count as one document; of linked documents the one with the
smallest id stays, null ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import bounded_batches, materialize, maybe_broadcast, text_or_empty
from quillon.llm.odd_sketch import set_links, sketched
from quillon.llm.simhash import near_edges


def _tree_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or linked within radius by BK-trees, each to a least one."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "near-prints")
    equal = nodes.select("node", "fp").join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges = near_edges(least.select(F.col("fp").alias("node"), "fp"), radius)
    for end in ("a", "b"):
        edges = edges.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"_{end}")), end)
    return equal.unionByName(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def near_copies_dedup(
    docs: DataFrame, *, width: int = 5, least: float = 0.8, radius: int = 2, bands: int = 32, rows: int = 4, samples: int = 256, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, all columns, without those linked by similarities of at least `least` (in hundredths) to one with a smaller id."""
    bounded_batches(docs.sparkSession)
    own, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    keys = [F.xxhash64(F.lit(k), own, own.isNull(), text).alias(f"_k{k}") for k in (1, 2)]  # 128 bits that stand for id and text
    texts = docs.select(own.alias("_id"), *keys, F.xxhash64(text).alias("_key"), text.alias("_text"))
    found = materialize(sketched(texts, width, seed, samples, bands, rows), "near-sketches")
    nodes = found.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("docs"), *[F.first(c).alias(c) for c in ("_key", "n", "sketch", "keys", "fp")])
    nodes = materialize(nodes, "near-nodes")
    pairs = materialize(_tree_pairs(nodes, radius), "near-pairs")
    roots = set_links(texts, nodes, width=width, percent=round(100 * least), seed=seed, samples=samples, more=pairs)
    named = nodes.filter("docs > 1").select("node", F.col("node").alias("root"))
    if roots is not None:
        named = nodes.select("node", "docs").join(maybe_broadcast(roots, 48), "node", "left").filter("docs > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"))
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "_k1", "_k2").alias("place")
    placed = found.select("node", place).join(maybe_broadcast(materialize(named, "near-named"), 48), "node").select("root", "place")
    placed = materialize(placed, "near-placed")
    kept = materialize(placed.groupBy("root").agg(F.min("place").alias("kept")), "near-kept")
    gone = placed.join(maybe_broadcast(kept, 80), "root").filter("place <> kept").select("place._k1", "place._k2").distinct()
    gone = materialize(gone, "near-gone")
    # The row stands apart from its keys, whatever its columns are called.
    row = docs.select(F.struct("*").alias("row"), *keys)
    return row.join(maybe_broadcast(gone, 24), ["_k1", "_k2"], "left_anti").select("row.*")
