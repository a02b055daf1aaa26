"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document's expected number of copies is
its source's target over its source's words. The whole part is certain, and the
fraction is rounded: two fractional documents of a source exchange mass so that
their sum of size times fraction stays, at random so that each expectation
stays, until one of the two is integral. What is left of each group of
documents, one fractional document for each source, meets the leftovers of
other groups one level higher in a tree of groups. So a source's total misses
its target by less than one document.

Groups are made from a hash of the whole row, never from where rows lie, and
the random numbers come from hashes too, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take 0 words; a
null source is a source of its own, ordered last; repeated rows are rounded
each on its own, and rows that differ in any column are different rows; an empty
table gives an empty result.
"""

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import materialize, maybe_broadcast, row_hash, text_or_empty, word_count

#: Documents of a first group, and groups that meet at each further level.
LEAF_DOCS, FAN_IN = 20_000, 64
#: Sources are listed on the driver to set the targets, and dealt to groups of so many.
MAX_SOURCES, GROUP_SOURCES = 1_000_000, 1000
UNIT = "doc_id long, _null boolean, _row long, _row2 long, _k long, _source int, size long, _whole long, _part double, _leaf long, _deal int, _done boolean"


def source_targets(sizes: list[int], weights: list[float], share: float, stop: float) -> list[float]:
    """share times the sum of sizes, dealt by weight; nobody gets over stop times its size, and the excess is dealt again."""
    total, targets = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes)]
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if total * weights[i] / weight > stop * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = total * weights[i] / weight
            break
        for i in full:
            targets[i] = stop * sizes[i]
        total -= sum(targets[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return targets


def _uniform(a: int, b: int, seed: int) -> float:
    return xxhash.xxh64_intdigest(f"{a},{b}", seed=seed) / 2.0**64


def pivot(size: list[int], part: list[float], key: list[int], seed: int) -> tuple[list[float], int | None]:
    """Round the fractions of documents one after the other; what is left open is the place of one document or None.

    The sum of size times part stays, but for what rounding errors leave.
    """
    part = list(part)
    open_: int | None = None
    for j, p in enumerate(part):
        if size[j] == 0 or p <= 1e-12:
            part[j] = 0.0
            continue
        if p >= 1 - 1e-12:
            part[j] = 1.0
            continue
        if open_ is None:
            open_ = j
            continue
        i = open_
        # Mass, in words, that may go from i to j, and from j to i.
        up, down = min(size[i] * part[i], size[j] * (1 - part[j])), min(size[j] * part[j], size[i] * (1 - part[i]))
        move = up if _uniform(key[i], key[j], seed) * (up + down) < down else -down
        part[i] -= move / size[i]
        part[j] += move / size[j]
        ends = [k for k in (i, j) if 1e-9 < part[k] < 1 - 1e-9]
        for k in (i, j):
            if k not in ends:
                part[k] = float(round(part[k]))
        open_ = ends[0] if ends else None
    return part, open_


def _round_group(rows: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    """Pivot the documents of each source of a group. last: nothing stays open."""
    rows = rows.sort_values(["_source", "_row", "_k", "doc_id"], kind="stable", ignore_index=True)
    part, done = rows["_part"].to_numpy().copy(), np.ones(len(rows), bool)
    for _, at in rows.groupby("_source").indices.items():
        own = rows.iloc[at]
        key = ((own["_row"].to_numpy() ^ own["_k"].to_numpy()) & 0x7FFFFFFFFFFFFFFF).tolist()
        new, open_ = pivot(own["size"].tolist(), own["_part"].tolist(), key, seed)
        if open_ is not None:
            if last:
                new[open_] = float(_uniform(key[open_], 0, seed + 1) < new[open_])
            else:
                done[at[open_]] = False
        part[at] = new
    rows["_part"], rows["_done"] = part, done
    return rows


def _tree_level(units: DataFrame, last: bool, seed: int) -> DataFrame:
    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        return _round_group(rows, last, seed)

    return units.groupBy("_leaf", "_deal").applyInPandas(groups, UNIT)


def mix_copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    stop: float = 2.0,
    *,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, _row and _row2 (hashes of the whole row), _k (which of equal rows), size, source_size, target, copies for each document.

    Sources, by code point and null last, weigh what `weights` says, repeating.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        row_hash(docs, 1).alias("_row"),
        row_hash(docs, 2).alias("_row2"),
        F.col(source_col).alias("_name"),
        word_count(text).alias("size"),
    )
    # Equal rows are counted, then numbered, so that no task holds them before they are split by the group.
    rows = materialize(rows.groupBy("doc_id", "_row", "_row2", "_name", "size").agg(F.count(F.lit(1)).alias("_n")), "mix-rows")
    sums = rows.groupBy("_name").agg(F.sum(F.col("size") * F.col("_n")).alias("s"), F.sum("_n").alias("n"))
    found = sums.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["_name"] is None, (r["_name"] or "").encode()))
    sizes = [r["s"] for r in found]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, stop)
    dim = spark.createDataFrame(
        [(r["_name"], i, r["s"], t, t / r["s"] if r["s"] else 0.0) for i, (r, t) in enumerate(zip(found, targets, strict=True))],
        "_name2 string, _source int, source_size long, target double, _copies double",
    )
    small = len(found) <= 100_000
    dim = F.broadcast(dim) if small else dim
    n_docs = sum(r["n"] for r in found)
    leafs = FAN_IN ** math.ceil(math.log(max(1, n_docs / LEAF_DOCS), FAN_IN))
    leafs = max(1, min(leafs, 2 ** math.ceil(math.log2(max(1, n_docs / LEAF_DOCS)))))
    whole = F.floor("_copies").cast("long")
    units = (
        rows.join(dim, F.col("_name").eqNullSafe(F.col("_name2")))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("_null"), "_row", "_row2", F.col("_k").cast("long"), "_source", "size", whole.alias("_whole"), (F.col("_copies") - whole).alias("_part"),
            F.pmod(F.xxhash64("_row", "_k"), F.lit(leafs)).alias("_leaf"), (F.col("_source") % (1 + len(found) // GROUP_SOURCES)).cast("int").alias("_deal"), F.lit(False).alias("_done"),
        )
    )
    done: list[DataFrame] = []
    while True:
        last = leafs == 1
        level = materialize(_tree_level(units, last, seed), "mix-level")
        done.append(level.filter("_done"))
        if last:
            break
        units = level.filter("not _done").withColumn("_leaf", F.floor(F.col("_leaf") / FAN_IN).cast("long"))
        leafs = -(-leafs // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(dim.drop("_name2", "_copies"), "_source").select(
        F.when(~F.col("_null"), F.col("doc_id")).alias("doc_id"), "_row", "_row2", "_k", "size", "source_size", "target", (F.col("_whole") + F.col("_part").cast("long")).alias("copies")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it) of every document."""
    return mix_copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it."""
    copies = mix_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # Rows that are equal in all columns share their key; the mix takes as many of them as their copies sum up to.
    total = materialize(copies.groupBy("_row", "_row2").agg(F.sum("copies").alias("_take"), F.count(F.lit(1)).alias("_n")), "mix-take").filter("_take > 0")
    keyed = docs.select(F.struct("*").alias("_doc"), row_hash(docs, 1).alias("_row"), row_hash(docs, 2).alias("_row2"))
    joined = keyed.join(maybe_broadcast(total, 56), ["_row", "_row2"])
    once = joined.filter("_n = 1").select("_doc", "_take")
    if not total.filter("_n > 1").isEmpty():
        many = joined.filter("_n > 1").groupBy("_row", "_row2").agg(F.first("_doc").alias("_doc"), F.first("_take").alias("_take"))
        once = once.unionByName(many.select("_doc", "_take"))
    return once.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take")))).select("_doc.*")
