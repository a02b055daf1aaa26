"""Exact deduplication: 128-bit content hash, then a byte comparison inside groups.

Only DataFrame functions are used. Texts never move unless their hash occurs
more than once, and then each task sends one copy of a text at most, since the
grouping that compares bytes combines equal texts before the shuffle.

Defined results: a null text counts as empty; a null doc_id never wins over
another id, and its group has a null keep_id only if all its ids are null; rows
that repeat both doc_id and text are listed each with the same decision in the
report, and one of them stays in `exact_dedup`; an empty table gives an empty
result; extra columns are carried by `exact_dedup` and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import ascii_lower, materialize, maybe_broadcast, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def _normal(text: str, lower: bool) -> Column:
    return ascii_lower(text_or_empty(text)) if lower else text_or_empty(text)


def _groups_of_copies(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of rows (_hash, _text, ...) those whose hash is repeated."""
    return keyed.join(maybe_broadcast(repeated, 64), "_hash", "left_semi")


def exact_dedup_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    lower: bool = True,
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """A row for each document: its id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays.
    """
    best = F.min if keep == "smallest" else F.max
    keyed = docs.select(F.col(id_col).alias("doc_id"), _normal(text_col, lower).alias("_text"))
    keyed = keyed.select("doc_id", hash_fn(F.col("_text")).alias("_hash"), "_text")
    meta = materialize(keyed.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256")), "dedup-meta")
    repeated = materialize(meta.groupBy("_hash").count().filter("count > 1").select("_hash"), "dedup-repeated")
    groups = (
        _groups_of_copies(keyed, repeated)
        .groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "group_size", F.col("keep_id"), F.lit(True).alias("_grouped"))
    )
    groups = materialize(groups, "dedup-groups")
    return meta.join(maybe_broadcast(groups, 160), ["_hash", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("_grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_grouped"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        "text_sha256",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    lower: bool = True,
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The documents, all columns, with one row left of equal texts."""
    best = F.min_by if keep == "smallest" else F.max_by
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), _normal(text_col, lower).alias("_text"))
    keyed = keyed.select("_row", "_id", hash_fn(F.col("_text")).alias("_hash"), "_text")
    hashes = keyed.groupBy("_hash").count().filter("count > 1").select("_hash")
    repeated = materialize(hashes, "dedup-repeated")
    single = keyed.join(maybe_broadcast(repeated, 64), "_hash", "left_anti").select("_row.*")
    # Rows with a null id are weighed last: struct comparison puts nulls first.
    order = F.struct(F.col("_id").isNull(), "_id") if keep == "smallest" else F.struct(F.col("_id").isNotNull(), "_id")
    chosen = _groups_of_copies(keyed, repeated).groupBy("_hash", "_text").agg(best("_row", order).alias("_row")).select("_row.*")
    return single.unionByName(chosen)
