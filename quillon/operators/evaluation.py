"""Correlations, areas under the curve and nearest neighbours over whole tables, by blocks whose sums or best are merged in steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.sources.files import shared_table

#: Lists or sums that meet in a first merge; bytes of query vectors that are sent to the tasks together.
MERGE, BLOCK_BYTES = 64, 32 << 20
#: Rows of queries and of other vectors that are compared together.
TILE = (32, 256)


# Correlation --------------------------------------------------------------------


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs of features, each over the rows that have both; NaN where that has no variance.

    One pass finds the means, one more the sums of products about them: tasks
    multiply blocks of rows with BLAS, and their sums, one row for each
    feature, are merged in two steps. The matrix of features is all that comes to the driver.
    A NaN counts as missing.
    """
    p, names = len(features), [f"x{i}" for i in range(len(features))]
    values = df.select(*[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(n) for f, n in zip(features, names, strict=True)])
    means = np.array([0.0 if m is None else m for m in values.agg(*[F.avg(n) for n in names]).first()])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, p, p))
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1) - means
                has = (~np.isnan(x)).astype(float)
                x = np.where(has > 0, x, 0.0)
                sums += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
        if sums.any():
            yield pa.record_batch([pa.array(range(p), pa.int32()), pa.array(list(sums.transpose(1, 0, 2).reshape(p, 4 * p)), pa.list_(pa.float64()))], ["i", "sums"])

    def merge(rows: pa.Table) -> pa.Table:
        whole = np.zeros(4 * p)
        for part in rows["sums"].chunks:
            whole += part.flatten().to_numpy().reshape(-1, 4 * p).sum(axis=0)
        return pa.table({"i": rows["i"].slice(0, 1).combine_chunks(), "sums": pa.array([whole], pa.list_(pa.float64()))})

    parts = values.mapInArrow(block, "i int, sums array<double>").withColumn("part", F.spark_partition_id() % MERGE)
    merged = parts.groupBy("i", "part").applyInArrow(merge, "i int, sums array<double>").groupBy("i").applyInArrow(merge, "i int, sums array<double>")
    n, s, q, c = (np.full((p, p), np.nan) for _ in range(4))
    for r in merged.collect():
        n[r["i"]], s[r["i"]], q[r["i"]], c[r["i"]] = np.array(r["sums"]).reshape(4, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        out = (c - s * s.T / n) / np.sqrt(spread * spread.T)
    # What is left of a constant by rounding is no variance.
    out[(spread <= 1e-12 * q) | (spread.T <= 1e-12 * q.T)] = np.nan
    return np.clip(out, -1.0, 1.0)


# Areas under the curve ------------------------------------------------------------


def auc(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Keys, n, n_positive and auc, by average ranks of tied scores; null without both classes. Rows without truth or score don't count.

    Ties are counted first; then ranges of scores are ranked, each from the count
    of all before it, so a key with many scores is spread over tasks. Null keys are a key.
    """
    known = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return auc_of_ties(known.groupBy(*keys, F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("int")).alias("_p")), keys)


def auc_of_ties(ties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As auc, from counts: keys, _score, _n (rows) and _p (positive ones), one row for each key and score."""
    ranged = ties.repartitionByRange(*keys, "_score").withColumn("_part", F.spark_partition_id())
    ranged = shared_table(ranged)
    before = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    own = Window.partitionBy(*keys).orderBy("_part")  # a row for each partition
    before = before.select(*keys, "_part", (F.sum("_sum").over(own) - F.col("_sum")).alias("_before"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "_part")]
    placed = ranged.alias("l").join(before.alias("r"), same).select(*[F.col(f"l.{c}").alias(c) for c in ranged.columns], "_before")
    up_to = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_score"))
    ranked = placed.withColumn("_rank", F.col("_before") + up_to - (F.col("_n") - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_p").alias("n_positive"), F.sum(F.col("_rank") * F.col("_p")).alias("_s"))
    p = F.col("n_positive")
    return out.select(*keys, "n", "n_positive", F.try_divide(F.col("_s") - p * (p + 1) / 2, p * (F.col("n") - p)).alias("auc"))


def auc_differences(df: DataFrame, label: str, truth: str, first: str, second: str) -> DataFrame:
    """scope, label, auc_first, auc_second and delta (second minus first).

    Scope "label" has a row for each label; "micro" pools the rows of all labels;
    "macro" is the mean over labels that have both classes.
    """
    scores = F.array(*[F.struct(F.lit(i).alias("_model"), F.col(c).cast("double").alias("_s")) for i, c in enumerate((first, second))])
    scopes = F.array(F.struct(F.lit("label").alias("scope"), F.col(label).cast("string").alias("label")), F.struct(F.lit("micro").alias("scope"), F.lit(None).cast("string").alias("label")))
    long = df.filter(F.col(label).isNotNull()).select(F.col(truth).cast("int").alias("_truth"), F.explode(scores).alias("m"), scopes.alias("_scopes"))
    long = long.select("_truth", "m.*", F.inline("_scopes"))
    each = auc(long, ["_model", "scope", "label"], "_truth", "_s")
    macro = each.filter("scope = 'label'").groupBy("_model").agg(F.avg("auc").alias("auc")).select("_model", F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("label"), "auc")
    both = each.select("_model", "scope", "label", "auc").unionByName(macro)
    wide = both.groupBy("scope", "label").agg(*[F.max(F.when(F.col("_model") == i, F.col("auc"))).alias(f"auc_{n}") for i, n in enumerate(("first", "second"))])
    return wide.withColumn("delta", F.col("auc_second") - F.col("auc_first"))


# Neighbours ---------------------------------------------------------------------


def _best(k: int, held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of rows (query, distance, neighbour) the k nearest of each query; ties by the smaller neighbour."""
    q, d, b = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, d, q))
    q, d, b = q[order], d[order], b[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], b[keep]


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """query, neighbour, distance (to 6 digits) and rank of the k rows of base nearest to each query, other than itself.

    Queries are dealt to blocks of a bounded size; each block goes to all tasks,
    and a task gives out its k nearest of each query, so no pairs are shuffled.
    Rows without id or vector are left out; vectors must be of one length.
    """
    spark = base.sparkSession
    known = lambda df, name: df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
    asked = shared_table(known(queries, "query"))
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    n_blocks, rows = 1 + size // BLOCK_BYTES, known(base, "neighbour")
    out = spark.createDataFrame([], "query long, neighbour long, distance double, rank int")
    for at in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == at).orderBy("query").toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block["query"].to_numpy(), np.stack(block["v"].to_numpy())))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            held: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, v = batch["neighbour"].to_numpy(), batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                for a in range(0, len(q), TILE[0]):
                    for b in range(0, len(v), TILE[1]):
                        gap = q[a : a + TILE[0], None, :] - v[None, b : b + TILE[1], :]
                        d = np.round(np.sqrt((gap * gap).sum(axis=2)), 6)
                        d[ids[a : a + TILE[0], None] == own[None, b : b + TILE[1]]] = np.inf
                        least = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                        x, y = np.nonzero((d <= least[:, None]) & np.isfinite(d))
                        held.append((x + a, d[x, y], own[b + y]))
                held = [_best(k, held)]
            if held:
                x, d, b = held[0]
                yield pa.record_batch([pa.array(ids[x]), pa.array(b), pa.array(d)], ["query", "neighbour", "distance"])

        found = rows.mapInArrow(search, "query long, neighbour long, distance double").withColumn("_part", F.spark_partition_id() % MERGE)
        for keys in (["query", "_part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "neighbour"))).filter(F.col("rank") <= k)
        out = out.unionByName(found.select("query", "neighbour", "distance", "rank"))
    return out


def neighbour_auc(queries: DataFrame, base: DataFrame, id_col: str, vector: str, label: str, k: int) -> DataFrame:
    """scope, label, n, n_positive and auc of telling a query's label by the share of its k neighbours that have it.

    A row for each label of the queries or their neighbours, "micro" over all pairs of
    query and label, and "macro", the mean over labels that have both classes.
    Pairs without a neighbour of the label have score zero and are counted, not listed.
    """
    found = shared_table(nearest(queries, base, id_col, vector, k))
    named = base.filter(F.col(label).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("string").alias("label"))
    own = queries.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.col(label).cast("string").alias("label"), F.lit(1).alias("_truth"), F.lit(0).alias("_votes"))
    votes = found.join(named, F.col("neighbour") == F.col("_id")).select("query", "label", F.lit(0).alias("_truth"), F.lit(1).alias("_votes")).join(own.select("query").distinct(), "query", "left_semi")
    listed = shared_table(own.unionByName(votes).groupBy("query", "label").agg(F.max("_truth").alias("_truth"), F.sum("_votes").alias("_score")))
    ties = listed.groupBy("label", "_score").agg(F.count(F.lit(1)).alias("_n"), F.sum("_truth").alias("_p"))
    n = listed.agg(F.count_distinct("query")).first()[0]
    absent = listed.groupBy("label").agg((F.lit(n) - F.count(F.lit(1))).alias("_n")).select("label", F.lit(0).cast("long").alias("_score"), "_n", F.lit(0).cast("long").alias("_p"))
    ties = ties.unionByName(absent.filter("_n > 0")).groupBy("label", "_score").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    scoped = ties.withColumn("scope", F.lit("label")).unionByName(ties.groupBy("_score").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p")).select(F.lit(None).cast("string").alias("label"), "_score", "_n", "_p", F.lit("micro").alias("scope")))
    each = shared_table(auc_of_ties(scoped, ["scope", "label"]))
    macro = each.filter("scope = 'label' and auc is not null").agg(F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"), F.avg("auc").alias("auc"))
    return each.unionByName(macro.select(F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("label"), "n", "n_positive", "auc"))
