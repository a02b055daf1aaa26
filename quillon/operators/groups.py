"""Ordinals, labels and representatives within groups, by partial aggregates wherever a group may be large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def group_ordinals(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """Rows of each group numbered from 1 in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_min(value: str, index: str, out: str) -> Column:
    """Aggregate: out of the row with the least value, the least index among ties; rows without a value don't count."""
    return F.min_by(out, F.when(F.col(value).isNotNull(), F.struct(value, index)))


def stable_labels(df: DataFrame, group: Sequence[str], label: str, energy: str, name: str = "cluster") -> DataFrame:
    """Labels renumbered from 1 in each group: larger clusters first, then lower least energy, then the old label.

    Only one row for each cluster is ranked; rows without a label get none.
    """
    sizes = df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"), F.min(energy).alias("_low"))
    order = Window.partitionBy(*group).orderBy(F.desc("_n"), F.col("_low").asc_nulls_last(), label)
    ranks = sizes.select(*group, label, F.row_number().over(order).alias(name))
    return df.join(ranks, [*group, label], "left")


def representatives(df: DataFrame, group: Sequence[str], cluster: str, id_col: str, distance: str, energy: str, index: str, top: int = 5) -> DataFrame:
    """role and id for each group: the lowest energy of all, the medoid of cluster 1, then the medoids of clusters 2 to top.

    A medoid has the least mean distance. Ties go to the least index; a role that no row has a value for is absent.
    """
    low = F.min(F.when(F.col(energy).isNotNull(), F.struct(energy, index, F.col(id_col).alias("id")))).alias("low")
    each = df.groupBy(*group, cluster).agg(first_min(distance, index, id_col).alias("medoid"), low)
    c = F.col(cluster)
    medoids = F.when(c.between(1, top), F.struct(c.alias("cluster"), F.col("medoid").alias("id")))
    # A group has `top` medoids at most.
    wide = each.groupBy(*group).agg(F.min("low")["id"].alias("_low"), F.collect_list(medoids).alias("_medoids"))
    role = lambda m: F.when(m["cluster"] == 1, "dominant_cluster_medoid").otherwise(F.format_string("cluster_%03d_medoid", m["cluster"]))
    rows = F.transform("_medoids", lambda m: F.struct(role(m).alias("role"), m["id"].alias(id_col)))
    lowest = F.array(F.struct(F.lit("global_lowest_energy").alias("role"), F.col("_low").alias(id_col)))
    return wide.select(*group, F.inline(F.concat(lowest, rows))).filter(F.col(id_col).isNotNull())


def same_as_first(df: DataFrame, group: Sequence[str], order: Sequence[str], signature: str, name: str = "same_as_first") -> DataFrame:
    """Whether a row's signature equals the one of its group's first row; two nulls are equal, a null group is one too."""
    first = df.groupBy(*group).agg(F.min_by(signature, F.struct(*order)).alias("_first"))
    first = first.withColumnsRenamed({g: f"_{g}" for g in group})
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return df.join(first, on, "left").withColumn(name, F.col(signature).eqNullSafe(F.col("_first"))).drop("_first", *[f"_{g}" for g in group])
