"""Profiles, rechecks and status rules of an audit: each gives a table of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import scalars as S
from quillon.operators.checks import place_counts
from quillon.operators.evaluation import correlation_matrix
from quillon.operators.tables import numbered_ids
from quillon.sources.files import shared_table


def modal_value_deviations(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose value (an array, such as a file's columns) is not the most frequent one; of ties the one of the least name. A null value is a value."""
    best = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")).orderBy(F.desc("n"), "first").limit(1)
    best = F.broadcast(best.select(F.col(value).alias("_modal")))  # a single row
    return df.join(best, F.col(value).eqNullSafe(F.col("_modal")), "left_anti")


def table_profile(df: DataFrame, keys: Sequence[str], top: int = 12) -> DataFrame:
    """metric and value: rows, columns, the `top` columns with most missing values and their total, and rows that repeat a key.

    Keys are also judged by their first two columns together; a null key counts
    as a value. Blank text counts as missing.
    """
    text = {c for c, kind in df.dtypes if kind == "string"}
    flags = [(S.blank_to_null(F.col(f"`{c}`")).isNull() if c in text else F.col(f"`{c}`").isNull()).cast("int") for c in df.columns]
    tests = {"repeats:" + k: [k] for k in keys} | ({"repeats:first_two": list(keys[:2])} if len(keys) > 1 else {})
    counts = place_counts(df, [*[([], f) for f in flags], *[(k, None) for k in tests.values()]])
    names = [("missing", "missing:" + c) for c in df.columns] + [("repeats", t) for t in tests]
    named = df.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], "place int, kind string, metric string").join(F.broadcast(counts), "place", "left")  # a row for each column and test
    value = F.coalesce(F.when(F.col("kind") == "missing", F.col("flagged")).otherwise(F.col("rows") - F.col("distinct")), F.lit(0))
    each = shared_table(named.select("kind", "metric", value.alias("value"), F.coalesce("rows", F.lit(0)).alias("rows")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "metric"))
    kept = each.withColumn("_rank", rank).filter((F.col("kind") == "repeats") | (F.col("_rank") <= top)).select("metric", "value")
    total = each.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("kind") == "missing", F.col("value"))), F.lit(0)).alias("missing"))
    entry = lambda metric, x: F.struct(F.lit(metric).alias("metric"), x.cast("long").alias("value"))
    whole = total.select(F.inline(F.array(entry("rows", F.col("rows")), entry("columns", F.lit(len(df.columns))), entry("missing:total", F.col("missing")))))
    return kept.unionByName(whole)


def split_summary(df: DataFrame, part: str, key: str) -> DataFrame:
    """part, n_rows, n_unique, n_missing and n_repeated of each part; blank keys are missing, and neither unique nor repeated."""
    k = S.blank_to_null(F.col(key).cast("string"))
    rows = df.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("n_unique"), F.count_if(k.isNull()).alias("n_missing"))
    return rows.withColumn("n_repeated", F.col("n_rows") - F.col("n_missing") - F.col("n_unique"))


def cluster_summary(df: DataFrame, group: str, cluster: str, id_col: str, energy: str, distance: str) -> DataFrame:
    """Size, share of the group, medoid (least distance, then id), row of least energy, energy's mean, median and deviation, and mean distance of each cluster."""
    least = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(c, id_col)))[id_col]
    rows = df.groupBy(group, cluster).agg(
        F.count(F.lit(1)).alias("size"), least(distance).alias("medoid"), least(energy).alias("lowest_energy"), F.avg(energy).alias("energy_mean"),
        F.percentile(energy, F.lit(0.5)).alias("energy_median"), F.stddev_samp(energy).alias("energy_sd"), F.avg(distance).alias("mean_distance"),
    )
    return rows.withColumn("fraction", F.col("size") / F.sum("size").over(Window.partitionBy(group)))


def cutoff_sensitivity(df: DataFrame, group: str, cutoff: str, cluster: str) -> DataFrame:
    """n_clusters, dominant_size and dominant_fraction of each group at each cutoff."""
    sizes = df.groupBy(group, cutoff, cluster).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.groupBy(group, cutoff).agg(F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("dominant_size"), F.sum("n").alias("_all"))
    return rows.withColumn("dominant_fraction", F.col("dominant_size") / F.col("_all")).drop("_all")


def recheck(df: DataFrame, stored: Column, computed: Column, tolerance: float = 1e-12) -> DataFrame:
    """df with difference and agrees; two nulls agree, one null does not."""
    difference = F.abs(stored - computed)
    agrees = F.when(stored.isNull() | computed.isNull(), stored.isNull() & computed.isNull()).otherwise(difference <= tolerance)
    return df.withColumns({"difference": difference, "agrees": agrees})


def missing_counts(df: DataFrame) -> DataFrame:
    """n_rows, n_rows_missing and n_columns_missing: rows and columns with any null."""
    columns = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in df.columns], F.lit(0)) == 1
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null).alias("n_rows_missing"), *columns)
    with_null = sum(((F.col(f"m{i}") > 0).cast("long") for i in range(len(columns))), F.lit(0).cast("long"))
    return row.select("n_rows", "n_rows_missing", with_null.alias("n_columns_missing"))


def feature_ranking(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, missing, variance, is_constant and rank: fewest missing first, then largest population variance, then name."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"m{i}") for i, f in enumerate(features)], *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)])
    rows = stats.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.try_divide(f"m{i}", "n").alias("missing"), F.col(f"v{i}").alias("variance")) for i, f in enumerate(features)
    ])))
    order = Window.orderBy("missing", F.desc_nulls_last("variance"), "feature")  # a row for each feature
    return rows.withColumns({"is_constant": F.coalesce(F.col("variance") == 0, F.lit(False)), "rank": F.row_number().over(order)})


def training_rows(data: DataFrame, part: str | None = None, *, allow_global: bool = False) -> DataFrame:
    """The rows that may fix statistics: those of part "train"; all rows only if that is allowed in so many words."""
    if part is not None:
        return data.filter(F.col(part) == "train")
    if not allow_global:
        raise ValueError("statistics of all rows leak the test part: name the column of the part, or set allow_global")
    return data


def leakage_summary(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """key, n_train, n_test and n_shared: distinct values, other than null and blank, of each key in both parts."""
    rows = None
    for key in keys:
        value = S.blank_to_null(F.col(key).cast("string")).alias("v")
        each = train.select(value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(value, F.lit(0).alias("a"), F.lit(1).alias("b")))
        each = each.filter("v is not null").groupBy("v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        one = each.agg(zero("a").alias("n_train"), zero("b").alias("n_test"), zero(F.col("a") * F.col("b")).alias("n_shared")).select(F.lit(key).alias("key"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def name_coverage(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """name and present for each expected column."""
    return df.sparkSession.createDataFrame([(name, name in df.columns) for name in expected], "name string, present boolean")


def blank_local_paths(df: DataFrame) -> DataFrame:
    """Text cells that look like a path on somebody's machine as empty text."""
    return df.withColumns({c: F.when(S.local_path(F.col(c)), "").otherwise(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def split_by_status(df: DataFrame, status: str, accepted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an accepted status, and all others, null too, as issues."""
    good = F.coalesce(F.col(status).isin(list(accepted)), F.lit(False))
    return df.filter(good), df.filter(~good)


def far_groups(df: DataFrame, group: str, axes: Sequence[str], reference: Sequence[float], limit: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Groups whose centroid lies within `limit` of the reference point, and the others; both with the distance. A centroid without coordinates is among the others."""
    centre = df.groupBy(group).agg(*[F.avg(a).alias(a) for a in axes])
    distance = F.sqrt(sum((F.col(a) - x) * (F.col(a) - x) for a, x in zip(axes, reference, strict=True)))
    judged = centre.withColumn("distance", distance)
    return judged.filter(F.col("distance") <= limit), judged.filter(F.col("distance").isNull() | (F.col("distance") > limit))


def override_status(df: DataFrame, default: str, rules: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """df with status and reason: each rule (condition, status, reason) that holds overrides the status, and all their reasons are listed."""
    status, reasons = F.lit(default), []
    for holds, name, reason in rules:
        status = F.when(holds, name).otherwise(status)
        reasons.append(F.when(holds, reason))
    return df.withColumns({"status": status, "reason": F.concat_ws("; ", *reasons)})


def misaligned(left: DataFrame, right: DataFrame, ordinal: str, id_col: str) -> DataFrame:
    """ordinal, left_id and right_id of the places where two tables don't list the same id; a place that one of them lacks is one."""
    a, b = left.select(F.col(ordinal), F.col(id_col).alias("left_id")), right.select(F.col(ordinal), F.col(id_col).alias("right_id"))
    return a.join(b, ordinal, "full").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


def link_files(selected: DataFrame, inventory: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """name, kind and issue for each selected (name, kind, sha256) and each kind it lacks: missing_file, hash_mismatch, missing_kind, or null.

    inventory has name, kind and sha256 with one row a name and kind.
    """
    have = inventory.select("name", "kind", F.col("sha256").alias("_have"), F.lit(True).alias("_found"))
    linked = selected.join(have, ["name", "kind"], "left")
    issue = F.when(F.col("_found").isNull(), "missing_file").when(~F.col("sha256").eqNullSafe(F.col("_have")), "hash_mismatch")
    lacking = selected.groupBy("name").agg(F.collect_set("kind").alias("k")).select("name", F.explode(F.array_except(F.array(*map(F.lit, kinds)), "k")).alias("kind"))
    return linked.select("name", "kind", issue.alias("issue")).unionByName(lacking.withColumn("issue", F.lit("missing_kind")))


def pseudonyms(df: DataFrame, column: str, pattern: str = "Assessor_%02d") -> tuple[DataFrame, DataFrame]:
    """df with the column's values replaced by numbered names, in the order of the values, and the table of both; null stays null."""
    names = numbered_ids(df.select(F.col(column).alias("_v")).filter("_v is not null").distinct(), [F.col("_v")], pattern, "_name")
    out = df.join(names, F.col(column) == F.col("_v"), "left").withColumn(column, F.col("_name")).select(*df.columns)
    return out, names.select(F.col("_v").alias("value"), F.col("_name").alias("name"))


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float, top: int = 20) -> DataFrame:
    """a, b and r of the `top` pairs of features whose correlation exceeds the threshold in size; the matrix of features is all that comes to the driver."""
    r = correlation_matrix(df, features)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j and abs(r[i, j]) > threshold]
    rows.sort(key=lambda x: (-abs(x[2]), x[0], x[1]))
    return df.sparkSession.createDataFrame(rows[:top], "a string, b string, r double")


def run_summary(queue: DataFrame, values: DataFrame, keys: Sequence[str], shard: str, requested: str, state: str, value: str, source: str, *, ran: bool = True, default_requested: int = 0) -> DataFrame:
    """One row for each key of the queue, of the values that its shards gave.

    queue has a row for each shard: keys, shard, requested (null: a key
    without shards), state and source; values has keys, shard and value. Columns: status
    (CONFIGURED_NOT_RUN, NO_SHARDS, COMPLETE, PARTIAL or FAILED), requested, found,
    completion (percent, at most 100), shards_expected, shards_completed,
    shards_failed, best (least) with best_source (of ties the least shard),
    median, mean, sd (0 of one value), q25, q75 and worst.
    """
    text = F.coalesce(F.col(state), F.lit("NOT_RUN"))
    done, idle = text.isin("SUCCESS", "SKIPPED_COMPLETE"), text.isin("NOT_RUN", "")
    real = F.col(requested).isNotNull()
    planned = queue.groupBy(*keys).agg(
        F.coalesce(F.sum(requested), F.lit(0)).cast("long").alias("requested"), F.count_if(real).alias("shards_expected"), F.count_if(real & done).alias("shards_completed"), F.count_if(real & ~done & ~idle).alias("shards_failed"),
    )
    v = F.col(value)
    own = values.filter(v.isNotNull()).join(queue.select(*keys, shard, source), [*keys, shard])
    q = F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    made = own.groupBy(*keys).agg(
        F.count(v).alias("found"), F.min(v).alias("best"), F.min_by(source, F.struct(v, shard)).alias("best_source"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), q.alias("_q"), F.max(v).alias("worst"),
    )
    both = planned.join(made, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    asked, found = F.col("requested"), F.col("found")
    status = F.when(F.lit(not ran), "CONFIGURED_NOT_RUN").when(asked == 0, "NO_SHARDS").when((found >= asked) & (F.col("shards_failed") == 0), "COMPLETE").when(found > 0, "PARTIAL").otherwise("FAILED")
    completion = F.when(asked == 0, 0.0).otherwise(F.round(F.least(F.lit(100.0), 100.0 * found / asked), 1))
    quartiles = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return both.select(
        *keys, status.alias("status"), F.when(asked == 0, F.lit(default_requested)).otherwise(asked).cast("long").alias("requested"), "found", completion.alias("completion"),
        "shards_expected", "shards_completed", "shards_failed", "best", "best_source", "mean", "sd", *quartiles, "worst",
    )


def drop_label_if_released(vocabulary: DataFrame, entities: DataFrame, label_col: str, label: str, expected_entities: int, expected_labels: int) -> tuple[DataFrame, DataFrame]:
    """The vocabulary without the label if there are exactly the expected entities, and labels with this one on top; else all of it. Second, one row with both counts and what was done."""
    n = entities.agg(F.count(F.lit(1)).alias("n_entities"))
    m = vocabulary.agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col(label_col) == label).alias("n_label"))
    judged = n.crossJoin(m).withColumn("dropped", (F.col("n_entities") == expected_entities) & (F.col("n_labels") == expected_labels + 1) & (F.col("n_label") > 0))  # one row
    kept = vocabulary.crossJoin(F.broadcast(judged.select("dropped"))).filter(~F.col("dropped") | (F.col(label_col) != label) | F.col(label_col).isNull())
    return kept.select(*vocabulary.columns), judged
