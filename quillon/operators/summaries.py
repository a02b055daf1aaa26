"""Summaries by group, ordered rules and coverage, each as one aggregate or projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import scalars as S


def ordered_reason(rules: Sequence[tuple[Column, str]], otherwise: str = "") -> Column:
    """The reason of the first rule that holds; a condition that is null does not."""
    reason = F.lit(otherwise)
    for holds, name in reversed(rules):
        reason = F.when(holds, name).otherwise(reason)
    return reason


def category_by_prefix(path: Column, rules: Sequence[tuple[str | Sequence[str], str]], otherwise: str) -> Column:
    """The category of the first rule one of whose prefixes the path has; the longest need not come first."""
    starts = lambda prefixes: [path.startswith(p) for p in ([prefixes] if isinstance(prefixes, str) else prefixes)]
    return ordered_reason([(F.greatest(*map(_number, found), F.lit(0)) == 1, name) for prefixes, name in rules for found in [starts(prefixes)]], otherwise)


def _number(holds: Column) -> Column:
    return F.coalesce(holds, F.lit(False)).cast("int")


def pair_concordance(df: DataFrame, keys: Sequence[str], first: Column, second: Column, label: str, evidence: str, least: int = 2, divergent: float = 0.5) -> DataFrame:
    """How two boolean answers (null: not tested) agree in each group.

    Columns: n_rows, n_joint (both known), n_same, n_different, share_same and
    share_different (of the joint ones; null without any), class, included
    (enough joint rows), exclusion_reason (else empty); the sorted distinct labels, joined by ;, of
    joint rows, of those that agree and of those that differ; and the sorted distinct
    values of evidence that are not blank.
    """
    joint = first.isNotNull() & second.isNotNull()
    same = joint & (first == second)
    names = lambda cond: S.sorted_set(F.collect_set(F.when(cond, F.col(label).cast("string"))))
    known = S.blank_to_null(F.col(evidence).cast("string"))
    made = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(joint).alias("n_joint"), F.count_if(same).alias("n_same"),
        names(joint).alias("labels_joint"), names(same).alias("labels_same"), names(joint & ~same).alias("labels_different"), S.sorted_set(F.collect_set(known)).alias("evidence"),
    )
    different, enough = F.col("n_joint") - F.col("n_same"), F.col("n_joint") >= least
    return made.select(
        *keys, "n_rows", "n_joint", "n_same", different.alias("n_different"), F.try_divide("n_same", "n_joint").alias("share_same"), F.try_divide(different, "n_joint").alias("share_different"),
        S.concordance_class(F.col("n_joint"), different, least, divergent).alias("class"), enough.alias("included"), F.when(enough, "").otherwise("insufficient_jointly_tested").alias("exclusion_reason"),
        "labels_joint", "labels_same", "labels_different", "evidence",
    )


def response_summary(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Answers coded 1 to 4 in each group: n, n_1 to n_4, the shares of 1 or 3 (first) and of 2 or 3 (second), and their difference."""
    n = F.count_if(F.col(code).isin(1, 2, 3, 4))
    codes = {i: F.count_if(F.col(code) == i) for i in (1, 2, 3, 4)}
    first, second = F.try_divide(codes[1] + codes[3], n), F.try_divide(codes[2] + codes[3], n)
    return df.groupBy(*keys).agg(n.alias("n"), *[c.alias(f"n_{i}") for i, c in codes.items()], first.alias("share_first"), second.alias("share_second"), (first - second).alias("difference"))


def coverage_counts(df: DataFrame, keys: Sequence[str], pair: str, genes: str, flags: Mapping[str, Column]) -> DataFrame:
    """Of each entity the distinct pairs, known genes, and how often each flag holds, and whether it is 1 or 0 (as <flag>_single, <flag>_none)."""
    held = {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in flags.items()}
    made = df.groupBy(*keys).agg(F.count_distinct(pair).alias("n_pairs"), F.count(genes).alias("n_genes"), *[c.alias(n) for n, c in held.items()])
    return made.withColumns({f"{n}_{word}": F.col(n) == k for n in flags for word, k in (("single", 1), ("none", 0))})


def energy_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, least, median, mean and sd (0 of one value) of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"))


def feature_rows(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """keys, feature (the parts joined by :) and present (1), each once."""
    return df.select(*keys, F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).alias("feature")).distinct().withColumn("present", F.lit(1))


def inconsistent_groups(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Groups with several distinct values, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_hashes")).filter("n_hashes > 1")


def coverage(reference: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """n_reference, n_seen and coverage: the share of distinct reference keys that occur in the other table; null without keys."""
    keys = seen.select(key).distinct().withColumn("_s", F.lit(True))
    one = reference.select(key).distinct().join(keys, key, "left").agg(F.count(F.lit(1)).alias("n_reference"), F.count_if(F.col("_s")).alias("n_seen"))
    return one.withColumn("coverage", F.try_divide("n_seen", "n_reference"))


def expected_sets(df: DataFrame, keys: Sequence[str], value: str, expected: Column) -> DataFrame:
    """Of each group whether its distinct known values are exactly the expected array, with what it lacks and has beyond."""
    found = df.groupBy(*keys).agg(F.collect_set(value).alias("_v"))
    lacks, more = F.array_sort(F.array_except(expected, "_v")), F.array_sort(F.array_except("_v", expected))
    return found.select(*keys, ((F.size(lacks) == 0) & (F.size(more) == 0)).alias("matches"), lacks.alias("lacking"), more.alias("unexpected"))


def pair_counts(df: DataFrame, group: str, member: str, pairs: DataFrame | None = None, status: str = "status") -> DataFrame:
    """n distinct members and n_pairs = n(n-1)/2 of each group; with a table of pairs (group, status) also how many succeeded, were skipped, and are unaccounted for."""
    made = df.groupBy(group).agg(F.count_distinct(member).alias("n")).withColumn("n_pairs", F.expr("n * (n - 1) div 2"))
    if pairs is None:
        return made
    done = pairs.groupBy(F.col(group).alias("_g")).agg(F.count_if(F.col(status) == "SUCCESS").alias("_s"), F.count_if(F.col(status).startswith("SKIPPED")).alias("_k"))
    zero = {n: F.coalesce(c, F.lit(0)) for n, c in (("n_success", "_s"), ("n_skipped", "_k"))}
    both = made.join(done, F.col(group).eqNullSafe(F.col("_g")), "left").withColumns(zero).drop("_g", "_s", "_k")
    return both.withColumn("n_unaccounted", F.col("n_pairs") - F.col("n_success") - F.col("n_skipped"))


def importance(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """mean, sd0 (of all), sd1 (of a sample) to some digits, and the rank by falling mean, then keys; a row for each feature is ranked."""
    made = df.groupBy(*keys).agg(*[F.round(f(value), digits).alias(n) for n, f in (("mean", F.avg), ("sd0", F.stddev_pop), ("sd1", F.stddev_samp))])
    return made.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), *keys)))


def set_operation(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Distinct rows of the "union", "intersect" or "except" of two key tables with the same columns."""
    rights = right.select(*left.columns)
    return {"union": lambda: left.union(rights).distinct(), "intersect": lambda: left.intersect(rights), "except": lambda: left.subtract(rights)}[how]()


def best_value(df: DataFrame, keys: Sequence[str], value: str, *, largest: bool = True) -> DataFrame:
    """The best known value of each group; null where none is known."""
    return df.groupBy(*keys).agg((F.max if largest else F.min)(value).alias("best"))
