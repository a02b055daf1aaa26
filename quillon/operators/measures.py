"""Aggregates, profiles, checks, features, splits and model measures as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.scalars import bits_on, grid_size, packed_bits
from quillon.operators.evaluation import correlation_matrix
from quillon.operators.tables import SMALL_ROWS
from quillon.sources.files import shared_table


#: Longs of a bitmap of parities.
PARITY_WORDS = 8
#: Items whose counts are sent to the tasks, sets of a block that are compared with those of another, items that are ordered at once.
FREQUENT_ITEMS, BLOCK_SETS, ITEMS_AT_ONCE = 1 << 20, 4096, 1 << 20


def rating_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Raters, mean, sample deviation, median, maximum, and how often a value above zero was chosen."""
    v = F.col(value)
    n, chosen = F.count(v), F.count_if(F.coalesce(v, F.lit(0)) > 0)
    return df.groupBy(*keys).agg(
        n.alias("n_raters"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("sd_value"), F.median(v).alias("median_value"),
        F.max(v).alias("max_value"), chosen.alias("n_chosen"), F.try_divide(chosen, n).alias("share_chosen"),
    )


def key_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value; blanks don't count."""
    known = df.filter((F.col(key) != "") & (F.col(value) != ""))
    return known.groupBy(key).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def two_way_conflicts(df: DataFrame, left: str, right: str) -> DataFrame:
    """direction, key and n_values: values of either column that meet more than one of the other; blanks don't count."""
    pairs = shared_table(df.filter((F.col(left) != "") & (F.col(right) != "")).select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).distinct())
    one = lambda a, name: pairs.groupBy(a).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1").select(F.lit(name).alias("direction"), F.col(a).alias("key"), "n_values")
    return one("l", f"{left}->{right}").unionByName(one("r", f"{right}->{left}"))


def conflict_rows(df: DataFrame, keys: Sequence[str], value: str, source: str, reason: str = "conflicting_duplicate_records") -> DataFrame:
    """keys, sources (distinct ids in order, joined by ;), values and exclusion_reason of every key with more than one known value."""
    made = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_v"), F.array_sort(F.collect_set(F.col(source).cast("string"))).alias("_s"))
    return made.filter(F.size("_v") > 1).select(*keys, F.array_join("_s", ";").alias("sources"), F.array_join(F.col("_v").cast("array<string>"), ";").alias("values"), F.lit(reason).alias("exclusion_reason"))


def cooccurrence(df: DataFrame, entity: str, label: str) -> DataFrame:
    """How many entities have both labels, for every pair of labels of the vocabulary, zeros too."""
    own = df.select(entity, F.col(label).alias("a")).distinct()
    both = own.join(own.withColumnRenamed("a", "b"), entity).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = shared_table(own.select("a").distinct())
    other = vocabulary.withColumnRenamed("a", "b")
    grid = vocabulary.crossJoin(F.broadcast(other) if vocabulary.count() <= SMALL_ROWS else other)
    return grid.join(both, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def consensus(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value that all rows of a key agree on, else null; n_values tells why."""
    found = F.collect_set(value)
    return df.groupBy(*keys).agg(F.size(found).alias("n_values"), F.when(F.size(found) == 1, F.element_at(found, 1)).alias("value"))


def value_counts(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    v = F.col(column).cast("string")
    return df.groupBy(F.when(v.isNull() | (F.trim(v) == ""), missing).otherwise(v).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def long_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric and value of one-row aggregates, from one pass."""
    row = df.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_rows, n_distinct and n_duplicates of the keys; nulls are a value of their own."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.expr("n_rows - n_distinct"))


def frequency(events: DataFrame, successes: DataFrame, group: str, unit: str, label: str) -> DataFrame:
    """Share of a group's successful units in which a label occurs; each counts once a unit."""
    known = successes.select(group, unit).distinct()
    total = known.groupBy(group).agg(F.count(F.lit(1)).alias("n_units"))
    seen = events.select(group, unit, label).distinct().groupBy(group, label).agg(F.count(F.lit(1)).alias("n_with"))
    return seen.join(total, group, "left").select(group, label, "n_with", "n_units", F.round(F.try_divide("n_with", "n_units"), 6).alias("frequency"))


def expected_counts(required: DataFrame, rows: DataFrame, key: str, expected: int) -> DataFrame:
    """n, expected and PASS or FAIL for each required key, with zero for absent ones."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = required.select(key).distinct().join(found, key, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.withColumn("expected", F.lit(expected)).withColumn("status", F.when(F.col("n") == expected, "PASS").otherwise("FAIL"))


def worst_status(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """FAIL before WARNING before PASS."""
    rank = F.max(F.when(F.col(status) == "FAIL", 2).when(F.col(status) == "WARNING", 1).otherwise(0))
    worst = df.groupBy(*keys).agg(rank.alias("_r"))
    return worst.select(*keys, F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARNING").otherwise("PASS").alias("status"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max"))
    return out.select(*keys, "n", "mean", "sd", "min", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "median", "q75"))], "max")


def usable_features(train: DataFrame, features: Sequence[str], limit: float = 0.9) -> tuple[list[str], DataFrame]:
    """Features fit for training and a log of the dropped ones with reasons.

    A feature goes if it has missing values or no variance in the training rows,
    or if its correlation with one that ranks above it exceeds the limit. The
    statistics are passes on Spark; only the matrix of features comes to the
    driver.
    """
    spark = train.sparkSession
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.count_if(F.col(f).isNull()).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    stats = train.agg(*aggs).first()
    log, left = [], []
    for f in features:
        if stats[f"m_{f}"]:
            log.append((f, "missing", stats[f"m_{f}"] / stats["n"], None))
        elif not stats[f"v_{f}"]:
            log.append((f, "zero_variance", 0.0, None))
        else:
            left.append(f)
    left.sort(key=lambda f: (-stats[f"v_{f}"], f))
    r = np.abs(correlation_matrix(train, left)) if len(left) > 1 else np.zeros((1, 1))
    place = {f: i for i, f in enumerate(left)}
    kept: list[str] = []
    for f in left:
        above = [(x, k) for k in kept if (x := float(r[place[k], place[f]])) > limit]
        if above:
            log.append((f, "correlated", max(x for x, _ in above), above[0][1]))
        else:
            kept.append(f)
    if not kept:
        raise ValueError("no feature is left")
    return kept, spark.createDataFrame(log, "feature string, reason string, value double, partner string")


def standardize(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """All tables with features scaled by the training rows' mean and population deviation, and those parameters."""
    row = train.agg(F.count(F.lit(1)).alias("n"), *[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    scaled = [df.withColumns({f: (F.col(f) - row[f"m_{f}"]) / row[f"s_{f}"] for f in features}) for df in (train, *others)]
    params = [(f, row[f"m_{f}"], row[f"s_{f}"], row[f"s_{f}"] ** 2, row["n"]) for f in features]
    return scaled, train.sparkSession.createDataFrame(params, "feature string, mean double, scale double, variance double, n_train long")


def apply_split(data: DataFrame, train_keys: DataFrame, test_keys: DataFrame, key: str) -> DataFrame:
    """data with part; a key in both lists belongs to test, one in none has no part and goes."""
    test = test_keys.select(key).distinct()
    train = train_keys.select(key).distinct().join(test, key, "left_anti")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return data.join(parts, key)


def split_audit(train: DataFrame, test: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """metric and value: sizes, duplicates, overlap, keys absent from the reference, coverage of it."""
    flags = {"train": train, "test": test, "ref": reference}
    rows = None
    for name, df in flags.items():
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        rows = one if rows is None else rows.join(one, key, "full_outer")
    has = {n: F.col(n).isNotNull() for n in flags}
    used = has["train"] | has["test"]
    return long_metrics(rows, {
        "train_rows": F.coalesce(F.sum("train"), F.lit(0)), "test_rows": F.coalesce(F.sum("test"), F.lit(0)),
        "train_duplicates": F.coalesce(F.sum(F.col("train") - 1), F.lit(0)), "test_duplicates": F.coalesce(F.sum(F.col("test") - 1), F.lit(0)),
        "overlap_keys": F.count_if(has["train"] & has["test"]), "keys_not_in_reference": F.count_if(used & ~has["ref"]),
        "coverage": F.try_divide(F.count_if(used & has["ref"]), F.count_if(has["ref"])),
    })


def concordance_coefficient(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Lin's concordance correlation."""
    gap = F.avg(x) - F.avg(y)
    return df.groupBy(*keys).agg((2 * F.covar_pop(x, y) / (F.var_pop(x) + F.var_pop(y) + gap * gap)).alias("concordance"))


def knee(df: DataFrame, group: str, rank: str, value: str) -> DataFrame:
    """For each group the rank whose point lies farthest below the chord from the first to the last."""
    w = Window.partitionBy(group)
    ends = df.withColumns({"_r0": F.min(rank).over(w), "_r1": F.max(rank).over(w), "_v0": F.max_by(value, -F.col(rank)).over(w), "_v1": F.max_by(value, rank).over(w)})
    on_chord = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col(rank) - F.col("_r0"), F.col("_r1") - F.col("_r0"))
    gap = F.coalesce(on_chord - F.col(value), F.lit(0.0))
    return ends.groupBy(group).agg(F.min_by(rank, F.struct(-F.round(gap, 9), F.col(rank))).alias("knee"))


def hashed_fingerprint(tokens: Column, bits: int = 1024) -> Column:
    """Places of the bits that a text's tokens set, in order."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(bits)).cast("int"))))


def fingerprint_table(df: DataFrame, ids: Sequence[str], tokens: Column, valid: Column, bits: int = 1024) -> tuple[DataFrame, DataFrame]:
    """ids, words (the set bits as packed longs), on_bits and density of each valid row, and the ids of the others with a reason."""
    good = F.coalesce(valid, F.lit(False))
    made = df.filter(good).select(*ids, hashed_fingerprint(tokens, bits).alias("_bits")).select(*ids, packed_bits("_bits", bits).alias("words"))
    rows = made.withColumn("on_bits", bits_on("words")).withColumn("density", F.col("on_bits") / bits)
    return rows, df.filter(~good).select(*ids, F.lit("invalid_or_missing_input").alias("reason"))


def similar_pairs(df: DataFrame, id_col: str, items: str, threshold: float) -> DataFrame:
    """Pairs a < b of sets with Jaccard similarity above the threshold.

    Items are ordered by rising frequency, those beyond a broadcast table of the frequent ones by hash alone; any order
    that all sets share gives the same pairs. Of two sets that are similar enough, the
    larger has one of its first n - ceil(t n) + 1 items among the smaller one's first
    n - ceil(2 t n / (1 + t)) + 1, so only those are joined. A joined row carries
    an item's place and a bitmap of parities for each set, no items: what is left
    behind the places bounds the overlap, and bits that differ bound the
    difference from below, so a pair that fails either bound goes while it is joined. For
    the pairs that stay the sets themselves decide, block by block.
    """
    t, spark = threshold, df.sparkSession
    sets = df.select(F.col(id_col).alias("id"), F.array_distinct(items).alias("items")).filter(F.size("items") > 0)
    hashed = sets.select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("h"))
    frequent = spark.sparkContext.broadcast(_frequent(hashed.select(F.explode("h").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("f"))))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, f = frequent.value
        for whole in batches:
            ends, at = np.cumsum(pc.list_value_length(whole["h"]).to_numpy()), 0
            while at < len(whole):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS_AT_ONCE, "right")))
                batch, at = whole.slice(at, to - at), to
                n, item = pc.list_value_length(batch["h"]).to_numpy().astype(np.int64), batch["h"].flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                odd = np.bincount(row * (64 * PARITY_WORDS) + (item >> 8) % (64 * PARITY_WORDS), minlength=len(n) * 64 * PARITY_WORDS) % 2
                bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                place = np.minimum(np.searchsorted(known, item), max(len(known) - 1, 0))
                rank = np.where(known[place] == item, f[place], 0) if len(known) else np.zeros(len(item), np.int64)
                by_rank = np.lexsort((item, rank, row))
                first = n - np.ceil(n * t).astype(np.int64) + 1
                kept = by_rank[np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(first, n)]
                first = np.minimum(first, n)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), pa.array(v)) for k, v in ((first, item[kept]), (np.full(len(n), PARITY_WORDS), bits))]
                yield pa.record_batch([batch["id"], pa.array(n, pa.int32()), *lists], ["id", "n", "o", "bits"])

    kind = sets.schema["id"].dataType.simpleString()
    ordered = shared_table(hashed.mapInArrow(order, f"id {kind}, n int, o array<long>, bits array<long>"))

    def keyed(side: str, first: Column) -> DataFrame:
        names = [F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "bits")]
        return ordered.select(*names, F.posexplode(F.slice("o", F.lit(1), first)).alias(f"at_{side}", "item"))

    left = keyed("x", F.size("o"))
    right = keyed("y", F.least(F.size("o"), F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - F.lit(1e-9)).cast("int") + 1))
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("id_y") < F.col("id_x")))
    both = F.col("n_x") + F.col("n_y")
    least = both * (t / (1 + t)) - 1e-9
    left_over = 1 + F.least(F.col("n_x") - F.col("at_x") - 1, F.col("n_y") - F.col("at_y") - 1)
    differ = sum(F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(PARITY_WORDS))
    near = (F.col("n_y") >= t * F.col("n_x")) & (left_over >= least) & (differ <= both - 2 * least)
    found = left.join(right, "item").filter(smaller & near)
    pairs = shared_table(found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct())
    return _similarities(sets, pairs).filter(F.col("similarity") > threshold)


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent items (column item) in order, FREQUENT_ITEMS at most, and their counts f; all others rank as equally rare."""
    counts = shared_table(counts.filter("f > 1"))
    step = F.floor(F.log2("f") * 4).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a few hundred rows
    low, total = 1 << 30, 0
    for s, n in sizes:
        if total + n > FREQUENT_ITEMS:
            break
        low, total = s, total + n
    rows = counts.filter(step >= low).toArrow().sort_by("item")
    return rows["item"].to_numpy(), rows["f"].to_numpy()


def _similarities(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and similarity of pairs of sets (id, items).

    The sets that pairs name are dealt to blocks by a hash, and pairs of blocks are compared in a task each, which gets a
    set once, however many pairs have it there; so what moves does not grow with the pairs of a set.
    """
    ids = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    n_ids = ids.count()
    n_blocks = max(8, -(-n_ids // BLOCK_SETS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    keyed = pairs.withColumn("key", F.least(block("a"), block("b")) * n_blocks + F.greatest(block("a"), block("b")))
    wanted = keyed.select("key", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("id").agg(F.collect_list("key").alias("keys"))
    needed = sets.join(F.broadcast(ids) if n_ids <= FREQUENT_ITEMS else ids, "id", "left_semi")
    sent = needed.join(wanted, "id").select(F.explode("keys").alias("key"), "id", "items")

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        items = sets["items"].combine_chunks()
        n = pc.list_value_length(items).to_numpy().astype(np.int64)
        code = pc.dictionary_encode(items.flatten(), null_encoding="encode").indices.to_numpy()
        ends, has = np.cumsum(n), np.zeros(int(code.max(initial=-1)) + 1, bool)
        # Places of both ends of each pair among the sets; pairs by their first.
        place = [pc.index_in(pairs[c].combine_chunks(), value_set=sets["id"].combine_chunks()).to_numpy() for c in "ab"]
        order = np.argsort(place[0], kind="stable")
        one, two = place[0][order], place[1][order]
        shared = np.zeros(len(order), np.int64)
        starts = np.flatnonzero(np.diff(one, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(one)], strict=True):
            own = code[ends[one[low]] - n[one[low]] : ends[one[low]]]
            has[own] = True
            others = two[low:high]
            shared[low:high] = [np.count_nonzero(has[code[e - k : e]]) for e, k in zip(ends[others].tolist(), n[others].tolist(), strict=True)]
            has[own] = False
        back = pairs.take(pa.array(order))
        return pa.table({"a": back["a"], "b": back["b"], "similarity": pa.array(shared / (n[one] + n[two] - shared))})

    kind = pairs.schema["a"].dataType.simpleString()
    return keyed.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def linkage_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, i, j) of average linkage of points: a chain of nearest neighbours is followed until two are each other's, so the work is quadratic.

    i and j stand for the clusters that hold them. Equal distances may join in either order.
    """
    sq = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    size, merges, chain = np.ones(len(x)), [], []
    live = np.ones(len(x), bool)
    while len(merges) < len(x) - 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        c = chain[-1]
        j = int(np.argmin(d[c]))
        if len(chain) > 1 and d[c, chain[-2]] <= d[c, j]:
            j = chain[-2]
            i, j = min(c, j), max(c, j)
            merges.append((float(d[i, j]), i, j))
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
            size[i], live[j] = size[i] + size[j], False
            chain = chain[:-2]
        else:
            chain.append(j)
    return sorted(merges)


def average_linkage(df: DataFrame, group: str, id_col: str, vector: str, cutoffs: Sequence[float], max_rows: int = 4000) -> DataFrame:
    """group, id, cutoff and cluster by average linkage cut at each distance; clusters by falling size, then smallest id.

    Groups of up to max_rows rows are clustered, each in one task. Larger ones are
    not brought together: their rows have a null cluster, as have rows without a
    vector. Rows of a null group are a group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col, ignore_index=True)
        merges = linkage_merges(np.stack(rows[vector].to_numpy()).astype(float))
        out = []
        for cut in cutoffs:
            of = np.arange(len(rows))
            for height, i, j in merges:
                if height <= cut:
                    a, b = sorted((of[i], of[j]))
                    of[of == b] = a
            names, counts = np.unique(of, return_counts=True)
            order = {n: r + 1 for r, (_, n) in enumerate(sorted(zip(-counts, names, strict=True)))}
            out.append(pd.DataFrame({group: rows[group], id_col: rows[id_col], "cutoff": cut, "cluster": [order[o] for o in of]}))
        return pd.concat(out)

    kinds = dict(df.dtypes)
    rows = df.select(group, id_col, vector)
    large = rows.filter(F.col(vector).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    large = shared_table(large)
    same = F.col(group).eqNullSafe(F.col("_g"))
    bounded = rows.filter(F.col(vector).isNotNull()).join(large, same, "left_anti")
    made = bounded.groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, cutoff double, cluster int")
    rest = rows.join(large, same, "left_semi").unionByName(rows.filter(F.col(vector).isNull()).join(large, same, "left_anti"))
    cuts = F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff")
    return made.unionByName(rest.select(group, id_col, cuts, F.lit(None).cast("int").alias("cluster")))


def principal_axis(df: DataFrame, group: str, x: str, y: str, z: str) -> DataFrame:
    """Centroid and direction of largest spread of each group's points, from six moments on Spark."""
    c = {"x": x, "y": y, "z": z}
    moments = [F.covar_pop(c[a], c[b]).alias(f"{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    rows = df.groupBy(group).agg(*[F.avg(c[a]).alias(f"c{a}") for a in "xyz"], *moments)

    def axes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.stack([f[["xx", "xy", "xz"]], f[["xy", "yy", "yz"]], f[["xz", "yz", "zz"]]], axis=1).astype(float)
            v = np.linalg.eigh(m)[1][:, :, -1] if len(f) else np.zeros((0, 3))
            yield f[[group, "cx", "cy", "cz"]].assign(ax=v[:, 0], ay=v[:, 1], az=v[:, 2])

    return rows.mapInPandas(axes, f"{group} {dict(df.dtypes)[group]}, cx double, cy double, cz double, ax double, ay double, az double")


def axis_angle(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Degrees between two axes that have no direction: the size of the cosine, held to [0, 1]."""
    dot = reduce(lambda a, b: a + b, [a * b for a, b in zip(left, right, strict=True)])
    return F.degrees(F.acos(F.least(F.greatest(F.abs(dot), F.lit(0.0)), F.lit(1.0))))


def bounding_box(df: DataFrame, group: str, axes: Sequence[str], spacing: float, padding: float, centre: str = "bbox") -> DataFrame:
    """For each group and axis a: a_low, a_high, a_centre (of the box or, with "centroid", of the points), a_extent and a_points (even, the grid that covers the padded extent)."""
    aggs = [x.alias(f"{a}_{n}") for a in axes for n, x in (("low", F.min(a)), ("high", F.max(a)), ("mean", F.avg(a)))]
    made = df.groupBy(group).agg(*aggs)
    cols = [F.col(group)]
    for a in axes:
        low, high = F.col(f"{a}_low"), F.col(f"{a}_high")
        middle = (low + high) / 2 if centre == "bbox" else F.col(f"{a}_mean")
        cols += [low, high, middle.alias(f"{a}_centre"), (high - low).alias(f"{a}_extent"), grid_size(high - low, spacing, padding).alias(f"{a}_points")]
    return made.select(*cols)


def expected_audit(metrics: DataFrame, expected: dict[tuple[str, str], float]) -> DataFrame:
    """section, metric, value, expected and matches (null where nothing is expected); expected is a written list."""
    wanted = F.lit(None).cast("double")
    for (section, metric), value in expected.items():
        wanted = F.when((F.col("section") == section) & (F.col("metric") == metric), float(value)).otherwise(wanted)
    checked = metrics.select("section", "metric", "value", wanted.alias("expected"))
    return checked.withColumn("matches", F.when(F.col("expected").isNotNull(), F.col("value").eqNullSafe(F.col("expected"))))
