"""Operators on whole tables: columns, joins with accounting, reshaping, windows, keys. All take and return DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.scalars import packed_bits
from quillon.sources.files import shared_table

#: Dimensions up to this many rows, which callers know or count, may be broadcast.
SMALL_ROWS = 100_000
#: Asked rows in an array.
ASKED_ROWS = 1024
#: Ids of asked rows, and of all rows, of a class in an array; their product is made at once.
MEMBERS = (32, 1024)
#: Tasks that make these products.
SPREAD_PARTS = 256


def snake_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def plain_name(name: str) -> str:
    return re.sub(r"[\s\-/().%]", "_", name.strip().lower())


def normalize_columns(df: DataFrame, rule: Callable[[str], str] = snake_name) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def ensure_columns(df: DataFrame, columns: Sequence[str], default: str | None = "") -> DataFrame:
    """df with absent columns added."""
    return df.withColumns({c: F.lit(default).cast("string") for c in columns if c not in df.columns})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def split_columns(df: DataFrame, metadata: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that describe a row, and all others."""
    return [c for c in df.columns if c in metadata], [c for c in df.columns if c not in metadata]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def repeat_flag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "is_repeat") -> DataFrame:
    """Flags all but the first row of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def shared_key_flag(df: DataFrame, keys: Sequence[str], name: str = "is_shared") -> DataFrame:
    """Flags every row of a key that several rows have."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def numbered_ids(df: DataFrame, order: Sequence[Column], pattern: str, name: str) -> DataFrame:
    """Dense ids from 1 in a total order, without one task that sorts all rows.

    Rows are range-partitioned and sorted; the number of rows in each partition,
    a table as long as there are partitions, gives what to add to the place in
    the partition. The result of the sort is kept so that both passes agree.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = parts.withColumns({"_part": F.shiftright(at, 33), "_pos": at.bitwiseAND(F.lit((1 << 33) - 1))})
    placed = shared_table(placed)
    counts = sorted(placed.groupBy("_part").count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    shifts = df.sparkSession.createDataFrame([(part, at) for (part, _), at in zip(counts, before, strict=False)], "_part long, _before long")
    # One row a partition, so its size is bounded by their number.
    placed = placed.join(F.broadcast(shifts), "_part")
    return placed.withColumn(name, F.format_string(pattern, F.col("_pos") + F.col("_before") + 1)).drop("_part", "_pos", "_before")


def numeric_order(column: str) -> list[Column]:
    """Numbers by value before other text."""
    n = F.col(column).cast("string").try_cast("bigint")
    return [n.isNull(), n, F.col(column)]


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], small: bool = False) -> DataFrame:
    """Left join; small: the dimension has a proven bound and is broadcast."""
    return df.join(F.broadcast(dim) if small else dim, list(on), "left")


def pair_lookup(pairs: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs (a, b) with the values of both sides, where both are known."""
    side = lambda s: dim.select(F.col(key).alias(s), F.col(value).alias(f"{value}_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def pair_lookup_with_reasons(pairs: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs with the values of both sides and `reason`, empty where both are known."""
    side = lambda s: dim.select(F.col(key).alias(s), F.col(value).alias(f"{value}_{s}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    why = [F.when(F.col(f"{value}_{s}").isNull(), f"missing_{s}") for s in "ab"]
    return joined.withColumn("reason", F.array_join(F.array_compact(F.array(*why)), ";"))


def pairs_in_groups(df: DataFrame, group: Sequence[str], id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs a < b of each group, for groups of bounded size."""
    side = lambda s: df.select(*group, F.col(id_col).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in carry])
    return side("a").join(side("b"), list(group)).filter("a < b")


def pairs_with_asked(df: DataFrame, asked: Column | str, group: Sequence[str], id_col: str, carry: Sequence[str] = (), parts: int = 32) -> DataFrame:
    """Each row that the condition `asked` names (a) with every other row of its group (b), for groups of any size.

    The rows of a group are dealt to `parts` tasks and the asked ones, which should be few, go to each of them. Without
    groups the asked rows go there in arrays of about ASKED_ROWS, and a row that meets an array is spread over it.
    """
    side = lambda rows, s, part: rows.select(*group, F.col(id_col).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in carry], part.alias("_part"))
    queries = side(df.filter(asked), "a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = side(df, "b", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"))
    if not group:
        own, others = ([c for c in side(df, s, F.lit(0)).columns if c != "_part"] for s in "ab")
        few = df.filter(asked)
        n_blocks = max(1, -(-few.count() // ASKED_ROWS))
        packed = side(few, "a", F.pmod(F.xxhash64(id_col), F.lit(n_blocks))).groupBy("_part").agg(F.collect_list(F.struct(*own)).alias("_asked"))
        packed = packed.select("_asked", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        met = rows.repartition(parts, "_part").join(packed.hint("shuffle_hash"), "_part").select(F.inline("_asked"), *others)
        return met.filter("a <> b")
    return queries.join(rows, [*group, "_part"]).filter("a <> b").drop("_part")


def pairs_by_class(df: DataFrame, asked: str, id_col: str, by: Sequence[str], judge: Callable[[DataFrame], DataFrame], parts: int = 32) -> DataFrame:
    """Pairs a, b as of pairs_with_asked (no groups) that `judge` keeps, with the columns it adds, where nothing of a row but its columns `by` counts.

    Rows that agree in these are a class. `judge` gets pairs of classes, each with itself among them, by the columns
    of `by` with _a and _b, and is to keep _class_a, _class_b and _n_b; what it keeps is spread over the rows of both classes,
    whose ids are joined in arrays of MEMBERS at most (on average), so a class of any size is dealt to many tasks.
    """
    rows = shared_table(df.select(F.col(id_col).alias("_id"), *by, F.coalesce(F.expr(asked), F.lit(False)).alias("_asked")).filter("_id is not null"))
    counts = [F.count(F.lit(1)).alias("_n"), F.count_if("_asked").alias("_few")]
    classes = shared_table(rows.groupBy(*by).agg(*counts).withColumn("_class", F.monotonically_increasing_id()))
    carry = [*by, "_n"]
    with_itself = classes.filter("_few > 0").select(*[F.col(c).alias(n) for s in "ab" for c, n in [("_class", s), *[(c, f"{c}_{s}") for c in carry]]])
    met = pairs_with_asked(classes, "_few > 0", [], "_class", carry, parts).unionByName(with_itself)
    kept = judge(met.withColumnsRenamed({"a": "_class_a", "b": "_class_b"}).drop("_n_a"))
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by])
    rows = rows.alias("r").join(classes.alias("c"), same).select("_id", "_asked", "_class", "_n", "_few")

    def arrays(rows: DataFrame, n: str, size: int, side: str) -> DataFrame:
        block = F.pmod(F.xxhash64("_id"), F.ceil(F.col(n) / size)).alias("_block")
        return rows.groupBy(F.col("_class").alias(f"_class_{side}"), block).agg(F.collect_list("_id").alias(f"_{side}"))

    few = arrays(rows.filter("_asked"), "_few", MEMBERS[0], "a").drop("_block")
    spread = kept.join(few, "_class_a").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n_b") / MEMBERS[1]) - 1)))
    spread = spread.repartition(SPREAD_PARTS, "_class_b", "_block")  # a number, so that small tables of many pairs aren't brought together
    met = spread.join(arrays(rows, "_n", MEMBERS[1], "b"), ["_class_b", "_block"])
    more = [c for c in kept.columns if c not in ("_class_a", "_class_b", "_n_b")]
    return met.select(F.explode("_a").alias("a"), "_b", *more).select("a", F.explode("_b").alias("b"), *more).filter("a <> b")


def overlapping_with_asked(df: DataFrame, asked: str, id_col: str, bits: str, width: int, parts: int = 8) -> DataFrame:
    """a, b, shared and either (places that both sets have, and that one of them has) of each row that `asked` names with every other row whose set shares a place.

    Sets are arrays of places from 0 up to below `width`. Rows meet by place, so pairs without a common one are not made; a pair is taken at
    its least common place. The rows of a place are dealt to `parts` tasks and the asked ones, which should be few, go to each of them.
    """
    words = [F.coalesce(F.get("_words", F.lit(i)), F.lit(0).cast("long")) for i in range(width // 64)]
    packed = df.select(F.col(id_col).alias("_id"), F.array_distinct(bits).alias("_bits"), packed_bits(bits, width).alias("_words"), F.expr(asked).alias("_asked"))
    side = lambda rows, s: rows.select("_id", F.size("_bits").alias(f"_n{s}"), *[w.alias(f"_{s}{i}") for i, w in enumerate(words)], F.explode("_bits").alias("_bit")).withColumnRenamed("_id", s)
    few = side(packed.filter("_asked"), "a").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = side(packed, "b").withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    met = rows.repartition(SPREAD_PARTS, "_bit", "_part").join(few.hint("shuffle_hash"), ["_bit", "_part"]).filter("a <> b")
    both = [F.col(f"_a{i}").bitwiseAND(F.col(f"_b{i}")) for i in range(width // 64)]
    shared = reduce(Column.__add__, map(F.bit_count, both))
    # Of a word the bits below its lowest one; words without any are passed over.
    below = lambda w: F.bitwise_not(w).bitwiseAND(F.coalesce(F.try_subtract(w, F.lit(1)), F.lit((1 << 63) - 1)))
    least = F.coalesce(*[F.when(w != 0, 64 * i + F.bit_count(below(w))) for i, w in enumerate(both)])
    found = met.withColumn("shared", shared).filter((F.col("shared") == 1) | (least == F.col("_bit")))
    return found.select("a", "b", "shared", (F.col("_na") + F.col("_nb") - F.col("shared")).alias("either"))


def cell_diff(left: DataFrame, right: DataFrame, key: str, absent: str = "<absent>") -> DataFrame:
    """row, col, left and right of each cell that differs; numbers without a fraction read as integers, trailing blanks don't count."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        text = lambda c: F.rtrim(F.regexp_replace(F.col(c).cast("string"), r"^(-?\d+)\.0+$", "$1"))
        wide = df.select(F.col(key).cast("string").alias("row"), *[F.coalesce(text(c), F.lit("")).alias(c) for c in df.columns if c != key])
        return wide.unpivot("row", [c for c in wide.columns if c != "row"], "col", name)

    joined = cells(left, "left_value").join(cells(right, "right_value"), ["row", "col"], "full_outer")
    shown = joined.withColumns({c: F.coalesce(c, F.lit(absent)) for c in ("left_value", "right_value")})
    return shown.filter("left_value <> right_value")


def reconcile(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are required, with status PRESENT or MISSING."""
    have = present.select(*keys).distinct().withColumn("_have", F.lit(True))
    return required.select(*keys).distinct().join(have, list(keys), "left").select(*keys, F.when(F.col("_have"), "PRESENT").otherwise("MISSING").alias("status"))


def unaccounted(eligible: DataFrame, *documented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eligible keys that none of the documented tables holds."""
    out = eligible.select(*keys).distinct()
    for table in documented:
        out = out.join(table.select(*keys), list(keys), "left_anti")
    return out


def merge_last(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    others = [F.col(c).desc_nulls_last() for c in old.columns if c not in keys]
    return first_per_key(both, keys, [F.desc("_age"), *others]).drop("_age")


def roles_to_rows(df: DataFrame, keys: Sequence[str], roles: dict[str, str]) -> DataFrame:
    """One row for each role and its column."""
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("value")) for r, c in roles.items()])
    return df.select(*keys, F.inline(rows))


def top_k_wide(df: DataFrame, entity: str, label: str, value: str, k: int = 5) -> DataFrame:
    """For each entity its k labels of largest positive value, in columns; entities without any keep an empty row."""
    w = Window.partitionBy(entity).orderBy(F.col(value).desc(), F.col(label))
    best = df.filter(F.col(value) > 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    cells = [F.max(F.when(F.col("_n") == i, F.col(c))).alias(f"top{i}_{n}") for i in range(1, k + 1) for n, c in (("label", label), ("value", value))]
    return df.select(entity).distinct().join(best.groupBy(entity).agg(*cells), entity, "left")


def rule_issues(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("issue"))


def failure_log(tables: dict[str, DataFrame]) -> DataFrame:
    """stage and details ("k=v | k=v") of rows of different tables."""
    out = None
    for stage, df in tables.items():
        cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
        rows = df.select(F.lit(stage).alias("stage"), F.concat_ws(" | ", *cells).alias("details"))
        out = rows if out is None else out.unionByName(rows)
    return out


def priority_dedup(df: DataFrame, keys: Sequence[str], priority: Sequence[Column], answer: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The best row of each key, and the other rows with a reason.

    If the rows that tie for the best disagree on the answer, all rows of the key are excluded.
    """
    tie = Window.partitionBy(*keys).orderBy(*priority)
    whole = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rank": F.rank().over(tie), "_n": F.row_number().over(Window.partitionBy(*keys).orderBy(*priority, *order))})
    answers = F.size(F.collect_set(F.when(F.col("_rank") == 1, F.to_json(F.struct(*answer), {"ignoreNullFields": "false"}))).over(whole))
    judged = ranked.withColumn("_answers", answers)
    reason = F.when(F.col("_answers") > 1, "conflicting_top_rows").when(F.col("_n") > 1, "lower_priority")
    judged = judged.withColumn("exclusion_reason", reason).drop("_rank", "_n", "_answers")
    return judged.filter("exclusion_reason is null").drop("exclusion_reason"), judged.filter("exclusion_reason is not null")


def preferred_only(df: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """If any row has the preferred value only those stay; the rest is the second table."""
    any_ = df.agg(F.coalesce(F.bool_or(F.col(column) == value), F.lit(False)).alias("_any"))  # one row
    flagged = df.crossJoin(F.broadcast(any_)).withColumn("_out", F.col("_any") & ~F.coalesce(F.col(column) == value, F.lit(False)))
    return flagged.filter("not _out").drop("_any", "_out"), flagged.filter("_out").drop("_any", "_out")


def redact(df: DataFrame, pattern: str, by: str = "[redacted]") -> DataFrame:
    """All text columns with what matches the pattern replaced."""
    return df.withColumns({c: F.regexp_replace(c, pattern, by) for c, t in df.dtypes if t == "string"})
