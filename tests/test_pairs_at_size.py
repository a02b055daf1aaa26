"""Pairs of asked rows with all others, without work that grows faster than the pairs that are returned."""

import itertools

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import measures as M
from quillon.operators import tables as T
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bit_similarity_is_compiled_and_not_rounded_through_text(spark):
    text = plan(registry.QUERIES["f14_tanimoto"](spark, SF))
    assert "lambda" not in text and "round(" not in text and "SortMergeJoin" not in text


def test_shares_are_rounded_as_round_does(spark):
    rows = spark.range(0, 1300).select(F.col("id").alias("w")).crossJoin(spark.range(0, 1300, 7).select(F.col("id").alias("p"))).filter("p <= w")
    both = rows.select(S.rounded_share(F.col("p"), F.col("w")).alias("x"), F.round(F.try_divide("p", "w"), 6).alias("y"))
    assert both.filter("not (x <=> y)").isEmpty()


def test_several_arrays_of_asked_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "ASKED_ROWS", 3)
    df = spark.range(0, 900).select("id", (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(None, 1), (50, None)], "id long, v long"))
    got = [tuple(r) for r in T.pairs_with_asked(df, "id % 50 = 0", [], "id", ["v"], parts=5).select("a", "b", "v_a", "v_b").collect()]
    rows = [tuple(r) for r in df.collect() if r["id"] is not None]
    want = [(a, b, va, vb) for a, va in rows for b, vb in rows if a % 50 == 0 and a != b]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_only_classes_are_judged_and_all_their_rows_are_paired(spark, monkeypatch):
    monkeypatch.setattr(T, "MEMBERS", (3, 40))
    df = spark.range(0, 900).select("id", F.when(F.col("id") % 7 > 0, F.array(F.col("id") % 7 % 3)).alias("x"), (F.col("id") % 2 > 0).alias("odd"))
    seen = []

    def judge(pairs):
        seen.append(pairs.count())
        kept = F.coalesce(F.get("x_a", F.lit(0)), F.lit(1)) == F.coalesce(F.get("x_b", F.lit(0)), F.lit(1))
        return pairs.filter(kept).select("_class_a", "_class_b", "_n_b", (F.col("odd_a") | F.col("odd_b")).alias("any"))

    got = sorted(tuple(r) for r in T.pairs_by_class(df, "id % 50 = 0", "id", ["x", "odd"], judge).select("a", "b", "any").collect())
    rows = [(r["id"], r["x"][0] if r["x"] is not None else 1, r["odd"]) for r in df.collect()]
    assert got == sorted((a, b, p or q) for a, x, p in rows for b, y, q in rows if a % 50 == 0 and a != b and x == y)
    assert seen[0] <= 8 * 8


def test_sets_meet_by_their_places_and_each_pair_once(spark):
    places = F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.pmod(F.xxhash64("id", i), F.lit(40)).cast("int") * 3)
    df = spark.range(0, 500).select("id", F.when(F.col("id") % 9 > 0, F.concat(places, F.slice(places, 1, 1))).alias("x"))
    df = df.union(spark.createDataFrame([(1000, [63, 64, 127]), (1001, [127, 63]), (1002, [127]), (None, [127])], "id long, x array<int>"))
    got = sorted(tuple(r) for r in T.overlapping_with_asked(df, "id % 50 = 0", "id", "x", 128, parts=3).select("a", "b", "shared", "either").collect())
    rows = [(r["id"], set(r["x"] or [])) for r in df.collect() if r["id"] is not None]
    assert got == sorted((a, b, len(x & y), len(x | y)) for a, x in rows for b, y in rows if a % 50 == 0 and a != b and x & y)


def test_packed_sets_that_share_nothing_are_not_paired(spark):
    text = plan(registry.QUERIES["m1_f14_packed_tanimoto"](spark, SF))
    assert "_bit" in text.split("ShuffledHashJoin")[1].split("\n")[0]


def test_sets_move_once_for_all_their_pairs(spark, monkeypatch):
    """Near copies of one set, items beyond the frequent ones, several blocks; a set's items are not joined to its pairs."""
    monkeypatch.setattr(M, "FREQUENT_ITEMS", 5)
    monkeypatch.setattr(M, "BLOCK_SETS", 7)
    monkeypatch.setattr(M, "ITEMS_AT_ONCE", 50)
    sets = {i: {*range(40)} - {i % 13} | {100 + i % 7} for i in range(90)} | {i: {*range(i % 30 + 1)} for i in range(200, 260)}
    df = spark.createDataFrame([(i, [str(x) for x in s] + [None] * (i % 2)) for i, s in sets.items()], "id long, x array<string>")
    full = {i: s | ({None} if i % 2 else set()) for i, s in sets.items()}
    want = {(a, b): len(full[a] & full[b]) / len(full[a] | full[b]) for a, b in itertools.combinations(sorted(full), 2)}
    pairs = M.similar_pairs(df, "id", "x", 0.8)
    assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == {p: s for p, s in want.items() if s > 0.8}
    assert "FlatMapCoGroupsInArrow" in plan(pairs)
