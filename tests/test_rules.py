"""Rules on rows that hit each branch: blanks, nulls, ties, conflicts, bad formats, ragged files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import scalars as S
from quillon.operators import measures as M
from quillon.operators import tables as T
from quillon.sources import files


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_identifiers(spark):
    rows = ["50-00-0", "50-00-1", "5-00-0", "", None, "107-02-8", "64-17-5"]
    assert values(spark, rows, S.check_digit_ok) == [True, False, False, False, False, True, True]
    assert values(spark, [" 50-00 -0 "], S.clean_identifier) == ["50-00-0"]


def test_label_lists(spark):
    rows = ["['A','b']", "('a','b')", "a;b|c, A", "[]", None, " ", "x", "('a',)"]
    assert values(spark, rows, S.parse_labels) == [["a", "b"], ["a", "b"], ["a", "b", "c", "a"], [], [], [], ["x"], ["a"]]


def test_label_scores(spark):
    rows = ["x+1.5", "a+b+2", "x", "+3", "x+?", None, " "]
    got = [tuple(v) for v in values(spark, rows, S.parse_label_score)]
    assert got == [
        ("x", 1.5, "ok"), ("a+b", 2.0, "ok"), ("x", None, "label_without_score"), (None, 3.0, "missing_label"),
        ("x", None, "score_parse_failed"), (None, None, "missing"), (None, None, "empty"),
    ]


def test_numbers_and_words(spark):
    assert values(spark, ["1", "NaN", "x", "", None, " 2.5 "], S.safe_double) == [1.0, None, None, None, None, 2.5]
    # Words that only look like answers are neither.
    words = ["y", "t", "response", "positive", "n", "f", "no response", "negative", "moderate", "nd", "N/A", "untested"]
    assert values(spark, words, S.parse_response) == [None] * len(words)
    assert values(spark, ["Active ", "NON-responsive", "inactive", "1.00", "0e0"], S.parse_response) == [True, False, False, True, False]
    assert values(spark, ["High", " medium", "low", "moderate", "", None], S.level_rank) == [3, 2, 1, 0, 0, 0]
    assert values(spark, ["Yes", "0.0", "1", "no", "2", "", None], S.parse_response) == [True, False, True, False, None, None, None]
    assert values(spark, [1.0, float("inf"), float("nan"), None], S.finite, "double") == [1.0, None, None, None]
    assert values(spark, ["combo12", "combo", "x12", None], lambda x: S.trailing_number(x, "combo")) == [12, None, None, None]
    assert [v and v["number"] for v in values(spark, ["h:A:SER:1:2", "h:A:SER", None], S.feature_parts)] == ["1:2", None, None]


def test_jaccard_conventions(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "a"], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [r["j"] for r in df.select(S.jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got == [None, 0.0, 1.0, pytest.approx(1 / 3)]
    assert df.select(S.jaccard(F.col("a"), F.col("b"), 1.0).alias("j")).first()["j"] == 1.0
    typed = spark.createDataFrame([(["h:A:S:1", "p:A:S:2"], ["h:A:S:1", "q:A:S:2"])], "a array<string>, b array<string>")
    assert typed.select(S.typed_jaccard(F.col("a"), F.col("b"), ["p", "q"]).alias("j")).first()["j"] == 1.0


def test_concordance_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (4, 2), (5, 2)], "n int, d int")
    got = [r["c"] for r in df.select(S.concordance_class(F.col("n"), F.col("d")).alias("c")).collect()]
    assert got == ["insufficient_data", "insufficient_data", "concordant", "divergent", "indeterminate"]


def test_distance_over_permutations(spark):
    a = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    df = spark.createDataFrame([(a, a[::-1], [[0, 1], [1, 0]])], "a array<struct<x:double,y:double,z:double>>, b array<struct<x:double,y:double,z:double>>, p array<array<int>>")
    assert df.select(S.fixed_frame_rmsd(F.col("a"), F.col("b"), F.col("p")).alias("d")).first()["d"] == 0.0


def test_priority_dedup_keeps_excludes_and_logs(spark):
    rows = [("one", 1, "x", 0), ("win", 2, "x", 1), ("win", 1, "y", 2), ("agree", 2, "x", 3), ("agree", 2, "x", 4), ("clash", 2, "x", 5), ("clash", 2, "y", 6), ("clash", 1, "x", 7), ("null", 1, None, 8), ("null", 1, "x", 9)]
    df = spark.createDataFrame(rows, "k string, p int, v string, row int")
    kept, out = T.priority_dedup(df, ["k"], [F.desc("p")], ["v"], [F.col("row")])
    assert sorted((r["k"], r["row"]) for r in kept.collect()) == [("agree", 3), ("one", 0), ("win", 1)]
    assert sorted((r["k"], r["row"], r["exclusion_reason"]) for r in out.collect()) == [
        ("agree", 4, "lower_priority"), ("clash", 5, "conflicting_top_rows"), ("clash", 6, "conflicting_top_rows"), ("clash", 7, "conflicting_top_rows"),
        ("null", 8, "conflicting_top_rows"), ("null", 9, "conflicting_top_rows"), ("win", 2, "lower_priority"),
    ]


def test_preferred_only_without_the_value_keeps_all(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert T.preferred_only(df, "s", "z")[0].count() == 2 and T.preferred_only(df, "s", "a")[1].count() == 1


def test_numbered_ids_and_numeric_order(spark):
    df = spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "v string").repartition(3)
    got = T.numbered_ids(df, T.numeric_order("v"), "PAIR_%04d", "id").collect()
    assert {r["v"]: r["id"] for r in got} == {"9": "PAIR_0001", "10": "PAIR_0002", "a": "PAIR_0003", "b": "PAIR_0004"}
    assert T.numbered_ids(df.limit(0), [F.col("v")], "%d", "id").count() == 0


def test_summary_of_missing_and_single_ratings(spark):
    df = spark.createDataFrame([("e", "a", None), ("e", "b", 2.0), ("e", "c", 0.0), ("e", "c", 1.0)], "k string, l string, v double")
    got = {r["l"]: r for r in M.rating_summary(df, ["k", "l"], "v").collect()}
    assert got["a"]["n_raters"] == 0 and got["a"]["share_chosen"] is None and got["b"]["sd_value"] is None and got["c"]["share_chosen"] == 0.5


def test_clusters_of_groups(spark):
    rows = [("g", i, [float(x)]) for i, x in enumerate((0, 1, 10, 11, 12))] + [("h", 9, [0.0])]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    got = {(r["g"], r["i"], r["cutoff"]): r["cluster"] for r in M.average_linkage(df, "g", "i", "v", [2.0, 50.0]).collect()}
    assert [got["g", i, 2.0] for i in range(5)] == [2, 2, 1, 1, 1] and got["h", 9, 2.0] == 1 and {got["g", i, 50.0] for i in range(5)} == {1}
    bounded = {(r["g"], r["i"]): r["cluster"] for r in M.average_linkage(df, "g", "i", "v", [1.0], max_rows=3).collect()}
    assert bounded == {**{("g", i): None for i in range(5)}, ("h", 9): 1}  # a group beyond the bound is not brought together


def test_features_need_training_rows_that_vary(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    with pytest.raises(ValueError):
        M.usable_features(df, ["x"])


def test_principal_axis(spark):
    df = spark.createDataFrame([("g", float(i), 2.0 * i, 0.0) for i in range(5)], "g string, x double, y double, z double")
    r = M.principal_axis(df, "g", "x", "y", "z").first()
    assert (r["cx"], r["cy"]) == (2.0, 4.0) and abs(r["ay"] / r["ax"]) == pytest.approx(2)


def test_fingerprint_and_markup(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "t array<string>")
    bits = df.select(M.hashed_fingerprint(F.col("t")).alias("b")).first()["b"]
    assert len(bits) == 2 and bits == sorted(bits)
    docs = spark.createDataFrame([(1, "<r><hb>x</hb><pi>y</pi><hb>z</hb></r>")], "i int, xml string")
    got = files.xml_events(docs, "xml", {"hb": "hydrogen_bond", "pi": "stacking"}).collect()
    assert sorted((r["type"], r["value"]) for r in got) == [("hydrogen_bond", "x"), ("hydrogen_bond", "z"), ("stacking", "y")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.csv").write_bytes("﻿k,v\n1,é\n".encode())
    (tmp_path / "in/b.csv").write_bytes("k,v\n2,é\n".encode("latin1"))
    (tmp_path / "in/c.bin").write_bytes(b"\0\1")
    inventory = files.file_inventory(spark, str(tmp_path / "in"))
    assert {r["name"]: r["encoding"] for r in inventory.collect()} == {"A.csv": "utf-8", "b.csv": "latin1", "c.bin": None}
    texts = {r["path"].rpartition("/")[2]: (r["encoding"], r["text"]) for r in files.decode_files(spark, str(tmp_path / "in")).collect()}
    assert texts["A.csv"] == ("utf-8", "k,v\n1,é\n")
    wanted = spark.createDataFrame([("a.CSV",), ("nope",)], "key string")
    assert {r["key"]: r["status"] for r in files.unique_matches(inventory, wanted).collect()} == {"a.CSV": "ok", "nope": "missing"}
    assert files.read_tsv(spark, str(tmp_path / "absent"), "a int").count() == 0
    (tmp_path / "rag.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    good, bad = files.read_csv_checked(spark, str(tmp_path / "rag.csv"), StructType.fromDDL("a int, b int"))
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and bad.count() == 2
    keyed = files.stem_keyed(spark, str(tmp_path / "in/A.csv"), "k int, v string")
    assert [tuple(r) for r in keyed.collect()] == [("A", 1, "é")]
    files.write_tsv(spark.createDataFrame([("x\ty", 1, "no")], "a string, b int, c string"), str(tmp_path / "out"), ["a", "b"])
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "out"), "a string, b int").collect()] == [("x y", 1)]
    files.write_bundle({"t" * 40: good}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle" / ("t" * 31))).count() == 1


def test_log_blocks(spark):
    text = ["noise", "MODEL", "E= -1.5", "ATOM", "MODEL", "ATOM", "MODEL", "E= 1", "E= 2", "ATOM", "MODEL", "E= 3"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "f string, n int, t string")
    good, bad = files.block_table(lines, "f", "n", "t", "^MODEL", r"^E= *(\S+)", "^ATOM")
    assert [(r["block"], r["value"]) for r in good.collect()] == [(1, -1.5)]
    assert sorted((r["block"], r["reason"]) for r in bad.collect()) == [(2, "values"), (3, "values"), (4, "no_items")]
    head = spark.createDataFrame([("f", 0, "x"), ("f", 1, "b, a"), ("f", 2, "a,b")], "f string, n int, t string")
    assert files.header_rows(head, "t", "f", "n", ["a", "b"]).first()["header_line"] == 1
