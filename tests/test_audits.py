"""Rules of the audit operators on rows with nulls, ties, repeats and no rows."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import audits as A
from quillon.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_modal_value_of_ties_is_that_of_the_least_name(spark):
    df = spark.createDataFrame([("b", ["x"]), ("a", ["y"]), ("c", None)], "f string, c array<string>")
    assert rows(A.modal_value_deviations(df, "f", "c"), "f") == [("b",), ("c",)]
    assert rows(A.modal_value_deviations(df.limit(0), "f", "c")) == []


def test_table_profile(spark):
    df = spark.createDataFrame([(1, " ", None), (1, "a", 1), (None, None, 1)], "k int, s string, v int")
    found = dict(rows(A.table_profile(df, ["k", "v"], top=2)))
    assert found == {"rows": 3, "columns": 3, "missing:total": 4, "missing:s": 2, "missing:k": 1, "repeats:k": 1, "repeats:v": 1, "repeats:first_two": 0}
    assert dict(rows(A.table_profile(df.limit(0), ["k"])))["rows"] == 0


def test_split_summary(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", " "), ("b", None)], "part string, k string")
    assert rows(A.split_summary(df, "part", "k"), "part", "n_rows", "n_unique", "n_missing", "n_repeated") == [("a", 3, 1, 1, 1), ("b", 1, 0, 1, 0)]


def test_cluster_summary(spark):
    df = spark.createDataFrame([(1, 1, 7, 0.5, 2.0), (1, 1, 5, 0.5, 2.0), (1, 2, 9, None, None)], "g int, c int, id int, e double, d double")
    found = {r["c"]: r for r in A.cluster_summary(df, "g", "c", "id", "e", "d").collect()}
    assert (found[1]["medoid"], found[1]["lowest_energy"], found[1]["energy_sd"], round(found[1]["fraction"], 6)) == (5, 5, 0.0, 0.666667)
    assert (found[2]["medoid"], found[2]["energy_mean"]) == (None, None)


def test_recheck_and_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.1), (None, None), (1.0, None)], "a double, b double")
    assert [r["agrees"] for r in A.recheck(df, F.col("a"), F.col("b")).collect()] == [True, False, True, False]
    assert rows(A.missing_counts(df)) == [(4, 2, 2)]
    assert rows(A.missing_counts(df.limit(0))) == [(0, 0, 0)]


def test_features(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, "train"), (2.0, 5.0, 1.0, "test")], "a double, b double, c double, part string")
    assert rows(A.feature_ranking(df, ["a", "b", "c"]), "rank", "feature", "is_constant") == [(1, "a", False), (2, "b", True), (3, "c", True)]
    assert A.training_rows(df, "part").count() == 1 and A.training_rows(df, allow_global=True).count() == 2
    with pytest.raises(ValueError, match="leak"):
        A.training_rows(df)
    assert rows(A.name_coverage(df, ["a", "z"])) == [("a", True), ("z", False)]


def test_leakage(spark):
    left = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "k string")
    assert rows(A.leakage_summary(left, left.limit(0), ["k"])) == [("k", 1, 0, 0)]
    assert rows(A.leakage_summary(left, left, ["k"])) == [("k", 1, 1, 1)]


def test_status_rules(spark):
    df = spark.createDataFrame([("ok", "/home/x"), (None, None), ("bad", "fine")], "s string, p string")
    good, issues = A.split_by_status(df, "s", ["ok"])
    assert rows(good, "s") == [("ok",)] and issues.count() == 2
    assert rows(A.blank_local_paths(df), "p") == [("",), ("fine",), (None,)]
    over = A.override_status(df, "PASS", [(F.col("s") == "bad", "WARNING", "bad"), (F.col("p") == "fine", "FAIL", "path")])
    assert rows(over, "s", "status", "reason") == [("bad", "FAIL", "bad; path"), ("ok", "PASS", ""), (None, "PASS", "")]


def test_far_groups(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 50.0), ("c", None)], "g string, x double")
    near, far = A.far_groups(df, "g", ["x"], [0.0])
    assert rows(near, "g", "distance") == [("a", 1.0)] and rows(far, "g") == [("b",), ("c",)]


def test_alignment_and_links(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, id string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "i int, id string")
    assert rows(A.misaligned(a, b, "i", "id")) == [(2, "y", "z"), (3, None, "w")]
    chosen = spark.createDataFrame([("m", "pose", "1"), ("m", "log", "2"), ("n", "pose", None)], "name string, kind string, sha256 string")
    have = spark.createDataFrame([("m", "pose", "9"), ("n", "pose", None)], "name string, kind string, sha256 string")
    found = rows(A.link_files(chosen, have, ["pose", "log"]))
    assert found == [("m", "log", "missing_file"), ("m", "pose", "hash_mismatch"), ("n", "log", "missing_kind"), ("n", "pose", None)]


def test_pseudonyms(spark):
    out, names = A.pseudonyms(spark.createDataFrame([(1, "zoe"), (2, "ann"), (3, None)], "i int, who string"), "who")
    assert rows(out) == [(1, "Assessor_02"), (2, "Assessor_01"), (3, None)]
    assert rows(names) == [("ann", "Assessor_01"), ("zoe", "Assessor_02")]


def test_csv_versions_stay(spark, tmp_path):
    first = files.write_csv(spark.range(1), str(tmp_path / "t"))
    second = files.write_csv(spark.range(2), str(tmp_path / "t"))
    assert first < second and spark.read.csv(first, header=True).count() == 1 and spark.read.csv(second, header=True).count() == 2


def test_tsv_keeps_quotes_and_blanks(spark, tmp_path):
    texts = ['say "x"', "back\\slash\\", ' lead and trail ', '"', "a\tb\r\nc", "", None]
    files.write_tsv(spark.createDataFrame(list(enumerate(texts)), "i int, s string"), str(tmp_path / "t"), ["i", "s"])
    back = dict(rows(files.read_tsv(spark, str(tmp_path / "t"), "i int, s string")))
    assert [back[i] for i in range(7)] == ['say "x"', "back\\slash\\", " lead and trail ", '"', "a b  c", None, None]
