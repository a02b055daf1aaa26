"""Check suites, feature tables, evaluation, scans and split tables on rows with nulls, ties, repeats and no rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import audits as A
from quillon.operators import checks as C
from quillon.operators import evaluation as E
from quillon.operators import measures as M
from quillon.operators import splits as P
from quillon.operators import summaries as Y
from quillon.sources import files, scans


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# checks


def suite_of_three():
    suite = C.CheckSuite()
    suite.measure("no nulls", "t", "none", lambda r: r.n == 0, n=F.count_if(F.col("k").isNull()))
    suite.measure("sum is known", "t", "six", lambda r: r.s == 6, s=F.sum("k"))
    suite.measure("gone", "t", "never", lambda r: True, n=F.max("gone"))
    return suite


def test_suite_gives_a_row_for_everything(spark):
    suite = suite_of_three()
    suite.measure("raises on the data", "t", "never", lambda r: True, n=F.max(F.col("s").cast("int")))
    suite.measure("raises in the judgement", "t", "never", lambda r: 1 / 0 > 0, n=F.count(F.lit(1)))
    suite.measure("no table", "u", "never", lambda r: True, n=F.count(F.lit(1)))
    suite.rule("two rows", "t", "one")(lambda tables: tables["t"].select(F.lit(True).alias("holds")))
    suite.rule("raises", "t", "one")(lambda tables: tables["absent"])
    df = spark.createDataFrame([(1, "x"), (5, "2")], "k int, s string")
    got = {r["check"]: r for r in suite.run({"t": df}).collect()}
    assert [got[n]["status"] for n in ("no nulls", "sum is known", "gone", "raises on the data", "raises in the judgement", "no table", "two rows", "raises")] == ["PASS", "PASS", *["ERROR"] * 6]
    assert got["sum is known"]["observed"] == "s=6" and got["raises on the data"]["message"] == "CAST_INVALID_INPUT" and "KeyError" in got["no table"]["message"]
    with pytest.raises(ValueError, match="already"):
        suite.measure("gone", "t", "", lambda r: True, n=F.count(F.lit(1)))
    empty = {r["check"]: r["status"] for r in suite_of_three().run({"t": df.limit(0)}).collect()}
    assert empty == {"no nulls": "PASS", "sum is known": "FAIL", "gone": "ERROR"}


def test_watched_table_is_scanned_by_its_writer_alone(spark, tmp_path):
    suite, seen = suite_of_three(), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1,), (5,), (None,)], "k int").repartition(2).mapInArrow(count, "k int")
    watched = suite.watch("t", df)
    watched.write.parquet(f"{tmp_path}/out")
    got = {r["check"]: (r["status"], r["observed"]) for r in suite.run({"t": df}).collect()}
    assert got == {"no nulls": ("FAIL", "n=1"), "sum is known": ("PASS", "s=6"), "gone": ("ERROR", "")} and seen.value == 3


def test_fused_checks_share_a_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    suite = C.CheckSuite()
    for i in range(5):
        suite.measure(f"c{i}", "t", "", lambda r: r.n == 4, n=F.count(F.lit(1)))
    assert {r["status"] for r in suite.run({"t": spark.range(4).mapInArrow(count, "id long")}).collect()} == {"PASS"} and seen.value == 4


def test_feature_table(spark):
    df = spark.createDataFrame([(1, 4.0, "2"), (2, 0.0, "x"), (3, None, None), (4, 1.0, "Infinity"), (5, 1.0, "NaN"), (None, 2.0, "1")], "id int, a double, s string")
    made, report, bad = C.feature_table(df, ["id"], {"inverse": F.try_divide(F.lit(1.0), "a"), "number": F.col("s").try_cast("double"), "odd name": F.lit(None).cast("double")}, F.col("id").isNotNull())
    assert rows(made, "id", "inverse", "number") == sorted([(1, 0.25, 2.0), (2, None, None), (3, None, None), (4, 1.0, None), (5, 1.0, None)], key=repr)
    found = {r["feature"]: r for r in report.collect()}
    assert [tuple(found[f])[1:] for f in ("inverse", "number", "odd name")] == [(5, 2, 0.4, 0, 2, False), (5, 4, 0.8, 1, 2, False), (5, 5, 1.0, 0, 5, True)]
    assert rows(bad) == [(None, "invalid_or_missing_input")]
    assert {r["missing_fraction"] for r in C.feature_table(df.limit(0), ["id"], {"a": F.col("a")}, F.lit(True))[1].collect()} == {None}


def test_profiles_take_one_scan(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, "a", inf, {"k": 1}), (None, "a", 1.0, {"k": 1}), (1, None, None, None), (2, "", -inf, {"k": 2})], "i int, s string, d double, m map<string,int>")
    got = {r["column"]: tuple(r)[1:] for r in C.column_profile(df, df.columns, {"d": 7}).collect()}
    assert got == {"i": (4, 1, 2, False, 0.25, 0, 0, False), "s": (4, 1, 2, False, 0.25, 0, 0, False), "d": (4, 1, 3, False, 0.25, 2, 7, False), "m": (4, 1, 2, False, 0.25, 0, 0, False)}
    none = {r["column"]: tuple(r)[1:4] for r in C.column_profile(df.limit(0), ["i", "s"]).collect()}
    assert none == {"i": (0, 0, 0), "s": (0, 0, 0)}
    table = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    for profiled in (C.column_profile(table, table.columns), C.place_counts(table, [(["p_name"], None), (["p_brand", "p_size"], None)])):
        plan = profiled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1


# evaluation


def test_correlations_of_many_features_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 217)) * np.logspace(-3, 6, 217) + 1e6
    x[:, 1] = 2 * x[:, 0] + 5
    x[:, 2] = 7.0
    gaps = rng.random(x.shape) < 0.1
    data = [tuple(None if g else float(v) for v, g in zip(r, gs, strict=True)) for r, gs in zip(x, gaps, strict=True)]
    names = [f"f {i}" for i in range(217)]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = E.correlation_matrix(df, names)
    for i, j in ((0, 1), (3, 200), (50, 51), (7, 8)):
        both = ~gaps[:, i] & ~gaps[:, j]
        assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9) == got[j, i]
    assert np.isnan(got[2]).all() and np.allclose(np.diag(got)[3:], 1)
    assert np.isnan(E.correlation_matrix(df.limit(0), names[:3])).all()


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = [("abc"[i % 3], int(rng.random() < 0.4), float(rng.integers(0, 9)), float(rng.random())) for i in range(200)]
    data += [("one", 1, 1.0, 2.0), ("one", 1, 2.0, 1.0), ("a", None, 3.0, 1.0), ("a", 1, None, 1.0), (None, 1, 5.0, 0.5)]
    df = spark.createDataFrame(data, "g string, y int, s double, t double").repartition(3)
    got = {r["g"]: r["auc"] for r in E.auc(df, ["g"], "y", "s").collect()}
    known = [(g, y, s) for g, y, s, _ in data if y is not None and s is not None]
    assert got == pytest.approx({g: brute_auc([(y, s) for h, y, s in known if h == g]) for g in ("a", "b", "c", "one", None)})
    both = {(r["scope"], r["label"]): r for r in E.auc_differences(df, "g", "y", "s", "t").collect()}
    pooled = [[(d[1], d[i]) for d in data if d[0] and d[1] is not None and d[i] is not None] for i in (2, 3)]
    assert both["micro", None]["auc_first"] == pytest.approx(brute_auc(pooled[0])) and both["micro", None]["auc_second"] == pytest.approx(brute_auc(pooled[1]))
    assert both["macro", None]["auc_first"] == pytest.approx(np.mean([got[g] for g in "abc"])) and both["label", "one"]["delta"] is None
    assert E.auc(df.limit(0), ["g"], "y", "s").count() == 0 and E.auc(df, [], "y", "s").count() == 1


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.round(rng.random((150, 3)), 1)
    data = [(i, v[i].tolist(), ["x", "y", None][i % 3]) for i in range(150)] + [(None, [0.0, 0.0, 0.0], "x"), (900, None, "y"), (5, v[5].tolist(), "y")]
    df = spark.createDataFrame(data, "id long, v array<double>, label string").repartition(4)
    want = set()
    for q in range(0, 150, 10):
        d = sorted((round(math.dist(v[q], x), 6), i) for i, x, _ in data if i is not None and x is not None and i != q)
        want |= {(q, i, dist, rank) for rank, (dist, i) in enumerate(d[:4], 1)}
    asked = df.filter("id % 10 = 0")
    for size in (32 << 20, 200):
        monkeypatch.setattr(E, "BLOCK_BYTES", size)
        assert set(rows(E.nearest(asked, df, "id", "v", 4))) == want
    assert E.nearest(asked.limit(0), df, "id", "v", 4).count() == 0
    labels = {i: label for i, _, label in data[:150]}
    queries = [q for q in range(0, 150, 10) if labels[q]]
    votes = {q: [labels.get(i) for a, i, _, _ in want if a == q] for q in queries}
    pairs = {x: [(labels[q] == x, votes[q].count(x)) for q in queries] for x in "xy"}
    got = {(r["scope"], r["label"]): r["auc"] for r in E.neighbour_auc(asked, df.filter("id <> 5 or label is null"), "id", "v", "label", 4).collect()}
    assert set(got) == {("label", "x"), ("label", "y"), ("micro", None), ("macro", None)}
    if not any(a == 5 or i == 5 for a, i, _, _ in want):
        assert got["micro", None] == pytest.approx(brute_auc(pairs["x"] + pairs["y"])) and got["label", "x"] == pytest.approx(brute_auc(pairs["x"]))


# scans


def test_scan_of_encodings_and_faults(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {
        "a.csv": 'k,w\n1,"naïve, é"\n2,"two\nlines"\n'.encode(), "b.csv": "﻿k,w\n3,größe\n".encode(), "c.csv": "w,k\n香气,4\n".encode("gbk"), "d.csv": "k,w\n5,café\n".encode("latin1"),
        "e.tsv": b"k\tw\n6\tx\ty\n7\tz\n", "f.csv": b"", "g.csv": b"k,w\n", "halogen_bonds.tsv": b"k\tw\n", "h.csv": b'k,w\n1,"open\n', "i.csv": b"w\nlone\n",
    }
    for name, data in texts.items():
        (folder / name).write_bytes(data)
    facts, found = scans.scan_delimited(spark, f"file://{folder}")
    by = {r["name"]: r for r in facts.collect()}
    assert {n: (r["encoding"], r["n_rows"], r["status"], r["issue"]) for n, r in by.items() if n != "h.csv"} == {
        "a.csv": ("utf-8", 2, "PASS", None), "b.csv": ("utf-8", 1, "PASS", None), "c.csv": ("gbk", 1, "PASS", None), "d.csv": ("latin1", 1, "PASS", None), "e.tsv": ("utf-8", 2, "FAIL", "1 rows have inconsistent column count"),
        "f.csv": (None, 0, "FAIL", "empty file"), "g.csv": ("utf-8", 0, "FAIL", "header only; no data rows"), "halogen_bonds.tsv": ("utf-8", 0, "PASS", None), "i.csv": ("utf-8", 1, "PASS", None),
    }
    assert by["h.csv"]["status"] == "FAIL" and "Error" in by["h.csv"]["issue"]
    assert all(r["n_bytes"] == len(texts[n]) and r["sha256"] == hashlib.sha256(texts[n]).hexdigest() for n, r in by.items())
    named = {(r["path"].rpartition("/")[2], r["line"]): (r["k"], r["w"]) for r in scans.named_cells(found, facts, ["k", "w"]).collect()}
    assert named["a.csv", 1] == ("1", "naïve, é") and named["a.csv", 2] == ("2", "two\nlines") and named["b.csv", 1] == ("3", "größe")
    assert named["c.csv", 1] == ("4", "香气") and named["d.csv", 1] == ("5", "café") and named["e.tsv", 1] == ("6", "x") and named["i.csv", 1] == (None, "lone")
    (folder / "bin.dat").write_bytes(b"\0\1")
    (folder / "nul.txt").write_bytes(b"a\0b")
    listed = {r["name"]: (r["readable_status"], r["encoding"], r["notes"]) for r in scans.inventory(spark, f"file://{folder}", [".csv", ".txt"]).collect()}
    assert listed["bin.dat"] == ("readable", None, "hash only") and listed["nul.txt"][0] == "unreadable" and listed["c.csv"][1] == "gbk" and listed["f.csv"][2] == "empty" and len(listed) == 12


def test_nested_events(spark):
    docs = spark.createDataFrame([
        (1, "<r><s><hb><n> </n><m>A</m></hb><hb><n>B</n><m>C</m><d>2.5</d></hb><pi/><zz><n>Q</n></zz></s></r>"), (2, "<r><s></s></r>"), (3, "<r><s><hb>"), (4, None), (5, "<r/>"),
    ], "id int, xml string")
    found, bad = scans.nested_events(docs, "xml", ["s"], {"hb": "bond", "pi": "stack"}, {"name": ["n", "m"], "distance": ["d", "dist"]})
    assert rows(found) == [(1, "bond", "A", ""), (1, "bond", "B", "2.5"), (1, "stack", "", "")]
    assert [r[0] for r in rows(bad, "id")] == [3, 4]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


# splits, fingerprints, summaries


def test_split_table_is_read_by_seed(spark, tmp_path):
    ids = spark.range(40).withColumnRenamed("id", "k")
    splits = {seed: P.stratified_split(ids.withColumn("l", F.array(F.lit("a"))), "k", "l", 0.7, seed) for seed in (42, 43, 44)}
    table = P.write_split_table(splits, f"file://{tmp_path}/splits")
    experiments = files.shared_table(spark.createDataFrame([(42, "x"), (44, "y")], "seed int, name string")).filter("name = 'y'")
    applied = P.apply_split_table(ids, table, experiments, "k")
    got = {(r["k"], r["seed"], r["part"]) for r in applied.collect()}
    assert got == {(r["id"], 44, r["part"]) for r in splits[44].collect()} and len(got) == 40
    assert "dynamicpruning" in applied._jdf.queryExecution().optimizedPlan().toString().lower()


def test_packed_fingerprints(spark):
    df = spark.createDataFrame([(1, [0, 63, 64, 1023], [0, 64, 5]), (2, [], []), (3, None, [1])], "id int, a array<int>, b array<int>")
    packed = df.select("id", S.packed_bits("a").alias("a"), S.packed_bits("b").alias("b"))
    got = {r["id"]: r for r in packed.select("id", "a", S.bits_on("a").alias("n"), S.packed_tanimoto("a", "b").alias("t")).collect()}
    assert got[1]["a"] == [-(2**63) + 1, 1, *[0] * 13, -(2**63)] and got[1]["n"] == 4 and got[1]["t"] == pytest.approx(2 / 5)
    assert (got[2]["n"], got[2]["t"], got[3]["n"], got[3]["t"]) == (0, None, None, None)
    texts = spark.createDataFrame([(1, ["x", "y", "x"]), (2, None)], "id int, w array<string>")
    made, bad = M.fingerprint_table(texts, ["id"], F.col("w"), F.col("w").isNotNull())
    assert rows(made, "id", "on_bits", "density") == [(1, 2, 2 / 1024)] and rows(bad) == [(2, "invalid_or_missing_input")]


def test_run_states(spark):
    queue = spark.createDataFrame([("a", 1, 2, "SUCCESS", "s1"), ("a", 2, 1, "SKIPPED_COMPLETE", "s2"), ("b", 1, 3, "TIMEOUT", "s3"), ("c", 1, 1, None, "s4"), ("d", None, None, None, None)], "k string, shard int, n int, state string, source string")
    values = spark.createDataFrame([("a", 1, -5.0), ("a", 2, -5.0), ("a", 1, -3.0), ("b", 1, -1.0), ("b", 1, None)], "k string, shard int, e double")
    made = {r["k"]: r for r in A.run_summary(queue, values, ["k"], "shard", "n", "state", "e", "source", default_requested=9).collect()}
    assert {k: r["status"] for k, r in made.items()} == {"a": "COMPLETE", "b": "PARTIAL", "c": "FAILED", "d": "NO_SHARDS"}
    assert (made["a"]["best_source"], made["a"]["completion"], made["b"]["completion"], made["b"]["sd"], made["d"]["requested"]) == ("s1", 100.0, 33.3, 0.0, 9)
    assert (made["a"]["shards_completed"], made["b"]["shards_failed"], made["c"]["shards_failed"], made["c"]["best"]) == (2, 1, 0, None)
    assert {r["status"] for r in A.run_summary(queue, values, ["k"], "shard", "n", "state", "e", "source", ran=False).collect()} == {"CONFIGURED_NOT_RUN"}


def test_conflicts_labels_axes_and_boxes(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("", "x", 4), ("c", None, 5), ("a", "x", 1)], "k string, v string, id int")
    assert rows(M.two_way_conflicts(df, "k", "v")) == [("k->v", "a", 2), ("v->k", "x", 2)]
    assert rows(M.conflict_rows(df, ["k"], "v", "id")) == [("a", "1;2", "x;y", "conflicting_duplicate_records")]
    words = spark.createDataFrame([("x",), ("odorless",), (None,)], "w string")
    assert A.drop_label_if_released(words, df, "w", "odorless", 6, 2)[0].count() == 2 and A.drop_label_if_released(words, df, "w", "odorless", 5, 2)[0].count() == 3
    box = M.bounding_box(spark.createDataFrame([("g", 0.0, 1.0), ("g", 3.0, 1.0), ("g", 0.0, 4.0)], "g string, x double, y double"), "g", ["x", "y"], 1.0, 0.5, "centroid").first()
    assert (box["x_centre"], box["x_extent"], box["x_points"], box["y_centre"]) == (1.0, 3.0, 4, 2.0)
    angle = spark.range(1).select(M.axis_angle([F.lit(1.0), F.lit(0.0)], [F.lit(-1.0), F.lit(0.0)]).alias("a"), M.axis_angle([F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]).alias("b")).first()
    assert angle["a"] == 0 and angle["b"] == pytest.approx(90)
    lines = spark.createDataFrame([("p", "ATOM  " + " " * 24 + "   1.000"), ("p", "ATOM  " + " " * 24 + "   1.x00"), ("q", "REMARK"), ("r", "HETATM" + " " * 24 + "  -2.5  ")], "f string, l string")
    assert rows(scans.fixed_width_report(lines, "f", "l", "^(ATOM  |HETATM)", {"x": (30, 38)})) == [("p", 2, 1, "1/2 records malformed", "FAIL"), ("q", 0, 0, "no records", "FAIL"), ("r", 1, 0, None, "PASS")]


def test_summaries(spark):
    df = spark.createDataFrame([("a", True, True, "x", "e"), ("a", True, False, "y", " "), ("a", None, True, "z", "d"), ("b", False, False, None, None)], "k string, p boolean, q boolean, label string, ev string")
    got = {r["k"]: r for r in Y.pair_concordance(df, ["k"], F.col("p"), F.col("q"), "label", "ev").collect()}
    assert tuple(got["a"])[1:] == (3, 2, 1, 1, 0.5, 0.5, "divergent", True, "", "x;y", "x", "y", "d;e")
    assert tuple(got["b"])[1:] == (1, 1, 1, 0, 1.0, 0.0, "insufficient_data", False, "insufficient_jointly_tested", "", "", "", "")
    assert Y.pair_concordance(df.limit(0), ["k"], F.col("p"), F.col("q"), "label", "ev").count() == 0
    codes = spark.createDataFrame([(1,), (3,), (2,), (9,), (None,)], "c int")
    assert tuple(Y.response_summary(codes, [], "c").first()) == (3, 1, 1, 1, 0, 2 / 3, 2 / 3, 0.0)
    assert rows(codes.select(Y.ordered_reason([(F.col("c") > 2, "big"), (F.col("c") > 1, "mid")], "none").alias("r"))) == [("big",), ("big",), ("mid",), ("none",), ("none",)]
    paths = spark.createDataFrame([("data/x/1",), ("data/2",), (None,)], "p string")
    assert rows(paths.select(Y.category_by_prefix(F.col("p"), [("data/x/", "X"), (["data/", "raw/"], "D")], "?").alias("r"))) == [("?",), ("D",), ("X",)]
    seen = spark.createDataFrame([(1,), (1,), (7,)], "k int")
    assert tuple(Y.coverage(spark.createDataFrame([(1,), (2,), (2,)], "k int"), seen, "k").first()) == (2, 1, 0.5)
    assert Y.coverage(seen.limit(0), seen, "k").first()["coverage"] is None
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", None)], "k string, v int")
    assert rows(Y.expected_sets(sets, ["k"], "v", F.array(F.lit(1), F.lit(2)))) == [("a", True, [], []), ("b", False, [1], [3])]
    pairs = spark.createDataFrame([("a", "SUCCESS"), ("b", "SKIPPED_X"), ("b", None)], "k string, status string")
    assert rows(Y.pair_counts(sets, "k", "v", pairs)) == [("a", 2, 1, 1, 0, 0), ("b", 2, 1, 0, 1, 0)]
    for how, n in (("union", 3), ("intersect", 1), ("except", 1)):
        assert Y.set_operation(seen, spark.createDataFrame([(1,), (9,)], "k int"), how).count() == n
    energies = spark.createDataFrame([("a", -1.0), ("b", None)], "k string, e double")
    assert rows(Y.energy_summary(energies, ["k"], "e")) == [("a", 1, -1.0, -1.0, -1.0, 0.0), ("b", 0, None, None, None, None)]


def brute_linkage(x, cut):
    """Clusters of average linkage, by joining the two nearest until none are within the cut."""
    groups = [[i] for i in range(len(x))]
    gap = lambda a, b: np.mean([math.dist(x[i], x[j]) for i in a for j in b])
    while len(groups) > 1:
        d, a, b = min((gap(p, q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_average_linkage_against_joining_the_nearest(spark):
    x = np.random.default_rng(9).random((40, 3))
    data = [("g", i, x[i].tolist()) for i in range(40)] + [("h", 50, [0.0]), ("h", 51, None), (None, 60, [1.0]), *[("big", 100 + i, [float(i)]) for i in range(60)]]
    df = spark.createDataFrame(data, "g string, id int, v array<double>").repartition(3)
    got = M.average_linkage(df, "g", "id", "v", [0.3, 0.5, 9.0], max_rows=50).collect()
    assert len(got) == 3 * len(data)
    for cut in (0.3, 0.5, 9.0):
        of = {}
        for r in got:
            if r["g"] == "g" and r["cutoff"] == cut:
                of.setdefault(r["cluster"], set()).add(r["id"])
        assert {frozenset(v) for v in of.values()} == brute_linkage(x, cut)
        sizes = [len(of[c]) for c in sorted(of)]
        assert sizes == sorted(sizes, reverse=True)
    rest = {(r["g"], r["id"]): r["cluster"] for r in got if r["g"] != "g"}
    assert rest["h", 50] == rest[None, 60] == 1 and rest["h", 51] is None and {rest["big", 100 + i] for i in range(60)} == {None}
