"""Groups and splits on rows with ties, nulls, chains of links and empty tables."""

import itertools
import random

from quillon.operators import groups as G
from quillon.operators import measures as M
from quillon.operators import splits as P


def test_labels_and_representatives(spark):
    rows = [("g", 1, 7, 2.0, 0.5), ("g", 2, 7, None, 0.5), ("g", 3, 4, 1.0, 0.1), ("g", 4, 4, 3.0, 0.1), ("g", 5, 9, 1.0, None), ("h", 6, None, None, None)]
    df = spark.createDataFrame(rows, "g string, i long, raw int, e double, d double")
    got = G.stable_labels(df, ["g"], "raw", "e")
    assert {r["i"]: r["cluster"] for r in got.collect()} == {3: 1, 4: 1, 1: 2, 2: 2, 5: 3, 6: None}
    made = G.representatives(got, ["g"], "cluster", "i", "d", "e", "i")
    assert sorted(map(tuple, made.collect())) == [("g", "cluster_002_medoid", 1), ("g", "dominant_cluster_medoid", 3), ("g", "global_lowest_energy", 3)]
    same = G.same_as_first(df.fillna({"raw": 7}), ["g"], ["i"], "raw")
    assert {r["i"]: r["same_as_first"] for r in same.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert G.same_as_first(df.limit(0), ["g"], ["i"], "raw").count() == 0
    null_group = spark.createDataFrame([(None, 1, "x"), (None, 2, None)], "g string, i long, s string")
    assert {r["i"]: r["same_as_first"] for r in G.same_as_first(null_group, ["g"], ["i"], "s").collect()} == {1: True, 2: False}


def test_components(spark):
    chain = [(i, i + 1, 0.9) for i in range(1, 40)] + [(50, 52, 0.9), (51, 50, 0.9), (60, 60, 1.0)]
    pairs = spark.createDataFrame(chain, "a long, b long, similarity double")
    ids = spark.createDataFrame([(i,) for i in (*range(1, 41), 50, 51, 52, 60, 70)], "id long")
    found = {r["id"]: r["component"] for r in P.components(ids, pairs).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50, 60: 60, 70: 70}
    assert P.components(ids, pairs.limit(0)).filter("id <> component").count() == 0
    parts = P.disjoint_split(P.components(ids, pairs), 0.5)
    assert parts.groupBy("component").agg({"part": "min", "*": "count"}).count() == 4
    crossing = P.max_train_similarity(parts, pairs).filter("max_train_similarity is not null")
    assert crossing.count() == 0


def test_stratified(spark):
    rows = [(i, ["common"] + ["rare"] * (i % 5 == 0) + [None]) for i in range(1000)] + [(1000, None), (1001, [])]
    df = spark.createDataFrame(rows, "i long, labels array<string>")
    shares = {r["stratum"]: (r["n"], r["n_train"]) for r in P.split_marginals(P.stratified_split(df, "i", "labels", 0.7)).collect()}
    assert shares == {"rare": (200, 140), "common": (800, 560), "": (2, 1)}
    a, b = (dict(map(tuple, P.stratified_split(df, "i", "labels", 0.7, seed).select("id", "part").collect())) for seed in (42, 43))
    assert a != b and a == dict(map(tuple, P.stratified_split(df.repartition(3), "i", "labels", 0.7).select("id", "part").collect()))


def test_iterative_split_keeps_every_label(spark):
    rng = random.Random(6)
    names = [f"l{i}" for i in range(20)]
    lists = [[n for at, n in enumerate(names) if rng.random() < 0.5 / (at + 1)] for _ in range(900)]
    rows = [(i, [*x, None, *x[:1]]) for i, x in enumerate(lists)] + [(5000, None), (5001, []), (5002, ["alone"])]
    df = spark.createDataFrame(rows, "i long, labels array<string>").repartition(3)
    made = P.iterative_split(df, "i", "labels", 0.7)
    assert made.count() == len(rows) == made.select("id").distinct().count()
    for r in P.label_marginals(made, df, "i", "labels").collect():
        assert abs(r["n_train"] - 0.7 * r["n"]) <= max(1, 0.01 * r["n"]), r
    again = dict(map(tuple, P.iterative_split(df.repartition(5), "i", "labels", 0.7).select("id", "part").collect()))
    first, other = (dict(map(tuple, x.select("id", "part").collect())) for x in (made, P.iterative_split(df, "i", "labels", 0.7, 43)))
    assert again == first != other
    assert P.iterative_split(df.limit(0), "i", "labels", 0.7).count() == 0


def test_similar_pairs_of_many_sizes(spark):
    """Thresholds, sizes at the edges of the prefixes, and sets that differ by one item."""
    rng = random.Random(3)
    sets = {}
    for base in range(12):
        own = rng.sample(range(200), 4 + 3 * base)
        for copy in range(6):
            sets[len(sets)] = {*own[: len(own) - copy % 3], *rng.sample(range(200), copy % 2)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, x array<string>").repartition(3)
    for t in (0.5, 0.75, 0.8, 0.9):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > t}
        assert {(r["a"], r["b"]) for r in M.similar_pairs(df, "id", "x", t).collect()} == want


def test_similar_pairs_against_brute_force(spark):
    sets = {i: {f"w{(i * k) % 17}" for k in range(1, 2 + i % 9)} for i in range(1, 60)} | {100: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, x array<string>")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b]}
    got = {(r["a"], r["b"]): r["similarity"] for r in M.similar_pairs(df, "id", "x", 0.6).collect()}
    assert got == {p: s for p, s in want.items() if s > 0.6}
    classes = {r["id"]: r["class"] for r in P.set_classes(df, "id", "x").collect()}
    assert classes == {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}


def test_metric_documents(spark):
    docs = ['{"model":"m","representation":"r","mean":0.5,"folds":[0.4,0.6]}', '{"model":"m","representation":"s","mean":0.9,"folds":[0.4,0.6]}', "broken", None]
    got = P.metric_table(spark.createDataFrame([(d,) for d in docs], "j string"), "j", 3).collect()
    assert [(r["agrees"], r["fold_1"], r["fold_3"]) for r in got] == [(True, 0.4, None), (False, 0.4, None), (None, None, None), (None, None, None)]
    metrics = spark.createDataFrame([("a", "n", 1.0), ("a", "m", 2.0), ("b", "n", None)], "section string, metric string, value double")
    audit = M.expected_audit(metrics, {("a", "n"): 1, ("b", "n"): 3})
    assert {(r["section"], r["metric"]): r["matches"] for r in audit.collect()} == {("a", "n"): True, ("a", "m"): None, ("b", "n"): False}
