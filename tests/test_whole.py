"""Queries that take whole tables."""

from quillon.operators import tables as T
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def test_pairs_of_all_orders(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    want = {(min(r), max(r)) for r in lines}
    got = [(r["a"], r["b"]) for r in registry.QUERIES["j6_pairs_with_reasons_all"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)
    sizes = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").filter("p_size > 10").collect()}
    found = registry.QUERIES["j5_pair_lookup_all"](spark, SF).collect()
    assert {(r["a"], r["b"]) for r in found} == {(a, b) for a, b in want if a in sizes and b in sizes}


def test_every_order_has_a_place(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    want = sorted((-r["o_totalprice"], r["o_orderkey"]) for r in orders)
    got = {r["o_orderkey"]: r["place"] for r in registry.QUERIES["w12_order_places"](spark, SF).collect()}
    assert got == {key: at for at, (_, key) in enumerate(want, 1)}


def test_asked_rows_meet_all_others_of_their_group(spark):
    rows = [(n % 3, n if n % 11 else None, n * n) for n in range(120)] + [(0, 50, 1), (None, 100, 2)]
    df = spark.createDataFrame(rows, "g long, id long, v long")
    for group in ([], ["g"]):
        got = T.pairs_with_asked(df, "id % 50 = 0", group, "id", ["v"], parts=4).collect()
        want = [(a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[1] is not None and b[1] is not None and a[1] % 50 == 0 and a[1] != b[1] and (not group or a[0] == b[0] is not None)]
        assert sorted((r["a"], r["b"], r["v_a"], r["v_b"]) for r in got) == sorted(want)
