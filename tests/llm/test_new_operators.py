"""Whitening, odd sketches and lexical search against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import lexical, odd_sketch, whitening
from quillon.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import ascii_lower, rows_of

SF = "/root/testdata/sf0.001"

# whitening


def brute_whitening(vectors, k=16):
    """n, S, eigenvalues, unit vectors and all variance by float64 over centred distinct vectors."""
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}), np.int64)
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    values, v = np.linalg.eigh(z.T @ z / n)
    return n, s, values[::-1][:k], v[:, ::-1][:, :k], values.sum()


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, s, values, v, variance = brute_whitening([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op11_embedding_whitening"](spark, SF).collect()}
    assert len(got) == len(rows) * 16
    for r in rows:
        x = np.array([math.floor(64 * c) + 1_000_000 for c in map(float, r["embedding"])], object)
        deviation = int(sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True)))
        w = (x.astype(float) - s / n) @ v / np.sqrt(values)
        for c in range(16):
            found = got[r["vec_id"], c + 1]
            assert found["n"] == n and found["deviation"] == deviation and found["identity_error"] < 1e-9
            assert found["explained"] == pytest.approx(values[c] / variance, rel=1e-9)
            assert abs(found["whitened"]) == pytest.approx(abs(w[c]), abs=1e-8)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 0.5)], "x") for i in range(60)]
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 0.0, 0.0], "x"), (103, [0.0, inf, 0.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x")]
    rows = [*good, *good[:20], (None, [0.5, 0.5, 0.5], None), *bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    got = whitening.whiten_embeddings(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 3 * (1 + (i < 20)) for i in range(60)} | {None: 3})
    n, s, values, v, variance = brute_whitening([r[1] for r in [*good, (None, [0.5] * 3)]])
    assert {r["n"] for r in got} == {61} and sum({round(r["explained"], 9) for r in got}) == pytest.approx(1)
    w = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] == i][:: 1 + (i < 20)] for i in range(60)] + [[r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] is None]])
    assert np.abs(w.T @ w / n - np.eye(3)).max() < 1e-9
    assert whitening.whiten_embeddings(df.filter("vec_id >= 100")).count() == 0
    assert whitening.whiten_embeddings(df.filter("vec_id = 5")).count() == 0
    far = spark.createDataFrame([(1, [1e13]), (2, [-1e13]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten_embeddings(far).collect()} == {None, 0}


@pytest.mark.parametrize("values", [[1, 1, 1, 1], [5, 5, 1, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 3], [1e6, 1e6 * (1 - 1e-12), 1, 1e-6], list(range(1, 41)), [0, 0, 2, 2.0000001]])
def test_eigenvectors_of_clusters(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * q.T @ q)
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    top = max(values)
    assert np.abs(e - np.array(sorted(values, reverse=True))).max() < 1e-17 * top * len(values) * 4
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17 * len(values) * 4
    assert np.abs(a @ x - x * e).max() < 1e-17 * top * len(values) * 4


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for largest in (3, 10**6, 10**8, 2**40):
        z = rng.integers(-largest, largest + 1, (50, 4))
        assert (whitening.gram(z, largest) == z.astype(object).T @ z.astype(object)).all()
    batch = pa.record_batch([pa.array([[2**62, -(2**62)], [2**62, -5]], pa.list_(pa.int64()))], ["x"])
    (made,) = whitening._moments(2, [batch])
    assert [whitening._whole(r) for r in made.to_pylist()] == [2**63, -(2**62) - 5]


# odd sketches


def brute_sets(rows):
    """For each row its set of two-word shingles."""
    out = []
    for _, text in rows:
        words = ascii_lower(text).split()
        out.append({tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    return out


def brute_components(rows, percent=80):
    sets = brute_sets(rows)
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    at[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return Counter((doc, len(sets[i]), least.get(root(i)), doc == least.get(root(i))) for i, (doc, _) in enumerate(rows))


def found_components(df, **options):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in odd_sketch.odd_sketch_components(df, **options).collect())


def test_odd_sketches_of_odd_rows(spark, edge_docs, no_docs):
    assert found_components(edge_docs) == brute_components(rows_of(edge_docs))
    assert odd_sketch.odd_sketch_components(no_docs).count() == 0
    lone = edge_docs.filter("doc_id in (201, 202, 203)")
    assert found_components(lone) == brute_components(rows_of(lone))


def near_family(rng, vocabulary, length, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        yield " ".join(words)


@pytest.mark.parametrize("shape", ["usual", "split", "heavy"])
def test_odd_sketch_links_equal_brute_force(spark, monkeypatch, shape):
    """Chains and families around the bar, small blocks, and pairs of blocks that confirm in the task."""
    if shape != "usual":
        monkeypatch.setattr(odd_sketch, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(odd_sketch, "PAIRS_A_SLICE", 7)
    if shape == "heavy":
        monkeypatch.setattr(odd_sketch, "PAIRS_A_ROW", 0)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [t for length, edits in ((60, 6), (60, 9), (30, 4), (12, 1), (3, 1)) for t in near_family(rng, vocabulary, length, 40, edits)]
    texts += [f"{' '.join(rng.choice(vocabulary) for _ in range(20))} a passage that all of these have in common {i}" for i in range(40)]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_components(df) == brute_components(rows)


def test_odd_sketch_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op12_odd_sketch_dedup"](spark, SF).collect())
    assert got == brute_components(rows_of(docs))


def test_estimates_of_odd_sketches():
    rng = np.random.default_rng(3)
    multipliers = rng.integers(0, 1 << 31, 256, np.uint32) * np.uint32(2) + np.uint32(1)
    bar, errors = odd_sketch.most_odd(0.8, 256), []
    for share in (0.8, 0.9, 0.97, 1.0):
        for _ in range(60):
            n = 400
            both = int(n * 2 * share / (1 + share))
            h = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
            pair = np.stack([odd_sketch.minima(np.sort(h[:n]), multipliers), odd_sketch.minima(np.sort(h[n - both :]), multipliers)])
            sketch = odd_sketch.odd_sketches(pair)
            odd = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            assert odd <= bar
            errors.append((share, float(odd_sketch.estimate(odd, 256)) - both / (2 * n - both)))
    for share in (0.8, 0.9, 0.97, 1.0):
        own = [e for s, e in errors if s == share]
        assert abs(np.mean(own)) < 0.012 and np.std(own) < 0.045


def test_shingle_sets_follow_the_words():
    texts = ["", " \t\x0b\x0c\r\n", "a", "A\x0bb", "a b a b a b", "à b c d", "x\x1cy z", "a b" * 500, "  lead and trail "]
    for width in (1, 2, 3):
        got = list(odd_sketch.shingle_sets(pa.array(texts), width, 42))
        want = [ascii_lower(t).split() for t in texts]
        sizes = [len({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else 0 for w in want]
        assert list(map(len, got)) == sizes
    one, two = odd_sketch.shingle_sets(pa.array(["b", "b c"]), 3, 42)
    assert one[0] != two[0]


# lexical search


def brute_search(docs, items, top=20):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    cut = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts = [(d, Counter(cut(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = 0
            for t in cut(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out.update((item, rank, None if z else d, -s) for rank, (s, z, d) in enumerate(sorted(scores)[:top], 1))
    return out


def found_search(docs, items, **options):
    return Counter(map(tuple, lexical.search_documents(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("tiles", [None, (3, 2, 5)])
def test_search_of_odd_rows(spark, edge_docs, no_docs, monkeypatch, tiles):
    if tiles:
        for name, value in zip(("QUERY_TILE", "TERM_TILE", "DOC_TILE"), tiles, strict=True):
            monkeypatch.setattr(lexical, name, value)
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 100)
        monkeypatch.setattr(lexical, "CHUNK", 11)
    asked = [(1, "The of und, HAUS!"), (2, None), (3, ""), (4, "zzz"), (5, "straße niño x" * 3), (None, "der les"), (7, "the the the"), (7, "eau eau der"), (8, "12 abc"), (9, "ÀBC àbc")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    got = found_search(edge_docs, items)
    assert got == brute_search(rows_of(edge_docs), asked)
    assert found_search(no_docs, items) == found_search(edge_docs, items.filter("item_id > 99")) == Counter()


def test_search_sums_stay_exact(monkeypatch):
    """Columns are split where a weight or a query's sum could reach 2^53, and the parts add up."""
    monkeypatch.setattr(lexical, "MOST_IMPACT", 1 << 40)
    queries = [Counter({0: 5, 1: 3, 2: 100}), Counter({1: 7})]
    tiles = lexical.query_tiles(queries, [1000, 900, 800])
    room = (1 << 53) // (1 << 40) - 1
    total = np.zeros((2, 3), np.int64)
    for tile in tiles[0]:
        assert tile.weights.sum(axis=1).max() <= room
        for j, term in enumerate(tile.terms):
            total[:, term] += tile.weights[:, j].astype(np.int64)
    assert total.tolist() == [[5000, 2700, 80000], [0, 6300, 0]]


def test_search_table(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = Counter(tuple(r) for r in con.sql(f"select item_id, rank, doc_id, score from ({ORACLES['op13_lexical_search']})").fetchall())
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, QUERIES["op13_lexical_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == want == brute_search(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()])
