"""Edited copies: the stages before mixing against brute force on planted ones."""

import random

import pytest

import corpus_pipeline
from quillon.llm import odd_sketch
from quillon.llm.near_copies import near_copies_dedup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs, least=0.8):
    """Ids that have no smaller id in their component."""
    parent = {d: d for d, _ in docs}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sets = {d: shingles(t) for d, t in docs}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d for d in parent if find(d) == d}


def planted():
    """Texts of 150 words with copies of 1 to 6 changed words, on either side of 0.8, a chain and a large group."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    docs = []
    for at in range(40):
        base = [word() for _ in range(150)]
        docs.append((1000 + at, " ".join(base)))
        for changes in range(1, 7):
            copy = list(base)
            for place in rng.sample(range(150), changes):
                copy[place] = word()
            docs.append((len(docs) * 7 % 997 + 2000, " ".join(copy)))
    chain = [word() for _ in range(150)]
    for at in range(12):
        docs.append((5000 + at, " ".join(chain)))
        chain[at * 11 + 3] = word()
    base = [word() for _ in range(200)]
    for at in range(120):
        copy = list(base)
        copy[at] = word()
        docs.append((6000 + at, " ".join(copy)))
    assert len({d for d, _ in docs}) == len(docs)
    return docs + [(9000, "too short"), (9001, "Too  short"), (9002, ""), (9003, " ")]


def test_edited_copies_do_not_reach_mixing(spark):
    docs = planted()
    found = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    names = [name for name, _ in corpus_pipeline.STAGES]
    for _, stage in corpus_pipeline.STAGES[names.index("simhash_dedup") : names.index("source_mix")]:
        found = stage(spark, found, "")
    want = brute_kept(docs)
    assert {r["doc_id"] for r in found.collect()} == want and len(want) < 200 and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("shingles_a_block", [200_000, 400])
def test_near_copies(spark, monkeypatch, shingles_a_block):
    monkeypatch.setattr(odd_sketch, "BLOCK_SHINGLES", shingles_a_block)
    docs = planted()
    found = near_copies_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"] for r in found.collect()} == brute_kept(docs)


def test_copies_of_a_template_are_told_apart_within_tasks(spark):
    """Copies that differ from each other by more than the bar but share buckets: few rows are written for them, and no link is lost."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    docs = []
    for at in range(150):
        copy = list(base)
        for place in rng.sample(range(120), 2 if at % 10 else 1):
            copy[place] = f"u{rng.randrange(9000)}"
        docs.append((at, " ".join(copy)))
    found = near_copies_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"] for r in found.collect()} == brute_kept(docs)


def test_null_and_repeated_ids(spark, edge_docs, no_docs):
    base = " ".join(f"v{i}" for i in range(100))
    rows = [(None, base), (None, base + " more"), (4, base + " other"), (4, base + " words"), (5, None)]
    found = near_copies_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in found) == [(4, False), (5, True)]
    assert near_copies_dedup(no_docs).count() == 0
    assert near_copies_dedup(edge_docs).columns == edge_docs.columns
