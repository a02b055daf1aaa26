"""Each operator against brute force on rows with nulls, ties, repeats, long texts and clashing column names."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import flac, langid, lm_score, packing, shard, simhash, sstable, url_filter
from quillon.llm.exact_dedup import exact_dedup, exact_dedup_report
from quillon.llm.mixing import mix_copies, mix_documents, mix_report, pivot, source_targets
from quillon.llm.queries import QUERIES
from quillon.llm.shard import minimax_cuts, shard_documents, shards_needed
from quillon.llm.tokens import PieceEncoder

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ascii_lower(text):
    return (text or "").encode().lower()


# tokens, sstables, packing


@functools.cache
def whole_tokenizer(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def direct(path, text):
    return whole_tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_pieces_give_the_ids_of_the_whole_text(path):
    rng = random.Random(3)
    letters = " \n\t.,'$é0aZßÿ\u00a0\u3000\u0301Σ½İ'stm<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += [None, "", " ", "  a  b\n\nc ", "<|endoftext|> x", "\x1c a \x1d", "don't I'll 's", "naïve, ÀÉ. ÿþ"]
    texts += ["".join(rng.choice(" \nabZé.,%") for _ in range(rng.randrange(60))) for _ in range(2000)]
    got = PieceEncoder(path).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [direct(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_ids_of_a_text_do_not_depend_on_earlier_texts(path):
    rng = random.Random(11)
    parts = ["\0", "\0hello", "hello", " hello", "a", " ", "\n", "\x01", "\x1f", "<|endoftext|>", "<|startoftext|>", "Ġhello", "hello</w>", "wörld", "\0\0", "."]
    texts = ["hello world", "\0hello", "a \0hello b", "\0"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    want = {t: direct(path, t) for t in texts}
    for order in (texts, texts[::-1], sorted(texts)):
        enc = PieceEncoder(path)
        for at in range(0, len(order), 100):
            got = enc.encode(order[at : at + 100])
            assert [np.frombuffer(g, "<u2").tolist() for g in got] == [want[t] for t in order[at : at + 100]]


def test_sstable_report_and_lookup(spark, edge_docs, no_docs, tmp_path):
    manifest = sstable.write_sstables(edge_docs, BYTE_BPE, f"file://{tmp_path}/tables")
    got = sstable.read_sstables(spark, manifest).collect()
    want = Counter()
    for doc_id, text in rows_of(edge_docs):
        ids = np.array([*direct(BYTE_BPE, text), 0], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    asked = spark.createDataFrame([(-5,), (3,), (207,), (999,), (None,)], "doc_id long")
    found = sstable.lookup(asked, manifest).collect()
    assert sorted(r["doc_id"] for r in found) == [-5, 3, 207, 207, 207]
    texts = dict(rows_of(edge_docs))
    assert all(list(r["tokens"]) == [*direct(BYTE_BPE, texts[r["doc_id"]]), 0] for r in found)
    assert sstable.token_shards(no_docs, BYTE_BPE).count() == 0


def test_sstable_blocks_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    file = tmp_path / "one.sst"
    pairs = [(sstable.key_of(i // 3), bytes([i % 250]) * (i % 7)) for i in range(-60, 400)]
    with open(file, "wb") as sink:
        writer = sstable.ShardWriter(sink, 1)
        for k, v in pairs:
            writer.add(k, v)
        writer.close()
    reader = sstable.ShardReader(f"file://{file}")
    assert list(reader.scan()) == pairs and len(reader.index) > 3
    for k in {k for k, _ in pairs}:
        assert reader.get(k) == [v for x, v in pairs if x == k]
    assert reader.get(sstable.key_of(5000)) == []
    data = bytearray(file.read_bytes())
    data[-80] ^= 1
    file.write_bytes(data)
    with pytest.raises(ValueError):
        sstable.ShardReader(f"file://{file}")


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    room, want = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            best = min(fits)
            want.append(best)
            room[room.index(best)] -= n
        else:
            want.append(64)
            room.append(64 - n)
    got = packing.best_fit_decreasing(lengths, 64)
    assert [64 - offset for _, offset in got] == want


def check_packed(got, docs, window):
    by_doc = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*direct(WORD_BPE, text), 1], "<u4")
        for a in range(0, len(ids), window):
            want[doc_id, a, len(ids[a : a + window]), zlib.crc32(ids[a : a + window]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    return len(windows)


def test_packing(edge_docs, no_docs):
    got = packing.pack_documents(edge_docs, WORD_BPE, window=512).collect()
    n = check_packed(got, rows_of(edge_docs), 512)
    assert n <= sum(r["length"] for r in got) / 512 * 1.05 + 5
    assert packing.pack_documents(no_docs, WORD_BPE).count() == 0


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.range(300).selectExpr("cast(null as long) doc_id", "'one two' text"))
    got = [packing.pack_documents(docs.repartition(n), WORD_BPE).collect() for n in (4, 64)]
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1]))
    n = check_packed(got[0], rows_of(docs), 2048)
    assert sum(r["length"] for r in got[0]) >= 0.98 * n * 2048
    groups = Counter(r["sequence_id"] >> 40 for r in got[0])
    assert len(groups) > 2 and max(groups.values()) < 700


# simhash


def brute_components(prints, radius):
    ids = sorted(prints, key=lambda d: (d is None, d))
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def brute_fingerprint(text):
    words = ascii_lower(text).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(edge_docs, no_docs):
    got = simhash.simhash_components(edge_docs).collect()
    docs = rows_of(edge_docs)
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter((d, brute_fingerprint(t)) for d, t in docs)
    prints = {("n", i) if d is None else d: brute_fingerprint(t) for i, (d, t) in enumerate(docs)}
    # Null ids name no component: here both share it with a document that has an id, or stand alone.
    named = brute_components({(10**9 + k[1]) if isinstance(k, tuple) else k: v for k, v in prints.items()}, 2)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == named[r["doc_id"]]
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.simhash_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {d for d, c in named.items() if d == c and d < 10**9}


def test_simhash_of_any_ids_and_repeated_rows(spark):
    rows = [(1 << 61, "a b c d"), ((1 << 61) + 5, "A b c d"), ((1 << 62) + 7, "x y z w"), (-(1 << 63), "q r s t"), ((1 << 63) - 1, "Q r s t"), (3, "one text here"), (5, "one text here"), (5, "quite other words"), (9, "same row"), (9, "same row"), (None, "lone words alone")]
    docs = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, _row int, _gone string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(docs).collect()}
    for d, t in rows:
        same = [x for x, u in rows if u.lower() == t.lower() and x is not None]
        assert got[d, f"{brute_fingerprint(t):016x}"] == min(same, default=None)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    want = [(1 << 61, "a b c d"), ((1 << 62) + 7, "x y z w"), (-(1 << 63), "q r s t"), (3, "one text here"), (5, "quite other words"), (9, "same row"), (None, "lone words alone")]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


@pytest.mark.parametrize("limit", [200_000, 5])
def test_near_edges_connect_what_is_near(spark, limit):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(15)} | {0, 1, (1 << 64) - 1})
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    edges = simhash.near_edges(spark.createDataFrame(signed, "node long, fp long"), 2, tree_limit=limit)
    assert all((r["a"] > r["b"]) for r in edges.collect())
    got = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    want = brute_components(dict(enumerate(prints)), 2)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# exact dedup, shards, mixing


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(edge_docs, no_docs, keep, weak):
    from pyspark.sql import functions as F

    options = {"keep": keep} | ({"hash_fn": lambda t: F.pmod(F.length(t), F.lit(3))} if weak else {})
    groups = defaultdict(list)
    for doc_id, text in rows_of(edge_docs):
        groups[ascii_lower(text)].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known, default=None)
        for i in ids:
            want[i, best, len(ids), i == best, hashlib.sha256(text).hexdigest()] += 1
    got = exact_dedup_report(edge_docs, **options).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    left = exact_dedup(edge_docs, **options)
    assert left.columns == edge_docs.columns
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    assert Counter((ascii_lower(r["text"]), r["doc_id"]) for r in left.collect()) == Counter(best.items())
    assert exact_dedup_report(no_docs, **options).count() == 0 and exact_dedup(no_docs, **options).count() == 0


@given(st.lists(st.integers(1, 30), min_size=1, max_size=14), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_minimax_is_the_best_partition(sizes, k):
    capacity, begins = minimax_cuts(sizes, k)
    best = min(
        max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)]))
        for n in range(min(k, len(sizes)))
        for cuts in itertools.combinations(range(1, len(sizes)), n)
    )
    assert capacity == best and len(begins) <= k
    assert shards_needed(sizes, capacity) == len(begins)


@given(st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1) | st.integers(-40, 40), st.integers(1, 30)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.integers(1, 7), st.integers(2, 6))
@settings(max_examples=150, deadline=None)
def test_refined_cuts_are_those_of_all_groups(groups, k, round_bits):
    groups = sorted(groups)

    def parts(pieces, more):
        out = []
        for depth in {p.depth for p in pieces}:
            sums, held, to = Counter(), Counter(), min(64, depth + min(more, round_bits))
            for h, size in groups:
                if any(p.depth == depth and p.bits == h >> (64 - depth) for p in pieces):
                    sums[h >> (64 - to)] += size
                    held[h >> (64 - to)] += 1
            out += [shard.Piece(to, b, n, held[b] == 1) for b, n in sums.items()]
        return sorted(out, key=lambda p: p.start)

    whole = shard.Piece(1, 0, 0, False), shard.Piece(1, -1, 0, False)
    capacity, begins = shard.refined_cuts(parts(whole, 1), k, parts)
    sizes = [s for _, s in groups]
    assert capacity == minimax_cuts(sizes, k)[0]
    sums = Counter()
    for h, size in groups:
        sums[sum(h >= b for b in begins)] += size
    assert max(sums.values()) <= capacity and len(begins) < k


def test_shards_of_the_query_are_the_best_over_groups(spark):
    from quillon.llm.queries import op6_minimax_shards

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.selectExpr("xxhash64(coalesce(text, '')) h", "octet_length(coalesce(text, '')) + 16 n").collect()
    groups = Counter()
    for r in rows:
        groups[r["h"]] += r["n"]
    got = op6_minimax_shards(spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()
    assert max(r[1] for r in got) == minimax_cuts([groups[h] for h in sorted(groups)], 40)[0]


def test_shards(edge_docs, no_docs):
    got = shard_documents(edge_docs, 7).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(edge_docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert all(len(s) == 1 for s in of_text.values())
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) <= max(99016, sum(sums.values()) // 7 + 31000)
    assert shard_documents(no_docs, 7).count() == 0


def test_targets():
    assert source_targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    assert source_targets([10, 1000], [3, 1], 1.5, 2.0) == pytest.approx([20, 1495])
    assert source_targets([10, 10], [1, 1], 3, 2.0) == [20, 20] and source_targets([0, 5], [1, 1], 1.5, 2.0) == pytest.approx([0, 7.5])


def test_pivot_keeps_the_sum_and_the_expectation():
    rng = random.Random(2)
    size = [rng.randrange(1, 50) for _ in range(40)]
    part = [rng.random() for _ in size]
    mean = np.zeros(40)
    for seed in range(400):
        new, open_ = pivot(size, part, list(range(40)), seed)
        assert sum(s * p for s, p in zip(size, new)) == pytest.approx(sum(s * p for s, p in zip(size, part)), abs=1e-6)
        assert all(p in (0, 1) for i, p in enumerate(new) if i != open_)
        mean += np.array(new) / 400
    assert np.abs(mean - part).max() < 0.12


def test_mixing(edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr("quillon.llm.mixing.LEAF_DOCS", 10)
    monkeypatch.setattr("quillon.llm.mixing.FAN_IN", 3)
    got = mix_report(edge_docs).collect()
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in edge_docs.collect()]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, s) for d, _, s in rows)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    target = dict(zip(sizes, source_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source_size"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source_size"]] += r["taken"]
        largest[r["source_size"]] = max(largest[r["source_size"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    again = mix_report(edge_docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    copies = Counter()
    for r in mix_copies(edge_docs).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mix_report(no_docs).count() == 0 and mix_documents(no_docs).count() == 0


def test_mixing_keeps_rows_that_differ_in_any_column(spark):
    rows = [(1, "a b c", "s", i) for i in (1, 2, 3)] + [(None, "a b", None, 7), (-1, "a b", "\0", 8), (2, "d e", "s", 5), (2, "d e", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _doc int")
    mixed = Counter(map(tuple, mix_documents(docs, share=2.0).collect()))
    assert mixed == Counter({r: 2 * n for r, n in Counter(rows).items()})


# urls


def test_url_filter(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = [
        None, "", "nothing", "http://net/", "http://net", "HTTP://A.Example.NET/en/x?y#z", "x://a.net/en/", "http://b.example.net/de/", "http://www.example.com/de/1",
        "http://example.com/de", "http://example.com/en/", "http://a.org/fr/2", "http://notnet/", "http://xnet/", "http://a.bnet/", "http://a?://b/c", "http://É.net/Q", "http://.net/", "a://b://c.net/",
        "http://example.net/en/\nx", "http://x.net?/", "http://x.net#/", "http://" + "a." * 20_000 + "net/", "http://" + "a." * 20_000 + "com/",
    ] * 2
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert tuple(got[i])[1:] == (host, path, rule, rules.get(rule, "allow")), u
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, {}).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 20_000, 37).selectExpr("concat('k', id) as key")
    levels = url_filter.build_cascade(universe, listed)
    assert len(levels) > 2
    found = universe.filter(url_filter.member(levels, universe["key"]))
    assert {r["key"] for r in found.collect()} == {f"k{i}" for i in range(0, 20_000, 37)}


# media


@given(st.lists(st.binary(max_size=300) | st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=9), st.integers(1, 3000)), max_size=6))
@settings(max_examples=40, deadline=None)
def test_flac_round_trip(payloads):
    streams = flac.encode_streams(payloads)
    assert [b"".join(b for _, b in blocks) for blocks in flac.decode_streams(streams)] == payloads
    bare = [s[:4] + bytes([0x80]) + s[5:42] + s[flac.read_metadata(s).start :] for s in streams]  # no seek table
    assert flac.decode_streams(bare) == flac.decode_streams(streams)


def test_flac_long_stream_and_damage():
    data = np.random.default_rng(0).integers(90, 110, 700_000, np.uint8).tobytes()  # frame numbers of two bytes
    (stream,) = flac.encode_streams([data])
    (blocks,) = flac.decode_streams([stream])
    assert b"".join(b for _, b in blocks) == data and [o for o, _ in blocks] == list(range(0, len(data), 4096))
    point = flac.read_metadata(stream)
    (x,), numbers, _ = flac.decode_frames(np.frombuffer(stream, np.uint8), [point.start + point.points[150]])
    assert numbers == [150] and (x + 128).astype(np.uint8).tobytes() == data[150 * 4096 : 151 * 4096]
    for at in (point.start + 5, point.start + 900, 30):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises((ValueError, KeyError, IndexError)):
            flac.decode_streams([bytes(bad)])


def test_media_columns(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    got = flac.media_report(edge_docs).collect()
    want = Counter()
    for doc_id, text in rows_of(edge_docs):
        raw = (text or "").encode()
        payload = flac.pad(raw)
        want[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    media = flac.encode_media(edge_docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), "shard"))
    assert media.columns == ["doc_id", "payload", "shard", "media"]
    blocks = flac.media_blocks(media).collect()
    lengths = Counter()
    for r in blocks:
        lengths[r["doc_id"]] += r["n_samples"]
        assert r["sample_offset"] == 4096 * r["block"] and len(r["pcm"]) == r["n_samples"]
    assert lengths[208] == 99000 and lengths[209] == 30000
    assert flac.media_report(no_docs).count() == 0


# language identification


@pytest.mark.parametrize("tree_nodes", [None, 1, 20, 8000])
def test_shards_of_any_size_lose_no_link(spark, tree_nodes):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for fp in list(prints)[:120]:
        prints.add(fp ^ (1 << rng.randrange(64)))
        prints.add(fp ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "node long, fp long")
    edges = {tuple(r) for r in simhash.near_edges(nodes, 2, 200_000, tree_nodes).collect()}
    unsigned = lambda x: x & ((1 << 64) - 1)
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {p: p for p in signed}
    changed = True
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if (unsigned(a) ^ unsigned(b)).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert {p: root(p) for p in signed} == want


def test_trees_are_pruned():
    """A search of a tree of thousands of fingerprints visits a few in a hundred of them."""
    value = np.random.default_rng(1).integers(0, 1 << 63, 4000, np.uint64)
    forest, visits = simhash.Forest(np.zeros(4000, np.int64), value), 0
    stack = [(np.arange(4000), forest.root_of[np.arange(4000)])]
    while stack:
        q, node = stack.pop()
        visits += len(q)
        d = np.bitwise_count(value[q] ^ value[node]).astype(np.int64)
        low, high = np.searchsorted(forest.keys, node * 65 + np.maximum(d - 2, 0)), np.searchsorted(forest.keys, node * 65 + np.minimum(d + 2, 64), side="right")
        if len(q) and (n := high - low).sum():
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((np.repeat(q, n), forest.child[np.repeat(low, n) + step]))
    assert visits / 4000 < 0.05 * 4000


def test_long_lists_of_keys(spark):
    """A million listed keys, a third of which no page can ask for, are told from the others exactly, by filters far larger than a word."""
    universe = spark.range(900_000).selectExpr("concat('h', id, '/') as key")
    listed = spark.range(1_000_000).selectExpr("concat('h', id * 3, '/') as key")
    levels = url_filter.build_cascade(universe, listed)
    assert isinstance(levels, list) and max(len(x.packed) for x in levels) > 50_000
    found = universe.filter(url_filter.member(levels, universe["key"]))
    assert found.count() == 300_000 and found.join(listed, "key", "left_anti").count() == 0


def test_lists_beyond_the_largest_filter_are_joined(spark, monkeypatch):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "e.org/fr/": "block", "aa.org/": "allow", "a.org/b/": "block"}
    hosts, paths = ["net", "example.net", "www.example.net", "xexample.net", "example.com", "org", "e.org", "aa.org", "a.org", "b.aa.org"], ["", "/", "/en/1", "/de/", "/fr/x", "/b/c", "/en"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(itertools.product(hosts, paths))] + [(900, None), (901, "nothing")]
    pages = spark.createDataFrame([*rows, *rows[:5]], "page_id long, url string").repartition(3)
    want = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=repr)
    for most in (0, 1):
        monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", most)
        assert sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=repr) == want
    assert len(want) == len(rows) + 5 and {r[3] for r in want} == {*rules, None}


def test_languages(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in langid.language_report(edge_docs).collect()}
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "und"}
    assert all(got[d]["lang_pred"] == "und" for d in (200, 201, 202, -5)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert langid.language_report(no_docs).count() == 0
    kept = langid.filter_languages(edge_docs)
    assert kept.columns == edge_docs.columns and {200, 201, 202, -5}.isdisjoint({r["doc_id"] for r in kept.collect()})
    # Nothing but the text decides.
    from pyspark.sql import functions as F

    named = edge_docs.selectExpr("*", "'x' _lang", "1 _score", "2 _p", "3 told", "4 row")
    filtered = langid.filter_languages(named)
    assert filtered.columns == named.columns and filtered.filter("_lang = 'x' and _p = 2 and row = 4").count() == kept.count()

    model = langid.learn_languages(edge_docs)
    shown = edge_docs.withColumns({"lang": F.lit("fr"), "source": F.lit("q")})
    pair = [sorted(map(str, langid.predict_languages(d, model).select("text", "_lang", "_score").collect())) for d in (edge_docs, shown)]
    assert pair[0] == pair[1]


def test_languages_of_repeated_rows(spark):
    rows = [(i, "der Hund und die Katze", "de") for i in range(2000)] + [(i, "x y z", f"l{i % 70}") for i in range(2000, 2140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.language_report(docs.filter("doc_id < 2000")).filter("lang_pred = 'de'").count() == 2000
    model = langid.learn_languages(docs)
    assert sum(map(len, model.members.values())) >= 60 and langid.filter_languages(docs).count() == 2140
    only = docs.filter("doc_id < 2000 and crc32(cast(doc_id as string)) % 3 = 1")  # none to learn from
    assert {r["lang_pred"] for r in langid.language_report(only).collect()} == {"und"}


def test_predictions_follow_the_machines(spark, edge_docs):
    """Every row against a plain prediction: the best family, then votes of its pairs."""
    model = langid.learn_languages(edge_docs)
    got = langid.predict_languages(edge_docs, model).select("text", "_lang").collect()
    for r in got:
        text = r["text"]
        if text is None or not any(c.isalpha() for c in text):
            assert r["_lang"] == "und"
            continue
        margin = langid.features(text).dot(model.weights) + model.bias
        families = list(model.families)
        family = max(range(len(families)), key=lambda i: (margin[i], -i))
        own = model.members[families[family]]
        wins, sums = Counter(dict.fromkeys(own, 0)), Counter(dict.fromkeys(own, 0.0))
        for at, (a, b) in enumerate(model.pairs, len(families)):
            if a in own:
                wins[a if margin[at] > 0 else b] += 1
                sums[a] += margin[at]
                sums[b] -= margin[at]
        assert r["_lang"] == max(own, key=lambda x: (wins[x], sums[x], x))


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97


# language model


def test_row_hash_takes_maps(spark):
    from quillon.llm.common import row_hash

    df = spark.sql("select id, map('a', id % 2) as m, struct(map(1, id)) as s from range(4)")
    assert df.select(row_hash(df, 1).alias("h")).distinct().count() == 4
    docs = spark.createDataFrame([(i, f"some words {i}", "s", {"k": i}) for i in range(50)], "doc_id long, text string, source string, m map<string,int>")
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert simhash.simhash_dedup(docs).count() >= 1


def test_scores(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr("quillon.llm.lm_score.FREQUENT", 6)
    got = lm_score.score_documents(edge_docs).collect()
    docs = [(d, [*ascii_lower(t).split(), b"\n"]) for d, t in rows_of(edge_docs)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, words in docs if not held(d) for w in words)
    n, v = sum(c.values()), len(c)
    base = lambda words: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
    want = Counter((d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(base(w), 4)) for d, w in docs)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_score.score_documents(no_docs).count() == 0


def test_word_probabilities_sum_to_one_over_bits():
    from quillon.llm import context_mixing as cm

    code = cm.BitCode.of(np.bincount(np.frombuffer(b"abc " * 50, np.uint8), minlength=256))
    table = np.zeros((cm.SLOTS, 2), np.float32)
    words = [b"ab", b"abc", b"b"] * 3
    cm.count_bits(words, table, code)
    mixer, table = cm.Mixer.new(), cm.packed(table, cm.PRIOR)
    cm.learn(words, table, code, mixer)
    assert all(np.array_equal(x, y) for x, y in zip(vars(cm.Mixer.of(mixer.flat())).values(), vars(mixer).values(), strict=True))
    # All words of one byte, and all that begin with a byte: the chance of the first byte sums to one.
    first = 0.0
    for b in range(256):
        u = cm.units([bytes([b])], code)
        x, gate = cm.inputs(u, table, 0)
        t, _, _ = cm._refined(cm._mixed(x, mixer.weights[gate]), u.node, mixer.odds)
        own = u.place == u.step[0]
        first += float(np.exp(-np.log1p(np.exp((1 - 2 * u.bit[own]) * t[own]))).prod())
    assert first == pytest.approx(1, abs=1e-3)


def test_long_words_are_spelled_in_pieces():
    from quillon.llm import context_mixing as cm

    code, table, mixer = cm.BitCode.of(np.ones(256, np.int64)), np.zeros(cm.SLOTS, np.uint16), cm.Mixer.new()
    word = bytes(range(97, 117)) * 100
    parts = [word[a : a + cm.PIECE_BYTES] for a in range(0, len(word), cm.PIECE_BYTES)]
    alone = cm.spelled(parts, table, code, mixer, 0).sum()
    assert cm.spelled([b"a", word, b""], table, code, mixer, 0)[1] == pytest.approx(alone)


class PlainMixer:
    """The online mixer bit by bit, over exact contexts in dictionaries."""

    def __init__(self, v, texts):
        self.v, self.counts = v, Counter()
        for places in texts:
            for names, node, bit in self.bits(places):
                for name in names:
                    self.counts[name, node, bit] += 1

    def bits(self, places):
        from quillon.llm import text_mixing as tm

        code = self.v.code
        klass = [int(self.v.klass[p]) for p in places]
        for i, k in enumerate(klass):
            one, two = [klass[i - j] if i >= j else None for j in (1, 2)]
            word = int(places[i - 1]) if i else None
            names = [(0,), (1, one), (2, one, two), (3, word), (4, word, two)]
            assert len(names) == tm.TABLES
            for at in range(code.start[k], code.start[k] + code.size[k]):
                yield names, int(code.node[at]), int(code.bit[at])

    def log10(self, places, learned):
        from quillon.llm import context_mixing as cm, text_mixing as tm

        weights = defaultdict(lambda: tm._START.astype(float).copy())
        seen, own, bits, out = Counter(), Counter(), list(self.bits(places)), 0.0
        sizes = [int(self.v.code.size[self.v.klass[p]]) for p in places]
        ends = list(itertools.accumulate(sizes))
        for a in range(0, len(places), tm.CHUNK):
            steps, more_seen, more_own = defaultdict(lambda: np.zeros(tm.INPUTS)), Counter(), Counter()
            for names, node, bit in bits[ends[a - 1] if a else 0 : ends[min(a + tm.CHUNK, len(places)) - 1]]:
                x, n = [], 0
                for name in names:
                    small = self.counts[name, node, 0] + self.counts[name, node, 1] <= cm.EXACT
                    n0, n1 = (self.counts[name, node, b] - (learned and small and b == bit) for b in (0, 1))
                    x.append(math.log((n1 + tm.PRIOR) / (n0 + tm.PRIOR)))
                    n = n0 + n1
                x += [math.log((own[node, 1] + tm.PRIOR) / (own[node, 0] + tm.PRIOR)), 0.3]
                gate = (node, sum(n >= least for least in (1, 4, 32)))
                p = 1 / (1 + math.exp(-float(weights[gate] @ x)))
                out += math.log10(p if bit else 1 - p)
                steps[gate] += (bit - p) * np.array(x)
                more_seen[gate] += p * (1 - p) * sum(y * y for y in x)
                more_own[node, bit] += 1
            own.update(more_own)
            for gate, step in steps.items():
                seen[gate] += more_seen[gate]
                weights[gate] += tm.RATE / (tm.DAMP + seen[gate]) * step
        return out


def test_texts_are_mixed_as_bit_by_bit(monkeypatch):
    from quillon.llm import context_mixing as cm, text_mixing as tm

    rng = np.random.default_rng(4)
    klass = np.array([0, 0, 1, 1, 2, 3, 4, 5, 6])
    v = tm.Vocabulary(klass, np.zeros(9), np.ones(9), cm.BitCode.of(np.array([50, 20, 9, 9, 4, 3, 1])))
    texts = [rng.choice(9, n, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]).astype(np.int32) for n in (1, 5, 64, 65, 300, 130, 0, 40)]
    bits = tm.table_bits(30_000_000)
    counts = np.zeros(2 * int(tm.offsets(bits)[-1]), np.uint32)
    for at in (0, 4):  # in any parts
        tm.count_texts(v, texts[at : at + 4], bits, counts)
    plain, mixing = PlainMixer(v, texts), tm.Mixing(v, bits, tm.packed(counts))
    learned = np.arange(len(texts)) % 2 == 0
    want = [plain.log10(p, k) for p, k in zip(texts, learned, strict=True)]
    assert mixing.read(texts, learned)[0] == pytest.approx(want, rel=5e-4, abs=1e-6)
    monkeypatch.setattr(tm, "TOKENS_AT_ONCE", 50)  # long texts go on in runs
    assert mixing.read(texts, learned)[0] == pytest.approx(want, rel=5e-4, abs=1e-6)
    assert mixing.read([texts[4][::-1]], learned[:1])[0] != pytest.approx(want[4:5], rel=1e-4)  # order matters


def test_scores_by_hand(spark, edge_docs, monkeypatch):
    """The score put together from the plain mixer, shares of classes and of rare words, and spellings."""
    from quillon.llm import context_mixing as cm, text_mixing as tm

    monkeypatch.setattr(lm_score, "FREQUENT", 6)
    monkeypatch.setattr(lm_score, "FIT_DOCS", 0)
    monkeypatch.setattr(lm_score, "FIT_GROUPS", 1)
    docs = [(r["doc_id"], r["lang"], [*ascii_lower(r["text"]).split(), b"\n"], len((r["text"] or "").encode())) for r in edge_docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c, by_lang = Counter(), defaultdict(Counter)
    known = Counter(lang for d, lang, *_ in docs if lang and not held(d))
    number = {lang: i for i, (lang, _) in enumerate(sorted(known.items(), key=lambda x: (-x[1], x[0])))}
    for d, lang, words, _ in docs:
        if not held(d):
            c.update(words)
            for w in words:
                by_lang[w][number.get(lang, lm_score.LANGS)] += 1
    steps = Counter(math.floor(math.log2(n) * 4) for n in c.values() if n > 1)
    least = min(s for s in steps if sum(steps[x] for x in steps if x >= s) <= 6)
    frequent = sorted(w for w, n in c.items() if n > 1 and math.floor(math.log2(n) * 4) >= least or w == b"\n")
    top = {w: max(by_lang[w].items(), key=lambda x: (x[1], -x[0]))[0] for w in frequent}
    names = [(-1, 0) if w == b"\n" else (top[w], c[w].bit_length() // 3) for w in frequent]
    kinds = sorted(set(names))
    totals = [sum(c[w] for w, x in zip(frequent, names) if x == kind) for kind in kinds]
    rare_total = sum(c.values()) - sum(totals)
    v = tm.Vocabulary(np.array([*map(kinds.index, names), len(kinds)]), None, None, cm.BitCode.of(np.array([*totals, rare_total, 0])))
    place = {w: i for i, w in enumerate(frequent)}
    texts = [[place.get(w, len(frequent)) for w in words] for _, _, words, _ in docs]
    plain = PlainMixer(v, [t for t, (d, *_) in zip(texts, docs) if not held(d)])
    rare = sorted(w for w in c if w not in place)
    parts, _ = cm.pieces(rare)
    code, table, mixer = cm.BitCode.of(np.bincount(np.frombuffer(b" ".join([*rare, b""]), np.uint8), minlength=256)), np.zeros((cm.SLOTS, 2), np.float32), cm.Mixer.new()
    cm.count_bits(parts, table, code)
    table = cm.packed(table, cm.PRIOR)
    cm.learn(parts, table, code, mixer)
    bound = min(c[w] for w in frequent)
    once = sum(c[w] == 1 for w in rare)
    again = rare_total - once + bound * sum(c[w] == bound for w in frequent)
    want = []
    for (d, _, words, size), text in zip(docs, texts):
        score = plain.log10(text, not held(d)) + sum(math.log10(c[w] / totals[kinds.index(names[place[w]])]) for w in words if w in place)
        for w, k in Counter(w for w in words if w not in place).items():
            left = c[w] - (0 if held(d) else k)
            seen = math.log10(left / rare_total * (again + 1) / (once + again + 2)) if left > 0 else None
            new = math.log10((once + 1) / (once + again + 2)) + cm.spelled([w], table, code, mixer, int(c[w] > 0))[0]
            score += k * (seen if seen is not None else new)
        want.append((str(d), round(score, 2), round(-score * math.log2(10) / max(size, 1), 2)))
    key = lambda x: (x[0], x[1])
    for n in (1, 7):
        got = sorted(((str(r["doc_id"]), r["score"], r["bits_per_byte"]) for r in lm_score.score_documents(edge_docs.repartition(n)).collect()), key=key)
        for g, w in zip(got, sorted(want, key=key), strict=True):
            assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-3, abs=0.02) and g[2] == pytest.approx(w[2], rel=1e-3, abs=0.02)


def test_scores_beat_word_counts_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm_score.score_documents(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > got["b"]


# every query on its whole table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, folder)
    count = lambda table: spark.read.parquet(f"{folder}/{table}.parquet").count()
    if name.startswith("op4_"):
        whole = rows.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
        assert len(whole) == count("documents") and all(r[1] == r[2] for r in whole)
    elif name.startswith("op11_"):
        assert rows.count() == 16 * count("embeddings")
    elif name.startswith("op13_"):
        assert rows.select("item_id").distinct().count() == count("benchmark")
    else:
        assert rows.count() == count("pages" if name.startswith("op2_") else "documents")
