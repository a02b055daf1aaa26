"""MinHash near-dedup with odd sketches.

Each text's set of shingle hashes gives `samples` minima. Documents that agree
on all minima of a band share a bucket. All minima of a set, each with its
number, are folded into an odd sketch: a bitmap that holds the parity of how many
of them fall on each bit. Where two sets agree on a minimum the bits cancel, so
the population count of the XOR of two sketches tells on how many they differ,
most precisely for high similarities. That estimate decides which candidates are
worth a look at their whole sets, which alone confirm a link.

A pair of similarity s meets in one of b bands of r minima with probability
1 - (1 - s^r)^b: for 0.8 with 32 bands of 4 that fails once in 2e7 pairs. The
estimate's bar lies six standard deviations below the least similarity: once in 1e9.

Sets that are equal are one node. A bucket's members are first compared with its
least one, which joins a group of copies as a star. What is left are buckets whose
members lie in several components: these are dealt to blocks of bounded sets, and each
pair of blocks is compared by sketches in one task, across components only. A pair
of blocks with few likely pairs gives them out; one with many gets its
members' sets and confirms links in the task until what can be joined is joined. So
no bucket is capped, no pair is left out, and what is written for a bucket grows
with its members, not their pairs.

Defined results: a text that is null or without words is empty and linked with
nothing; one with fewer words than a shingle has its whole sequence as the only
shingle; repeated rows are listed each; a component is named by its smallest
id, null only if all of its ids are null, and rows without an id are kept only then; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import bounded_batches, give_back, materialize, maybe_broadcast, text_or_empty
from quillon.llm.simhash import bits_of, connected_components

#: Bits of a sketch; bytes of text whose words are hashed together; shingles whose minima are taken together.
BITS, SLICE_BYTES, CHUNK = 512, 2 << 20, 1024
#: Shingles of a block of a bucket, pairs that a pair of blocks gives out for each of its rows, pairs that share one copy of a set.
BLOCK_SHINGLES, PAIRS_A_ROW, PAIRS_A_SLICE = 200_000, 4, 500


# Shingles, minima, sketches ---------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at)))
        flat = cut.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        known = pc.dictionary_encode(flat.filter(pa.array(real)))
        words = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in known.dictionary.to_pylist()], np.uint64)
        word = words[known.indices.to_numpy()] if len(words) else words
        joined = mixed(word)
        for step in range(1, width):
            joined = mixed(joined[: max(len(word) - step, 0)] * np.uint64(0x9E3779B97F4A7C15) + word[step:])
        start = 0
        for end in ends.tolist():
            if end - start >= width:
                yield np.unique(joined[start : end - width + 1])
            elif end > start:  # the whole sequence, told from longer ones by its length
                h = np.array([end - start], np.uint64)
                for w in word[start:end]:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
                yield h
            else:
                yield word[:0]
            start = end
        at = to


def minima(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least image of the set under each multiplier, in 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(least, (multipliers[:, None] * x[None, at : at + CHUNK]).min(axis=1), out=least)
    return least


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of BITS / 64 words) of the numbered minima in each row."""
    rows, k = least.shape
    numbered = least.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))
    bit = (mixed(numbered) >> np.uint64(40)).astype(np.int64) % BITS
    counts = np.bincount((np.arange(rows)[:, None] * BITS + bit).ravel(), minlength=rows * BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(rows, BITS), axis=1, bitorder="little").view("<u8")


def estimate(odd: np.ndarray | float, samples: int) -> np.ndarray | float:
    """Similarity of two sets whose sketches differ in so many bits."""
    left = np.maximum(1 - 2 * np.asarray(odd, float) / BITS, 1 / BITS)
    return 1 - np.log(left) / np.log(1 - 2 / BITS) / (2 * samples)


def most_odd(least: float, samples: int, deviations: float = 6.0) -> int:
    """Differing bits that a pair of at least this similarity exceeds with the probability of so many standard deviations only."""
    differ = 2 * samples * (1 - least)
    two, four = (1 - 2 / BITS) ** differ, (1 - 4 / BITS) ** differ
    mean = BITS / 2 * (1 - two)
    folding = BITS / 4 * (1 - two * two + (BITS - 1) * (four - two * two))
    sampling = (two * differ / differ) ** 2 * 4 * samples * least * (1 - least) if differ else 0.0  # each sample that differs moves about 2 * two bits
    return math.ceil(mean + deviations * math.sqrt(max(folding, 0) + sampling))


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each row of minima, from its own minima and its number."""
    own = least[:, : bands * rows].astype(np.uint64).reshape(len(least), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), own.shape[:2])
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, r])
    return key.view(np.int64)


def _name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return b"".join(int(mixed(s ^ np.uint64(c)).sum(dtype=np.uint64)).to_bytes(8, "big") for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


def sketched(docs: DataFrame, width: int, seed: int, samples: int, bands: int, rows: int) -> DataFrame:
    """docs (other columns than _text must be longs) with node (a name of the set, null if it is empty), n, sketch, keys and fp (a SimHash fingerprint of the set)."""
    multipliers = np.random.default_rng(seed).integers(0, 1 << 31, samples, np.uint32) * np.uint32(2) + np.uint32(1)
    carried = [c for c in docs.columns if c != "_text"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, least, prints = [], [], np.zeros((batch.num_rows, samples), np.uint32), np.zeros(batch.num_rows, np.uint64)
            for i, s in enumerate(shingle_sets(batch["_text"], width, seed)):
                names.append(_name(s) if len(s) else None)
                sizes.append(len(s))
                least[i] = minima(s, multipliers)
                prints[i] = bits_of(s)
            words = odd_sketches(least).view(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (words, band_keys(least, bands, rows))]
            yield pa.record_batch([*[batch[c] for c in carried], pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), *lists, pa.array(prints.view(np.int64))], [*carried, "node", "n", "sketch", "keys", "fp"])
            give_back()

    return docs.mapInArrow(of, ", ".join(f"{c} long" for c in carried) + ", node binary, n long, sketch array<long>, keys array<long>, fp long")


def _sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """node and s (its shingles, sorted) of each document that has any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingle_sets(batch["_text"], width, seed) if len(s)]
            yield pa.record_batch([pa.array([_name(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "s"])
            give_back()

    return docs.mapInArrow(of, "node binary, s array<long>")


# Candidates and links ---------------------------------------------------------


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, bar: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow the similarity. b is the side that many pairs share."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                odd = np.bitwise_count(_words(batch["sketch_a"]) ^ _words(batch["sketch_b"])).sum(axis=1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(odd <= bar))

    return pairs.filter(fits).select("a", "b", "sketch_a", "sketch_b").mapInArrow(of, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar.

    Pairs of one b are cut into slices; a slice gets the set of b once, however
    many pairs it has.
    """
    count = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_SLICE).alias("slices"))
    sliced = materialize(pairs.join(count, "b").select("a", "b", F.pmod(F.xxhash64("a"), "slices").alias("slice")), "odd-slices")
    own = sliced.join(sets.select(F.col("node").alias("a"), "s"), "a").select("b", "slice", "a", "s")
    hubs = sliced.select("b", "slice").distinct().join(sets.select(F.col("node").alias("b"), "s"), "b").select("b", "slice", F.lit(None).cast("binary").alias("a"), "s")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, np.empty(0, np.int64)
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (b, a, s) in enumerate(zip(batch["b"].to_pylist(), batch["a"].is_valid().to_pylist(), batch["s"], strict=True)):
                if not a:
                    hub, of_hub = b, s.values.to_numpy().view(np.uint64)
                else:
                    hit[i] = hub == b and similar(s.values.to_numpy().view(np.uint64), of_hub, percent)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    dealt = own.unionByName(hubs).repartition("b", "slice").sortWithinPartitions("b", "slice", F.asc_nulls_first("a"))
    return dealt.mapInArrow(of, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (longs), one at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[k].to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and any(held[-1][k][0].as_py() != batch[k][a].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(rows: pa.Table, percent: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of likely pairs of different components; of two blocks only pairs across."""
    rows = rows.combine_chunks()
    n, component, side = rows["n"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy()
    sketch = _words(rows["sketch"].chunk(0))
    one = rows["i"][0].as_py() == rows["j"][0].as_py()
    left = np.arange(len(n)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 256):
        p = left[at : at + 256]
        fits = component[p][:, None] != component[right][None, :]
        fits &= 100 * np.minimum(n[p][:, None], n[right][None, :]) >= percent * np.maximum(n[p][:, None], n[right][None, :])
        if one:
            fits &= p[:, None] < right[None, :]
        x, y = np.nonzero(fits)
        hit = np.bitwise_count(sketch[p[x]] ^ sketch[right[y]]).sum(axis=1, dtype=np.int64) <= bar
        found.append((p[x[hit]], right[y[hit]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (left[:0], left[:0])


def across(members: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, bar: int) -> DataFrame:
    """Links (a, b) between components that share a bucket. members: key, node and component (long) of buckets with several components."""
    found = members.join(nodes.select("node", "n", "sketch"), "node")
    sizes = found.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = found.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = dealt.select("key", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), (F.col("block") > F.col("other")).cast("long").alias("side"), "node", "n", "component", "sketch")
    each = materialize(each, "odd-blocks")
    by = ["key", "i", "j"]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, by):
            p, q = _open_pairs(rows, percent, bar)
            node = rows["node"].combine_chunks()
            if len(p) > PAIRS_A_ROW * len(node):  # marked, with no pair given out
                p, q = p[:1], None
            key = [pa.repeat(rows[k][0], len(p)) for k in by]
            yield pa.record_batch([*key, node.take(pa.array(p)), pa.nulls(len(p), pa.binary()) if q is None else node.take(pa.array(q))], [*by, "a", "b"])

    schema = "key long, i long, j long, a binary, b binary"
    first = materialize(each.repartition(*by).sortWithinPartitions(*by).mapInArrow(few, schema), "odd-across")
    light = likely_once(first.filter("b is not null").select("a", "b"))
    heavy = first.filter("b is null").select(*by)
    if not heavy.isEmpty():
        each = materialize(each.join(maybe_broadcast(heavy, 24), by, "left_semi"), "odd-heavy")
    else:
        each = None
    asked = light.select(F.explode(F.array("a", "b")).alias("node"))
    asked = asked.unionByName(each.select("node")) if each is not None else asked
    sets = sets_of(asked.distinct())
    links = confirmed(light, sets, percent)
    if each is None:
        return links

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, by):
            p, q = _open_pairs(rows, percent, bar)
            s = rows["s"].combine_chunks()
            offsets, values = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            parts = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            _, parent = np.unique(rows["component"].to_numpy(), return_inverse=True)
            made = []
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                if parent[x] != parent[y] and similar(parts[x], parts[y], percent):
                    parent[parent == parent[y]] = parent[x]
                    made.append((x, y))
            node = rows["node"].combine_chunks()
            x, y = np.array(made, np.int64).reshape(-1, 2).T
            yield pa.record_batch([node.take(pa.array(x)), node.take(pa.array(y))], ["a", "b"])
            give_back()

    return links.unionByName(each.join(sets, "node").repartition(*by).sortWithinPartitions(*by).mapInArrow(many, "a binary, b binary"))


def likely_once(pairs: DataFrame) -> DataFrame:
    """Pairs with their larger end as a, each once."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _components(edges: DataFrame) -> DataFrame:
    """node and root of every node of edges."""
    found = connected_components(edges)
    return materialize(found.select("node", F.col("component").alias("root")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("root")).distinct()), "odd-components")


def set_links(docs: DataFrame, nodes: DataFrame, *, width: int, percent: int, seed: int, samples: int, more: DataFrame | None = None) -> DataFrame | None:
    """node and root of all linked nodes, or None if no nodes come together.

    docs has _text and _key, nodes has node, _key, n, sketch and keys; more are further pairs (a, b) of nodes to be looked at.
    """
    bar = most_odd(percent / 100, samples)

    def sets_of(asked: DataFrame) -> DataFrame:
        texts = materialize(nodes.join(asked, "node", "left_semi").select("_key"), "odd-asked")
        return materialize(_sets(docs.join(maybe_broadcast(texts, 16), "_key", "left_semi").select("_text"), width, seed).dropDuplicates(["node"]), "odd-sets")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).filter("m > 1"), "odd-buckets")
    members = materialize(keyed.join(maybe_broadcast(buckets, 64), "key"), "odd-members")
    pairs = members.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = pairs if more is None else pairs.unionByName(more)
    stars = materialize(likely(likely_once(pairs), nodes, percent, bar), "odd-stars")
    if stars.isEmpty() and members.isEmpty():
        return None
    edges = confirmed(stars, sets_of(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent)
    edges = materialize(edges, "odd-edges")
    found = _components(edges)
    # Buckets of three or more whose members are not all connected by now; two are a pivot and its only pair.
    placed = members.filter("m > 2").join(maybe_broadcast(found, 48), "node", "left").select("key", "node", F.coalesce("root", "node").alias("component"))
    placed = materialize(placed, "odd-placed")
    mixed_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    left = placed.join(maybe_broadcast(materialize(mixed_, "odd-mixed"), 16), "key", "left_semi")
    more = materialize(across(left.select("key", "node", F.xxhash64("component").alias("component")), nodes, sets_of, percent, bar), "odd-more")
    if more.isEmpty():
        return found
    return _components(edges.unionByName(more))


def odd_sketch_components(
    docs: DataFrame, *, width: int = 2, percent: int = 80, bands: int = 32, rows: int = 4, samples: int = 256, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; sets are linked if their Jaccard similarity is at least percent / 100."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    found = materialize(sketched(texts, width, seed, samples, bands, rows), "odd-sketches")
    nodes = found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"), *[F.first(c).alias(c) for c in ("_key", "n", "sketch", "keys")])
    nodes = materialize(nodes, "odd-nodes")
    roots = set_links(texts, nodes, width=width, percent=percent, seed=seed, samples=samples)
    known = nodes.select("node", "least", "docs")
    if roots is None:
        named = known.filter("docs > 1").select("node", F.col("least").alias("component"))
    else:
        rooted = materialize(known.join(maybe_broadcast(roots, 48), "node", "left").filter("docs > 1 or root is not null").withColumn("root", F.coalesce("root", "node")), "odd-rooted")
        named = rooted.select("node", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    named = materialize(named.withColumn("_named", F.lit(True)), "odd-named")
    joined = found.select("doc_id", "node", F.col("n").alias("n_shingles")).join(maybe_broadcast(named, 48), "node", "left")
    component = F.when(F.col("_named"), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
