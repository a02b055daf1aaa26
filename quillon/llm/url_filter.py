"""URL rules held in a Bloom filter cascade over the corpus's own key universe.

A key is a host suffix joined to a path prefix. The universe is every key that
the pages can ask for: each suffix of a host and prefix of the path that are as
long as some rule's. Level 0 encodes the listed keys, level 1 those
keys of the universe that level 0 wrongly accepts, level 2 the listed keys that
level 1 wrongly accepts, and so on until none is left; the first level that
rejects a key decides. For keys of that universe the answer is exact, so no join
of pages with the rules is needed. Rules that no page can ask for are left out first. A filter's bits are set by a distributed aggregation,
and only filters reach the driver; their sizes follow the list, not the corpus. A
filter is one binary literal of the plan. A list whose filter would be larger than
MAX_FILTER_BYTES is joined with the keys instead, with the same result.

Defined results: a null url, or one without "://", has an empty host and path
and fits no rule; a url that fits no rule gets the default verdict; repeated
rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import ascii_lower, materialize

#: A filter may be this large at most; a longer list is joined.
MAX_FILTER_BYTES = 32 << 20
#: Bits that a byte of a filter holds: seven, so that any byte is a character.
BYTE_BITS = 7


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path without query and fragment."""
    known = F.coalesce(url, F.lit(""))
    pattern = F.lit(r"(?s)^.*?://([^/?#]*)([^?#]*)")
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    fits = F.regexp_like(known, pattern)
    return ascii_lower(F.when(fits, host).otherwise("")), F.when(fits, path).otherwise("")


def candidate_keys(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """All keys of a url that a rule could have, longest first: lengths has the lengths of the rules' hosts and paths.

    A host's end of a rule's length counts if it is the host or follows a dot, so
    the work for a url follows the rules' lengths and not the number of its labels.
    """
    order = sorted(lengths, key=lambda x: (-sum(x), -x[0]))
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in order])
    n = F.length(host)

    def key(pair: Column) -> Column:
        whole = (n == pair["h"]) | ((n > pair["h"]) & (F.substring(host, n - pair["h"], F.lit(1)) == "."))
        return F.when(whole & (F.length(path) >= pair["p"]), F.concat(F.right(host, pair["h"]), F.left(path, pair["p"])))

    return F.filter(F.transform(pairs, key), lambda k: k.isNotNull())


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bytes, of BYTE_BITS bits each, and how many bits a key sets."""

    level: int
    packed: bytes
    hashes: int

    @property
    def bits(self) -> int:
        return BYTE_BITS * len(self.packed)

    def accepts(self, key: Column) -> Column:
        """Whether all bits of key are set."""
        packed, hit = F.lit(self.packed), F.lit(True)
        for at in _positions(key, self.level, self.bits, self.hashes):
            byte = F.ascii(F.substring(packed, F.floor(at / BYTE_BITS).cast("int") + 1, F.lit(1)).cast("string"))
            hit = hit & (F.getbit(byte, F.pmod(at, F.lit(BYTE_BITS)).cast("int")) == 1)
        return hit


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions by double hashing, seeded with the level."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.shiftright(a, 8) + F.lit(i) * F.shiftright(b, 8), F.lit(bits)).cast("long") for i in range(hashes)]


def _build_level(keys: DataFrame, n_keys: int, rate: float, level: int) -> Level:
    """A filter of keys (column key) with about the given rate of false positives."""
    n_bytes = filter_bytes(n_keys, rate)
    bits = BYTE_BITS * n_bytes
    hashes = max(1, round(bits / max(n_keys, 1) * math.log(2)))
    hashes = min(hashes, 16)
    at = F.explode(F.array(*_positions(F.col("key"), level, bits, hashes)))
    each = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / BYTE_BITS).cast("int").alias("byte"))
    one = F.expr(f"shiftleft(1, cast(pmod(at, {BYTE_BITS}) as int))")
    set_bits = each.agg(F.bit_or(one).cast("int").alias("value")).toArrow()  # no more rows than the filter has bytes
    packed = np.zeros(n_bytes, np.uint8)
    packed[set_bits["byte"].to_numpy()] = set_bits["value"].to_numpy()
    return Level(level, packed.tobytes(), hashes)


def filter_bytes(n_keys: int, rate: float) -> int:
    return max(1, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2 / BYTE_BITS))


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level] | DataFrame:
    """Levels for exact membership of the universe's keys in the listed ones; both have a column key. The listed keys themselves if a filter would be too large.

    Level 0 is sized so that about as many false positives as listed keys are
    expected, and each further level halves what remains.
    """
    inside = universe.select("key").distinct().join(listed.select("key").distinct(), "key", "left_semi")
    inside = materialize(inside, "cascade-in")
    outside = materialize(universe.select("key").distinct().join(inside, "key", "left_anti"), "cascade-out")
    n_in, n_out = inside.count(), outside.count()
    if not n_in:
        return []
    if filter_bytes(n_in, _first_rate(n_in, n_out)) > MAX_FILTER_BYTES:
        return inside
    levels, encode, other = [], inside, outside
    n_encode, n_other = n_in, n_out
    while n_encode:
        rate = 0.5 if levels else _first_rate(n_encode, n_other)
        levels.append(_build_level(encode, n_encode, rate, len(levels)))
        wrong = materialize(other.filter(levels[-1].accepts(F.col("key"))), "cascade-level")
        encode, other, n_encode, n_other = wrong, encode, wrong.count(), n_encode
    return levels


def _first_rate(n_in: int, n_out: int) -> float:
    return min(0.5, max(1e-9, n_in / max(n_out, 1) / math.sqrt(2)))


def member(levels: list[Level], key: Column) -> Column:
    """Whether key is listed: the first level that rejects it decides, exactly for keys of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.accepts(key), out).otherwise(F.lit(level.level % 2 == 1))
    return out


def filter_urls(
    pages: DataFrame,
    rules: dict[str, str],
    *,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: a rule such as "example.net/en/" to its verdict. It fits its host and
    all subdomains where the path starts with the rule's; the longest rule wins.
    A url that fits none gets `default`, since the cascade lists no key of it.
    """
    spark = pages.sparkSession
    lengths = sorted({(r.index("/"), len(r) - r.index("/")) for r in rules})
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = judged.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths) if rules else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("_keys").alias("key")).distinct()
    verdicts = {v: spark.createDataFrame([(r,) for r, x in rules.items() if x == v], "key string") for v in sorted(set(rules.values()))}
    known = materialize(universe, "url-universe")
    cascades = {v: build_cascade(known, listed) for v, listed in verdicts.items()}
    joined = {v: x for v, x in cascades.items() if isinstance(x, DataFrame)}
    filters = {v: x for v, x in cascades.items() if not isinstance(x, DataFrame) and x}
    hit = lambda k: F.struct(k.alias("rule"), F.coalesce(*[F.when(member(levels, k), F.lit(v)) for v, levels in filters.items()], F.lit(None).cast("string")).alias("verdict"))
    hits = F.filter(F.transform("_keys", hit), lambda h: h["verdict"].isNotNull())
    if joined:
        return _joined(keyed, hits, joined, default)
    return keyed.select("page_id", "host", "path", F.get(hits, F.lit(0)).alias("_hit")).select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict")
    )


def _joined(keyed: DataFrame, hits: Column, joined: dict[str, DataFrame], default: str) -> DataFrame:
    """As filter_urls, where the lists of some verdicts are joined: the keys of equal urls are looked up once."""
    parts = materialize(keyed.select("host", "path", "_keys").distinct(), "url-parts")
    table = None
    for v, keys in joined.items():
        one = keys.select("key", F.lit(v).alias("verdict"))
        table = one if table is None else table.unionByName(one)
    listed = parts.select("host", "path", F.explode("_keys").alias("key")).join(table, "key").select("host", "path", F.col("key").alias("rule"), "verdict")
    known = parts.select("host", "path", F.inline(hits)).unionByName(listed)
    best = known.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.position(F.lit("/"), F.col("rule")))).alias("_hit"))
    return keyed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
