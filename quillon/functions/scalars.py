"""Column functions for cleaning, parsing, keys, set similarity and classes. All are built-in expressions."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: The identifier's format, words that mean true and false, ranks of levels.
IDENTIFIER = r"^\d{2,7}-\d{2}-\d$"
TRUE_WORDS = ["1", "1.0", "true", "responsive", "yes", "active"]
FALSE_WORDS = ["0", "0.0", "false", "nonresponsive", "non-responsive", "no", "inactive"]
LEVELS = {"high": 3, "medium": 2, "low": 1}
#: A path with something below it, a cell that begins with a path, a credential.
ABSOLUTE_PATH = r"(?:[A-Za-z]:\\[A-Z]|/(?:home|Users|mnt|private|var)/[A-Za-z0-9])"
LOCAL_CELL = r"^(?:[A-Za-z]:\\|/home/)"
CREDENTIAL = r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}"


def clean_text(x: Column) -> Column:
    """Empty for null; white space of any kind cut off at both ends."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(clean_text(x) != "", x)


def first_known(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def clean_identifier(x: Column) -> Column:
    return F.replace(clean_text(x), F.lit(" "), F.lit(""))


def identifier_format_ok(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(IDENTIFIER)


def check_digit_ok(x: Column) -> Column:
    """The last digit is the sum of the others, from right to left times 1, 2, 3 and so on, modulo 10."""
    digits = F.split(F.reverse(F.regexp_replace(x, "-", "")), "")
    terms = F.transform(F.slice(digits, 2, F.greatest(F.size(digits) - 1, F.lit(0))), lambda d, i: (i + 1) * d.try_cast("int"))
    total = F.aggregate(terms, F.lit(0), lambda a, b: a + b)
    return F.when(identifier_format_ok(x), F.pmod(total, F.lit(10)) == F.get(digits, F.lit(0)).try_cast("int")).otherwise(False)


def parse_labels(x: Column) -> Column:
    """A list literal, or text split at ; , or |, as lower-case labels without blanks; repeats stay."""
    literal = F.regexp_replace(F.regexp_replace(x, r"^\s*\(", "["), r",?\s*\)\s*$", "]")
    listed = F.from_json(literal, "array<string>")
    split = F.split(x, r"[;,|]")
    found = F.when(x.rlike(r"^\s*[\[(]"), F.coalesce(listed, split)).otherwise(split)
    return F.coalesce(F.filter(F.transform(found, lambda v: F.lower(clean_text(v))), lambda v: v != ""), F.array().cast("array<string>"))


def safe_double(x: Column) -> Column:
    """A number, or null for text that is none, and for NaN."""
    number = F.trim(x).try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(x: Column) -> Column:
    """Null for infinite values and NaN."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_label_score(x: Column) -> Column:
    """label, score and status of "label+score", split at the last plus."""
    text = clean_text(x)
    label = F.when(text.contains("+"), clean_text(F.regexp_extract(text, r"(?s)^(.*)\+([^+]*)$", 1))).otherwise(text)
    raw = F.when(text.contains("+"), clean_text(F.regexp_extract(text, r"(?s)^(.*)\+([^+]*)$", 2)))
    score = safe_double(raw)
    status = (
        F.when(x.isNull(), "missing").when(text == "", "empty").when(raw.isNull(), "label_without_score")
        .when(label == "", "missing_label").when(score.isNull(), "score_parse_failed").otherwise("ok")
    )
    return F.struct(F.when(label != "", label).alias("label"), score.alias("score"), status.alias("status"))


def parse_response(x: Column) -> Column:
    """True, false, or null for what is neither."""
    word = F.lower(clean_text(x))
    number = word.try_cast("double")
    return F.when(word.isin(TRUE_WORDS) | (number == 1), True).when(word.isin(FALSE_WORDS) | (number == 0), False)


def level_rank(x: Column) -> Column:
    out = F.lit(0)
    for word, rank in LEVELS.items():
        out = F.when(F.lower(clean_text(x)) == word, rank).otherwise(out)
    return out


def synonym(x: Column, groups: dict[str, Sequence[str]]) -> Column:
    """The name of the group that holds the value in lower case, else the value."""
    out = clean_text(x)
    for name, words in groups.items():
        out = F.when(F.lower(clean_text(x)).isin(list(words)), name).otherwise(out)
    return out


def code_name(x: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for code, name in names.items():
        out = F.when(x == code, name).otherwise(out)
    return out


def presence_score(*columns: Column) -> Column:
    """How many of the columns are neither null nor blank."""
    return sum((clean_text(c.cast("string")) != "").cast("int") for c in columns)


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "__")


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Jaccard similarity of two arrays as sets; `empty` is the value for two empty ones."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(shared, union), F.lit(empty).cast("double"))


def derived_or_source(derived: Column, source: Column) -> Column:
    return F.when(F.size(derived) > 0, derived).otherwise(source)


def tanimoto_bits(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two arrays of 64-bit words."""
    ones = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, n: s + n)
    return F.try_divide(ones(lambda x, y: x.bitwiseAND(y)), ones(lambda x, y: x.bitwiseOR(y)))


def packed_bits(bits: str, width: int = 1024) -> Column:
    """A set of places below width as width / 64 longs, lowest first; a null set is null."""
    word = lambda w: F.aggregate(F.filter(F.col(bits), lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))))
    return F.when(F.col(bits).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(width // 64 - 1)), word))


def bits_on(words: str | Column) -> Column:
    """Number of set bits of packed words."""
    words = F.col(words) if isinstance(words, str) else words
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))


def packed_counts(a: str | Column, b: str | Column, width: int = 1024) -> tuple[Column, Column]:
    """How many bits two packed sets of that width share, and how many either has."""
    words = [(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(width // 64)]
    shared, all_ = (reduce(lambda x, y: x + y, [F.bit_count(f(x, y)) for x, y in words]) for f in (Column.bitwiseAND, Column.bitwiseOR))
    return shared, all_


def packed_tanimoto(a: str | Column, b: str | Column, width: int = 1024) -> Column:
    """Shared over all set bits of two packed sets of that width; null if neither has any."""
    return F.try_divide(*packed_counts(a, b, width))


def rounded_share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole of counts, halves rounded up as F.round does, but in whole numbers rather than through decimal text; null for a whole of 0."""
    scale, whole = 10**digits, F.nullif(whole, F.lit(0)).cast("long")
    return F.call_function("div", part.cast("long") * F.lit(2 * scale) + whole, whole * F.lit(2)) / F.lit(float(scale))


def folded_key(x: Column) -> Column:
    """A key without regard to case and outer white space; blank is null."""
    return blank_to_null(F.lower(clean_text(x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def concordance_class(joint: Column, different: Column, least: int = 2, divergent: float = 0.5) -> Column:
    return (
        F.when(joint < least, "insufficient_data").when(different == 0, "concordant")
        .when(different / joint >= divergent, "divergent").otherwise("indeterminate")
    )


def class_by_thresholds(x: Column, limits: dict[str, float], beyond: str, missing: str = "not_assessed") -> Column:
    """The first class, in order, whose limit the value does not exceed."""
    out = F.lit(beyond)
    for name, limit in reversed(list(limits.items())):
        out = F.when(x <= limit, name).otherwise(out)
    return F.when(x.isNull(), missing).otherwise(out)


def fixed_frame_rmsd(a: Column, b: Column, perms: Column) -> Column:
    """Least root mean square distance of two arrays of x, y, z over the permutations (arrays of places from 0) of the second."""
    square = lambda p, q: sum((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz")
    total = lambda p: F.aggregate(F.transform(p, lambda j, i: square(F.get(a, i), F.get(b, j))), F.lit(0.0), lambda s, v: s + v)
    return F.array_min(F.transform(perms, lambda p: F.sqrt(total(p) / F.size(a))))


def feature_parts(x: Column) -> Column:
    """type, chain, name and number of "type:chain:name:number"; null unless it has all four."""
    p = F.split(x, ":", 4)
    names = ("type", "chain", "name", "number")
    return F.when(F.size(p) == 4, F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def typed_items(x: Column, types: Sequence[str]) -> Column:
    """The features "type:..." of the given types, with the type cut off."""
    return F.transform(F.filter(x, lambda v: F.substring_index(v, ":", 1).isin(list(types))), lambda v: F.regexp_replace(v, "^[^:]*:", ""))


def typed_jaccard(a: Column, b: Column, types: Sequence[str], empty: float | None = 1.0) -> Column:
    """Jaccard of the features "type:..." of the given types, with the type cut off."""
    return jaccard(typed_items(a, types), typed_items(b, types), empty)


def partial_status(ok: str, **missing: Column) -> Column:
    """ok, or PARTIAL_<NAME> of the first flag that is true."""
    out = F.lit(ok)
    for name, flag in reversed(list(missing.items())):
        out = F.when(flag, f"PARTIAL_{name.upper()}").otherwise(out)
    return out


def seed_from(keys: Sequence[Column], part: int = 0) -> Column:
    """A number from seven hex digits of the SHA-256 of the joined keys, plus one; `part` chooses the digits."""
    digest = F.sha2(F.concat_ws("|", *keys), 256)
    return F.conv(F.substring(digest, 1 + 7 * part, 7), 16, 10).cast("long") + 1


def even_share(total: Column, parts: Column, index: Column) -> Column:
    """What part `index`, from 0, gets of a total that is dealt evenly, the remainder first."""
    return F.expr("0").cast("long") + F.floor(total / parts) + (index < F.pmod(total, parts)).cast("long")


def trailing_number(x: Column, prefix: str) -> Column:
    """The integer after a prefix, null for other text."""
    return F.regexp_extract(x, f"^{prefix}(\\d+)$", 1).try_cast("int")


def fixed_decimal(x: Column, digits: int = 3, missing: str = "NA") -> Column:
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", x))


def error_reduction(new: Column, base: Column) -> Column:
    return F.try_divide(new - base, 1 - base)


def grid_size(extent: Column, spacing: float, margin: float = 0.0) -> Column:
    """Points along a box side: the next even number."""
    n = F.ceil((extent + 2 * margin) / spacing).cast("long")
    return n + F.pmod(n, F.lit(2))


def sorted_set(x: Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(x)), sep)


def local_path(x: Column) -> Column:
    """Whether the text begins with a path on somebody's machine."""
    return F.coalesce(x, F.lit("")).rlike(LOCAL_CELL)


def text_issues(x: Column) -> Column:
    """Names of what a text should not hold, joined by "; "."""
    flags = {
        "absolute_path": x.rlike(ABSOLUTE_PATH),
        "credential": x.rlike(CREDENTIAL),
        "nul_byte": x.contains("\0"),
    }
    return F.array_join(F.array_compact(F.array(*[F.when(f, n) for n, f in flags.items()])), "; ")
