"""Hierarchical language identification.

A linear support vector machine for each language family tells it from the
others; within the chosen family, one machine for each pair of languages votes.
Features are hashed byte n-grams of the whole text in lower case, padded with a
space, each weighed by its share of the text. The machines are fitted on a
bounded sample of labelled documents (at most `per_lang` distinct texts for each
language, chosen by a hash of the text); every language with a label is learned;
prediction reads every text as a whole and looks at nothing but the text.

Defined results: a text that is null or has no letter is "und" with score 0;
without any labelled document every text is "und"; a language that is not in
FAMILIES is a family of its own; repeated rows are judged each; an empty table
gives an empty result; extra columns are carried by `filter_languages`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from quillon.llm.common import bounded_batches, materialize, maybe_broadcast

#: Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ca", "gl", "ro", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "sinitic": ["zh", "yue"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS, ORDERS = 1 << 12, (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are hashed together.
CHUNK = 1 << 20


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def _hashed(buf: np.ndarray, seen: int) -> list[np.ndarray]:
    """For each order, the features of all n-grams that don't lie wholly in the first `seen` bytes."""
    codes, out = np.zeros(len(buf), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        codes = codes[: len(buf) - n + 1] * np.uint32(0x01000193) ^ buf[n - 1 :]
        if n in ORDERS:
            mixed = codes[max(seen - n + 1, 0) :] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out.append((mixed >> np.uint32(33 - DIMS.bit_length())).astype(np.int64))
    return out


def _bytes_of(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "surrogatepass")


def features(text: str) -> np.ndarray:
    """Share of each hashed n-gram, as a dense vector of unit length."""
    out = np.zeros(DIMS)
    raw = _bytes_of(text)
    for at in range(0, len(raw), CHUNK):
        seen = min(at, max(ORDERS) - 1)
        buf = np.frombuffer(raw[at - seen : at + CHUNK], np.uint8).astype(np.uint32)
        for h in _hashed(buf, seen):
            out += np.bincount(h, minlength=DIMS)
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """weights: DIMS x machines; the first machines are the families', then come those of pairs (winner if positive, else the other)."""

    families: tuple[str, ...]
    members: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or text is None or not _LETTER.search(text):
            return "und", 0.0
        margins = features(text) @ self.weights + self.bias
        f = int(np.argmax(margins[: len(self.families)]))
        family = self.families[f]
        langs = self.members[family]
        score = 1 / (1 + np.exp(-4 * float(margins[f]))) if len(self.families) > 1 else 1.0
        if len(langs) == 1:
            return langs[0], score
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), m in zip(self.pairs, margins[len(self.families) :].tolist(), strict=True):
            if a in votes and b in votes:
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        best = max(langs, key=lambda x: (votes[x], sums[x], x))
        return best, min(score, 1 / (1 + np.exp(-4 * sums[best] / (len(langs) - 1))))


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss, L2) by dual coordinate descent; y is +1 or -1. The last weight is the bias."""
    rng = np.random.default_rng(0)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    norm = (x * x).sum(axis=1)
    top = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(texts_features: np.ndarray, langs: list[str]) -> LanguageModel:
    known = sorted(set(langs))
    families = tuple(sorted({family_of(x) for x in known}))
    members = {f: tuple(x for x in known if family_of(x) == f) for f in families}
    lang, fam = np.array(langs), np.array([family_of(x) for x in langs])
    found = []
    for f in families:
        found.append(fit_svm(texts_features, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(DIMS), 1.0))
    pairs = tuple(p for f in families for p in combinations(members[f], 2))
    for a, b in pairs:
        own = (lang == a) | (lang == b)
        found.append(fit_svm(texts_features[own], np.where(lang[own] == a, 1.0, -1.0)))
    weights = np.stack([w for w, _ in found], axis=1) if found else np.zeros((DIMS, 0))
    return LanguageModel(families, members, pairs, weights, np.array([b for _, b in found]))


def training_rows(id_col: str = "doc_id"):
    """Documents that may be learned from, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(True))


def learn_languages(docs: DataFrame, *, per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most per_lang distinct labelled texts of each language.

    These are ones that training_rows leaves; the sample is bounded, and
    vectors of features are all that comes to the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & training_rows(id_col))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *[F.xxhash64(F.lit(seed), text_col).alias(h) for seed, h in ((11, "_h"), (12, "_h2"))])
    # Of frequent languages a part by hash that holds twice as many is enough to choose from, so no task ranks all of one.
    space = 1 << 30
    distinct = known.select("lang", "_h", "_h2").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    limits = materialize(distinct.select("lang", F.least(F.lit(space), F.floor(F.lit(space * (2 * per_lang + 50)) / F.col("n"))).alias("_to")), "languages")
    near = known.join(maybe_broadcast(limits, 100), "lang").filter(F.pmod("_h", F.lit(space)) < F.col("_to")).dropDuplicates(["lang", "_h", "_h2"])
    first = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(space)), "_h", "_h2")
    sample = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_lang).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t).astype(np.float32).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["lang"], pa.array(made, pa.binary())], ["lang", "x"])

    rows = sorted(map(tuple, sample.mapInArrow(vectors, "lang string, x binary").collect()))
    if not rows:
        return LanguageModel((), {}, (), np.zeros((DIMS, 0)), np.zeros(0))
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in rows]), [lang for lang, _ in rows])


def _judge(docs: DataFrame, model: LanguageModel):
    """A function from texts to (lang, score), in one pass over the texts and without a shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x machines at most

    @F.pandas_udf("lang string, score double")
    def judge(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return judge


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with _lang and _score, in place of columns of these names."""
    told = docs.select(F.struct("*").alias("row"), _judge(docs, model)(F.col(text_col)).alias("told"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("_lang", "_score")]
    return told.select(*kept, F.col("told.lang").alias("_lang"), F.col("told.score").alias("_score"))


def language_report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = learn_languages(docs, id_col=id_col, **options)
    text_col = options.get("text_col", "text")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict_languages(own, model).select("doc_id", (~training_rows()).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def filter_languages(docs: DataFrame, *, min_score: float = 0.0, **options) -> DataFrame:
    """The documents, all columns, whose language is told with at least min_score; "und" goes."""
    model = learn_languages(docs, **options)
    judged = _judge(docs, model)(F.col(options.get("text_col", "text")))
    told = docs.select(F.struct("*").alias("row"), judged.alias("told"))
    return told.filter((F.col("told.lang") != "und") & (F.col("told.score") >= min_score)).select("row.*")
