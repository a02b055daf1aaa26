"""The pipeline's stages, each against what brute force keeps of its own input."""

import zlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import ascii_lower, check_packed, rows_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before = rows_of(docs)
        if name == "language_id":
            assert {d for d, t in before if any(c.isalpha() for c in t)} == {d for d, _ in rows_of(out)}
        if name == "exact_dedup":
            best = {}
            for d, t in before:
                best[ascii_lower(t)] = max(d, best.get(ascii_lower(t), -1))
            assert {d for d, _ in rows_of(out)} == set(best.values())
        if name == "simhash_dedup":
            assert {d for d, _ in rows_of(out)} == brute_kept(before)
        if name == "source_mix":
            assert max(Counter(d for d, _ in rows_of(out)).values()) <= 2
        if name == "packing":
            check_packed(out.collect(), before, 2048)
        else:
            assert out.columns == columns and dict(rows_of(out)).items() <= dict(before).items()
        seen.append(out.count())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == seen[-1] and zlib
