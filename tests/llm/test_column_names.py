"""Stages and operators that keep other columns do so whatever those are called."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import paragraph_dedup

SF = "/root/testdata/sf0.001"
NAMES = (
    "score", "lang_pred", "__text", "__bad", "__hit", "__gone", "__id", "row", "id", "item", "t", "p", "it", "ip", "hid", "seed", "share", "node", "fp",
    "component_id", "fingerprint", "a.b", "back`tick", "with space", "kind", "start",
)


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    return given.select(*given.columns, *(F.lit(f"v{k}").alias(n) for k, n in enumerate(NAMES)))


def test_stages_keep_clashing_columns(spark, docs):
    import corpus_pipeline

    plain = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept, want = stage(spark, docs, SF), stage(spark, plain, SF)
        assert kept.columns == docs.columns, name
        got = kept.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r.doc_id for r in want.collect()), name
        assert all(r[len(plain.columns) :] == tuple(f"v{k}" for k in range(len(NAMES))) for r in got), name
    assert corpus_pipeline.pack(spark, docs, SF).count() >= docs.count()


def test_paragraph_removal_keeps_clashing_columns(docs):
    out = paragraph_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
