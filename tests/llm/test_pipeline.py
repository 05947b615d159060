import pytest

import corpus_pipeline
from loomline.llm import registry

from .helpers import rows, table


def test_stages_on_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == docs.columns, name
        docs = out
        assert docs.count() > 0.8 * n
    assert docs.columns[:2] == ["doc_id", "n_tokens"]
    assert len(corpus_pipeline.STAGES) == 5


def test_run_agrees_with_itself(spark, sf_dir):
    a, b = (sorted(corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("data", [rows(), []], ids=["odd", "empty"])
def test_every_stage_stands_odd_rows(spark, sf_dir, data):
    for name, stage in corpus_pipeline.STAGES:
        docs = table(spark, data)
        out = stage(spark, docs, sf_dir)
        found = out.collect()
        assert name == "bpe" or out.columns == docs.columns
        if name == "secret_scan" or name == "bpe":
            assert len(found) == len(data)
        elif data:
            assert 0 < len(found) and {r.doc_id for r in found} <= {d[0] for d in data}


def test_rejected_documents_go_and_clean_ones_stay(spark, sf_dir):
    docs = table(spark)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()}
    letters = {d[0] for d in rows() if any(c.isalpha() for c in d[1] or "")}
    assert kept <= letters and len(letters - kept) <= 2
    unlabelled = table(spark, [(*d[:2], None, *d[3:]) for d in rows()])
    assert corpus_pipeline.STAGES[0][1](spark, unlabelled, sf_dir).count() == len(rows())
