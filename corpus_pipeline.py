"""The corpus pipeline: language ID, near-dedup, secret scan, source mix and BPE, each over all that its predecessor kept.

Stages 1 to 4 return the columns of documents; the last one returns a row of token digests per row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, dedup, langid, mixing, secret_scan
from loomline.llm.common import written
from loomline.llm.queries_tokens import vocabulary_path

#: A document whose language is less sure than this is rejected, as is one without letters.
LEAST_SCORE = 0.2
SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised. Labels come from lang; lang itself stays as it is. Without any label nothing can be rejected."""
    model = langid.fit(docs)
    if not model.langs:
        return docs
    found = langid.predict(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return dedup.deduplicate(docs, percent=SIMILARITY)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; n_chars follows the text. No document is dropped."""
    return secret_scan.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix holds it."""
    mixed = mixing.mix_sources(docs, carry=True).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of whole texts, as counts and digests; the ids were decoded again."""
    return bpe.encode_documents(docs, vocabulary_path(), keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secrets_out),
    ("source_mix", source_mix),
    ("bpe", tokens),
]

#: Models and tokenizers can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
