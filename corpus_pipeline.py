"""Corpus cleaning in five stages. Each takes what its predecessor kept, written and read again, and decides on all of it.

1. toxicity: documents that the classifier rejects go; it learns from the labels that operator 6 may learn from.
2. near_duplicates: one document of each class stays, that of the least doc_id.
3. decontamination: documents that hold a window of any benchmark item go.
4. secrets: spans of credentials are masked in the text, and n_chars follows; no document goes.
5. bpe: the documents' token ids, with digests of the ids and of the text they decode to.

Toxic texts go first so that a class of near duplicates is represented by an accepted text.

Defined cases: null and empty texts are accepted, clean and without secrets or tokens, and one row of them all stays, as
they are equal texts; null doc_ids are ids like others and come last where the least one stays; of repeated rows one
stays; ties within a class go to the least doc_id, then the least text hash; an empty table gives an empty result with
the same columns; extra columns, also of names that operators use inside, pass through all stages but the last, which
returns its own columns. Stages decide by row, so texts that share a doc_id are decided each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontaminate, near_dup, secret_scan, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, toxicity.learnable(labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(docs, keep=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, outputs=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: No SQL: classifier, sampling and tokenizer are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
