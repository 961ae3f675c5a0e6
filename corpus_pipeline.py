"""The corpus pipeline: five stages over documents, each written and read again by the next.

run() applies STAGES in order. All but the last return rows of documents; the last
returns the packed pieces. SQL can't express the tokenizer of the last stage, so there is
no ORACLE_SQL; the tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm.bestfit import pack_documents
from quiverlake.llm.decontaminate import keep_clean
from quiverlake.llm.host_rules import keep_good
from quiverlake.llm.ngram_join import keep_one
from quiverlake.llm.secret_index import mask
from quiverlake.llm.shared import drop_folder, materialise, run_folder, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: 5-word shingles, similarity of 0.8 or more; the smallest doc_id stays."""
    return keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "white", 0, 2048)


def prepared(stage):
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return apply


STAGES = [
    ("quality rules", prepared(quality_rules)),
    ("n-gram Jaccard join", prepared(near_duplicates)),
    ("benchmark decontamination", prepared(decontamination)),
    ("secret scans", prepared(secret_scan)),
    ("best-fit packing", prepared(packing)),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's table is dropped when the next one's is written; the last is read by the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = run_folder(spark, f"pipeline_{name.replace(' ', '_')}")
        docs = materialise(stage(spark, docs, sf_dir), path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
