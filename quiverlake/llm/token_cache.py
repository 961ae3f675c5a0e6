"""Token counts through a digest cache.

The cache is an append-only Parquet table (content_digest, n_tokens) with a folder for
each tokenizer_digest, in a folder that the cluster shares. A call joins the digests of its contents and of
the tokenizer's file to the stored counts, encodes each distinct content that is
missing once, appends those counts, and reads every answer from the cache.

Content is normalised before it is digested. The normalisation has to keep the count;
the default only makes a null the empty text, since this tokenizer counts every other
difference, white space included.

Defined results: a null text counts as the empty text; equal texts share one cache row;
rows that share an id are counted each by its own text; an empty table gives no rows;
other columns are ignored. A very long text is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, materialise, run_folder

CACHE = "content_digest binary, n_tokens bigint, tokenizer_digest string"
BROADCAST_ROWS = 200_000  # of about 60 bytes
_MODELS: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their counts, by the library that the file belongs to."""
    if path not in _MODELS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _MODELS[path] = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _MODELS[path]


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text", normalise=null_as_empty) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of docs; counts that cache lacks are appended to it."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("text"))
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("content_digest"), "text")
    stored = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    digests = materialise(keyed.select("doc_id", "content_digest", F.octet_length(null_as_empty(F.col("text"))).cast("long").alias("n_bytes")), run_folder(spark, "digests"))
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)  # so that a new cache can be read
    # One row for each distinct content: only digests and ids are grouped, so copies never meet with their texts.
    first = digests.groupBy("content_digest").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("doc_id"))
    missing = materialise(first.join(stored(), "content_digest", "left_anti"), run_folder(spark, "missing"))
    number = missing.count()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), set()
        for batch, text in blocks(batches, "text"):
            names = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new, pa.int64())), pa.array(count([text[i].as_py() for i in new]), pa.int64())], names=["content_digest", "n_tokens"])

    if number:
        chosen = _texts_of(keyed, digests, missing, number).select("content_digest", "text")
        counts = chosen.mapInArrow(encode, "content_digest binary, n_tokens bigint").groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # repeated rows
        counts.select("content_digest", "n_tokens", F.lit(version).alias("tokenizer_digest")).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    # Two calls at once may store a count twice; they are equal. The answers are a table of their own, so that
    # the digest that many documents share is split in the join.
    answers = first.select("content_digest").join(stored(), "content_digest").groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    answers = materialise(answers, run_folder(spark, "answers"))
    return digests.join(answers, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def _texts_of(keyed: DataFrame, digests: DataFrame, missing: DataFrame, number: int) -> DataFrame:
    """The rows of keyed that are to be encoded, at least one for each row of missing.

    While either these rows or all others are few, their ids and digests go to all tasks and no text is shuffled.
    """
    same = lambda few: keyed["doc_id"].eqNullSafe(few["doc_id"]) & (keyed["content_digest"] == few["content_digest"])
    if number <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(missing), same(missing), "left_semi")
    known = digests["doc_id"].eqNullSafe(missing["doc_id"]) & (digests["content_digest"] == missing["content_digest"])
    others = materialise(digests.join(missing, known, "left_anti").select("doc_id", "content_digest"), run_folder(keyed.sparkSession, "known"))
    if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(others), same(others), "left_anti")
    return keyed.join(missing.hint("merge"), same(missing), "left_semi")


def op5_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents through a cache that begins empty."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), run_folder(spark, "token_cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
