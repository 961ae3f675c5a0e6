"""Token-id files: Parquet shards of token lists that can be read selectively.

Layout of a set of files at `path`:
    data/    one shard for each range of document ids, rows in ascending id order:
             doc_id (delta encoded), part, part_start (ids before it in its part),
             n_tokens, tokens (list of ids, dictionary encoded)
    parts/   one row for each shard: part, first and last doc_id, rows, ids, and
             the number of ids in all shards before it

Row groups and pages are of controlled size and carry column and page indexes, so a
reader of metadata never touches the token pages, and a reader of a few documents
reads the pages that hold them.

Defined results: a null text is the empty text; an empty text still has its end id;
rows with a null id come first; rows that share an id are in the order of a hash of
their texts; other columns of the input are ignored; an empty table gives no rows.
A very long text is encoded whole, in the one task that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import encoder
from .shared import blocks, partitions_for, run_folder

SHARD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
])
PARTS = "part int, first_doc_id bigint, last_doc_id bigint, n_docs bigint, n_tokens bigint, start bigint"


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each row's ids."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def tokenise(docs: DataFrame, tokenizer: str, rule: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SHARD for each partition of docs, in the partition's order."""
    fields = pa.schema([("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, start = encoder(tokenizer, rule), 0
        for batch, text in blocks(batches, "text"):
            ids, bounds = with_end(*codec.encode(text), end_id)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
            ], schema=fields)
            start += int(bounds[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(encode, "doc_id bigint, part_start bigint, n_tokens bigint, tokens array<int>")
    return out.select("doc_id", F.spark_partition_id().alias("part"), "part_start", "n_tokens", "tokens")


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, rule: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
    partitions: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
) -> None:
    """Encode docs and write the files. Text is dealt by ranges of the id once; the ids are never shuffled.

    An id of very many rows is dealt to several ranges, by hashes of its texts and numbers of its rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = "doc_id", "_hash", "_row"
    keyed = named.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(partitions or partitions_for(docs), *order).sortWithinPartitions(*order)
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    tokenise(ordered, tokenizer, rule, end_id).write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/data")
    shards = spark.read.schema(SHARD).parquet(f"{path}/data").groupBy("part").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The documents at path: doc_id, start, n_tokens, tokens, or those of these columns that are asked for.

    A condition on doc_id reaches the Parquet reader, which then skips row groups and
    pages; without "tokens" among the columns no token page is read.
    """
    data, parts = spark.read.schema(SHARD).parquet(f"{path}/data"), spark.read.schema(PARTS).parquet(f"{path}/parts")
    if where is not None:
        data = data.where(where)
    out = data.join(parts.select("part", "start"), "part").withColumn("start", F.col("start") + F.col("part_start"))
    return out.select(columns or ["doc_id", "start", "n_tokens", "tokens"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows with the column tokens."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            lists = lists.cast(pa.large_list(pa.int32()))
            bounds = lists.offsets.to_numpy().tolist()
            raw = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], schema=fields)

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of documents and return what is read back from them."""
    import public_tokenizers

    path = run_folder(spark, "token_files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), "gpt", 2)
    return token_digests(read_token_files(spark, path))
