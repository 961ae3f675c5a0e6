"""Resampling documents by their likeness to target texts, over hashed n-grams.

A position table holds a row for each word: posexplode gives words their places, and lead()
over a document's window puts the following words beside each, so that one row yields the
n-grams of every order that begin there. N-grams are hashed into a fixed number of buckets.
Counting the buckets of all documents and of all target texts gives each bucket a gain, the
logarithm of how much likelier it is in the target; a document's weight is the mean gain of
its n-grams. Adding Gumbel noise, drawn from a hash of the id, to the weights and taking the
highest sums draws documents without replacement in proportion to exp(weight / 1000).

Texts are dealt once, by row; their words are numbered, sorted and windowed where they then
lie. The position table is stored as bucket numbers and scanned twice: for the counts, and
for the weights beside the broadcast gains, a row for each bucket. Ranks come from sorted
ranges of about equally many rows and the ranges' counts, whatever the scores are.

Defined results: null and empty texts, and texts without words, have no features and weight
0; a null id is hashed like the empty string and ranks behind others of the same score; rows
that share an id are separate documents with the same draw; other columns of both tables are
ignored; without target texts all gains follow from the documents alone; empty tables are fine.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_folder, materialise, partitions_for, run_folder

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
TEXT_BYTES = 16 << 20  # of stored documents for a task: its words take some fifteen times as much


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def position_table(docs: DataFrame, orders: int = 2, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, and b1, b2, ... for each word: the buckets of the n-grams of each order that begin there, null where the text ends before.

    A document without words has one row, of nulls.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    dealt = texts.repartition(partitions_for(docs, TEXT_BYTES), "_row")
    pieces = dealt.select("_row", "doc_id", F.posexplode(F.split("_text", GAP)).alias("_pos", "_piece"))
    # a text that begins or ends between words has an empty piece there; it is no word and ends n-grams
    words = pieces.select("_row", "doc_id", "_pos", F.when(F.col("_piece") != "", lowered(F.col("_piece"))).alias("_w0"))
    place = Window.partitionBy("_row").orderBy("_pos")
    table = words.select("_row", "doc_id", *[(F.lead("_w0", k).over(place) if k else F.col("_w0")).alias(f"_w{k}") for k in range(orders)])
    grams = [F.concat(*[x for j in range(k + 1) for x in (F.lit(" "), F.col(f"_w{j}"))][1:]) for k in range(orders)]
    return table.select("_row", "doc_id", *[(F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"b{k + 1}") for k, gram in enumerate(grams)])


def bucket_counts(table: DataFrame) -> DataFrame:
    """bucket and n, over all orders: a row for each bucket at most."""
    parts = [table.groupBy(F.col(b).alias("bucket")).agg(F.count("*").alias("n")) for b in table.columns if b not in ("_row", "doc_id")]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, for every bucket, of two tables of counts."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for side, name in ((source, "s"), (target, "t")):
        both = both.join(F.broadcast(side.select("bucket", F.col("n").cast("double").alias(name))), "bucket", "left").fillna(0.0, [name])
    whole = Window.partitionBy()  # a row for each bucket
    odds = (F.col("t") + 1) * (F.sum("s").over(whole) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def weigh(table: DataFrame, gains: DataFrame) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight of each document of a position table."""
    columns = [b for b in table.columns if b not in ("_row", "doc_id")]
    gained = table
    for b in columns:
        gained = gained.join(F.broadcast(gains.select(F.col("bucket").alias(b), F.col("gain").alias(f"_g{b}"))), b, "left")
    total, number = F.lit(0), F.lit(0)
    for b in columns:
        total, number = total + F.coalesce(F.col(f"_g{b}"), F.lit(0)), number + F.col(b).isNotNull().cast("int")
    sums = gained.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.count("b1").alias("n_words"), F.sum(number).alias("n_features"), F.sum(total).alias("_gain"))
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("_gain") / F.col("n_features"))).otherwise(0)
    return sums.select("_row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousandfold draw of the standard Gumbel distribution, floored, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add rank: 1, 2, 3, ... for the eligible rows of the highest scores, `percent` of them; null for others.

    scored needs _row, doc_id and score, and should be stored: sorting by ranges reads it twice.
    """
    spark = scored.sparkSession
    order = F.desc("_eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")
    ranged = scored.withColumn("_eligible", eligible).repartitionByRange(partitions_for(scored), *order).sortWithinPartitions(*order)
    stored = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), run_folder(spark, "ranks"))  # range << 33 | place in it
    counts = stored.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count("*").alias("_n"), F.count_if("_eligible").alias("_m"))
    before, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row for each range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.floor(F.sum("_m").over(whole) * percent / 100).alias("_drawn"))
    joined = stored.withColumn("_range", F.shiftright("_place", 33)).join(F.broadcast(starts), "_range")
    rank = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.withColumn("rank", F.when(F.col("_eligible") & (rank <= F.col("_drawn")), rank).cast("long")).drop("_range", "_eligible", "_place", "_start", "_drawn")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, orders: int = 2, buckets: int = BUCKETS, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document; `percent` of those of `least_words` words or more are drawn."""
    spark, folders = docs.sparkSession, [run_folder(docs.sparkSession, "positions") for _ in range(2)]
    table = materialise(position_table(docs, orders, buckets, id_col, text_col), folders[0], compression="zstd")
    wanted = materialise(position_table(target.select(F.lit(None).alias("doc_id"), F.col(target_text_col).alias("text")), orders, buckets), folders[1], compression="zstd")
    gains = materialise(bucket_gains(bucket_counts(table), bucket_counts(wanted), buckets), run_folder(spark, "gains"))
    weighed = weigh(table, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialise(weighed, run_folder(spark, "scores"))
    for folder in folders:
        drop_folder(spark, folder)
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a quarter of those of 20 words or more drawn towards the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


OP11_SQL = rf"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))
), texts AS (
  SELECT row_number() OVER () AS k, doc_id, true AS source, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), words AS (
  SELECT k, doc_id, source, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT k, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM words
), coded AS (
  SELECT gram, hex(encode(gram)) AS digits FROM (SELECT DISTINCT gram FROM grams)
), hashed AS (
  SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(c // 256, crcs[xor(c, x) % 256 + 1]))) % 10000 AS bucket
  FROM coded, crc_table
), features AS (
  SELECT k, source, bucket FROM grams JOIN hashed USING (gram)
), counts AS (
  SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM features GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (total_s + 10000) / ((s + 1)::DOUBLE * (total_t + 10000)))) AS gain
  FROM counts, (SELECT sum(s)::DOUBLE AS total_s, sum(t)::DOUBLE AS total_t FROM counts)
), weights AS (
  SELECT k, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE source GROUP BY k
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (k) WHERE source
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
