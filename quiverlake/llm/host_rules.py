"""Quality rules with host-level verdicts.

Each document is measured by itself (words, symbols, repeated lines and windows) and
fails the base rules or not. Failures are then counted by host. A host's rate is shrunk
towards the corpus by a beta prior that is fitted to the hosts' own rates by the method
of moments, so a host of three documents isn't condemned by one of them. Hosts whose
shrunk rate passes the limit are rejected, and that verdict is joined back to their
documents. A document is kept if it passes the base rules and its host isn't rejected.

The prior is computed in whole numbers (rates in millionths), so its sums don't depend
on the order of rows. Counting by host combines within each task first; only the
rejected hosts are joined back, by broadcast while there are few of them and else by a
shuffled join whose skewed hosts Spark splits.

Defined results: a null text has no words and fails; so does an empty one; a null host is
a host of its own; equal rows are judged each; an empty table gives no rows; other
columns are ignored by score() and passed on by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, chained, distinct, materialise, run_folder, text_buffers, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
HOST_LIMIT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
BROADCAST_HOSTS = 50_000
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row."""
    n_rows = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": np.bincount(rows, minlength=n_rows), "word_chars": total(inside & (data & 0xC0 != 0x80)), "n_symbols": total(SYMBOL[data])}
    # Lines: cut at line feeds and at the rows' ends.
    feeds = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_end = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    seen = np.concatenate([[0], np.cumsum(inside)])
    wordy = seen[line_end] > seen[line_start]
    line_start, line_end = line_start[wordy], line_end[wordy]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line = distinct(data, line_start, line_end)[1]
    order = np.lexsort((line, line_row))
    again = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out["n_dup_lines"] = np.bincount(line_row[order][1:][again], minlength=n_rows)
    twice = repeated_windows(distinct(data, starts, ends)[1], rows, WINDOW)
    cover = np.zeros(len(rows) + 1, np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n_rows)
    return {k: v.astype(np.int64) for k, v in out.items()}


def repeated_windows(word: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The first word of each window that occurs twice or more in its row, from the words' numbers.

    A hash brings likely equals together; windows count as equal only if all their words are.
    """
    first = windows(rows, width)
    if not len(first):
        return first
    value = word.astype(np.uint64)
    hashes, row = chained([value[first + k] for k in range(width)]), rows[first]
    order = np.lexsort((hashes, row))
    hashes, row, first = hashes[order], row[order], first[order]
    alike = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    equal = alike.copy()
    left = np.flatnonzero(alike)
    for k in range(width):
        equal[left] &= word[first[left] + k] == word[first[left + 1] + k]
    found = np.zeros(len(first), bool)
    if (equal == alike).all():
        found[1:] |= equal
        found[:-1] |= equal
        return np.sort(first[found])
    some = np.zeros(len(first), bool)  # unequal windows share a hash: group by the words themselves
    some[1:] |= alike
    some[:-1] |= alike
    first, row = first[some], row[some]
    _, which, number = np.unique(np.stack([row, *(word[first + k] for k in range(width))], axis=1), axis=0, return_inverse=True, return_counts=True)
    return np.sort(first[number[which.ravel()] > 1])


def with_counts(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id (null without an id column), host, COUNTS and base_failed of each document."""
    fields = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, "text"):
            m = measure(*text_buffers(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(m[c]) for c in COUNTS), pa.array(base_failed(m))], schema=fields)

    rows = docs.select((F.lit(None) if id_col is None else F.col(id_col)).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, host string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean")


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta prior from the table of hosts with their documents n and failures f."""
    rate = hosts.select("n", F.expr("f * 1000000 div n").alias("x"))
    k, x, xx, noise = rate.agg(
        F.count("*"), F.sum("x"), F.sum(F.expr("cast(x * x as decimal(38, 0))")), F.sum(F.expr("cast(x * (1000000 - x) div n as decimal(38, 0))"))).first()
    return beta(k, int(x or 0), int(xx or 0), int(noise or 0))


def beta(k: int, x: int, xx: int, noise: int) -> tuple[float, float]:
    """From k hosts: sums of their rates, of squared rates and of the rates' own sampling variance, in millionths."""
    if not k:
        return LEAST_STRENGTH / 2, LEAST_STRENGTH / 2
    mean = x / k / 1e6
    between = max(xx / k / 1e12 - mean * mean - noise / k / 1e12, 0.0)
    spread = mean * (1 - mean)
    strength = min(max(spread / between - 1 if between > 0 else MOST_STRENGTH, LEAST_STRENGTH), MOST_STRENGTH)
    return mean * strength, (1 - mean) * strength


def bad_hosts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rejected hosts (bad_host, host_rejected), read from a table, with a broadcast hint while they are few."""
    spark = counts.sparkSession
    hosts = materialise(counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), run_folder(spark, "hosts"))
    a, b = prior(hosts)
    bad = hosts.where((F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b)) > limit).select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected"))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return F.broadcast(bad) if few else bad


def score(docs: DataFrame, limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and host_rejected of each document."""
    counts = materialise(with_counts(docs, **columns), run_folder(docs.sparkSession, "rule_counts"))
    bad = bad_hosts(counts, limit)
    judged = counts.join(bad, counts["host"].eqNullSafe(bad["bad_host"]), "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are measured once and never shuffled: what passes the base rules is stored as it is measured, what fails
    only as its host.
    """
    spark = docs.sparkSession
    fields = T.StructType([T.StructField("row", docs.schema), T.StructField("host", docs.schema[host_col].dataType), T.StructField("base_failed", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, text_col):
            failed = pa.array(base_failed(measure(*text_buffers(text))))
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema), mask=failed)
            yield pa.RecordBatch.from_arrays([row, batch.column(batch.schema.get_field_index(host_col)), failed], names=["row", "host", "base_failed"])

    judged = materialise(docs.mapInArrow(judge, fields), run_folder(spark, "judged"))
    host = F.col("host").cast("string")
    bad = bad_hosts(judged.select(host.alias("host"), "base_failed"), limit).select("bad_host")
    return judged.where("NOT base_failed").join(bad, host.eqNullSafe(F.col("bad_host")), "left_anti").select("row.*")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents, with their source as host."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH tokens AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM tokens)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tokens)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, t.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM tokens t LEFT JOIN lines l ON t.doc_id = l.doc_id LEFT JOIN covered c ON t.doc_id = c.doc_id
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS f FROM failed GROUP BY source
), sums AS (
  SELECT count(*) AS k, sum(x)::DOUBLE AS x, sum(x * x)::DOUBLE AS xx, sum(x * (1000000 - x) // n)::DOUBLE AS noise
  FROM (SELECT n, f * 1000000 // n AS x FROM hosts)
), moments AS (
  SELECT x / k / 1e6 AS mean, greatest(xx / k / 1e12 - (x / k / 1e6) * (x / k / 1e6) - noise / k / 1e12, 0) AS between_hosts FROM sums
), prior AS (
  SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE 1000 END, 1), 1000) AS strength FROM moments
), verdicts AS (
  SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS host_rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""
