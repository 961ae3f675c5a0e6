import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import target_resample as tr

from .common import documents, nothing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = ["The", "cat", "İstanbul", "größe", "日本語", "42", "K", "ǅ", "a"]
MARKS = [" ", " ", ", ", "\n", "-", "\x00", "_"]


def grams(text, orders=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, orders=2, percent=25, least=20, seed=7):
    """The contract in loops: doc_id, n_words, n_features, weight, score, rank."""
    each = [(i, *grams(text, orders)) for i, text in docs]
    s, t = Counter(b for _, _, found in each for b in found), Counter(b for text in target for b in grams(text, orders)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for i, n, found in each:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=order)


def order(row):
    return [(x is not None, x) for x in row]


def texts(seed, n=300):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) + pick.choice(MARKS) for _ in range(pick.randrange(60))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=order)


@pytest.mark.parametrize("orders,percent,least", [(2, 25, 20), (3, 40, 5), (1, 100, 0)])
def test_against_the_contract(spark, orders, percent, least):
    more = [(1000 + i, t, *[None] * 9) for i, t in enumerate([*texts(3), "cat " * 30_000, "größe" * 20_000])]
    docs, target = documents(spark, more), spark.createDataFrame([(1, t, 5) for t in [*texts(4, 20), None, ""]], "item_id long, text string, doc_id int")
    got = tr.resample(docs, target, orders=orders, percent=percent, least_words=least)
    assert rows_of(got) == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], orders, percent, least)


def test_empty_tables(spark):
    empty = nothing(spark)
    assert tr.resample(empty, empty).count() == 0
    docs = documents(spark)
    assert rows_of(tr.resample(docs, empty)) == plain([(r.doc_id, r.text) for r in docs.collect()], [])


def test_ranks_over_many_ranges_and_ties(spark):
    scored = spark.range(5000).select(F.col("id").alias("_row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 4).alias("score"), (F.col("id") % 5 > 0).alias("able"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r._row: r["rank"] for r in tr.ranked(scored, F.col("able"), 30).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    able = sorted((r for r in scored.collect() if r.able), key=lambda r: (-r.score, r.doc_id, r._row))
    want = {r._row: k + 1 for k, r in enumerate(able[: len(able) * 30 // 100])}
    assert got == {k: want.get(k) for k in range(5000)}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    df, found = tr.op11_target_resample(spark, sf), con.execute(tr.OP11_SQL)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=order) == sorted(found.fetchall(), key=order)
