import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quiverlake.llm import host_rules
from quiverlake.llm.shared import text_buffers

from .common import DOCS, documents, nothing, twins


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("seed", range(5))
def test_counts(seed):
    pick = random.Random(seed)
    parts = ["a", "b", " ", " ", "\n", "é", "#", " x", "\t", " ", "日", "\x0b", "\x1c", "\x85", "|"]
    texts = ["".join(pick.choices(parts, k=pick.choice([0, 3, 30, 300]))) for _ in range(400)] + ["", "", "a b c d e f g h " * 5]
    m = host_rules.measure(*text_buffers(pa.array(texts)))
    assert list(zip(*(m[c].tolist() for c in host_rules.COUNTS), strict=True)) == [plain(t) for t in texts]


def test_counts_of_long_texts_and_equal_polynomial_hashes():
    words = [f"w{i * i % 9973}" for i in range(700_000)]
    texts = ["\n".join(twins(10)), "\n".join(twins(12)), " ".join(twins(10, "a ", "b ")), " ".join(words), "x" * 3_000_000, "\n".join(["same line"] * 200_000)]
    m = host_rules.measure(*text_buffers(pa.array(texts)))
    assert list(zip(*(m[c].tolist() for c in host_rules.COUNTS), strict=True)) == [plain(t) for t in texts]
    assert m["n_dup_lines"].tolist() == [0, 0, 0, 0, 0, 199_999]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(host_rules, "chained", lambda parts: parts[0] * 0)
    test_counts(1)


def test_beta_prior():
    assert host_rules.beta(0, 0, 0, 0) == (0.5, 0.5)
    a, b = host_rules.beta(2, 1_000_000, 10**12, 0)  # rates 0 and 1: no two hosts alike
    assert a == b == 0.5
    a, b = host_rules.beta(3, 300_000, 3 * 10**10, 0)  # all the same: strongest
    assert (round(a), round(b)) == (100, 900)


def hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "spam " * 40
    rows = [(i, good, None, "fine", 1, *[None] * 6) for i in range(300)]
    rows += [(1000 + i, bad if i % 10 else good, None, "farm", 1, *[None] * 6) for i in range(300)]
    rows += [(2000, good, None, "small", 1, *[None] * 6), (2001, bad, None, "small", 1, *[None] * 6), *((2100 + i, good, None, "small", 1, *[None] * 6) for i in range(3)), (2002, good, None, None, 1, *[None] * 6)]
    return spark.createDataFrame(rows, DOCS)


def test_bad_host_loses_its_good_documents(spark):
    out = {r.doc_id: r for r in host_rules.score(hosts(spark)).collect() if r.doc_id >= 100}
    assert all(out[i].kept for i in range(100, 300)) and not any(out[1000 + i].kept for i in range(300))
    assert not out[1000].base_failed and out[1000].host_rejected
    assert out[2000].kept and not out[2001].kept and out[2002].kept


def test_keep_good_passes_rows_on(spark):
    docs = hosts(spark)
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in host_rules.score(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert host_rules.keep_good(nothing(spark)).count() == 0 == host_rules.score(nothing(spark)).count()
    assert host_rules.score(documents(spark)).count() == documents(spark).count()
