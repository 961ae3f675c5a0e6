import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quiverlake.llm import fill_middle as fm
from quiverlake.llm.shared import text_buffers

from .common import documents, nothing

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "größe", "日本", " ", "\n", "\t\t", "\x1f", " ", "x" * 30, "<P", ">", "😀", "\x0b", ""]


def plain(doc_id, text):
    """The contract, by Python's own regular expressions over code points."""
    units = UNIT.findall(text or "")
    n, text = len(units), text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out


def key(row):
    return tuple((x is not None, x) for x in row)


def texts(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices(PARTS, k=pick.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("every,window", [(1, 7), (3, 5), (64, 1 << 20), (4, 64)])
def test_checkpoints_and_cuts(every, window):
    rows = [*texts(every, 200), "", " ", "", "a b " * 500, ""]
    raw, offsets = text_buffers(pa.array(rows))
    index = fm.count_units(raw, offsets, every, window)
    units = [UNIT.findall(t) for t in rows]
    assert index.n_units.tolist() == [len(u) for u in units]
    assert len(index.row) == sum(len(u) // every + 1 for u in units)
    for cut in ("first", "half", "last"):
        places = np.array([{"first": 0, "half": len(u) // 2, "last": len(u)}[cut] for u in units])
        byte, point = fm.locate(index, raw, offsets, np.arange(len(rows)), places)
        done = ["".join(u[:k]) for u, k in zip(units, places.tolist(), strict=True)]
        starts = np.cumsum([0, *map(len, rows)])
        assert (byte - offsets[:-1]).tolist() == [len(d.encode()) for d in done] and (point - starts[:-1]).tolist() == [len(d) for d in done]


def test_nothing_to_count():
    for rows in ([], ["", ""]):
        index = fm.count_units(*text_buffers(pa.array(rows, pa.string())))
        assert index.n_units.tolist() == [0] * len(rows) and index.unit.tolist() == [0] * len(rows)


def test_against_the_contract(spark):
    more = [(1000 + i, t, *[None] * 9) for i, t in enumerate([*texts(9, 600), "a <P> b", "<S><M>", "word " * 40_000 + "größe", "y" * 300_000, "\n" * 5000])]
    docs = documents(spark, more)
    got = fm.fill_in_middle(docs)
    both = got.select("*", fm.restored(got.output, got.form).alias("back")).collect()
    want = [plain(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:6] for r in both), key=key) == sorted(want, key=key)
    assert sorted(r.back for r in both) == sorted(r.text or "" for r in docs.collect())
    assert {r.form for r in both} == {"plain", "spm", "psm"}
    assert fm.fill_in_middle(nothing(spark)).count() == 0


def test_other_marks_and_rates(spark):
    docs = spark.createDataFrame([(i, f"one two <P> {i} three", i) for i in range(50)], "k long, body string, n int")
    got = fm.fill_in_middle(docs, percent=100, spm_percent=0, marks=("[pre]", "[suf]", "[mid]"), id_col="k", text_col="body")
    back = got.select("doc_id", "form", "output", fm.restored(got.output, got.form, ("[pre]", "[suf]", "[mid]")).alias("back")).collect()
    assert all(r.form == "psm" and r.output.startswith("[pre]") and r.back == f"one two <P> {r.doc_id} three" for r in back)


def test_query_equals_its_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
        sf = str(tmp_path)
    got = fm.op12_fill_middle(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet{'/*.parquet' if os.path.isdir(f'{sf}/documents.parquet') else ''}')")
    found = con.execute(fm.OP12_SQL)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(found.fetchall(), key=key)
