import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import license_rules as lr

from .common import documents, nothing

WORDS = ["MIT", "License", "licence", "the", "GNU", "General", "Public", "CC", "by", "nc", "4", "0", "v2", "or", "later", "version", "3", "under", "Released", "terms", "of", "apache", "é", "MİT", "gpl", "lgpl", "spdx", "identifier", "bsd", "public", "domain", "\n", "all", "rights", "reserved", "x"]
MARKS = [" ", " ", " ", ", ", ".\n", "-", " \x00", "'"]
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """What the module's docstring says, in loops over one text: counts, base places, labels, score and kept places."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in GAP.split(low) if w]
    joined = "".join(f" {w} " for w in words)
    places = []
    for k, rule in enumerate(lr.RULES):
        for m in re.finditer(rule.pattern, joined):
            places.append((joined[: m.start()].count(" ") // 2, m[0].count(" ") // 2, k, rule))

    def beaten(p):
        for q in places:
            inside = q[0] <= p[0] and q[0] + q[1] >= p[0] + p[1] and q[3].priority <= p[3].priority
            if inside and (q[1] > p[1] or (q[3].priority, q[2]) < (p[3].priority, p[2])):
                return True
        return False

    kept = sorted(((p[0], p[1], p[3].label, p[3].priority, p[3].relevance) for p in places if not beaten(p)))
    base = []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        wanted = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    labels = {x for _, x in base}
    return (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, sorted(labels),
            sorted(labels | {k[2] for k in kept}), max((k[4] for k in kept), default=0.0), kept)


def texts(seed, n=250):
    pick = random.Random(seed)
    return ["".join(pick.choice(WORDS) + pick.choice(MARKS) for _ in range(pick.randrange(60))) for _ in range(n)]


def sample(pattern, pick):
    """A text that a rule's expression matches."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            depth, end = 0, at
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                if not depth:
                    break
                end += 1
            inner, at, parts, depth = pattern[at + 1 : end], end + 1, [""], 0
            for x in inner:
                depth += {"(": 1, ")": -1}.get(x, 0)
                if x == "|" and not depth:
                    parts.append("")
                else:
                    parts[-1] += x
            chosen = sample(pick.choice(parts), pick)
            times = 1
            if pattern[at : at + 1] == "?":
                times, at = pick.randrange(2), at + 1
            elif m := re.match(r"\{0,(\d+)\}\?", pattern[at:]):
                times, at = pick.randrange(int(m[1]) + 1), at + m.end()
            out += chosen * times
        elif c == "[":
            end = pattern.index("]", at)
            group, at = pattern[at + 1 : end], end + 1
            chosen = "w" if group[0] == "^" else "7" if group == "0-9" else pick.choice(group)
            at += pattern[at : at + 1] == "+"
            out += chosen
        else:
            follow = pattern[at + 1 : at + 2]
            out += "" if follow == "?" and pick.randrange(2) else c
            at += 2 if follow == "?" else 1
    return out


def test_table():
    assert 200 < len(lr.RULES) and [(r.pattern.split(), r.label) for r in lr.RULES[:4]] == [(w.split(), x) for w, x in lr.BASE]
    assert all(r.needs[0] in lr.ANCHORS and lr.TAG <= r.priority <= lr.CLUE and 0 < r.relevance <= 1 for r in lr.RULES)
    assert lr.signature("(a b|c)? d {0,3} e") == "( a  b | c )? d ( [^ ]+ ){0,3}? e "


def test_every_match_has_the_keywords():
    pick = random.Random(5)
    for rule in lr.RULES:
        for _ in range(12):
            text = sample(rule.pattern, pick)
            assert re.fullmatch(rule.pattern, text), (rule, text)
            assert all(n in text for n in rule.needs), (rule, text)


def rows_of(found):
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(p) for p in r.detections]) for r in found.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(8)
    made = ["lead  " + ", ".join(sample(r.pattern, pick).upper() for r in pick.sample(lr.RULES, 3)) for _ in range(150)]
    long = "Released under the MIT License. " * 3000 + "word " * 50_000 + "CC BY-NC 4.0"
    known = ["SPDX-License-Identifier: GPL-2.0-or-later", "licensed under the GNU General Public License, version 3.", "mıt license", "ＭIT license", "public KDE domain", "cc by cc by cc by", long]
    rows = [(1000 + i, t, *[None] * 9) for i, t in enumerate([*texts(1), *made, *known])]
    return documents(spark, rows).select("doc_id", "text", "lang", F.lit("x").alias("label")).cache()  # a clashing name


def order(row):
    return [(x is not None, x) for x in row]


def test_against_the_docstring(docs):
    got = sorted(rows_of(lr.scan_licenses(docs)), key=order)
    want = sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=order)
    assert got == want


def test_known_texts(spark):
    known = {
        "Licensed under CC BY-NC 4.0.": ["cc-by", "cc-by-nc-4.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl", "gpl-3.0"],
        "version 2 of the GNU Lesser General Public License": ["lgpl-2.0"],
        "GNU GPL v3 or any later version": ["gpl-3.0-or-later"],
        "SPDX-License-Identifier: Apache-2.0": ["apache-2.0"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy": ["mit"],
        "All Rights Reserved.": ["proprietary"],
        "a license to drive": [],
    }
    found = lr.scan_licenses(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in found.collect()} == dict(enumerate(known.values()))


def test_sql(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    nothing(spark).write.parquet(str(tmp_path / "none/documents.parquet"))
    for sf in (str(tmp_path), str(tmp_path / "none"), "/root/testdata/sf0.001"):
        if not os.path.isdir(sf):
            continue
        at = f"{sf}/documents.parquet"
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
        df = lr.op13_license_rules(spark, sf)
        found = con.execute(lr.OP13_SQL)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=order) == sorted(found.fetchall(), key=order)


def test_no_python_in_the_plan(spark, tmp_path):
    nothing(spark).write.parquet(str(tmp_path / "documents.parquet"))
    plan = lr.op13_license_rules(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "MapInPandas", "ExistingRDD", "Cartesian", "NestedLoop"))
