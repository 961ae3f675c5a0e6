import contextlib
import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest

from quiverlake.llm import ngram_join as nj
from quiverlake.llm.components import components
from quiverlake.llm.shared import materialise, run_folder

from .common import documents, nothing, twins


def plain_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def plain(rows, width, percent):
    """(doc_id, size, component) of (doc_id, text) rows, by comparing all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    low = {}
    for r, (d, _) in zip(root, rows, strict=True):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), low[r]) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def corpus(seed, n):
    pick = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(30))
    base = [[f"w{pick.randrange(5000)}" for _ in range(pick.choice([2, 5, 30, 120]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(pick.choice(base[: 3 if i % 2 else None]))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5])):
            w[pick.randrange(len(w))] = f"e{pick.randrange(10**6)}"
        text = " ".join(w).replace("w1", "W1" if pick.random() < 0.5 else "w1")
        rows.append((i, text + (" " + common if i % 4 == 0 else "")))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 100)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(nj, "FREQUENT", 5)
    rows = corpus(seed, 260)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in nj.similar_groups(docs, width, percent).collect()), key=str)
    assert got == plain(rows, width, percent)
    kept = {r.doc_id for r in nj.keep_one(docs, width, percent).collect()}
    assert kept == {d for d, _, c in got if d == c}


def test_odd_rows(spark):
    docs = documents(spark)
    got = sorted((tuple(r) for r in nj.similar_groups(docs).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert nj.similar_groups(nothing(spark)).count() == 0 == nj.keep_one(nothing(spark)).count()


def test_one_row_of_each_component_stays(spark):
    one, two, three, four = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [(1, one), (1, one), (2, one), (2, two), (3, three), (None, three), (None, three), (None, four), (None, four), (4, ""), (4, ""), (None, None), (5, two)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, `cls.a` string").repartition(3)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (2, two), (3, three), (None, four), (4, ""), (4, ""), (None, None)], key=str)


def test_words_of_equal_polynomial_hashes(spark):
    a, b = twins(11)
    shared = "p q r s t u"
    rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, a), (4, b), (5, a), (6, f"{a} x y z w {b}"), (7, f"{b} x y z w {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in nj.similar_groups(docs).collect()) == plain(rows, 4, 85)


def test_long_texts(spark):
    pick = random.Random(9)
    long = [f"v{pick.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-3])), (3, " ".join(reversed(long))), (4, "x" * 3_000_000), (5, "x" * 3_000_001), (6, "x " * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_groups(docs).collect()}
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 3, 4, 5, 6] and got[6][0] == 1 == got[4][0] and got[1][0] == len(plain_set(rows[0][1], 4))


def test_shingles_are_sets():
    grams, bounds = nj.shingles(pa.array(["a b a b a b", "", "A b", "a b"]), 2)
    assert (bounds[1:] - bounds[:-1]).tolist() == [2, 0, 1, 1] and grams[2] == grams[3]
    names = nj.set_names(*nj.shingles(pa.array(["a b c", "b a", "c b a", "A B C"]), 1))
    assert names[0] == names[2] == names[3] != names[1]


def test_star_rounds(spark):
    pick = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(pick.randrange(2000, 2200), pick.randrange(2000, 2200)) for _ in range(150)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_lists_are_paired_in_cells(spark, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 5)
    monkeypatch.setattr(nj, "LIST_ROWS", 7)
    rows = corpus(6, 240)
    got = sorted((tuple(r) for r in nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 70).collect()), key=str)
    assert got == plain(rows, 3, 70)


def test_private_counts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c x y z"), (3, "a b c d e f"), (4, "q r s"), (5, None)]
    for parts in (1, 5):
        members = nj.profile(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 2, "doc_id", "text")
        got = {r.doc_id: (r.n, r.s) for r in members.collect()}
        assert got[2] == (5, 3) and got[4] == (2, 2) and got[5] == (0, 0)
        assert got[1] == got[3] and got[1] in ((5, 3), (5, 0))  # a copy in another block counts as another set


def shuffle_files(spark):
    """The data files of Spark's shuffles that are on disk."""
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")))


@contextlib.contextmanager
def no_shuffle_files(spark):
    """What runs within leaves no shuffle files, though the driver collects no garbage; Spark deletes them a little later."""
    before = shuffle_files(spark)
    yield
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left


def test_shuffle_files_go_with_their_job(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000).repartition(3, "id")
    with no_shuffle_files(spark):
        table = materialise(rows, run_folder(spark, "rows"))
    assert spark.conf.get(key, None) is None
    assert table.count() == 1000 == rows.count() == rows.count()
    spark.conf.set(key, "false")
    assert materialise(rows, run_folder(spark, "rows")).count() == 1000 and spark.conf.get(key) == "false"
    spark.conf.unset(key)
    sets = spark.createDataFrame([(i, 2, 0, [7, i]) for i in range(40)], "cls bigint, n int, s int, grams array<bigint>")
    with no_shuffle_files(spark):
        assert nj.frequent_grams(sets)[0].tolist() == [7]


def test_tables_that_nothing_reads_are_dropped(spark):
    docs = spark.createDataFrame(corpus(8, 120), "doc_id long, text string")
    folder = Path(run_folder(spark, "x").removeprefix("file://")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    groups = nj.similar_groups(docs)
    names = [p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before]
    assert "ngram_members" in names and not {"ngram_profile", "ngram_chosen", "ngram_sets", "ngram_lists", "ngram_pairs", "ngram_labelled_lists"} & set(names)
    assert groups.count() == 120


@pytest.mark.parametrize("few", [True, False])
def test_few_ids_that_go_are_sent_to_the_documents(spark, monkeypatch, few):
    monkeypatch.setattr(nj, "BROADCAST_IDS", 1000 if few else 0)
    rows = corpus(8, 120)
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"), run_folder(spark, "documents"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, size in ((docs, 120), (docs.unionAll(docs.limit(1)), 121)):
            kept = nj.keep_one(table, 3, 70)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("LeftAnti, BuildRight" in plan) == few == ("SortMergeJoin [doc_id" not in plan), size
            assert {r.doc_id for r in kept.collect()} == {d for d, _, c in plain(rows, 3, 70) if d == c}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
