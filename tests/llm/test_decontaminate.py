import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from quiverlake.llm import decontaminate as dc

from .common import documents, nothing


def folded(text):
    chars, _, bounds = dc.fold([text])
    return "".join(map(chr, chars[:-1])).strip(" ")


def best(item, text):
    """Edit distance of item to its best stretch of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def worn(pick, text, edits):
    s = list(text)
    for _ in range(edits):
        at = pick.randrange(len(s)) if s else 0
        s[at : at + 1] = pick.choice([[], [*s[at : at + 1], "x"], ["y"]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(300))
def test_banded_alignment(seed):
    pick = random.Random(seed)
    item = words(pick, pick.choice([1, 3, 8]))
    text = words(pick, pick.randrange(3)) + worn(pick, item, pick.randrange(4)) + words(pick, pick.randrange(3))
    arrays = [np.array([ord(c) for c in s], np.uint32) for s in (item, text)]
    (n,), (end,) = dc.banded(arrays[:1], arrays[1:], [len(text) + 1], True)
    assert n == best(item, text) and best(item, text[:end]) == n
    (m,), (size,) = dc.banded([arrays[0][::-1]], [arrays[1][:end][::-1]], [int(n)], False)
    assert m == n and best(item, text[end - size : end]) == n


def words(pick, n):
    return " ".join("".join(pick.choices("abcde", k=pick.randrange(2, 6))) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_finds_exactly_what_the_edit_bound_says(seed):
    pick = random.Random(seed)
    items = [words(pick, pick.choice([3, 8, 20, 40])) for _ in range(8)]
    index = dc.Items(list(enumerate(items)))
    names = {"".join(map(chr, c)): i for i, c in enumerate(index.chars)}
    texts = []
    for _ in range(60):
        part = worn(pick, pick.choice(items), pick.randrange(8))
        texts.append(pick.choice(["", words(pick, 30) + ". "]) + part + pick.choice(["", "!! " + words(pick, 20)]))
    found = {(row, k): n for row, item, a, b, n in index.find(texts) for k in index.ids[item]}
    for row, text in enumerate(texts):
        for item in range(len(items)):
            n = best(folded(items[item]), folded(text))
            assert found.get((row, item)) == (n if n <= index.edits[names[folded(items[item])]] else None), (row, item, n)


def test_places_are_of_the_original_text():
    item = "The quick brown fox, jumps over the lazy dog -- again and again."
    text = "Ünd   davor:\n" + item.upper().replace(" ", "!!  ") + " nach"
    ((row, _, a, b, n),) = dc.Items([(7, item)]).find(["", text, ""])
    assert row == 1 and n == 0 and text[a:b].startswith("THE!!") and text[a:b].endswith("AGAIN")
    changed = item.replace("brown", "brXwn")
    ((_, _, a, b, n),) = dc.Items([(7, item)]).find(["zzz " + changed + " zzz"])
    assert n == 1 and ("zzz " + changed + " zzz")[a:b] == changed[:-1]


def test_short_and_odd_items():
    index = dc.Items([(1, "cat"), (2, "Cat!"), (3, ""), (4, None), (5, "...")])
    assert [(r, index.ids[i], a, b) for r, i, a, b, _ in index.find(["a CAT, here", "concatenate", "", "cat"])] == [(0, [1, 2], 2, 5), (3, [1, 2], 0, 3)]
    assert dc.Items([]).find(["a"]) == []


def test_qgrams_depend_on_their_characters_only():
    x = np.arange(50, dtype=np.uint32) % 7
    for q in (1, 2, 3, 5, 10, 12):
        g = dc.qgrams(x, q)
        assert len(g) == 51 - q and len(set(g.tolist())) == len({tuple(x[i : i + q]) for i in range(51 - q)})
    assert len(dc.qgrams(x[:3], 10)) == 0


def test_on_tables(spark):
    item = "never gonna find this passage in the wild, as it is only planted here"
    items = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (None, "", "z"), (3, item.upper(), "x")], "item_id long, text string, doc_id string")
    docs = documents(spark, [(60, "so. " + item + "!", *[None] * 9)])
    assert sorted(tuple(r)[:2] for r in dc.leaks(docs, items).collect()) == [(60, 1), (60, 3)]
    clean = dc.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1 and clean.where("doc_id = 60").count() == 0
    many = list(dc.item_blocks(items, most=50))
    assert len(many) > 1 and sum(map(len, (x.chars for x in many))) >= 1
    assert dc.leaks(nothing(spark), items).count() == 0 == dc.leaks(docs, items.limit(0)).count()
    assert dc.keep_clean(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("seed", range(4))
def test_repetitive_items_and_small_slices(seed, monkeypatch):
    monkeypatch.setattr(dc, "SLICE_BANDS", 50)
    monkeypatch.setattr(dc, "CELLS", 200)
    monkeypatch.setattr(dc, "MANY_PLACES", 2)
    pick = random.Random(seed)
    prompt = words(pick, 12)
    items = ["ab" * 60, "a" * 120, "abc " * 30, *(f"{prompt} {words(pick, 6)}" for _ in range(8))]
    index = dc.Items(list(enumerate(items)))
    names = {"".join(map(chr, c)): i for i, c in enumerate(index.chars)}
    texts = ["ab" * 400, "a" * 300 + "b" + "a" * 100, "abc " * 200, "x".join(["ab" * 20] * 9), prompt, prompt + " " + prompt, *(worn(pick, x, 4) + " " + prompt for x in items)]
    found = {(row, k): n for row, item, a, b, n in index.find(texts) for k in index.ids[item]}
    for row, text in enumerate(texts):
        for item in range(len(items)):
            n = best(folded(items[item]), folded(text))
            assert found.get((row, item)) == (n if n <= index.edits[names[folded(items[item])]] else None), (row, item, n)


def test_many_short_items():
    pick = random.Random(3)
    items = sorted({words(pick, 1) for _ in range(300)}) + ["a b", "b c"]
    texts = [words(pick, pick.randrange(40)) for _ in range(200)] + ["a b c", " a b", "", "x" * 9]
    index = dc.Items(list(enumerate(items)))
    got = {(row, index.ids[item][0], a, b) for row, item, a, b, _ in index.find(texts)}
    want = {(row, k, (f" {t} ").index(f" {x} "), (f" {t} ").index(f" {x} ") + len(x)) for row, t in enumerate(texts) for k, x in enumerate(items) if f" {x} " in f" {t} "}
    assert got == want


MEMORY = """
import random, resource
from quiverlake.llm import decontaminate as dc
pick = random.Random(1)
prose = lambda n: " ".join("".join(pick.choices("abcdefghijklmnop", k=6)) for _ in range(n))
assert dc.Items([(1, "a" * 500)]).find(["a" * 5_000_000]) == [(0, 0, 0, 500, 0)]
prompt = prose(40)
items = [(k, prompt + " " + prose(12)) for k in range(10_000)]
found = dc.Items(items).find([prose(400_000) + " " + items[77][1] + " " + prose(100_000), prose(100) + " " + prompt + " " + prose(100)])
assert [(row, item, n) for row, item, _, _, n in found] == [(0, 77, 0)], found
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20  # kB
"""


def test_memory_is_bounded_for_periodic_texts_and_shared_prompts():
    subprocess.run([sys.executable, "-c", MEMORY], check=True, cwd=Path(__file__).resolve().parents[2])
