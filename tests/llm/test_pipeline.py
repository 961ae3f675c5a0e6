"""The pipeline against a version that follows each stage's rule in plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quiverlake.llm.shared import materialise, run_folder

from .common import rows
from .test_decontaminate import best
from .test_ngram_join import plain as plain_groups
from .test_rules import plain as plain_counts
from .test_secrets import plain as plain_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the benchmark asks what the small red fox did on the way to the old mill by the river"


def corpus():
    pick = random.Random(11)
    word = lambda: "".join(pick.choices("abcdefghij", k=pick.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(pick.randrange(25, 120)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", texts[1] + " words", texts[2].upper()]
    texts += [prose(40) + ". " + ITEM.upper() + "! " + prose(10), prose(30) + " " + ITEM.replace("small", "smal")]
    texts += [prose(30) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(5), prose(3), "spam " * 50, prose(900)]
    out = [(1000 + i, t, "en", "ok", len(t)) for i, t in enumerate(texts)]
    out += [(2000 + i, "spam " * 50 if i % 10 else prose(60), "en", "farm", 1) for i in range(60)]
    out += [(3000 + i, prose(60) if i % 10 else "spam " * 50, "en", "fine", 1) for i in range(60)]
    return [*out, *(r[:5] for r in rows() if r[0] is not None)]


def kept_by_hosts(docs):
    """Documents that pass the base rules and whose host's shrunk rate of failures is half at most."""
    failed = [(c := plain_counts(r[1] or ""))[0] < 20 or 100 * c[4] > 30 * c[0] for r in docs]
    hosts = {}
    for r, f in zip(docs, failed, strict=True):
        n, m = hosts.get(r[3], (0, 0))
        hosts[r[3]] = n + 1, m + f
    rates = {h: m * 10**6 // n for h, (n, m) in hosts.items()}
    mean = sum(rates.values()) / len(hosts) / 1e6
    between = sum(x * x for x in rates.values()) / len(hosts) / 1e12 - mean**2 - sum(rates[h] * (10**6 - rates[h]) // n for h, (n, _) in hosts.items()) / len(hosts) / 1e12
    strength = min(max(mean * (1 - mean) / between - 1, 1), 1000) if between > 0 else 1000
    bad = {h for h, (n, m) in hosts.items() if (m + mean * strength) / (n + strength) > 0.5}
    assert "farm" in bad and not {"ok", "fine"} & bad
    return [r for r, f in zip(docs, failed, strict=True) if not f and r[3] not in bad]


def fold(text):
    """Lower-case letters and digits; any other run is one space."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip(" ")


def expected(docs):
    docs = kept_by_hosts(docs)
    low = {(d, c) for d, _, c in plain_groups([r[:2] for r in docs], 5, 80)}
    docs = [r for r in docs if (r[0], r[0]) in low]
    item = fold(ITEM)
    clean = [r for r in docs if best(item, fold(r[1])) > min(len(item) * 9 // 100, (len(item) - 9) // 9)]
    assert len(docs) - len(clean) == 2
    docs = clean
    out = []
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs:
        text = r[1]
        if plain_spans(text):
            text = re.sub(r'token = "[0-9a-f]{40}', "[assign]", text)
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        out += [(r[0], k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, part in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048))]
    return sorted(out)


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(docs)
    for s in {r.sequence_id for r in got}:
        places = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 2048


def test_stages_keep_the_columns(spark, tmp_path):
    clashes = "tokens, host, host_rejected, bad_host, _gone, _id, cls, rep, n, s, kind, block, g, root".split(", ")
    docs = spark.createDataFrame([(*r, *("x" for _ in clashes)) for r in corpus()], COLUMNS + "".join(f", {c} string" for c in clashes))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = materialise(out, run_folder(spark, "stage"))
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
