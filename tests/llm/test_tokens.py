import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quiverlake.llm import bestfit, token_cache, token_files
from quiverlake.llm.encode import PieceEncoder
from quiverlake.llm.shared import run_folder

from .common import documents, nothing, twins

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "B", " ", "  ", "\n", "\n\n", " \n", "\n ", "é", " ", "\t", "'s", "don't", "12", "<|endoftext|>", "!!", "日本", "́", "\u0085", "\u001c", "ß", "İ", "Σ", "×", ".", "\r\n", "😀", "\x01"]


@pytest.mark.parametrize(("path", "rule"), [(BYTE, "gpt"), (WORD, "white")])
@pytest.mark.parametrize("kept", [5, 500_000])
def test_pieces_give_the_ids_of_whole_texts(path, rule, kept):
    pick = random.Random(7)
    texts = ["".join(pick.choices(PARTS, k=pick.randrange(30))) for _ in range(3000)]
    mine = PieceEncoder(path, rule, kept)
    for at in range(0, len(texts), 500):
        ids, bounds = mine.encode(pa.array(texts[at : at + 500]))
        for k, e in enumerate(Tokenizer.from_file(path).encode_batch(texts[at : at + 500], add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids


def test_long_texts():
    text = "some words that go on, and on " * 250_000
    for path, rule in ((BYTE, "gpt"), (WORD, "white")):
        ids, bounds = PieceEncoder(path, rule).encode(pa.array(["x", text, "y"]))
        assert ids[bounds[1] : bounds[2]].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("power", [10, 11, 12])
def test_texts_of_equal_polynomial_hashes(spark, power):
    texts = [*twins(power), *twins(power, "x", "y")]
    for path, rule in ((BYTE, "gpt"), (WORD, "white")):
        ids, bounds = PieceEncoder(path, rule).encode(pa.array(texts))
        for k, e in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t, whole = Tokenizer.from_file(WORD), {}
    for r in bestfit.pack_documents(docs, WORD, "white", 0, 2048, with_ids=True).orderBy("doc_id", "piece").collect():
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    token_files.write_token_files(docs, path := run_folder(spark, "t"), BYTE, "gpt", 2)
    t = Tokenizer.from_file(BYTE)
    assert {r.doc_id: r.tokens for r in token_files.read_token_files(spark, path).collect()} == {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    docs, path = documents(spark), run_folder(spark, "t")
    token_files.write_token_files(docs, path, BYTE, "gpt", 2, partitions=3, page_rows=2)
    got = sorted(tuple(r) for r in token_files.token_digests(token_files.read_token_files(spark, path)).collect() if r.doc_id is not None)
    t, start, want = Tokenizer.from_file(BYTE), 0, []
    for doc_id, text in sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(x for x in want if x[0] is not None)
    some = token_files.read_token_files(spark, path, ["doc_id", "n_tokens"], F.col("doc_id").between(3, 5))
    assert "tokens" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0].replace("n_tokens", "")
    assert sorted(r.doc_id for r in some.collect()) == [3, 4, 5]
    files = pa.fs.FileSystem.from_uri(path)[0].get_file_info(pa.fs.FileSelector(f"{path.removeprefix('file://')}/data"))
    meta = [pq.ParquetFile(f.path).metadata for f in files if f.path.endswith(".parquet")]
    group = next(m for m in meta if m.num_rows > 2).row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and kinds["tokens.list.element"].has_dictionary_page
    assert kinds["doc_id"].has_column_index and kinds["doc_id"].has_offset_index


def test_token_files_of_nothing(spark):
    path = run_folder(spark, "t")
    token_files.write_token_files(nothing(spark), path, BYTE, "gpt", 2)
    assert token_files.token_digests(token_files.read_token_files(spark, path)).count() == 0


@pytest.mark.parametrize("few", [0, 2, 200_000])
def test_cache_encodes_each_content_once(spark, monkeypatch, few):
    import sentencepiece

    monkeypatch.setattr(token_cache, "BROADCAST_ROWS", few)
    docs, cache = documents(spark), run_folder(spark, "c")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    for _ in range(2):
        assert Counter(tuple(r) for r in token_cache.count_tokens(docs, PIECE, cache).collect()) == want
        assert spark.read.parquet(cache).count() == len({r.text or "" for r in docs.collect()})
    assert token_cache.count_tokens(nothing(spark), PIECE, cache).count() == 0
    token_cache.count_tokens(docs, WORD, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer_digest").distinct().count() == 2


def test_counts_of_long_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["some words that go on, and on " * 100_000, "x" * 100_000, "\n" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(docs, PIECE, run_folder(spark, "c")).collect()}
    assert got == {k: len(model.encode(t)) for k, t in enumerate(texts)}


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(capacity - n)
        else:
            room[room.index(fit)] -= n
    return sorted(room)


@pytest.mark.parametrize("seed", range(30))
def test_histogram_packing_is_best_fit_decreasing(seed):
    pick = random.Random(seed)
    capacity = pick.choice([1, 7, 50, 128])
    lengths = [pick.randint(1, capacity) if seed % 3 else pick.choice([1, capacity, max(1, capacity // 3)]) for _ in range(pick.randrange(1, 400))]
    placed, sequences = bestfit.best_fit_decreasing(Counter(lengths), capacity)
    used, counts = [[] for _ in range(sequences)], Counter(lengths)
    for k, (length, rank, first, each, offset) in enumerate(placed):
        end = next((r for n, r, *_ in placed[k + 1 :] if n == length), counts[length])
        for i in range(end - rank):
            used[first + i // each].append((offset + i % each * length, length))
    for places in used:
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in used) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("ranked", [7, 200_000])
def test_packing_documents(spark, monkeypatch, ranked):
    monkeypatch.setattr(bestfit, "RANKED", ranked)
    more = [(i, "word " * (i % 37), None, None, None, None, None, None, None, None, None) for i in range(100, 300)]
    docs = documents(spark, more)
    got = bestfit.pack_documents(docs, WORD, "white", 0, 64).collect()
    t, want = Tokenizer.from_file(WORD), Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.update((r.doc_id, k, 64 * k, len(ids[64 * k : 64 * k + 64]), crc(ids[64 * k : 64 * k + 64])) for k in range(-(-len(ids) // 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and min(x)[0] == 0 and sum(n for _, n in x) <= 64
    assert len(places) == len(plain_best_fit([r.length for r in got], 64))
    assert bestfit.pack_documents(nothing(spark), WORD, "white", 0, 64).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = documents(spark)
    packed = bestfit.pack_documents(docs, WORD, "white", 0, 64, with_ids=True)
    pieces = packed.collect()
    whole = {r.sequence_id: r.ids for r in bestfit.sequences(packed).collect()}
    assert all(0 < len(x) <= 64 for x in whole.values()) and len(whole) == len({r.sequence_id for r in pieces})
    for r in pieces:
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert part == r.ids and crc(part) == r.ids_crc32
