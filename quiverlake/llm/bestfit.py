"""Packing documents into sequences by best-fit decreasing.

Lengths are whole numbers up to the capacity, so the packing of the whole corpus is
decided from its histogram: one count for each length, whatever the corpus holds. The
driver runs best-fit decreasing over that histogram. Open bins are kept by remaining
capacity in a segment tree that finds the tightest fitting one in logarithmic time;
bins of equal capacity are handled as runs, so equal lengths are placed together and
the state stays bounded by the capacity. The result is a list of intervals: the pieces
of one length with ranks a to b go to sequences from s on, m to a sequence, from an
offset on. Tasks then look up their own pieces by length and rank. This equals placing
the pieces one by one in descending order of length.

Ranks within a length are dealt by salt, as many salts as the length's pieces ask for, so
that a length that most pieces share is numbered by many tasks at any size.

Defined results: a null text is the empty text, which is one end id; a document longer
than the capacity is cut into full pieces and a last one; pieces of the capacity get a
sequence each; ties of length are ordered by salt, doc_id and piece; rows that share an
id are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder
from .shared import batch_of, blocks, materialise, run_folder
from .token_files import with_end

RANKED = 200_000  # pieces that one task numbers, about


class TightestFit:
    """Segment tree over remaining capacities 0..capacity; each leaf tells whether runs of bins are open there."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, number)

    def _mark(self, at: int) -> None:
        node = at + self.width
        self.any[node] = bool(self.runs[at])
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def put(self, remaining: int, first: int, number: int) -> None:
        if number and remaining:
            bisect.insort(self.runs[remaining], (first, number))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop(0)
        self._mark(remaining)
        return run

    def find(self, least: int) -> int:
        """The smallest remaining capacity of at least `least` with an open bin, or -1."""
        node = least + self.width
        while not self.any[node]:
            while node & 1:
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
        while node < self.width:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, first rank, first sequence, pieces to a sequence, offset), and the number of sequences."""
    tree, out, sequences = TightestFit(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room < 0:
                each = capacity // length
                first, number, room = sequences, -(-left // each), capacity
                sequences += number
            else:
                first, number = tree.take(room)
                each = room // length
            full = min(number, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                tree.put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last few go to one more bin
                out.append((length, rank, first + full, each, capacity - room))
                tree.put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            tree.put(room, first + full, number - full)
    return out, sequences


def cut_pieces(docs: DataFrame, tokenizer: str, rule: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each document, and their ids if asked for."""
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] * with_ids)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, rule)
        for batch, text in blocks(batches, "text"):
            ids, bounds = with_end(*codec.encode(text), end_id)
            number = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(batch.num_rows), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            first = bounds[row] + start
            length = np.minimum(capacity, bounds[row + 1] - first)
            raw = memoryview(ids.astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(first, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))] * with_ids  # pieces follow each other
            yield batch_of(fields, batch.column(0).take(pa.array(row)), piece, start, length, sums, *lists)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to pieces with a column length from 1 to capacity.

    pieces is evaluated three times (for the counts of lengths, of salts and for the places), so it should be read from a table.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    number = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        number[length] = -(-n // RANKED)
    many = F.create_map(*[F.lit(int(x)) for length in np.flatnonzero(number > 1) for x in (length, number[length])]) if (number > 1).any() else None
    salts = F.lit(1) if many is None else F.coalesce(many[F.col("length").cast("int")], F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), salts).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_number")).collect()  # a row for each RANKED pieces and for each length
    totals: dict[int, int] = {}
    base = np.concatenate([[0], np.cumsum(number)])
    before = np.zeros(base[-1], np.int64)  # of salt s of length n at base[n] + s
    for length, salt, n in sorted(groups):
        before[base[length] + salt] = totals.get(length, 0)
        totals[length] = totals.get(length, 0) + n
    placed, _ = best_fit_decreasing(totals, capacity)
    table = np.array(placed, np.int64).reshape(-1, 5)
    width = np.int64(1) << 44  # more than any rank
    low = table[:, 0] * width + table[:, 1]
    order = np.argsort(low)
    low, table = low[order], table[order]
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((base, before, low, table))  # capacity numbers, and one for each RANKED pieces
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    ranked = salted.withColumn("_rank", rank.cast("long"))
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, before, low, table = shared.value
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            length, salt, rank = get("length"), get("_salt"), get("_rank")
            rank = rank + before[base[length] + salt]
            rows = table[np.searchsorted(low, length * width + rank, side="right") - 1]
            more, within = np.divmod(rank - rows[:, 1], rows[:, 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(rows[:, 2] + more), pa.array(rows[:, 4] + within * length)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, rule: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places."""
    pieces = materialise(cut_pieces(docs, tokenizer, rule, end_id, capacity, with_ids=with_ids), run_folder(docs.sparkSession, "pieces"))
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces with ids; each is of the capacity at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def op6_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), "white", 0, 2048)
