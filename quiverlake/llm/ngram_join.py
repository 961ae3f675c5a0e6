"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

Two documents link if 100 * intersection >= percent * union of their sets of n-grams.
N-grams are 64-bit hashes, and the order of hashes is the global order that is cut into
fragments. The work runs in these steps:

1. Private n-grams, fragment by fragment. Every block of documents sends each distinct
   n-gram once to the fragment it falls in; a fragment finds those that occur nowhere
   else and counts them by document. The counts of all fragments are summed. If s of a
   document's n are private, its overlap with any other is n - s at most, which leaves
   only documents of which nearly all n-grams are shared: copies and near copies.
2. The sets of those documents are kept, one for each distinct set.
3. Candidates: in the global order, with very frequent n-grams moved to its end, linked
   sets share one of their first n - ceil(t * n) + 1 n-grams. Members of one such list
   are not all paired. First each is paired with its neighbour and with the list's most
   central member, and the links found give components. Then only members of different
   components are paired, and only if sizes, private counts and the n-gram's places in
   the two orders allow a link. A linked pair passes in the list of its first common
   n-gram, so rows of lists further on are not needed.
4. Candidates are verified by fragments: the overlap of each fragment's segments is
   counted by itself and summed for each pair.
5. Connected components over all links.

Equal sets are one node from the start, so copies are never paired. No list is cut.

Words of more than seven bytes and sets are told apart by 64 bits of BLAKE2b, n-grams by
64 bits mixed from their words' hashes; nothing else is approximate. A false link between
two texts would need such a collision in about every sixth of their n-grams, or in the
names of their sets.

Defined results: without words (or text) a document has no n-grams and links with
nothing; with fewer words than n, the whole sequence is one n-gram. Equal rows link.
A null id is no candidate for component_id, so a component of such rows alone has a null
one. Rows that share an id are separate documents. An empty table gives no rows; other
columns are ignored. A very long text is handled whole in the task that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .components import components
from .shared import FOLD, blocks, chained, drop_folder, materialise, mix, partitions_for, run_folder, shuffles_dropped, slices, text_buffers, window_hashes, windows, word_hashes, words

FRAGMENTS = 4  # of the order, when pairs are verified
SCATTER = 4  # fragments for each shuffle partition, when private n-grams are found
FREQUENT, MOST_FREQUENT = 16, 200_000
SEND_BYTES = 4 << 20
SLICE_GRAMS = 400_000  # handled at once by a task
LIST_ROWS = 20_000  # of a list that one task pairs; longer ones are cut into blocks that meet two by two
BROADCAST_LISTS = 100_000
BROADCAST_SETS = 1_000_000  # of 20 bytes each
BROADCAST_IDS = 1_000_000  # of rows that go
HELD_GRAMS = 8_000_000  # counts that a task gathers before it sends them on

PROFILE = "kind int, doc_id bigint, cls bigint, n int, block bigint, idx int, own int, part int, data binary"
PROFILE_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("block", pa.int64()), ("idx", pa.int32()), ("own", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def shingles(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all rows in ascending order within each row, and the bounds of the rows."""
    data, offsets = text_buffers(text)
    data = FOLD[data]
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    first = windows(rows, width)
    grams, gram_rows = window_hashes(hashes, width)[first], rows[first]
    count = np.bincount(rows, minlength=len(text))
    for k in range(1, width):  # texts of fewer words are one n-gram
        few = np.flatnonzero(count == k)
        at = np.searchsorted(rows, few)
        grams, gram_rows = np.concatenate([grams, chained([hashes[at + j] for j in range(k)])]), np.concatenate([gram_rows, few])
    order = np.lexsort((grams, gram_rows))
    grams, gram_rows = grams[order], gram_rows[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (gram_rows[1:] != gram_rows[:-1])
    return grams[fresh], np.searchsorted(gram_rows[fresh], np.arange(len(text) + 1))


def set_names(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name of each row's set: the first 64 bits of BLAKE2b over its n-grams in ascending order."""
    raw = memoryview(grams.astype("<u8")).cast("B")
    names = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(names), "<i8").astype(np.int64)


def _profile(width: int, parts: int):
    """Rows of kind 0 (a document: its set's name, size, block and number there, and how many n-grams no other set of
    the block has) and 1 (n-grams of a block for a fragment: 32 bits of each, and the owners of those that have one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch, text in blocks(batches, "text", SEND_BYTES):
            grams, bounds = [], [np.zeros(1, np.int64)]
            for _, part in blocks(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), "text"):
                g, b = shingles(part, width)
                grams.append(g)
                bounds.append(b[1:] + bounds[-1][-1])
            grams, bounds = np.concatenate(grams), np.concatenate(bounds)
            names = set_names(grams, bounds)
            _, first, idx = np.unique(names, return_index=True, return_inverse=True)
            rows = len(names)
            fill = lambda v, t, k: pa.array(np.full(k, v), t)
            # One copy of each set, then one copy of each n-gram; those of several sets have no owner.
            sizes = np.diff(bounds)[first]
            take = np.repeat(bounds[:-1][first] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            grams, owner = grams[take], np.repeat(np.arange(len(first)), sizes)
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = grams[1:] != grams[:-1]
            alone = new.copy()
            alone[:-1] &= new[1:]
            own = np.bincount(owner[alone], minlength=len(first))
            yield pa.RecordBatch.from_arrays([
                fill(0, pa.int32(), rows), batch.column(0), pa.array(names), pa.array(np.diff(bounds), pa.int32()), fill(block, pa.int64(), rows),
                pa.array(idx, pa.int32()), pa.array(own[idx], pa.int32()), pa.array((np.arange(rows) + block) % parts, pa.int32()), pa.nulls(rows, pa.binary()),
            ], schema=PROFILE_ARROW)
            owner[~alone] = len(first)
            grams, owner = grams[new], owner[new]
            part = (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # fragments of the order of hashes
            cuts = np.searchsorted(part, np.arange(parts + 1))
            sent, data = np.flatnonzero(np.diff(cuts)), []
            kind = np.uint16 if len(first) < 1 << 16 else np.uint32
            for a, b in zip(cuts[sent].tolist(), cuts[sent + 1].tolist(), strict=True):
                by = np.argsort(owner[a:b], kind="stable")
                owned = owner[a:b][by]
                owned = owned[: np.searchsorted(owned, len(first))].astype(kind)
                data.append(np.array([len(owned), owned.itemsize], np.uint32).tobytes() + mix(grams[a:b][by]).astype(np.uint32).tobytes() + owned.tobytes())
            k = len(sent)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([
                fill(1, pa.int32(), k), none, none, none.cast(pa.int32()), fill(block, pa.int64(), k), none.cast(pa.int32()), none.cast(pa.int32()), pa.array(sent, pa.int32()), pa.array(data, pa.binary()),
            ], schema=PROFILE_ARROW)
            block += 1

    return run


def _counted(found: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    counts = [np.stack(np.unique(np.concatenate(x), return_counts=True), axis=1).astype(np.uint32).tobytes() for x in found.values()]
    k = len(found)
    none = pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, 2), pa.int32()), none, none, none.cast(pa.int32()), pa.array(list(found)), *[none.cast(pa.int32())] * 3, pa.array(counts, pa.binary())], schema=PROFILE_ARROW)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their fragments: rows of kind 2, how many owned n-grams of a block's sets other blocks have too. Rows of kind 0 pass.

    One fragment is held at a time. 32 bits may take two n-grams of a fragment for one; that only lowers a private
    count, which stays a bound.
    """
    found: dict[int, list[np.ndarray]] = {}
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
    at, held = None, 0

    def end() -> int:
        if not waiting:
            return 0
        grams = np.concatenate([g for *_, g in waiting])
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        shared = np.zeros(len(grams), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        place = total = 0
        for block, owners, g in waiting:
            met = owners[shared[place : place + len(owners)]]  # owned n-grams come first
            if len(met):
                found.setdefault(block, []).append(met.astype(np.uint32))
                total += len(met)
            place += len(g)
        waiting.clear()
        return total

    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind == 0).any():
            yield batch.filter(pa.array(kind == 0))
        for i in np.flatnonzero(kind == 1).tolist():
            part = batch.column(7)[i].as_py()
            if part != at:
                held += end()
                at = part
                if held > HELD_GRAMS:
                    yield _counted(found)
                    held = 0
                    found.clear()
            raw = batch.column(8)[i].as_py()
            owned, width = np.frombuffer(raw, np.uint32, 2).tolist()
            cut = len(raw) - owned * width
            owners = np.frombuffer(raw[cut:], np.uint16 if width == 2 else np.uint32)
            waiting.append((batch.column(4)[i].as_py(), owners, np.frombuffer(raw[8:cut], np.uint32)))
    end()
    if found:
        yield _counted(found)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, idx, met), one row for each set that other blocks share with, from rows (block, data) in the order of blocks."""
    at, have = None, np.zeros(0, np.int64)

    def end() -> Iterator[pa.RecordBatch]:
        idx = np.flatnonzero(have)
        if len(idx):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), at)), pa.array(idx, pa.int32()), pa.array(have[idx], pa.int32())], names=["block", "idx", "met"])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != at:
                yield from end()
                at, have = block, np.zeros(0, np.int64)
            idx, met = np.frombuffer(data, np.uint32).reshape(-1, 2).astype(np.int64).T
            if len(have) <= idx.max():
                have = np.concatenate([have, np.zeros(int(idx.max()) + 1 - len(have), np.int64)])
            have[idx] += met  # a blob names a set once
    yield from end()


def profile(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, cls (the set's name), n and s (n-grams that no other set has, at most) of each document, read from a table."""
    spark = docs.sparkSession
    partitions = partitions_for(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(_profile(width, SCATTER * partitions), PROFILE).repartition(partitions, "part").sortWithinPartitions("part")
    path = run_folder(spark, "ngram_profile")
    found = materialise(sent.mapInArrow(_met, PROFILE), path)
    messages = found.where("kind = 2").select("block", "data").repartition(partitions, "block").sortWithinPartitions("block")
    met = messages.mapInArrow(_summed, "block bigint, idx int, met int")
    private = (F.col("own") - F.coalesce("met", F.lit(0))).cast("int")
    members = found.where("kind = 0").join(met, ["block", "idx"], "left").select("doc_id", "cls", "n", private.alias("s"))
    members = materialise(members, run_folder(spark, "ngram_members"))
    drop_folder(spark, path)
    return members


def shared_sets(docs: DataFrame, members: DataFrame, width: int, percent: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """cls, n, s and grams (ascending as unsigned numbers) of the sets that can link with another, read from a table at the path.

    Of each set one document is read again. While those are few, their ids go to all tasks and no text is shuffled;
    ids that several rows of a set share are joined by a shuffle, so that one task sees them all and keeps one.
    """
    spark = docs.sparkSession
    able = members.where(f"n > 0 and 100 * (n - s) >= {percent} * n")
    rows_of = able.groupBy("cls", "doc_id").agg(F.count("*").alias("_rows"), F.max("s").alias("s"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_rows")).alias("first")
    chosen = rows_of.groupBy("cls").agg(first, F.max("s").alias("s")).select("cls", "s", F.col("first.doc_id").alias("rep"), ((F.col("first._rows") > 1) | F.col("first.no")).alias("odd"))
    of_chosen = run_folder(spark, "ngram_chosen")
    chosen = materialise(chosen, of_chosen)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    single, odd = chosen.where("NOT odd").drop("odd"), chosen.where("odd").drop("odd")
    single = F.broadcast(single) if single.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS else single
    joined = rows.join(single, rows["doc_id"] == single["rep"]).select("cls", "s", "text")
    if odd.limit(1).count():
        joined = joined.unionAll(rows.join(odd.hint("merge"), rows["doc_id"].eqNullSafe(odd["rep"])).select("cls", "s", "text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, text in blocks(batches, "text"):
            grams, bounds = shingles(text, width)
            names = set_names(grams, bounds)
            want = batch.column(0).to_numpy()
            keep = [i for i in np.flatnonzero(names == want).tolist() if not (names[i] in seen or seen.add(names[i]))]
            lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(grams.view(np.int64))).cast(pa.list_(pa.int64()))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.diff(bounds)[keep], pa.int32()), batch.column(1).take(at), lists.take(at)], names=["cls", "n", "s", "grams"])

    sets = materialise(joined.mapInArrow(collect, "cls bigint, n int, s int, grams array<bigint>"), path)
    drop_folder(spark, of_chosen)
    return sets


def frequent_grams(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams to move to the end of the order, ascending, and their places there. Any choice is right; their number is bounded."""
    with shuffles_dropped(sets.sparkSession):
        top = sets.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "g").limit(MOST_FREQUENT).collect()
    grams = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (len(grams) - np.arange(len(grams)))[order]


def prefixes(sets: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(g, cls, n, s) for the first n-grams of each set in the global order.

    s is a number of the set's n-grams that no partner shares for whom this list is the first common one: those
    before g, or the private ones.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = shared.value
        for batch in (x for b in batches for x in slices(b, b.column(1).to_numpy(), SLICE_GRAMS)):
            cls, n, s = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            grams = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(grams), np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(late, grams), len(late) - 1)
                rank = np.where(late[at] == grams, place[at], 0)
            order = np.lexsort((grams, rank, row))
            nth = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
            size = n - (percent * n.astype(np.int64) + 99) // 100 + 1
            early = nth < size[row]
            keep = order[early]
            r = row[keep]
            bound = np.maximum(nth[early], s[r]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(cls[r]), pa.array(n[r]), pa.array(bound)], names=["g", "cls", "n", "s"])

    return sets.select("cls", "n", "s", "grams").mapInArrow(cut, "g bigint, cls bigint, n int, s int")


def possible(n1, s1, n2, s2, percent: int):
    """Whether sets of these sizes and private counts can link."""
    most = np.minimum(n1 - s1, n2 - s2).astype(np.int64)
    return (most > 0) & ((100 + percent) * most >= percent * (n1.astype(np.int64) + n2))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def long_lists(lists: DataFrame) -> DataFrame:
    """(g, blocks) of the lists of more than LIST_ROWS members, read from a table, with a broadcast hint while they are few."""
    long = lists.groupBy("g").count().where(F.col("count") > LIST_ROWS).select("g", F.ceil(F.col("count") / LIST_ROWS).cast("int").alias("blocks"))
    long = materialise(long, run_folder(lists.sparkSession, "ngram_long_lists"))
    return F.broadcast(long) if long.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS else long


def first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the one before it and with the list's first, in order of private counts.

    A long list is dealt into blocks, and the blocks' first members are paired with the list's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = last = None  # (g, block, cls, n, s) of the current block's first row and of the row before
        for batch in batches:
            g, block, cls, n, s = (batch.column(i).to_numpy() for i in range(5))
            if not len(g):
                continue
            if last is not None:
                g, block, cls, n, s = (np.concatenate([np.array([x, y], z.dtype), z]) for x, y, z in zip(lead, last, (g, block, cls, n, s), strict=True))
            start = np.ones(len(g), bool)
            start[1:] = (g[1:] != g[:-1]) | (block[1:] != block[:-1])
            head = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            at = np.arange(len(g))
            x, y = np.concatenate([at[~start], at[~start]]), np.concatenate([at[~start] - 1, head[~start]])
            good = (cls[x] != cls[y]) & possible(n[x], s[x], n[y], s[y], percent)
            yield _pairs(cls[x[good]], cls[y[good]])
            lead, last = (tuple(z[i].item() for z in (g, block, cls, n, s)) for i in (head[-1], -1))

    blocks = F.coalesce("blocks", F.lit(1))
    placed = lists.join(long_lists(lists), "g", "left").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    dealt = placed.select("g", "block", "cls", "n", "s").repartition(partitions_for(lists), "g", "block").sortWithinPartitions("g", "block", "s", "n", "cls")
    leads = placed.where("blocks IS NOT NULL").groupBy("g", "block").agg(F.min(F.struct("s", "n", "cls")).alias("lead"))
    first = leads.groupBy("g").agg(F.min("lead").alias("first"))
    s1, n1, s2, n2 = (F.col(x).cast("long") for x in ("lead.s", "lead.n", "first.s", "first.n"))
    most = F.least(n1 - s1, n2 - s2)
    able = leads.join(first, "g").where((F.col("lead.cls") != F.col("first.cls")) & (most > 0) & ((100 + percent) * most >= percent * (n1 + n2)))
    of_leads = able.select(F.least("lead.cls", "first.cls").alias("a"), F.greatest("lead.cls", "first.cls").alias("b"))
    return dealt.mapInArrow(run, "a bigint, b bigint").unionAll(of_leads).distinct()


def cross_pairs(lists: DataFrame, roots: DataFrame, percent: int, path: str) -> DataFrame:
    """All pairs of a list's members that are in different components and can link. They are made from a table at the path.

    Lists of one component are dropped first. In the others, the rest (what isn't of the list's largest component) meets
    all members: cell (i, j) holds block i of the rest and block j of all members, LIST_ROWS of each about, so a list
    of which few members are left costs about its own length, and no task holds more than a cell.
    """

    def of_cell(rest: np.ndarray, cls: np.ndarray, n: np.ndarray, s: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, all_ = np.flatnonzero(rest), np.flatnonzero(~rest)
        step = max(1, (1 << 22) // max(len(all_), 1))
        y = all_[None, :]
        for lo in range(0, len(one), step):
            x = one[lo : lo + step, None]
            i, j = np.nonzero((root[x] != root[y]) & possible(n[x], s[x], n[y], s[y], percent))
            if len(i):
                yield _pairs(cls[x[i, 0]], cls[all_[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # what has come of the current cell
        for batch in batches:
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            new = np.zeros(batch.num_rows, bool)
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b <= a:
                    continue
                if held and any(held[0][k][0] != columns[k][a] for k in range(3)):
                    yield from of_cell(*(np.concatenate([h[k] for h in held]) for k in range(3, 8)))
                    held = []
                held.append(tuple(c[a:b] for c in columns))
        if held:
            yield from of_cell(*(np.concatenate([h[k] for h in held]) for k in range(3, 8)))

    labelled = lists.join(roots, lists["cls"] == roots["node"], "left").select("g", "cls", "n", "s", F.coalesce("root", "cls").alias("root"))
    labelled = materialise(labelled, path)
    of_root = labelled.groupBy("g", "root").agg(F.count("*").alias("rows"))
    mixed = of_root.groupBy("g").agg(F.sum("rows").alias("size"), F.max(F.struct("rows", "root")).alias("top")).where("size > top.rows")
    blocks = lambda x: F.ceil(x / LIST_ROWS).cast("int")
    mixed = mixed.select("g", F.col("top.root").alias("top"), blocks(F.col("size")).alias("of_all"), blocks(F.col("size") - F.col("top.rows")).alias("of_rest"))
    sized = labelled.join(mixed, "g")
    last = lambda x: F.sequence(F.lit(0), F.col(x) - 1)
    rest = sized.where("root != top").select("g", F.pmod(F.xxhash64("cls", "g"), F.col("of_rest")).cast("int").alias("i"), F.explode(last("of_all")).alias("j"), F.lit(True).alias("rest"), "cls", "n", "s", "root")
    all_ = sized.select("g", F.explode(last("of_rest")).alias("i"), F.pmod(F.xxhash64("cls"), F.col("of_all")).cast("int").alias("j"), F.lit(False).alias("rest"), "cls", "n", "s", "root")
    dealt = rest.unionAll(all_).repartition(partitions_for(lists), "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int, fragments: int = FRAGMENTS) -> DataFrame:
    """The pairs that link, as (u, v): overlaps are counted by fragment and summed for each pair."""
    segments = sets.mapInArrow(_segments(fragments), "cls bigint, n int, fragment int, segment array<bigint>")
    left = segments.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("of_a"))
    right = segments.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("of_b"))
    joined = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "of_a", "of_b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, b.column(2).to_numpy() + b.column(3).to_numpy(), SLICE_GRAMS * fragments)):
            x, y = batch.column(4), batch.column(5)
            rows = np.arange(batch.num_rows)
            nx, ny = (np.diff(c.offsets.to_numpy()) for c in (x, y))
            value = np.concatenate([x.flatten().to_numpy(), y.flatten().to_numpy()])
            row = np.concatenate([np.repeat(rows, nx), np.repeat(rows, ny)])
            order = np.lexsort((value, row))
            same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
            count = np.bincount(row[order][1:][same], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(count, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])

    counted = joined.mapInArrow(overlap, "a bigint, b bigint, n_a int, n_b int, common bigint")
    total = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("n_a").cast("long") + F.col("n_b") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _segments(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // fragments for k in range(1, fragments)], np.uint64)
        for batch in (x for b in batches for x in slices(b, b.column(1).to_numpy(), SLICE_GRAMS)):
            rows = batch.num_rows
            n = batch.column(1).to_numpy()
            grams = batch.column(3).flatten().to_numpy()
            place = np.searchsorted(edges, grams.view(np.uint64), side="right")
            cell = np.repeat(np.arange(rows), n) * fragments + place  # ascending, since grams are
            bounds = np.searchsorted(cell, np.arange(rows * fragments + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(grams))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), fragments)), pa.array(np.repeat(n, fragments)), pa.array(np.tile(np.arange(fragments), rows), pa.int32()), lists], names=["cls", "n", "fragment", "segment"])

    return run


def grouped_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The members (see profile), and (cls, root, component_id) of each set that has n-grams, both read from tables.

    Tables of n-grams, lists and pairs are dropped as soon as nothing reads them.
    docs is read twice, and blocks are numbered by partition and place, so it should come from a table: a task that is
    repeated after a lost executor then sees the same rows in the same order.
    """
    spark = docs.sparkSession
    members = profile(docs, width, id_col, text_col)
    of_sets, of_lists, of_pairs, of_labelled, of_crossed = (run_folder(spark, f"ngram_{x}") for x in ("sets", "lists", "pairs", "labelled_lists", "pairs"))
    sets = shared_sets(docs, members, width, percent, id_col, text_col, of_sets)
    lists = materialise(prefixes(sets, percent, frequent_grams(sets)), of_lists)
    pairs = materialise(first_pairs(lists, percent), of_pairs)  # so that what made them goes before they are verified
    links = materialise(verified(pairs, sets, percent), run_folder(spark, "ngram_links"))
    roots = materialise(components(links), run_folder(spark, "ngram_roots"))
    pairs = materialise(cross_pairs(lists, roots, percent, of_labelled), of_crossed)
    for path in (of_pairs, of_lists, of_labelled):
        drop_folder(spark, path)
    more = materialise(verified(pairs, sets, percent), run_folder(spark, "ngram_links"))
    for path in (of_crossed, of_sets):
        drop_folder(spark, path)
    if more.limit(1).count():
        roots = materialise(components(links.unionByName(more)), run_folder(spark, "ngram_roots"))
    named = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    rooted = named.join(roots, named["cls"] == roots["node"], "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    lowest = materialise(rooted.groupBy("root").agg(F.min("low").alias("component_id")), run_folder(spark, "ngram_lowest"))  # so that a large component is split in the join
    return members, materialise(rooted.join(lowest, "root").select("cls", "root", "component_id"), run_folder(spark, "ngram_components"))


def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document. docs should come from a table."""
    members, table = grouped_sets(docs, width, percent, id_col, text_col)
    # Without n-grams all sets have one name; such documents keep to themselves.
    joined = members.join(table.withColumn("_full", F.lit(True)), (members["cls"] == table["cls"]) & (members["n"] > 0), "left")
    return joined.select(members["doc_id"], members["n"].cast("long").alias("n_shingles"), F.when(F.col("_full"), F.col("component_id")).otherwise(members["doc_id"]).alias("component_id"))


def _named(width: int):
    """Rows (row, text) with the name of their set and its size instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, "text"):
            grams, bounds = shingles(text, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_names(grams, bounds), pa.int64()), pa.array(np.diff(bounds), pa.int32())], names=["row", "cls", "n"])

    return run


def _hinted(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row with the smallest id, with all its columns; null ids come last.

    An id tells a row unless it is null or repeated. Such rows are stored with the name of their set and a number, and
    of those with a component's smallest id the one with the smallest number stays.

    While the ids that go are few, they are sent to all tasks and no row of docs is shuffled; so are repeated ids.
    """
    spark = docs.sparkSession
    members, table = grouped_sets(docs, width, percent, id_col, text_col)
    found = members.where("n > 0").join(table, "cls").where("doc_id != component_id")
    gone = _hinted(materialise(found.select(F.col("doc_id").alias("_gone")).distinct(), run_folder(spark, "ngram_gone")))
    repeated = members.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_repeated"))
    repeated = _hinted(materialise(repeated, run_folder(spark, "ngram_repeated")))
    own = docs[id_col].cast("long")
    if not repeated.limit(1).count():
        return docs.join(gone, own == gone["_gone"], "left_anti")
    single = docs.join(repeated, own.eqNullSafe(repeated["_repeated"]), "left_anti").join(gone, own == gone["_gone"], "left_anti")
    odd = docs.join(repeated, own.eqNullSafe(repeated["_repeated"]), "left_semi").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    fields = StructType([odd.schema["row"], StructField("cls", LongType()), StructField("n", IntegerType())])
    tagged = odd.mapInArrow(_named(width), fields).withColumn("tag", F.monotonically_increasing_id())
    tagged = materialise(tagged, run_folder(spark, "ngram_repeated"))
    placed = tagged.where("n > 0").join(table, "cls").withColumn("low", F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("component_id")))
    first = placed.where("low").groupBy("root").agg(F.min("tag").alias("tag")).select("tag")
    kept = tagged.where("n = 0").select("row").unionAll(tagged.join(first, "tag", "left_semi").select("row"))
    return single.unionAll(kept.select("row.*"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a Jaccard similarity of 0.85."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM tokens WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
