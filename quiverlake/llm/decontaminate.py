"""Benchmark decontamination by the q-gram lemma.

An item of length m that occurs in a document with at most k edits shares at least
m - q + 1 - k * q q-grams with it, all on k + 1 neighbouring diagonals (document position
minus item position). So:

1. Characters are folded one by one to lower-case letters and digits; each run of other
   characters becomes one space. Every position keeps its place in the original text.
2. All q-grams of a block of documents are hashed at once and looked up in the item's
   q-grams; a row without enough hits within the longest item's reach is done.
3. Hits are counted in diagonal bands of width 2 * (k + 1) that overlap by half, so any
   k + 1 neighbouring diagonals lie in one of them. Bands that meet the bound are retained.
   A q-gram with many places in one item counts once for each band from its first to its
   last place, which keeps the bound, as no more is asked for than as many positions of
   the text. Hits are taken in slices of bounded size, and bands are decided as they end,
   so memory depends neither on repetitive texts nor on what items have in common.
4. Retained regions, neighbouring bands as one, are verified by banded alignment of the whole item against the text
   around the band, with free ends in the text. Those within k edits are leaks.

k is a share of the item's length, and small enough that one shared q-gram is asked for at
least. Items shorter than q have to occur unchanged, between
other characters. The index of the items, some ten bytes a character, is made in blocks and sent
to every task; documents are read once, whatever the number of blocks, and never shuffle.

Defined results: null and empty texts and items match nothing; items that fold to the
same characters are found together; an item that occurs in several places of a document
gives one row, its best and then its first place; equal rows are reported each; empty
tables give no rows; other columns are ignored by leaks() and passed on by keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, mix

Q, EDIT_SHARE = 9, 0.09
ITEM_BYTES = 8 << 20
MANY_PLACES = 12  # of a q-gram in one item
SLICE_BANDS = 500_000  # counted at once
CELLS = 1 << 16  # of a row of alignments
_B = 0x9E3779B97F4A7C15 | 1
_TABLE_BITS = 22
_FOLDS: list[np.ndarray] = []
SPACE, WALL = 0x20, 0x10FFFF + 1


def _folds() -> np.ndarray:
    """For each code point: what it folds to (SPACE if it is no letter or digit)."""
    if not _FOLDS:
        table = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDS.append(table)
    return _FOLDS[0]


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, the place of each in its own text, and where each text begins; texts are walled off from each other."""
    if not texts:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(1, np.int64)
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    folded = _folds()[raw]
    folded[ends - 1] = WALL
    keep = folded != SPACE
    keep[1:] |= folded[:-1] != SPACE  # the first of a run of spaces
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, np.append(begins, len(raw)))
    return folded[at], at - np.repeat(begins, np.diff(bounds)), bounds


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters that begin at each position; those at the end of the array are missing."""
    if len(chars) < q:
        return np.empty(0, np.uint64)
    h, width, out, done = chars.astype(np.uint64), 1, None, 0
    left = q
    while True:  # join powers of two to the width asked for
        if left & 1:
            out = h[: len(chars) - q + 1] if out is None else out * np.uint64(pow(_B, width, 1 << 64)) + h[done : done + len(chars) - q + 1]
            done += width
        left >>= 1
        if not left:
            return mix(out)
        n = max(len(h) - width, 0)
        h = h[:n] * np.uint64(pow(_B, width, 1 << 64)) + h[width : width + n]
        width *= 2


class Items:
    """An index of the q-grams of a block of items.

    A q-gram takes eight bytes: the entries are in the order of its hash, of which the first bits lead through a
    directory to a run of entries, the next 32 are in `keys`, and `place` is where it begins in `letters`, the items'
    characters one after the other.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], q: int = Q, share: float = EDIT_SHARE):
        named: dict[bytes, list[int | None]] = {}
        chars, _, bounds = fold([t or "" for _, t in items])
        for (item_id, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            c = chars[a : b - 1]  # without the wall
            c = c[1:] if len(c) and c[0] == SPACE else c
            c = c[:-1] if len(c) and c[-1] == SPACE else c
            if len(c):
                named.setdefault(c.tobytes(), []).append(item_id)
        del chars
        self.q, self.ids = q, list(named.values())
        self.lengths = np.array([len(k) // 4 for k in named], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        letters = np.frombuffer(b"".join(named), np.uint32)
        named.clear()
        self.letters = letters.astype(np.uint16) if letters.max(initial=0) < 1 << 16 else letters
        self.edits = np.clip(np.floor(self.lengths * share).astype(np.int64), 0, np.maximum((self.lengths - q) // q, 0))
        self.least = self.lengths - q + 1 - self.edits * q
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: hashes of the items between spaces, ascending, and the items
        for n in sorted(set(self.lengths[self.lengths < q].tolist())):
            short = np.flatnonzero(self.lengths == n)
            hashes = np.array([qgrams(self._between(i), n + 2)[0] for i in short.tolist()], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], short[order]
        long = np.flatnonzero(self.lengths >= q)
        grams = qgrams(letters, q)
        inside = np.zeros(len(grams) + 1, np.int32)  # q-grams that don't reach into the next item
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.starts[long] + self.lengths[long] - q + 1, -1)
        place = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int32)).astype(np.int32)
        grams = grams[place]
        order = np.argsort(grams, kind="stable")
        grams, place = grams[order], place[order]
        del order, inside
        # An entry is a q-gram with one of its places in an item, or with all of them if they are many: then from the first to the last.
        group = np.ones(len(grams), bool)
        item = (np.searchsorted(self.starts, place, side="right") - 1).astype(np.int32)
        group[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(group)
        size = np.diff(np.append(first, len(grams)))
        many = size > MANY_PLACES
        keep = group.copy()
        for a, b in zip(first[~many & (size > 1)].tolist(), (first + size)[~many & (size > 1)].tolist(), strict=True):
            keep[a:b] = True
        kept = np.flatnonzero(keep)
        self.wide = np.searchsorted(kept, first[many])  # entries from a first to a last place, their last places, and how many more bands they touch in all
        self.wide_last = place[first[many] + size[many] - 1]
        grams, place = grams[kept], place[kept]
        more = (self.wide_last - place[self.wide]) // (self.edits[item[kept[self.wide]]] + 1) if len(self.wide) else np.empty(0, np.int64)
        self.wide_more = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
        self.bits = min(max(len(grams).bit_length() + 5, 8), _TABLE_BITS)
        self.directory = np.searchsorted(grams, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.directory = np.append(self.directory, np.int32(len(grams)))
        self.keys, self.place = self._keys(grams), place
        self.reach = int((self.lengths + self.edits)[long].max()) if len(long) else 0
        self.fewest = int(self.least[long].min()) if len(long) else 1

    @property
    def chars(self) -> list[np.ndarray]:
        return [self.text_of(i) for i in range(len(self.lengths))]

    def text_of(self, item: int) -> np.ndarray:
        return self.letters[self.starts[item] : self.starts[item + 1]].astype(np.uint32)

    def _between(self, item: int) -> np.ndarray:
        return np.concatenate([[SPACE], self.text_of(item), [SPACE]]).astype(np.uint32)

    def _keys(self, grams: np.ndarray) -> np.ndarray:
        """The 32 bits of a hash that follow those of the directory."""
        return (grams >> np.uint64(32 - self.bits)).astype(np.uint32)

    def _entries(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the q-grams are in the index, the first of each one's entries, and the one behind its last."""
        bucket = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        low, high = self.directory[bucket], self.directory[bucket + 1]
        hits = np.flatnonzero(high > low)
        low, high, key = low[hits].astype(np.int64), high[hits].astype(np.int64), self._keys(grams[hits])
        first = self._bisect(key, low, high, False)
        good = first < high
        good[good] = self.keys[first[good]] == key[good]
        hits, first = hits[good], first[good]
        return hits, first, self._bisect(key[good], first, high[good], True)

    def _bisect(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, behind: bool) -> np.ndarray:
        """In each run of entries the first whose key isn't smaller, or is larger."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            found = self.keys[middle]
            up = found <= key[todo] if behind else found < key[todo]
            low[todo[up]], high[todo[~up]] = middle[up] + 1, middle[~up]
            todo = todo[low[todo] < high[todo]]
        return low

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits), the best place of each item in each row; positions are code points of the text."""
        chars, origin, bounds = fold(texts)
        regions = self._bands(chars, bounds) if len(self.keys) else []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (row, item, *_), (edits, a, b) in zip(regions, self._align(chars, bounds, regions), strict=True):
            if edits <= self.edits[item]:
                found = (edits, a, b)
                best[row, item] = min(best.get((row, item), found), found)
        for row, item, a in self._shorts(chars, bounds):
            best.setdefault((row, item), (0, a, a + int(self.lengths[item])))
        return [(row, item, int(origin[a]), int(origin[b - 1]) + 1, int(edits)) for (row, item), (edits, a, b) in sorted(best.items())]

    def _bands(self, chars: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, first diagonal, last diagonal) of the regions of bands that meet the item's bound, diagonals counted over the whole block."""
        grams = qgrams(chars, self.q)
        hits, first, behind = self._entries(grams)
        # A hit matters if enough others are within reach, before and after it together.
        before = np.arange(len(hits)) - np.searchsorted(hits, hits - self.reach)
        after = np.searchsorted(hits, hits + self.reach, side="right") - np.arange(len(hits))
        good = before + after >= self.fewest
        hits, first, behind = hits[good], first[good], behind[good]
        if not len(hits):
            return []
        # Bands are counted slice by slice; those that no later hit can touch are decided, the others go on to the next.
        wide = self.wide_more[np.searchsorted(self.wide, behind)] - self.wide_more[np.searchsorted(self.wide, first)] if len(self.wide) else 0
        total = np.cumsum(3 * (behind - first) + wide)  # bands that the hits touch, at most
        open_, out, lo = (np.empty(0, np.int64),) * 4, [], 0
        while lo < len(hits):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_BANDS, side="right")))
            row, item, band, count = _summed(*(np.concatenate(x) for x in zip(open_, self._touched(hits[lo:hi], first[lo:hi], behind[lo:hi], bounds), strict=True)))
            done = np.ones(len(row), bool)
            if hi < len(hits):  # a band (item, b) ends with diagonal (b + 2) * stride - 1
                done = (band + 2) * (self.edits[item] + 1) - self.reach <= hits[hi] - self.lengths[item]
            good = done & (count >= self.least[item])
            out.append((row[good], item[good], band[good]))
            open_ = tuple(x[~done] for x in (row, item, band, count))
            lo = hi
        row, item, band = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((band, item, row))
        row, item, band = row[order], item[order], band[order]
        # Bands that touch are verified as one region, up to a width.
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2)
        nth = np.arange(len(row)) - np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))
        begins |= nth % np.maximum(CELLS // (4 * (self.edits[item] + 1)), 1) == 0
        begin = np.flatnonzero(begins)
        last = np.append(begin[1:], len(row))[: len(begin)] - 1
        stride, low, high = self.edits[item[begin]] + 1, band[begin], band[last] + 2
        return list(zip(row[begin].tolist(), item[begin].tolist(), (low * stride - self.reach).tolist(), (high * stride - 1 - self.reach).tolist(), strict=True))

    def _touched(self, hits: np.ndarray, first: np.ndarray, behind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, band, 1) for each band that one of the hits touches; band b of an item holds its diagonals from b to b + 2 strides."""
        number = behind - first
        entry = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
        place, low = np.repeat(hits, number), self.place[entry].astype(np.int64)
        high = low
        if len(self.wide):
            at = np.minimum(np.searchsorted(self.wide, entry), len(self.wide) - 1)
            high = np.where(self.wide[at] == entry, self.wide_last[at], low)
        item = np.searchsorted(self.starts, low, side="right") - 1
        low, high = low - self.starts[item], high - self.starts[item]
        stride = self.edits[item] + 1
        first, last = (place - high + self.reach) // stride - 1, (place - low + self.reach) // stride
        width = last - first + 1
        band = np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())
        row = np.searchsorted(bounds, place, side="right") - 1
        return np.repeat(row, width), np.repeat(item, width), band, np.ones(len(band), np.int64)

    def _shorts(self, chars: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, place) of the first place of each short item in each row."""
        if not self.short:
            return
        spaced = np.concatenate([[SPACE], np.where(chars == WALL, SPACE, chars)]).astype(np.uint32)
        for n, (hashes, items) in self.short.items():
            grams = qgrams(spaced, n + 2)
            hits = np.flatnonzero((spaced[: len(grams)] == SPACE) & (spaced[n + 1 : n + 1 + len(grams)] == SPACE))
            at = np.minimum(np.searchsorted(hashes, grams[hits]), len(hashes) - 1)
            good = hashes[at] == grams[hits]
            for place, k in zip(hits[good].tolist(), at[good].tolist(), strict=True):
                found = spaced[place : place + n + 2].tobytes()
                while k < len(hashes) and hashes[k] == grams[place]:
                    if self._between(int(items[k])).tobytes() == found:
                        yield int(np.searchsorted(bounds, place, side="right")) - 1, int(items[k]), place
                    k += 1

    def _align(self, chars: np.ndarray, bounds: np.ndarray, regions: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Edits, start and end in chars of the item's best place in each region."""
        out: list[tuple[int, int, int]] = [(1 << 30, 0, 0)] * len(regions)
        todo = []
        for n, (row, item, first, last) in enumerate(regions):
            m, k = int(self.lengths[item]), int(self.edits[item])
            low, high = max(bounds[row], first - k), min(bounds[row + 1] - 1, last + k + m)  # an alignment leaves the band by k at most
            at = _search(chars[low:high], self.text_of(item))
            if at >= 0:
                out[n] = (0, low + at, low + at + m)
            elif k and last + k >= low:  # else it lies before the row
                todo.append((n, low, high, last + k - low, m))
        todo.sort(key=lambda x: (x[3], x[4]))  # like with like
        while todo:
            size = max(1, min(256, CELLS // (todo[-1][3] + 1)))  # the widest first
            part, todo = todo[-size:], todo[:-size]
            items = [self.text_of(regions[n][1]) for n, *_ in part]
            most = [int(self.edits[regions[n][1]]) for n, *_ in part]
            texts = [chars[a:b] for _, a, b, *_ in part]
            edits, ends = banded(items, texts, [last for *_, last, _ in part], True, most)
            good = [j for j in range(len(part)) if edits[j] <= most[j]]
            if good:
                back = [texts[j][max(0, ends[j] - len(items[j]) - most[j]) : ends[j]][::-1] for j in good]
                _, sizes = banded([items[j][::-1] for j in good], back, [most[j] for j in good], False)
                for j, size in zip(good, sizes, strict=True):
                    n, a, *_ = part[j]
                    out[n] = (int(edits[j]), a + int(ends[j]) - int(size), a + int(ends[j]))
        return iter(out)


def _summed(row: np.ndarray, item: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The counts of each (row, item, band)."""
    order = np.lexsort((band, item, row))
    row, item, band = row[order], item[order], band[order]
    edge = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (band[1:] != band[:-1])])[: len(row)])
    return row[edge], item[edge], band[edge], np.add.reduceat(count[order], edge)


def _search(text: np.ndarray, word: np.ndarray) -> int:
    """Where word begins in text, or -1."""
    raw, sought, at = text.tobytes(), word.tobytes(), -1
    while (at := raw.find(sought, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def banded(items: list[np.ndarray], texts: list[np.ndarray], last: list[int], free_start: bool, first: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each item to its best stretch of its text, and where that stretch ends (the first best end).

    Diagonals (text position minus item position) from -max(first), or -max(last), to max(last) are used. With a free
    start the stretch may begin anywhere in the text, else it begins with the text.
    """
    n, shift = len(items), max(first or last)
    width = shift + max(last) + 1
    longest = max(map(len, items))
    item = np.full((n, longest), WALL + 1, np.uint32)
    text = np.full((n, longest + width + 1), WALL + 2, np.uint32)
    for j in range(n):
        item[j, : len(items[j])] = items[j]
        text[j, shift : shift + min(len(texts[j]), text.shape[1] - shift)] = texts[j][: text.shape[1] - shift]
    kind = np.int16 if longest + width < 10_000 else np.int32
    sizes, far = np.array([len(t) for t in texts]), kind(20_000 if kind is np.int16 else 1 << 28)
    lengths = np.array([len(x) for x in items])
    column, step = np.arange(width), np.arange(width, dtype=kind)
    cost = np.tile((column - shift) * (not free_start), (n, 1)).astype(kind)
    cost[(column[None, :] < shift) | (column[None, :] - shift > sizes[:, None])] = far
    edits, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(longest + 1):
        done = np.flatnonzero(lengths == i)
        if len(done):
            final = cost[done]
            where = final.argmin(axis=1)
            edits[done], ends[done] = final[np.arange(len(done)), where], i + where - shift
        if i == longest:
            break
        fresh = cost + (text[:, i : i + width] != item[:, i : i + 1])
        np.minimum(fresh[:, :-1], cost[:, 1:] + kind(1), out=fresh[:, :-1])
        outside = np.flatnonzero(i + column - shift + 1 < 0)  # ends in the text once item[i] is matched on each diagonal
        beyond = sizes - (i - shift + 1) + 1  # the first column past the text's end
        fresh[:, outside] = far
        over = np.flatnonzero(beyond < width)
        mask = column[None, :] >= beyond[over, None]
        if len(over):
            fresh[over] = np.where(mask, far, fresh[over])
        cost = np.minimum.accumulate(fresh - step, axis=1) + step
        cost[:, outside] = far
        if len(over):
            cost[over] = np.where(mask, far, cost[over])
        np.minimum(cost, far, out=cost)
    return edits, ends


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = ITEM_BYTES) -> Iterator[Items]:
    """Indexes of blocks of items, each from about `most` bytes of text."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = -(-total // most)
    for k in range(number):
        part = rows if number == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        yield Items([tuple(r) for r in part.collect()])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end and edits of every item in every document."""
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = [docs.sparkSession.sparkContext.broadcast(index) for index in item_blocks(items)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, "text"):
            ids, texts = batch.column(0).to_pylist(), text.to_pylist()
            for index in (x.value for x in shared):
                found = [(ids[row], item_id, a, b, n) for row, item, a, b, n in index.find(texts) for item_id in index.ids[item]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * 5, fields, strict=True)], schema=fields)

    return rows.mapInArrow(search, "doc_id bigint, item_id bigint, start bigint, end bigint, edits int")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    shared = [docs.sparkSession.sparkContext.broadcast(index) for index in item_blocks(items)]

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, text_col):
            clean, texts = np.ones(batch.num_rows, bool), text.to_pylist()
            for index in (x.value for x in shared):
                clean[np.array([row for row, *_ in index.find(texts)], np.int64)] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(passing, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items in documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
