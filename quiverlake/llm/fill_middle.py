"""Fill-in-the-middle: documents cut in three parts and put together in another order.

A text is a run of units, each a word with the white space before it; white space at the
end of a text is a unit of its own. Two cuts between units, drawn from a hash of the id,
make prefix, middle and suffix.

The pass that counts units leaves a sparse index: at each text's start and after every
EVERY units of it, the unit number with its byte and code-point offset. A cut is found by a
binary search among these checkpoints and by matching at most EVERY - 1 units from there on.
Counting goes over windows of bytes, so beside the text itself a task holds some megabytes
and the checkpoints, however long the text is.

Defined results: a null text counts as empty; empty texts and texts that contain a mark stay
plain; a null id is hashed like the empty string; rows that share an id are cut by the same
draws; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, batch_of, blocks, text_buffers

EVERY = 64
WINDOW = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FIELDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


class Index(NamedTuple):
    """Checkpoints of a block of texts in the order of (row, unit): offsets count from the block's start."""

    row: np.ndarray
    unit: np.ndarray
    byte: np.ndarray
    point: np.ndarray
    n_units: np.ndarray  # of each row


def count_units(raw: np.ndarray, offsets: np.ndarray, every: int = EVERY, window: int = WINDOW) -> Index:
    """Count the units of each text and record a checkpoint at its start and after every `every` units."""
    size, n_rows = len(raw), len(offsets) - 1
    before, points = np.zeros(n_rows + 1, np.int64), np.zeros(n_rows + 1, np.int64)  # units and code points before each row
    units = chars = 0
    marks: list[tuple[np.ndarray, ...]] = []
    for low in range(0, size, window):
        part = raw[low : low + window]
        high = low + len(part)
        solid = ~WHITE[part]
        last = np.zeros(len(part), bool)  # the last byte of a unit
        last[:-1] = solid[:-1] & ~solid[1:]
        last[-1] = solid[-1] and (high == size or WHITE[raw[high]])
        here = np.searchsorted(offsets, [low, high], side="right")
        inside = np.arange(here[0], here[1])  # rows that start (or end) in (low, high]
        last[offsets[inside] - low - 1] = True
        ends = np.flatnonzero(last)
        passed = np.cumsum((part & 0xC0) != 0x80)
        before[inside] = units + np.searchsorted(ends, offsets[inside] - low - 1, side="right")
        points[inside] = chars + passed[offsets[inside] - low - 1]
        row = np.searchsorted(offsets, ends + low, side="right") - 1
        unit = np.arange(units + 1, units + 1 + len(ends)) - before[row]
        chosen = unit % every == 0
        marks.append((row[chosen], unit[chosen], ends[chosen] + low + 1, chars + passed[ends[chosen]]))
        units += len(ends)
        chars += int(passed[-1])
    rows = np.arange(n_rows)
    marks.append((rows, np.zeros(n_rows, np.int64), offsets[:-1], points[:-1]))
    row, unit, byte, point = (np.concatenate(x) for x in zip(*marks, strict=True))
    order = np.lexsort((unit, row))
    return Index(row[order], unit[order], byte[order], point[order], np.diff(before))


def locate(index: Index, raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and code-point offsets, from the block's start, of the place after `units` units of each of the rows."""
    step = int(index.n_units.max(initial=0)) + 1
    found = np.searchsorted(index.row * step + index.unit, rows * step + units, side="right") - 1
    byte, point, rest = index.byte[found], index.point[found], units - index.unit[found]
    view = memoryview(raw)
    for k in np.flatnonzero(rest).tolist():
        matches = UNIT.finditer(view, int(byte[k]), int(offsets[rows[k] + 1]))
        end = next(itertools.islice(matches, int(rest[k]) - 1, None)).end()
        point[k] += np.count_nonzero((raw[byte[k] : end] & 0xC0) != 0x80)
        byte[k] = end
    return byte, point


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers of each id: the start of SHA-256 of "seed:id"."""
    named = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids)
    return np.array([struct.unpack(">4I", d[:16]) for d in named], np.int64).reshape(-1, 4)


def fill_in_middle(
    docs: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS,
    every: int = EVERY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each document.

    `percent` of the documents are cut, `spm_percent` of these put the suffix first.
    """
    signs = [m.encode() for m in marks]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in blocks(batches, "text"):
            raw, offsets = text_buffers(text)
            index, drawn = count_units(raw, offsets, every), draws(batch.column(0).to_pylist(), seed)
            plain = (np.diff(offsets) == 0) | (drawn[:, 2] % 100 >= percent)
            for mark in marks:
                plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(~plain)
            places = np.sort(drawn[rows, :2] % (index.n_units[rows, None] + 1), axis=1)
            (start, start_point), (a, a_point), (b, b_point) = (locate(index, raw, offsets, rows, at) for at in (np.zeros(len(rows), np.int64), *places.T))
            view, spm = memoryview(raw), drawn[:, 3] % 100 < spm_percent
            output = [None if p else b"" for p in plain]
            for row, x, y, z in zip(rows.tolist(), start.tolist(), a.tolist(), b.tolist(), strict=True):
                prefix, middle, suffix = view[x:y], view[y:z], view[z : offsets[row + 1]]
                first, second = ((signs[1], suffix), (signs[0], prefix)) if spm[row] else ((signs[0], prefix), (signs[1], suffix))
                output[row] = b"".join([*first, *second, signs[2], middle])
            chars = np.zeros((2, len(plain)), np.int64)
            chars[:, rows] = a_point - start_point, b_point - a_point
            yield batch_of(
                FIELDS, batch.column(0), index.n_units, np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(),
                *(pa.array(c, mask=plain) for c in chars), pc.coalesce(pa.array(output, pa.binary()).cast(pa.string()), text))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Marks can't be read wrongly: a text that contains one stays plain."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, half of them cut; digests of the outputs and of the texts rebuilt from them."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), cuts AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[:least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
