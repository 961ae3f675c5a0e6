"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is
derived that holds for every text the rule matches: literal runs give conjunctions,
alternatives give disjunctions. Each block of rows gets an inverted index of the trigrams
that the queries name, from trigram to a bitmap of rows, over ASCII-folded bytes. The
query's bitmaps are intersected and united, and only the rows left are searched with the
expression itself. A rule without a mandatory trigram, such as a run of hex digits, is
searched in every row. A block is indexed, queried and verified in one task, so neither
text nor postings are shuffled.

A match is dropped after matching if its measured group is too short; it still uses up
its characters, as leftmost non-overlapping matching asks.

Defined results: a null text is the empty text and has no spans; equal rows are scanned
each; an empty table gives no rows; other columns are ignored by scan() and passed on by
mask(). Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FOLD, blocks, text_buffers

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules, in the order that breaks ties. A run of 32 hex digits or
# more is what is left of all runs once the short ones are dropped.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Further kinds with well-known shapes.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
# What follows a private key's first line: up to its last line, or, if that is missing, header lines and base64 (lines
# may be parted by spaces or written \\n).
KEY_END = re.compile(r"-----END [A-Z ]{0,20}PRIVATE KEY-----")
KEY_BODY = re.compile(r"(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info):\x20[A-Za-z0-9,-]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})++(?:\s*\n[A-Za-z0-9+/]++={0,2}(?=\s*(?:\n|\Z))|(?:\s|\\[nr])*+[A-Za-z0-9+/]++={1,2})?)?", re.ASCII)

# A query is True (every row), a trigram (bytes), or ("and" | "or", frozenset of queries).


def _join(op: str, parts) -> object:
    parts = set(parts)
    if op == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts or not parts:
        return True
    return parts.pop() if len(parts) == 1 else (op, frozenset(parts))


def _of_strings(strings: set[bytes]) -> object:
    """What holds if one of the strings occurs."""
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _characters(items) -> set[bytes] | None:
    """The folded characters of a class, or None if they are many or not plain."""
    out: set[bytes] = set()
    for op, value in items:
        if op is sre.LITERAL and value < 128:
            out.add(chr(value).lower().encode())
        elif op is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
            out |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[bytes] | None, object]:
    """Of a sequence: all strings it can match (None if they are too many), and a query that they imply."""
    run: set[bytes] | None = {b""}  # what the current stretch of exact items can match
    found, exact = [], True
    for op, value in tree:
        strings, query = _item(op, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        found += [_of_strings(run), query]
        run = strings if strings is not None else {b""}
    found.append(_of_strings(run))
    return (run if exact else None), _join("and", found)


def _item(op, value) -> tuple[set[bytes] | None, object]:
    if op is sre.LITERAL:
        return ({chr(value).lower().encode()}, True) if value < 128 else (None, True)
    if op is sre.IN:
        return _characters(value), True
    if op is sre.SUBPATTERN:
        return _walk(value[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(both := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return both, _join("or", (q for _, q in parts))
        return None, _join("or", (q for _, q in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {b""}, True
        if low and low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
            return {b"".join(x) for x in product(strings, repeat=low)}, query
        return None, query if low else True
    if op is sre.AT:
        return {b""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """A Boolean query over folded trigrams that every text with a match of the pattern meets."""
    return _walk(sre_parse.parse(pattern))[1]


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Bitmaps of rows for the named trigrams in one block of texts."""

    _tables: dict[tuple[bytes, ...], np.ndarray] = {}

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: tuple[bytes, ...]):
        if grams not in self._tables:
            table = np.zeros(1 << 24, np.uint16)
            table[[int.from_bytes(g, "big") for g in grams]] = np.arange(1, len(grams) + 1)
            self._tables.clear()
            self._tables[grams] = table
        folded = FOLD[data].astype(np.uint32)
        codes = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
        number = self._tables[grams][codes]
        at = np.flatnonzero(number)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        self.bits = np.zeros((len(grams), len(offsets) - 1), bool)
        self.bits[number[at[inside]] - 1, row[inside]] = True
        self.numbers = {g: i for i, g in enumerate(grams)}

    def rows(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.bits.shape[1], bool)
        if isinstance(query, bytes):
            return self.bits[self.numbers[query]]
        merge = np.logical_and if query[0] == "and" else np.logical_or
        return merge.reduce([self.rows(q) for q in query[1]])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.grams = tuple(sorted(set().union(*(trigrams(q) for *_, q in self.rules))))

    def spans(self, text: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each row: (start, number of the rule, end) in order."""
        index = BlockIndex(*text_buffers(text), self.grams)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
        cache: dict[int, str] = {}
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(index.rows(query)).tolist():
                s = cache.get(i)
                if s is None:
                    s = cache[i] = text[i].as_py()
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(s) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, an array of (kind, start, end) in order of start and then of the rules."""
    kinds = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch, text in blocks(batches, "text"):
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in scanner.spans(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "doc_id bigint, found array<struct<kind: string, start: bigint, end: bigint>>")


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by [kind]; of spans that overlap, the one that begins first covers both.

    A private key's span, which is its first line, is taken up to the key's end.
    """
    kinds = [r.kind for r in rules]

    def whole_keys(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, following = [], len(text)
        for a, k, b in reversed(spans):
            if kinds[k] == "private_key":
                last = KEY_END.search(text, b, following)
                following, b = a, last.end() if last else KEY_BODY.match(text, b, following).end()
            out.append((a, k, b))
        return out[::-1]

    def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at, end = [], 0, -1
        for a, k, b in whole_keys(text, spans):
            if a >= end:
                out += [text[at:a], f"[{kinds[k]}]"]
            at = end = max(end, b)
        return "".join([*out, text[at:]])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch, text in blocks(batches, text_col):
            found = scanner.spans(text)
            if any(found):
                at = batch.schema.get_field_index(text_col)
                fresh = [replaced(s, x) if x else s for s, x in zip(batch.column(at).to_pylist(), found, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(fresh, batch.schema.field(at).type))
                at = batch.schema.get_field_index(length_col)
                if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):  # a column of another type has another meaning
                    sizes = [len(s) if x else n for n, s, x in zip(batch.column(at).to_pylist(), fresh, found, strict=True)]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def op10_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans for all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """Matches and the texts between them give the places of each rule's matches."""
    found = []
    for k, r in enumerate(RULES):
        pattern = r.pattern
        if r.any_case:  # spelled out, since case folding would also take letters beyond ASCII
            words, rest = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + rest
        quoted = "'" + pattern.replace("'", "''") + "'"
        found.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(regexp_extract_all(text, {quoted})) AS m, unnest(regexp_extract_all(text, {quoted}, {r.group})) AS part, "
            f"unnest(string_split_regex(text, {quoted})[:len(regexp_extract_all(text, {quoted}))]) AS gap, unnest(range(len(regexp_extract_all(text, {quoted})))) AS i FROM texts WHERE regexp_matches(text, {quoted})")  # fmt: skip
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM found),
spans AS (SELECT doc_id, k, kind, stop - length(m) AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span FROM placed WHERE length(part) >= CASE k {least} END),
listed AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id
"""


OP10_SQL = _sql()
