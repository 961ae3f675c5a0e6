"""Exact token ids of whole texts from the tokenizers library, with each distinct piece of text encoded once.

A text is cut only where the tokenizer itself cuts, whatever stands around the place:

- "gpt" (byte-level pre-tokenizer with its usual pattern): before a single space, and
  around a single line feed, that stands between two visible characters. A space there
  always opens the next pre-token, and such a line feed is always one of its own.
- "white" (white space is dropped before encoding): around any run of spaces and line feeds.

Visible means ASCII 0x21-0x7E, or the letters U+00C0-U+00FF (UTF-8 C3 80 to C3 BF); elsewhere
the text stays in one piece. Pieces are recognised by their bytes, or by 128 bits of BLAKE2b if they
are of more than seven; their ids are kept in sorted arrays of bounded size, so the library sees each
distinct piece about once per task.
Special strings such as <|endoftext|> hold no white space, so they are never cut.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shared import distinct, string_hashes, text_buffers

KEPT_PIECES = 2_000_000
TOGETHER = 512
#: Put between pieces that the library is given together; it is always a token of its own there.
_BETWEEN = {"gpt": "\n", "white": " \x01 "}
_ENCODERS: dict[tuple[str, str], "PieceEncoder"] = {}


def encoder(path: str, rule: str) -> "PieceEncoder":
    """One encoder for each Python worker, tokenizer file and rule."""
    if (path, rule) not in _ENCODERS:
        _ENCODERS[path, rule] = PieceEncoder(path, rule)
    return _ENCODERS[path, rule]


class PieceEncoder:
    def __init__(self, path: str, rule: str, kept: int = KEPT_PIECES):
        if rule not in ("gpt", "white"):
            raise ValueError(f"unknown rule {rule!r}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.rule, self.kept = rule, kept
        self.between = self.tokenizer.encode(_BETWEEN[rule], add_special_tokens=False).ids
        if len(self.between) != 1:
            raise ValueError(f"{path} does not give {_BETWEEN[rule]!r} one id")
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)  # both hashes of each known piece, ascending by the first
        self.slots = np.empty(0, np.int64)
        self.ids, self.bounds = np.empty(0, self.kind), np.zeros(1, np.int64)  # ids of slot i: bounds[i] to bounds[i + 1]

    def learn(self, pieces: list[bytes], together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after the other, and how many each has; those in which the separator's neighbours could matter go alone."""
        between, mark = _BETWEEN[self.rule].encode(), self.between[0]
        found, lengths, order = [], [], []
        alone = np.flatnonzero(~together).tolist()
        together = np.flatnonzero(together)
        parts = [together[lo : lo + TOGETHER].tolist() for lo in range(0, len(together), TOGETHER)]
        joined = [between.join([pieces[k] for k in p]).decode() for p in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) == len(part) - 1:
                found.append(ids[ids != mark])
                lengths.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                order += part
            else:
                alone += part
        if alone:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in alone], add_special_tokens=False)]
            found += [np.array(ids, np.uint32) for ids in each]
            lengths.append(np.array([len(ids) for ids in each], np.int64))
            order += alone
        ids, lengths, order = np.concatenate(found), np.concatenate(lengths), np.array(order)
        starts = np.cumsum(lengths) - lengths
        back = np.argsort(order)
        number = lengths[back]
        return ids[np.repeat(starts[back] - np.cumsum(number) + number, number) + np.arange(number.sum())], number

    @staticmethod
    def visible(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At which bytes a visible character begins, and at which one ends."""
        plain = (data > 0x20) & (data < 0x7F)
        c3 = data == 0xC3
        closes = plain.copy()
        closes[1:] |= c3[:-1]
        return plain | c3, closes

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; no piece crosses a row."""
        n = len(data)
        opens, closes = self.visible(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = (data == 0x20) | (data == 0x0A)
        first = edge[:n].copy()
        if self.rule == "gpt":
            lone = np.zeros(n, bool)
            lone[1:-1] = gap[1:-1] & closes[:-2] & opens[2:] & ~edge[1 : n - 1] & ~edge[2:n]
            first |= lone
            first[1:] |= lone[:-1] & (data[:-1] == 0x0A)
            starts = np.flatnonzero(first)
            return starts, np.append(starts[1:], n)
        first[1:] |= gap[:-1] & ~gap[1:]
        first &= ~gap
        last = edge[1:].copy()
        last[:-1] |= ~gap[:-1] & gap[1:]
        last &= ~gap
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other (uint32), and the offsets of the rows in them."""
        data, offsets = text_buffers(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        starts, ends = self.cut(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        found, which = distinct(data, starts, ends)
        keys, checks = string_hashes(found)
        if len(self.keys) + len(keys) > self.kept or len(self.ids) > 8 * KEPT_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        slots = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == keys) & (self.checks[near] == checks)
            slots[known] = self.slots[near[known]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, cuts = text_buffers(found)
            opens, closes = self.visible(raw)
            a, b = cuts[new], cuts[new + 1]
            mark = np.concatenate([[0], np.cumsum(raw == ord(_BETWEEN[self.rule].strip(" ")))])
            first = opens[a] | ((raw[a] == 0x20) & opens[np.minimum(a + 1, len(raw) - 1)] & (b > a + 1))
            flat = raw.tobytes()
            pieces = [flat[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            ids, number = self.learn(pieces, first & closes[b - 1] & (mark[b] == mark[a]))
            slots[new] = np.arange(len(new)) + len(self.bounds) - 1
            self.ids, self.bounds = np.concatenate([self.ids, ids.astype(self.kind)]), np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(number)])
            order = new[np.argsort(keys[new], kind="stable")]
            only = np.ones(len(order), bool)  # a first hash is kept once
            only[1:] = keys[order[1:]] != keys[order[:-1]]
            if len(self.keys):
                only &= self.keys[np.minimum(at[order], len(self.keys) - 1)] != keys[order]
            order = order[only]
            self.keys, self.checks, self.slots = (np.insert(old, at[order], x[order]) for old, x in ((self.keys, keys), (self.checks, checks), (self.slots, slots)))
        bounds, slot = self.bounds, slots[which]
        lengths = bounds[slot + 1] - bounds[slot]
        out = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(lengths, out=out[1:])
        ids = self.ids[np.repeat(bounds[slot] - out[:-1], lengths) + np.arange(out[-1])].astype(np.uint32)
        return ids, out[np.searchsorted(starts, offsets)]
