"""Token counts of every prefix of a text, by dynamic programming.

The tokens of a byte-pair encoding are a valid encoding exactly if each neighbouring pair of them is what the merges
make of their joined text. So the last token of each prefix follows from those of shorter prefixes, and the count of
a prefix is one more than that of the prefix its last token leaves. One pass over a text answers how long it is, where it
must be cut for a budget, and what any prefix costs, without encoding anything again.

Texts are cut where no piece can cross; counts of segments add up, and each distinct segment is worked out once
per worker.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import Cache, Pieces, load_pieces, segments
from .trie import DoubleArray, alone, by_offset, lattice, like_lengths, stretches

#: Room for neighbouring pairs of pieces, a power of two; the table starts anew when half full, so memory is bounded.
SLOTS = 1 << 22
_NEVER = float("-inf")


class PrefixCounts:
    def __init__(self, pieces: Pieces):
        self.score = {p: s for p, (_, s) in pieces.normal.items()}
        self.pieces = pieces
        self.name = [""] * pieces.size
        for p, (i, _) in pieces.normal.items():
            self.name[i] = p
        whole = [p for p in self.score if len(p) == 1 or self.merge(p) == [p]]  # no text has other pieces as tokens
        self.trie = DoubleArray([p.encode() for p in whole], [pieces.normal[p][0] for p in whole])
        self.pairs, self.fits, self.known = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=bool), 0
        self.cache = Cache(self.prefixes)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scored neighbouring pair first, the leftmost of equal ones."""
        parts, score = list(text), self.score.get
        pairs = [score(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > _NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], _NEVER)
        return parts

    def fitting_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging makes the pieces a, b of their joined text. Answers are kept in a hash table."""
        key, most = a * self.pieces.size + b, SLOTS // 2  # so many keys always fit into an empty table
        if len(key) <= most:
            return self._fitting(key)
        return np.concatenate([self._fitting(key[i : i + most]) for i in range(0, len(key), most)])

    def _fitting(self, key: np.ndarray) -> np.ndarray:
        start = (key * 0x9E3779B1 & 0xFFFFFFFFFFFF) >> 16 & (SLOTS - 1)
        slot, ask = start.copy(), np.arange(len(key))
        while len(ask):
            there = self.pairs[slot[ask]]
            if (lost := ask[there < 0]).size:
                new = np.unique(key[lost])
                if self.known + len(new) > SLOTS // 2:  # full: forget all, and look up these keys from the start
                    self.pairs.fill(-1)
                    self.known = 0
                    slot, ask = start.copy(), np.arange(len(key))
                    continue
                for k in new.tolist():
                    self.learn(k)
                continue
            ask = ask[there != key[ask]]
            slot[ask] = slot[ask] + 1 & (SLOTS - 1)
        return self.fits[slot]

    def learn(self, key: int) -> None:
        x, y = self.name[key // self.pieces.size], self.name[key % self.pieces.size]
        at = (key * 0x9E3779B1 & 0xFFFFFFFFFFFF) >> 16 & (SLOTS - 1)
        while self.pairs[at] >= 0 and self.pairs[at] != key:
            at = at + 1 & (SLOTS - 1)
        self.known += self.pairs[at] < 0
        self.pairs[at], self.fits[at] = key, self.merge(x + y) == [x, y]

    def prefixes(self, texts: list[str]) -> list[bytes | array]:
        """For each segment the token counts of its prefixes of 1, 2, ... characters: bytes where they fit."""
        out: list[bytes | array] = [b""] * len(texts)
        for where, data in like_lengths(texts):
            for i, counts in zip(where, map(self._dynamic_long, data) if alone(data) else self._dynamic(data), strict=True):
                out[i] = counts
        return out

    def _dynamic(self, data: list[bytes]) -> list[bytes | array]:
        found = lattice(self.trie, data)
        shift = found.row[found.begin]
        rank, ranges = by_offset(found.end - found.first[shift])
        from_node, to_node, piece = (x[rank] for x in (found.begin + shift, found.end + shift, found.piece.astype(np.int64)))
        cost = np.where(piece >= 0, 1, to_node - from_node)
        nodes = len(found.flat) + len(data)
        last, count = np.full(nodes, -1, dtype=np.int64), np.zeros(nodes, dtype=np.int64)  # -1: the start, or no piece; fits anything
        for lo, hi in ranges:  # prefixes of one length of all segments
            before, to, token = from_node[lo:hi], to_node[lo:hi], piece[lo:hi]
            left = last[before]
            ask = np.flatnonzero((left >= 0) & (token >= 0))
            if len(ask):
                fits = np.ones(hi - lo, dtype=bool)
                fits[ask] = self.fitting_pairs(left[ask], token[ask])
                before, to, token = before[fits], to[fits], token[fits]
                count[to] = count[before] + cost[lo:hi][fits]
            else:
                count[to] = count[before] + cost[lo:hi]
            last[to] = token
        ends = np.append(found.heads[1:], len(found.flat))  # byte after each character
        per_char = count[ends + found.row[found.heads]]
        sizes = np.bincount(found.row[found.heads], minlength=len(data))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        small, wide = per_char.astype(np.uint8).tobytes(), per_char.astype(np.int64)
        top = np.where(sizes > 0, wide[np.maximum(cut[1:] - 1, 0)], 0)
        return [small[i:j] if n < 256 else array("q", wide[i:j].tobytes()) for i, j, n in zip(cut[:-1].tolist(), cut[1:].tolist(), top.tolist(), strict=True)]

    def _dynamic_long(self, data: bytes) -> bytes | array:
        """The same for one segment: 12 bytes are kept for each byte, edges for a stretch at a time, and answers about pairs within bounds."""
        last, count, size, name = array("i", [-1]) * (len(data) + 1), array("q", [0]) * (len(data) + 1), self.pieces.size, self.name
        known: dict[int, bool] = {}
        for begins, ends, ids in stretches(self.trie, data):
            if len(known) > SLOTS // 4:
                known.clear()
            for a, b, t in zip(begins, ends, ids, strict=True):
                left = last[a]
                if left >= 0 and t >= 0:
                    key = left * size + t
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = self.merge(name[left] + name[t]) == [name[left], name[t]]
                    if not fits:
                        continue
                last[b], count[b] = t, count[a] + (1 if t >= 0 else b - a)
        flat = np.frombuffer(data, dtype=np.uint8)
        ends = np.append(np.flatnonzero((flat[1:] & 0xC0) != 0x80) + 1, len(data))
        per_char = np.frombuffer(count, dtype=np.int64)[ends]
        return per_char.astype(np.uint8).tobytes() if per_char[-1] < 256 else array("q", per_char.tobytes())

    def of(self, cut: list[str]) -> int:
        return sum(map(itemgetter(-1), map(self.cache.__getitem__, cut)))

    def count(self, text: str | None) -> int:
        cut = segments(text or "", self.pieces.cuttable)
        self.cache.fill(cut)
        return self.of(cut)

    def table(self, text: str | None) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        cut = segments(text or "", self.pieces.cuttable)
        self.cache.fill(cut)
        out, before = [0], 0
        for s in cut:
            out += [before + n for n in self.cache[s]]
            before = out[-1]
        if cut:
            del out[1]  # the mark in front is no character of the text
        return np.array(out)

    def fitting(self, cut: list[str], budget: int) -> int:
        """Characters of the longest prefix, of those up to which no prefix is over it, with at most budget tokens."""
        ends = list(accumulate(map(itemgetter(-1), map(self.cache.__getitem__, cut))))
        k = bisect_right(ends, budget)
        chars = sum(map(len, cut[:k])) - 1
        if k < len(cut):
            before = ends[k - 1] if k else 0
            for n in self.cache[cut[k]]:
                if before + n > budget:
                    break
                chars += 1
        return max(0, chars)


_MADE: dict = {}


def _counter(path: str, pieces: Pieces) -> PrefixCounts:
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = PrefixCounts(pieces)
    return _MADE[path]


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    pieces = load_pieces(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _counter(model_path, pieces)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cut = [segments(t, pieces.cuttable) for t in texts]
            m.cache.fill(s for c in cut for s in c)
            yield row(m, b, texts, cut)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, model_path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): one row per row of docs.

    fit_chars is the length, in characters, of the prefix that keeps within budget tokens. Null texts count as empty: no
    bytes, no tokens. Repeated rows and null ids keep their rows; an empty table gives no rows. Texts are counted whole: a word of any
    length goes through in stretches. Other columns of docs play no part.
    """

    def row(m: PrefixCounts, b: pa.RecordBatch, texts: list[str], cut: list[list[str]]) -> pa.RecordBatch:
        n = [m.of(c) for c in cut]
        fit = [len(t) if k <= budget else m.fitting(c, budget) for t, c, k in zip(texts, cut, n, strict=True)]
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), size, pa.array(n, pa.int64()), pa.array([k > budget for k in n], pa.bool_()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return _mapped(docs, model_path, id_col, text_col, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", row)


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts array<int>): counts[i] is the exact number of tokens of the first i characters.

    Any later truncation or budget question is a lookup in this array. Null and empty texts have [0].
    """

    def row(m: PrefixCounts, b: pa.RecordBatch, texts: list[str], cut: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([m.table(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return _mapped(docs, model_path, id_col, text_col, "doc_id long, counts array<int>", row)
