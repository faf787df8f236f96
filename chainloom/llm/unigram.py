"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary is a public one, with bytes as fallback. Its file ranks pieces and has no probabilities, so by
default the log score of a piece is that of Zipf's law for its rank, log(1 / (rank * H)). Scores of a unigram model are
taken as they are with scores="model".

Texts are cut where no piece can cross, each distinct segment is encoded once per worker, and all new segments
of a slice go through the trie and the Viterbi lattice together in numpy.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import SPACE, Cache, Pieces, load_pieces, segments
from .trie import DoubleArray, alone, by_offset, lattice, like_lengths, stretches

UNKNOWN_PENALTY = np.float32(10)

#: Bytes of segments and their ids that a task keeps.
TASK_CACHE_BYTES = 32 << 20


class Unigram:
    """Encoder and decoder over a vocabulary; made once per worker."""

    def __init__(self, pieces: Pieces, scores: str = "zipf"):
        names = list(pieces.normal)
        ids = np.array([pieces.normal[p][0] for p in names])
        raw = np.array([pieces.normal[p][1] for p in names], dtype=np.float64)
        if scores == "zipf":
            rank = np.empty(len(names))
            rank[np.lexsort((ids, -raw))] = np.arange(1, len(names) + 1)
            raw = -np.log(rank) - np.log((1 / rank).sum())
        self.score = np.zeros(pieces.size, dtype=np.float32)
        self.score[ids] = raw.astype(np.float32)
        self.unknown = np.float32(raw.min()) - UNKNOWN_PENALTY
        self.pieces, self.byte_ids = pieces, np.array(pieces.byte_ids, dtype=np.int32)
        self.trie = DoubleArray([p.encode() for p in names], ids.tolist())
        self.bytes_of = [b""] * pieces.size
        for p in names:
            self.bytes_of[pieces.normal[p][0]] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(pieces.size, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.cache = Cache(self.encode_segments, TASK_CACHE_BYTES)

    def encode_segments(self, texts: list[str]) -> list[bytes]:
        """int32 ids of each segment's best path, as bytes."""
        out: list[bytes] = [b""] * len(texts)
        for where, data in like_lengths(texts):
            for i, ids in zip(where, map(self._viterbi_long, data) if alone(data) else self._viterbi(data), strict=True):
                out[i] = ids
        return out

    def _viterbi(self, data: list[bytes]) -> list[bytes]:
        found = lattice(self.trie, data)
        lengths, first, flat, begin, end, piece = found.lengths, found.first, found.flat, found.begin, found.end, found.piece
        score = np.where(piece >= 0, self.score[piece], self.unknown).astype(np.float32)
        shift = found.row[begin]
        from_node, to_node, offset = begin + shift, end + shift, begin - first[shift]
        rank, ranges = by_offset(offset)
        from_node, to_node, score, piece = from_node[rank], to_node[rank], score[rank], piece[rank]
        best = np.full(len(flat) + len(data), -np.inf, dtype=np.float32)
        back = np.full(len(flat) + len(data), -1, dtype=np.int64)
        start_node = first + np.arange(len(data))
        best[start_node] = 0
        for lo, hi in ranges:
            value = best[from_node[lo:hi]] + score[lo:hi]
            to = to_node[lo:hi]
            better = value > best[to]
            best[to[better]] = value[better]
            back[to[better]] = lo + np.flatnonzero(better)
        # read the paths back
        rows, at = np.arange(len(data)), start_node + lengths
        rows = rows[lengths > 0]
        at = at[lengths > 0]
        path_row, path_edge = [], []
        while len(rows):
            edge = back[at]
            path_row.append(rows)
            path_edge.append(edge)
            at = from_node[edge]
            on = at != start_node[rows]
            rows, at = rows[on], at[on]
        row, edge = np.concatenate(path_row)[::-1], np.concatenate(path_edge)[::-1]
        ranked = by_offset(row)[0]
        row, edge = row[ranked], edge[ranked]
        token, n = piece[edge], np.ones(len(edge), dtype=np.int64)
        lost = token < 0
        n[lost] = to_node[edge[lost]] - from_node[edge[lost]]
        out = np.repeat(token, n)
        spot = np.cumsum(n) - n
        for k in range(4):
            deep = lost & (n > k)
            out[spot[deep] + k] = self.byte_ids[flat[from_node[edge[deep]] - row[deep] + k]]
        per = np.bincount(row, weights=n, minlength=len(data)).astype(np.int64)
        raw, cut = out.astype(np.int32).tobytes(), np.concatenate([[0], np.cumsum(per)]) * 4
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _viterbi_long(self, data: bytes) -> bytes:
        """The best path of one segment: a step back, 12 bytes, is kept for each byte, and edges for a stretch at a time."""
        score, unknown = self.score.tolist(), float(self.unknown)
        best, token, origin = array("d", [-np.inf]) * (len(data) + 1), array("i", [-1]) * (len(data) + 1), array("i", [0]) * (len(data) + 1)
        best[0] = 0.0
        for begins, ends, ids in stretches(self.trie, data):
            for a, b, t in zip(begins, ends, ids, strict=True):
                value = best[a] + (score[t] if t >= 0 else unknown)
                if value > best[b]:
                    best[b], token[b], origin[b] = value, t, a
        out, at, byte_ids = array("i"), len(data), self.byte_ids.tolist()
        while at:
            if token[at] >= 0:
                out.append(token[at])
            else:
                out.extend([byte_ids[x] for x in reversed(data[origin[at] : at])])
            at = origin[at]
        out.reverse()
        return out.tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        cut = segments(text or "", self.pieces.cuttable)
        self.cache.fill(cut)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, cut)), dtype=np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Marks become spaces, runs of byte pieces UTF-8 (U+FFFD where invalid); the mark in front goes."""
        step = 1 << 16  # lists of numbers take 40 bytes each
        parts = (ids[i : i + step] for i in range(0, len(ids), step))
        text = b"".join(b"".join(map(self.bytes_of.__getitem__, x if isinstance(x, list) else x.tolist())) for x in parts).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_MADE: dict = {}


def _encoder(key: tuple, pieces: Pieces) -> Unigram:
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Unigram(pieces, key[1])
    return _MADE[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, n_fallback, round_trip): one row per row of docs.

    n_fallback counts byte pieces; round_trip tells whether decoding gives the text again (a text with a literal U+2581
    comes back with a space there, and is compared so). Null and empty texts have no tokens. Repeated rows and null
    ids keep their rows; an empty table gives no rows. Texts are encoded whole: a word of any length goes through the lattice in stretches. Among
    paths of equal score the one found first, from the left, counts. Other columns of docs play no part.
    """
    pieces, key = load_pieces(model_path), (model_path, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _encoder(key, pieces)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cut = [segments(t, pieces.cuttable) for t in texts]
            m.cache.fill(s for c in cut for s in c)
            raw = [b"".join(map(m.cache.__getitem__, c)) for c in cut]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), dtype=np.int32)
            bytes_up_to = np.concatenate([[0], np.cumsum(m.is_byte[ids])])
            back = [m.decode(np.frombuffer(r, dtype=np.int32)) == t.replace(SPACE, " ") for r, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(bytes_up_to[offsets[1:]] - bytes_up_to[offsets[:-1]]), pa.array(back, pa.bool_())],
                ["doc_id", "ids", "n_tokens", "n_fallback", "round_trip"],
            )
        m.cache.drop()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_fallback long, round_trip boolean")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", scores: str = "zipf") -> DataFrame:
    """(doc_id, text): the texts of id arrays; null arrays give null, empty ones the empty text. Repeated rows and null ids keep their rows."""
    pieces, key = load_pieces(model_path), (model_path, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _encoder(key, pieces)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
