"""Similarity search by seeds and extension: words of a query's neighbourhood, two hits on a diagonal, extension without gaps, banded alignment where that passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import AMINO_ACIDS, COARSE
from ..plans.materialize import written
from .transfer import alignment, pairs_of_rows, texts

#: Rows of a matrix table at most: all pairs of 100 letters.
MATRIX_ROWS = 10_000
#: Cells of the bands that are worked out together.
BAND_CELLS = 1 << 20
#: Targets of a word beyond which it is dealt out over salts.
COMMON = 10_000
# The vote's cut-off score, and costs of the first and of each further letter of a gap.
CUTOFF, GAP, EXTEND = 60.0, -8.0, -1.0


def class_matrix(same: float = 5.0, alike: float = 1.0, other: float = -2.0) -> dict[str, float]:
    """A matrix by rule: one letter, two of a coarse class, others."""
    of = {c: name for name, letters in COARSE.items() for c in letters}
    return {a + b: same if a == b else alike if of[a] == of[b] else other for a in AMINO_ACIDS for b in AMINO_ACIDS}


def letter_matrix(letters: str, same: float = 2.0, other: float = -1.0) -> dict[str, float]:
    return {a + b: same if a == b else other for a in letters for b in letters}


def matrix_of(table: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> dict[str, float]:
    """The matrix that a table (a, b, score) holds; scores count both ways, and a pair with two scores keeps the greater one. More than MATRIX_ROWS rows are an error."""
    rows = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.max(score).alias("s")).limit(MATRIX_ROWS + 1).collect()
    if len(rows) > MATRIX_ROWS:
        raise ValueError(f"a matrix of more than {MATRIX_ROWS} rows")
    out: dict[str, float] = {}
    for r in rows:
        for pair in (r[0] + r[1], r[1] + r[0]):
            out[pair] = max(out.get(pair, float("-inf")), float(r["s"]))
    return out


class Scores:
    """A matrix over codes of letters; letters that it lacks share a code that scores `other` with all."""

    def __init__(self, matrix: dict[str, float], other: float) -> None:
        self.letters = sorted({c for pair in matrix for c in pair})
        self.code = {c: i for i, c in enumerate(self.letters)}
        n = len(self.letters)
        self.m = np.full((n + 1, n + 1), other)
        for pair, s in matrix.items():
            self.m[self.code[pair[0]], self.code[pair[1]]] = self.m[self.code[pair[1]], self.code[pair[0]]] = s

    def codes(self, text: str) -> np.ndarray:
        return np.array([self.code.get(c, len(self.letters)) for c in text], dtype=np.int64)


def neighbourhood(word: str, scores: Scores, least: float) -> list[str]:
    """All words of known letters that score `least` or more against a word, itself in any case; branches that cannot get there are left."""
    rows = [scores.m[c, :-1] for c in scores.codes(word)]
    rest = np.cumsum([r.max() for r in rows][::-1])[::-1].tolist() + [0.0]
    found = [("", 0.0)]
    for i, row in enumerate(rows):
        found = [(w + c, s + x) for w, s in found for c, x in zip(scores.letters, row.tolist(), strict=True) if s + x + rest[i + 1] >= least]
    return sorted({word, *(w for w, _ in found)})


def ungapped(along: np.ndarray, at: int, drop: float) -> tuple[float, int]:
    """(score, end) of the best stretch through place `at` of the pair scores of a diagonal; each way ends where it falls `drop` below its best."""

    def one_way(x: np.ndarray) -> tuple[float, int]:
        total = np.cumsum(x)
        best = np.maximum.accumulate(np.maximum(total, 0.0))
        stop = np.flatnonzero(best - total > drop)
        upto = int(stop[0]) if len(stop) else len(x)
        return (float(best[upto - 1]), upto) if upto else (0.0, 0)

    right, n = one_way(along[at:])
    return right + one_way(along[:at][::-1])[0], at + n


def banded(pairs: list[tuple[np.ndarray, np.ndarray, int, int]], scores: Scores, gap: float, extend: float) -> np.ndarray:
    """Scores of the best local alignments of (query, target, least and greatest diagonal) within their bands, for all pairs at once, row by row."""
    width, n = max(hi - lo for *_, lo, hi in pairs) + 1, max(len(q) for q, *_ in pairs)
    count, wide = len(pairs), max(len(t) for _, t, *_ in pairs)
    q, t = np.full((count, n), -1), np.full((count, wide), -1)
    for i, (a, b, *_) in enumerate(pairs):
        q[i, : len(a)], t[i, : len(b)] = a, b
    lo, size = np.array([p[2] for p in pairs])[:, None], np.array([len(p[1]) for p in pairs])[:, None]
    hi = np.array([p[3] for p in pairs])[:, None]
    d, row = np.arange(width)[None, :], np.arange(count)[:, None]
    ramp = extend * d
    h, f, best = np.zeros((count, width)), np.full((count, width), -1e30), np.zeros(count)
    for i in range(n):
        j = i + lo + d
        valid = (j >= 0) & (j < size) & (q[:, i : i + 1] >= 0) & (lo + d <= hi)
        pair = scores.m[q[:, i : i + 1], t[row, np.clip(j, 0, wide - 1)]]
        up_h, up_f = np.full_like(h, -1e30), np.full_like(f, -1e30)
        up_h[:, :-1], up_f[:, :-1] = h[:, 1:], f[:, 1:]
        f = np.maximum(up_h + gap, up_f + extend)
        now = np.where(valid, np.maximum(np.maximum(h + pair, f), 0.0), 0.0)
        e = np.full_like(h, -1e30)
        e[:, 1:] = np.maximum.accumulate(now - ramp, axis=1)[:, :-1] + ramp[:, 1:] + gap - extend
        h = np.where(valid, np.maximum(now, e), 0.0)
        best = np.maximum(best, h.max(axis=1))
    return best


def seeds(queries: DataFrame, targets: DataFrame, key: str, seq: str, scores: Scores, word: int, least: float, window: int, common: int = COMMON, own: bool = False) -> DataFrame:
    """(q, t, seeds array<struct<diagonal, place>>): pairs, with `own` those of one key too, with two words on one diagonal, apart by a word at least and `window` at most; place is that of the second in the query.

    Words of queries meet those of targets by an equi-join on the words of their neighbourhoods. Words of more than `common` places of targets are salted: their queries are repeated for each salt.
    """

    def words(d: DataFrame, name: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(1), F.length(seq) - word + 1)).alias("at")
        return d.where(F.length(seq) >= word).select(F.col(key).alias(name), seq, at).select(name, (F.col("at") - 1).alias(f"{name}_at"), F.substring(F.col(seq), F.col("at"), F.lit(word)).alias("word"))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, x) for w in f["word"] for x in neighbourhood(w, scores, least)]
            yield pd.DataFrame(rows, columns=["mine", "word"])

    q, t = words(queries, "q"), words(targets, "t")
    there = written(t.groupBy("word").agg(F.ceil(F.count("*") / common).cast("int").alias("salts")), "words")
    around = written(q.select("word").distinct().mapInPandas(near, "mine string, word string").join(there, "word"), "neighbourhoods")
    ts = t.join(there, "word").withColumn("salt", F.pmod(F.xxhash64("t", "t_at"), "salts")).select("t", "t_at", "word", "salt")
    qs = q.withColumnRenamed("word", "mine").join(around, "mine").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("q", "q_at", "word", F.col("salt").cast("long").alias("salt"))
    met = qs.join(ts, ["word", "salt"])
    hits = (met if own else met.where("q <> t")).select("q", "t", (F.col("t_at") - F.col("q_at")).alias("diagonal"), F.col("q_at").alias("place")).distinct()
    along = Window.partitionBy("q", "t", "diagonal").orderBy("place")
    second = hits.withColumn("first", F.min("place").over(along.rangeBetween(-window, -word))).where("first is not null")
    return second.groupBy("q", "t").agg(F.array_sort(F.collect_list(F.struct("diagonal", "place"))).alias("seeds"))


def search_texts(queries: DataFrame, targets: DataFrame, key: str, seq: str, matrix: dict[str, float], other: float = -4.0, word: int = 3, least: float = 11.0, window: int = 40, drop: float = 16.0, trigger: float = 22.0, pad: int = 16, cutoff: float = CUTOFF, gap: float = GAP, extend: float = EXTEND, common: int = COMMON) -> DataFrame:
    """(q, t, score, aligned, same): pairs whose local alignment with affine gaps scores `cutoff` or more, as transfer.align_scores() has them, those of one key included.

    Seeds are those of seeds(). A seed is extended along its diagonal until its score falls `drop` below its best; where that reaches `trigger`, an alignment within `pad` diagonals of such seeds is
    scored for many pairs at once, and where that reaches the cut-off, the pair is a hit and is aligned in full. A pair without such a seed is not found: least, window and trigger set how many are, and tests
    measure it. matrix has the scores of pairs of letters (see matrix_of()), `other` those of letters that it lacks. Null and short sequences have no words; keys tell rows apart on each side; an empty table gives no rows.
    """
    scores = Scores(matrix, other)
    found = seeds(queries, targets, key, seq, scores, word, least, window, common, own=True)
    side = lambda d, name: d.select(F.col(key).alias(name), F.col(seq).alias(f"{name}_seq"))
    pairs = found.join(side(queries, "q"), "q").join(side(targets, "t"), "t").select("q", "t", "q_seq", "t_seq", "seeds")

    def extended(q: np.ndarray, t: np.ndarray, marks: list) -> list[int]:
        """Diagonals whose extension reaches the trigger."""
        out, done = [], (None, -1)
        for x in marks:
            diagonal, place = x["diagonal"], x["place"]
            if diagonal == done[0] and (place < done[1] or out and out[-1] == diagonal):
                continue
            first = max(0, -diagonal)
            last = min(len(q), len(t) - diagonal)
            score, end = ungapped(scores.m[q[first:last], t[first + diagonal : last + diagonal]], place - first, drop)
            done = (diagonal, first + end)
            if score >= trigger:
                out.append(diagonal)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            work = []
            for i, (a, b, marks) in enumerate(zip(f["q_seq"], f["t_seq"], f["seeds"], strict=True)):
                q, t = scores.codes(a), scores.codes(b)
                if diagonals := extended(q, t, marks):
                    work.append((i, (q, t, max(min(diagonals) - pad, -len(q)), min(max(diagonals) + pad, len(t)))))
            work.sort(key=lambda w: (len(w[1][0]), w[1][3] - w[1][2]))
            hits, some, cells = [], [], 0
            for k, w in enumerate(work):
                some.append(w)
                cells += w[1][3] - w[1][2] + 1
                if cells >= BAND_CELLS // 64 or k == len(work) - 1:
                    hits += [i for (i, _), s in zip(some, banded([p for _, p in some], scores, gap, extend), strict=True) if s >= cutoff]
                    some, cells = [], 0
            rows = []
            for i in hits:
                a, b = f["q_seq"].iloc[i], f["t_seq"].iloc[i]
                score, at = alignment(a, b, gap=gap, extend=extend, matrix=matrix, other=other, local=True)
                rows.append((f["q"].iloc[i], f["t"].iloc[i], score, len(at), sum(a[x] == b[y] for x, y in at)))
            yield pd.DataFrame(rows, columns=["q", "t", "score", "aligned", "same"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"q {kinds['q']}, t {kinds['t']}, score double, aligned int, same int")


def search(queries: DataFrame, targets: DataFrame, key: str, seq: str, matrix: dict[str, float], **options) -> DataFrame:
    """(q, t, score, aligned, same): the pairs of rows that search_texts(), with its options, finds among their different texts, but those of one key: copies are compared once."""
    return pairs_of_rows(search_texts(texts(queries, seq), texts(targets, seq), "id", seq, matrix, **options), queries, targets, key, seq)
