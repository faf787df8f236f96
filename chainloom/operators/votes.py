"""Votes of vectors for a stated set of queries, block by block: what is kept of all the scores is a small summary that can be merged."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .transfer import QUERY_BLOCK, top_hits

#: Cells of the scores from -100 to 100, and targets that are scored at once.
CELLS, ROWS = 1024, 4096


def _cosines(queries: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """100 times the cosine of each query with each target; a pair's value does not depend on the others."""
    dots = np.einsum("id,jd->ij", queries, targets)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 100 * dots / np.sqrt(np.einsum("id,id->i", queries, queries)[:, None] * np.einsum("jd,jd->j", targets, targets)[None, :])


def _cell(scores: np.ndarray, n: int) -> np.ndarray:
    return np.clip(np.floor((scores + 100) * (n / 200)), 0, n - 1).astype(np.int64)


def _scored(frames: Iterator[pd.DataFrame], ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(targets, scores, whether they count): not of a query with itself, nor where there is no cosine."""
    for f in frames:
        for i in range(0, len(f), ROWS):
            some = f.iloc[i : i + ROWS]
            s = _cosines(vectors, np.stack(some["v"].to_numpy()).astype(np.float64))
            yield some, s, ~np.isnan(s) & (ids[:, None] != some["t"].to_numpy()[None, :])


def _first_look(targets: DataFrame, ids: np.ndarray, vectors: np.ndarray, top: int, n_cells: int) -> DataFrame:
    """(q, cell, n, t, label, score): of each task and query the `top` best targets (cell null), and how many scores each cell has (t null)."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best = np.zeros((len(ids), n_cells), np.int64), [[] for _ in ids]
        for some, s, good in _scored(frames, ids, vectors):
            t, y = some["t"].to_numpy(), some["label"].to_numpy()
            for q in range(len(ids)):
                at = np.flatnonzero(good[q])
                counts[q] += np.bincount(_cell(s[q, at], n_cells), minlength=n_cells)
                if len(at) > top:
                    at = at[s[q, at] >= np.partition(s[q, at], -top)[-top]]
                best[q] = sorted([*best[q], *zip((-s[q, at]).tolist(), t[at].tolist(), y[at].tolist(), strict=True)])[:top]
        q, c = np.nonzero(counts)
        yield pd.DataFrame({"q": ids[q], "cell": c, "n": counts[q, c], "t": None, "label": None, "score": None})
        rows = [(ids[q], None, None, x[1], x[2], -x[0]) for q, found in enumerate(best) for x in found]
        yield pd.DataFrame(rows, columns=["q", "cell", "n", "t", "label", "score"])

    return written(targets.mapInPandas(look, "q long, cell int, n long, t long, label double, score double"), "looks")


def _second_look(targets: DataFrame, ids: np.ndarray, vectors: np.ndarray, cells: dict[int, set[int]], n_cells: int) -> DataFrame:
    """(q, cell, score, n): the scores of the wanted cells of each query."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, s, good in _scored(frames, ids, vectors):
            for i, q in enumerate(ids.tolist()):
                values = s[i, good[i]]
                at = _cell(values, n_cells)
                for c in cells.get(q, ()):
                    x, n = np.unique(values[at == c], return_counts=True)
                    yield pd.DataFrame({"q": q, "cell": c, "score": x, "n": n})

    return targets.mapInPandas(look, "q long, cell int, score double, n long").groupBy("q", "cell", "score").agg(F.sum("n").alias("n"))


def vector_votes(queries: DataFrame, targets: DataFrame, cutoff: float = 60.0, denom: float = 2.0, pctl: float = 0.95, gamma: float = 1.0, top: int = 32, block: int = QUERY_BLOCK, n_cells: int = CELLS) -> DataFrame:
    """(q, t, label, score, w): the votes that transfer.vote_weights() gives for 100 times the cosine of every query with every target but itself.

    queries: (q, v), a stated set, taken `block` at a time; targets: (t, v, label), read where they lie and never shuffled or repeated. For each query a task keeps its `top` best targets and a
    table of how many scores each of n_cells cells holds; these are merged. The percentile lies in one cell, or between two, and a second look counts the scores of that cell alone. Vectors
    have one length; rows with a null key or vector, and vectors of zeros, have no score; repeated targets are targets of their own; empty tables give no rows.
    """
    out, clean = None, targets.where("t is not null and v is not null").select("t", "v", F.col("label").cast("double").alias("label"))
    rows = queries.where("q is not null and v is not null").select("q", "v").toLocalIterator()  # one block at a time
    while some := list(islice(rows, block)):
        ids, vectors = np.array([r["q"] for r in some], dtype=np.int64), np.array([r["v"] for r in some], dtype=np.float64)
        first = _first_look(clean, ids, vectors, top, n_cells)
        counts = first.where("cell is not null").groupBy("q", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most n_cells rows a query of the block
        places, cells, before = [], {}, []
        for q, f in counts.sort_values("cell").groupby("q"):
            upto, total = f["n"].cumsum().to_numpy(), int(f["n"].sum())
            for name, p in (("edge", pctl), ("high", 0.95)):
                at = p * (total - 1)
                for place, share in ((floor(at), 1 - (at - floor(at))), (ceil(at), at - floor(at))):
                    k = int(np.searchsorted(upto, place, side="right"))
                    cell = int(f["cell"].iloc[k])
                    cells.setdefault(int(q), set()).add(cell)
                    before.append((int(q), cell, int(upto[k] - f["n"].iloc[k])))
                    places.append((int(q), name, place, cell, float(share)))
        spark = targets.sparkSession
        if not places:
            continue
        wanted = spark.createDataFrame(places, "q long, name string, place long, cell int, share double")
        starts = spark.createDataFrame(sorted(set(before)), "q long, cell int, before long")
        run = F.sum("n").over(Window.partitionBy("q", "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
        values = _second_look(clean, ids, vectors, cells, n_cells).join(F.broadcast(starts), ["q", "cell"]).withColumn("upto", F.col("before") + run)  # four cells a query of the block
        hit = values.join(F.broadcast(wanted), ["q", "cell"]).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        q_of = lambda name: F.sum(F.when(F.col("name") == name, F.col("share") * F.col("score"))).alias(name)
        stats = hit.groupBy("q").agg(q_of("edge"), q_of("high"))
        best = top_hits(first.where("cell is null").select("q", "t", "label", "score"), "q", [F.desc("score"), F.asc("t")], top)
        most = best.groupBy("q").agg(F.max("score").alias("most"))
        thr = F.least(F.col("most") / denom, F.col("edge"), F.col("most") - 1e-6)
        w = F.pow(F.greatest(F.lit(0.0), (F.col("score") - F.col("thr")) / F.greatest(F.col("high") - F.col("thr"), F.lit(1.0))), F.lit(gamma))
        votes = best.join(most, "q").join(stats, "q").withColumn("thr", thr).where((F.col("score") >= cutoff) & (F.col("score") > F.col("thr"))).select("q", "t", "label", "score", w.alias("w"))
        out = votes if out is None else out.unionByName(votes)
    return targets.sparkSession.createDataFrame([], "q long, t long, label double, score double, w double") if out is None else out
