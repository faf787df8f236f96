"""Ranked lexical search: inverted lists by block of documents, searched by a hybrid of term-at-a-time and document-at-a-time.

Two passes over Spark partitions. The first writes an index: for each block of documents, the lists (documents, counts) of the terms that the queries have, and the lengths of all its
documents. Statistics of the corpus (documents, terms, documents of a term) are sums over it. The second reads the blocks; for each query, short lists are summed into accumulators first, term at a
time, and stand from then on as one iterator whose bound is their largest sum. That iterator and the long lists are then worked through document at a time: iterators whose bounds together stay
below the tenth best score so far offer no candidates; they are only looked up, by binary search, for candidates that can still reach it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import col, written
from .common import as_bytes, slices

#: Bytes of text of one block of the index.
BLOCK_BYTES = 8 << 20
#: A list is short if it holds at most one of so many documents of its block.
SHORT_PART = 32
#: Distinct terms of the queries of one pass; more queries are taken in several passes.
PASS_TERMS = 500_000
#: Fixed values of the score: 100 * b, 10 * k1 * 0.8 and the scale of a share.
B, K, SCALE = 75, 8, 1_000_000_000
TOP = 10
#: What ends a term: all of ASCII but digits and letters. A to Z become small, bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
INDEX = "n_docs long, n_terms long, ids array<long>, lengths array<int>, terms array<int>, starts array<int>, docs array<int>, counts array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a text in order."""
    return (text or b"").translate(_TABLE).split()


def block_index(ids: list[int | None], texts: list[bytes | None], numbers: dict[bytes, int]) -> dict:
    """A row of the index: ids and lengths of documents with a term (null ids go last in ranks), and for each known term its documents, by place, and counts."""
    at, lengths, lists = [], [], {}
    for doc_id, text in zip(ids, texts, strict=True):
        words = terms_of(text)
        if words:
            for term, n in Counter(words).items():
                if (number := numbers.get(term)) is not None:
                    lists.setdefault(number, []).append((len(at), n))
            at.append(doc_id)
            lengths.append(len(words))
    terms = sorted(lists)
    starts = np.cumsum([0, *(len(lists[t]) for t in terms)]).tolist()
    flat = [p for t in terms for p in lists[t]]
    return {"n_docs": len(at), "n_terms": sum(lengths), "ids": at, "lengths": lengths, "terms": terms, "starts": starts, "docs": [p[0] for p in flat], "counts": [p[1] for p in flat]}


def index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of all docs, one row a block of about BLOCK_BYTES of text. numbers: the terms that get lists, by number."""
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.list_(pa.int32())) for n in ("lengths", "terms", "starts", "docs", "counts"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK_BYTES):
            yield pa.RecordBatch.from_pylist([block_index(b.column(0).to_pylist(), as_bytes(b.column(1)), numbers)], schema)

    return written(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(build, INDEX), "index")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to a document's score, in whole numbers."""
    m = 100 - B + (B * lengths * n) // total
    return (SCALE * counts) // (1000 * counts + K * m)


class Best:
    """The best documents of a query so far: by score, equal ones by id, null ids last."""

    def __init__(self, k: int = TOP) -> None:
        self.k = k
        self.rows: list[tuple[int, int | None]] = []

    @property
    def floor(self) -> int:
        """A score below this one is not among the best; an equal one may be."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.rows = sorted([*self.rows, *zip(scores.tolist(), ids, strict=True)], key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that reach the floor; lists: documents in order, and what each adds."""
    short = [x for x in lists if len(x[0]) * SHORT_PART <= n_docs]
    iterators = [x for x in lists if len(x[0]) * SHORT_PART > n_docs]
    sums = np.zeros(n_docs, np.int64)
    if short:  # term at a time: one list of sums
        for docs, adds in short:
            sums[docs] += adds
        at = np.flatnonzero(sums)
        iterators.append((at, sums[at]))
    iterators = sorted(((int(a.max(initial=0)), d, a) for d, a in iterators), key=lambda x: x[0])
    below = np.cumsum([0, *(x[0] for x in iterators)])  # the most that the first iterators add together
    must = int(np.searchsorted(below[1:], floor))  # first iterator without which nothing reaches the floor
    if must == len(iterators):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums[:] = 0
    for _, docs, adds in iterators[must:]:
        sums[docs] += adds
    here = np.flatnonzero(sums)
    scores = sums[here]
    for i in range(must - 1, -1, -1):  # document by document: what can still reach the floor skips to its place in the next list
        live = scores + below[i + 1] >= floor
        here, scores = here[live], scores[live]
        if not len(here):
            break
        _, docs, adds = iterators[i]
        to = np.minimum(np.searchsorted(docs, here), len(docs) - 1)
        scores = scores + np.where(docs[to] == here, adds[to], 0)
    live = scores >= floor
    return here[live], scores[live]


def search_index(blocks: DataFrame, wanted: list[tuple[int, dict[int, int]]], weights: dict[int, int], n: int, total: int, k: int = TOP) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each query (number, {term: times})."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, starts, docs, counts = (batch.column(i)[row].values for i in range(2, 8))
                n_docs = batch.column(0)[row].as_py()
                if not n_docs or not len(terms):
                    continue
                lengths, starts, docs, counts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, starts, docs, counts))
                place = {t: i for i, t in enumerate(terms.to_pylist())}
                adds = impacts(counts, lengths[docs], n, total)
                for (_, times), found in zip(wanted, best, strict=True):
                    lists = [(docs[a:b], adds[a:b] * (weights[t] * q)) for t, q in times.items() if (i := place.get(t)) is not None and weights[t] for a, b in [(starts[i], starts[i + 1])]]
                    if lists:
                        here, scores = search_block(lists, n_docs, found.floor)
                        if len(here) > k:  # all that reach the k-th of these
                            cut = np.partition(scores, -k)[-k]
                            here, scores = here[scores >= cut], scores[scores >= cut]
                            if len(here) > 4 * k:  # many ties: the smallest ids of each
                                order = np.lexsort((ids.to_numpy(zero_copy_only=False)[here], -scores))[:k]
                                here, scores = here[order], scores[order]
                        found.offer(scores, ids.take(pa.array(here)).to_pylist())
        rows = [(i, r[1], r[0]) for (i, _), found in zip(wanted, best, strict=True) for r in found.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(3)], schema=schema)

    return blocks.mapInArrow(search, "item int, doc_id long, score long")


def top_rows(hits: DataFrame, k: int = TOP, parts: int = 64) -> DataFrame:
    """The k best hits of each item with their rank: first of each of `parts` parts of an item, then of these."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts))
    cut = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def passes(queries: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, by passes of at most `most` terms (or one item), read one after another."""
    now, size = [], 0
    for item, text in queries.select(col(item_col).cast("long"), col(text_col).cast("string")).toLocalIterator():
        words = terms_of(None if text is None else text.encode())
        if now and size + len(words) > most:
            yield now
            now, size = [], 0
        now.append((item, words))
        size += len(words)
    if now:
        yield now


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries the k best rows of docs with a score above 0, best first, equal scores by id, null ids last.

    Terms are runs of digits, ASCII letters and characters above ASCII, A to Z lower-cased; texts are read whole. Terms that a query repeats count as often. Null and empty texts have no term: such documents are
    found by nothing and counted nowhere, such queries find nothing. Repeated rows are documents of their own, so they share a score and stand side by side; repeated queries get rows each.
    Other columns, whatever their names, are not read. Empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    for items in passes(queries, item_col, query_col, pass_terms):
        numbers = {t: i for i, t in enumerate(sorted({w for _, words in items for w in words}))}
        blocks = index(docs, numbers, id_col, text_col)
        sums = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n, total = int(sums[0] or 0), int(sums[1] or 0)
        lists = blocks.select(F.posexplode("terms").alias("i", "term"), "starts").select("term", (F.get("starts", F.col("i") + 1) - F.get("starts", F.col("i"))).cast("long").alias("n"))
        weights = {r["term"]: weight(n, r["df"]) for r in lists.groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}  # at most the terms of one pass
        wanted = [(i, dict(Counter(numbers[w] for w in words))) for i, (_, words) in enumerate(items)]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id long")
        found = top_rows(search_index(blocks, wanted, weights, n, total, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # the items of one pass
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
