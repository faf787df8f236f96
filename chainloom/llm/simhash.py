"""SimHash near-duplicates by a binary-trie self-join.

1. A 64-bit fingerprint of word shingles per document (Arrow batches, one pass over the text).
2. Distinct fingerprints are dealt out by pigeonhole: of m bit blocks, two that differ in at most b bits agree in m - b, so each goes
   to a group for every choice of m - b blocks. m grows with the number of fingerprints, so that groups stay small. A group above
   `split_over` fingerprints is cut into hashed chunks, and every pair of chunks becomes a group of its own: exact, and no task
   holds a hot group.
3. Inside a group, the sorted fingerprints form a binary trie. Pairs of nodes go down together, differing
   bits add up, and a pair beyond the budget is pruned; so is a pair whose leaves are linked already.
4. A group emits a spanning forest of its links, never all pairs; components join the forests.

For a similarity of shingle sets, similar() takes several independently seeded fingerprints of shorter shingles through the same trie join,
compares wide signatures where leaves meet, and confirms the links of the forests by exact shingle overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import component_roots
from ..plans.materialize import col, fresh, small, spread_join, written
from .common import as_bytes, slices

SEED = 42
#: Node pairs that go down together at most; bounds the memory of a task.
FRONTIER = 1 << 16
#: Fingerprints of a group, on average, up to which blocks are not made finer.
GROUP = 2048


def majority(h: np.ndarray) -> np.ndarray:
    """For each row of hashes (rows, n): the bits that more than half of them have."""
    rows, n = h.shape
    counts = np.zeros((rows, 8, 8), dtype=np.int64)  # byte, bit
    for at in range(0, n, 255 * 64):
        part = h[:, None, at : at + 255 * 64] >> np.arange(8, dtype=np.uint64)[:, None] & np.uint64(0x0101010101010101)
        lanes = np.add.reduceat(part, np.arange(0, part.shape[2], 255), axis=2)  # a byte lane holds up to 255
        counts += lanes.view(np.uint8).reshape(rows, 8, -1, 8).sum(axis=2, dtype=np.int64).transpose(0, 2, 1)
    return np.packbits(2 * counts.reshape(rows, 64) > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(data: bytes | None, k: int = 4) -> int:
    """64-bit SimHash of the k-word shingles of a UTF-8 text; 0 for null and texts without a word."""
    words = (data or b"").lower().split()  # bytes.lower and bytes.split know A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends[:n] - [len(w) + 1 for w in words[:n]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    return int(majority(h[None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp long): one row per row of docs, null ids and texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, k) for t in as_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- trie


def _leading_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bits of unsigned 64-bit numbers."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, 32 + np.frexp(high)[1], np.where(low > 0, np.frexp(low)[1], 0))
    return 64 - length


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray, used: list[np.ndarray] | None = None, number: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each leaf's component once the leaf pairs (i, j) are tied; used gets the numbers of the pairs that tied two components."""
    number = np.arange(len(i)) if number is None else number
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b, number = i[apart], j[apart], a[apart], b[apart], number[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(labels, high, low)
        if used is not None:
            won = np.flatnonzero(labels[high] == low)
            used.append(number[won[np.unique(high[won], return_index=True)[1]]])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


class Forest:
    """Binary tries of several groups at once: leaves sorted by (group, value), nodes as leaf ranges."""

    def __init__(self, group: np.ndarray, value: np.ndarray, wide: np.ndarray | None = None, wide_budget: int = 0):
        self.value, self.wide, self.wide_budget = value, wide, wide_budget
        self.tied: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(value)
        same = np.full(n, -1)  # leading bits shared with the leaf before; -1 at a new group
        if n > 1:
            same[1:] = np.where(group[1:] == group[:-1], _leading_equal(value[1:], value[:-1]), -1)
        self.starts, self.sizes, self.children = [], [], []
        node_before = None
        for depth in range(65):
            first = same < depth
            starts = np.flatnonzero(first)
            self.starts.append(starts)
            self.sizes.append(np.diff(np.append(starts, n)))
            node = np.cumsum(first) - 1
            if depth:
                child = np.full((len(self.starts[-2]), 2), -1, dtype=np.int64)
                bit = (value[starts] >> np.uint64(64 - depth)) & np.uint64(1)
                child[node_before[starts], bit.astype(np.int64)] = np.arange(len(starts))
                self.children.append(child)
            node_before = node

    def wide_distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for word in range(self.wide.shape[1]):
            out += np.bitwise_count(self.wide[i, word] ^ self.wide[j, word])
        return out

    def runs(self, a: int, b: int, labels: np.ndarray) -> np.ndarray:
        """Ties leaves of the runs a and b of equal values: each leaf in turn to all that are not in its component yet."""
        first, size = self.starts[64], self.sizes[64]
        left = np.arange(first[a], first[a] + size[a])
        both = left if a == b else np.concatenate([left, np.arange(first[b], first[b] + size[b])])
        for leaf in left:
            other = both[labels[both] != labels[leaf]]
            if not len(other):
                break
            near = np.full(len(other), True) if self.wide is None else self.wide_distance(np.full(len(other), leaf), other) <= self.wide_budget
            j = other[near]
            used: list[np.ndarray] = []
            labels = _merge(labels, np.full(len(j), leaf), j, used)
            self.tied += [(np.full(len(n), leaf), j[n]) for n in used]
        return labels

    def links(self, budget: int, labels: np.ndarray) -> np.ndarray:
        """labels after all leaf pairs of a group that differ in at most `budget` bits are tied."""
        uniform = []
        for starts in self.starts:
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            uniform.append(np.where(low == high, low, -1))
        roots = np.arange(len(self.starts[0]))
        stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.int64))]
        while stack:
            depth, a, b, diff = stack.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack += [(depth, a[:half], b[:half], diff[:half]), (depth, a[half:], b[half:], diff[half:])]
                continue
            linked = (uniform[depth][a] >= 0) & (uniform[depth][a] == uniform[depth][b])
            alone = (self.sizes[depth][a] == 1) & (self.sizes[depth][b] == 1)
            pair = alone & ~linked
            if pair.any():
                i, j = self.starts[depth][a[pair]], self.starts[depth][b[pair]]
                near = np.bitwise_count(self.value[i] ^ self.value[j]) <= budget
                i, j = i[near], j[near]
                if self.wide is not None:
                    near = self.wide_distance(i, j) <= self.wide_budget
                    i, j = i[near], j[near]
                used: list[np.ndarray] = []
                labels = _merge(labels, i, j, used)
                self.tied += [(i[n], j[n]) for n in used]
            go = ~(alone | linked)
            if depth == 64:
                for x, y in zip(a[go].tolist(), b[go].tolist(), strict=True):
                    labels = self.runs(x, y, labels)
            if depth == 64 or not go.any():
                continue
            a, b, diff = a[go], b[go], diff[go]
            ca, cb, twin = self.children[depth][a], self.children[depth][b], a == b
            found = []
            for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
                more = diff + (x != y)
                ok = (ca[:, x] >= 0) & (cb[:, y] >= 0) & (more <= budget)
                if (x, y) == (1, 0):
                    ok &= ~twin
                found.append((ca[ok, x], cb[ok, y], more[ok]))
            a, b, diff = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                stack.append((depth + 1, a, b, diff))
        return labels


def forest_edges(group: np.ndarray, value: np.ndarray, budget: int, wide: np.ndarray | None = None, wide_budgets: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """Leaf index pairs of a spanning forest of all links, each pair a link itself; group and value sorted.

    With wide signatures (one row a leaf), only leaves within the wide budget are links; closer budgets first, so the forest prefers them. Equal
    values may repeat within a group.
    """
    labels = np.arange(len(value))
    if not len(value):
        return labels, labels
    forest = Forest(group, value, wide)
    passes = [(min(1, budget), wide_budgets[0]), *[(budget, w) for w in wide_budgets]]  # close ones first: later pairs of linked nodes are pruned
    for step, forest.wide_budget in passes:
        labels = forest.links(step, labels)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *[i for i, _ in forest.tied]]), np.concatenate([none, *[j for _, j in forest.tied]])


# ---------------------------------------------------------------- plan


def block_plan(budget: int, n: int, group: int = GROUP) -> list[list[tuple[int, int]]]:
    """Key choices for n fingerprints: each a list of the (shift, width) of its blocks.

    Of m blocks, any two fingerprints within the budget agree in m - budget. m is the least with which n fingerprints of
    random bits give groups of `group` or fewer; all choices of blocks are used, so any m is exact.
    """
    m = budget + 1
    while m < 64 and n / 2 ** (64 * (m - budget) / m) > group and comb(m + 1, budget) <= 1000:
        m += 1
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(blocks, m - budget)]


def _keys(fp: Column, plan: list[list[tuple[int, int]]], first: int = 0) -> Column:
    """array<struct<block, part>>: what the fingerprint has in each choice of blocks."""

    def part(choice: list[tuple[int, int]]) -> Column:
        out, at = F.lit(0).cast("long"), 0
        for shift, width in choice:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)), at))
            at += width
        return out

    return F.array(*[F.struct(F.lit(first + k).alias("block"), part(choice).alias("part")) for k, choice in enumerate(plan)])


def _join_groups(budget: int, wide_budgets: tuple[int, ...] = (0,), wide_words: int = 0):
    names = ["block", "part", "ci", "cj"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(c).to_numpy() for c in names]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        group, value = np.cumsum(new), t.column("fp").to_numpy().view(np.uint64)
        node = t.column("node").to_numpy()
        order = np.lexsort((node, value, group))  # ties by node, so that the forest does not hang on the order in which rows came
        wide = None
        if wide_words:
            sig = t.column("sig").combine_chunks()
            sig = sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig
            wide = np.frombuffer(b"".join(sig.to_pylist()), dtype="<u8").reshape(-1, wide_words)[order]
        i, j = forest_edges(group[order], value[order], budget, wide, wide_budgets)
        node = node[order]
        far = np.zeros(len(i), dtype=np.int64) if wide is None else np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(far)], ["u", "v", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [], 0
        for b in batches:  # sorted by group; a group may go over several batches
            rest.append(b)
            held += b.num_rows
            if held < 1 << 15:
                continue
            t = pa.Table.from_batches(rest)
            open_from = np.logical_and.reduce([(k := t.column(c).to_numpy()) == k[-1] for c in names]).argmax()
            if open_from:
                yield solve(t.slice(0, open_from))
                rest = t.slice(open_from).to_batches()
                held = t.num_rows - int(open_from)
        if held:
            yield solve(pa.Table.from_batches(rest))

    return run


def near_links(fps: DataFrame, n: int, budget: int = 4, split_over: int = 8192, wide_budgets: tuple[int, ...] = (0,), wide_words: int = 0) -> DataFrame:
    """(u, v, far) links of a spanning forest, per group, over rows (node long, fp long[, seed int, sig binary]) whose fps differ in <= budget bits.

    n is the number of nodes, for the plan of blocks. fps must be cheap to read twice. Only rows of one seed meet. With signatures of wide_words
    64-bit words, links differ in at most the last of wide_budgets bits of them; far is that distance. Groups above split_over are dealt out
    as pairs of hashed chunks; nothing is capped. With signatures, which spanning forest of a group is found hangs on what its task holds, so their
    number of partitions is fixed: equal nodes give equal links, in every run.
    """
    plan = block_plan(budget, n)
    seed = "seed" if "seed" in fps.columns else F.lit(0).alias("seed")
    carried = ["node", "fp", *(["sig"] if wide_words else [])]
    spread = fps.select(*carried, seed).withColumn("key", F.explode(_keys(F.col("fp"), plan))).select(*carried, (F.col("key.block") + F.col("seed") * len(plan)).alias("block"), "key.part")
    hot = spread.groupBy("block", "part").count().where(F.col("count") > split_over).select("block", "part", F.ceil(F.col("count") / split_over).cast("int").alias("chunks"))
    spread = spread.join(small(written(hot, "hot-groups")), ["block", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.col("node")), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") > 2, F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != own)).otherwise(F.array(F.lit(0)))
    spread = spread.withColumn("other", F.explode(others)).select(
        *carried, "block", "part", F.when(F.col("chunks") > 2, F.least(own, "other")).otherwise(0).alias("ci"), F.when(F.col("chunks") > 2, F.greatest(own, "other")).otherwise(0).alias("cj"),
    )
    group = ["block", "part", "ci", "cj"]
    fixed = [int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if wide_words else []
    return spread.repartition(*fixed, *group).sortWithinPartitions(*group).mapInArrow(_join_groups(budget, wide_budgets, wide_words), "u long, v long, far long")


def _component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, component_id): the smallest `first` of each component, for nodes (node, first) and the roots of those that are tied."""
    tied = written(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "simhash-roots")
    least = written(tied.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    return written(spread_join(tied, least, "root").select("node", "root", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, budget: int = 4, split_over: int = 8192) -> DataFrame:
    """(doc_id, fp long, component_id): one row per row of docs; component_id is the smallest id reachable.

    Null and wordless texts have fingerprint 0 and are linked to each other like any other equal fingerprints. Rows with a
    null id keep a row; their component is the smallest id of the component, or null where it has none.
    Repeated ids and rows each keep their row. Ids are compared as longs. An empty table gives no rows. Texts are read whole, however long.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "simhash")
    same = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.col("fp").alias("node"), "first"), "simhash-fp")
    roots = component_roots(near_links(same, same.count(), budget, split_over))
    by_fp = _component_ids(same, roots).withColumnRenamed("node", "fp")
    return spread_join(fps, by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- similarity of shingle sets

#: Words of the shingles that the trie join reads, its fingerprints and budget: of pairs with five-word similarity 0.8, one fingerprint finds about 6 in 10.
SHORT, SEEDS, SHORT_BUDGET = 2, 4, 5
#: 64-bit words of a signature, and the bits that two of similarity 0.8 differ by: about 77 of 512, with a deviation of 8.
WIDE, WIDE_BUDGETS = 8, (72, 96)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _scattered(h: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; of the whole sequence where it is shorter."""
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = out * _TIMES + words[i : len(words) - k + 1 + i]
    return out


def _word_hashes(data: bytes | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in (data or b"").lower().split()], dtype=np.uint64)


def shingle_set(data: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; shorter texts have one, of all their words, and those without words none."""
    words = _word_hashes(data)
    return np.unique(_scattered(_shingles(words, k))) if len(words) else words


def sketch(data: bytes | None, k: int = 5) -> tuple[bytes, list[int], bytes]:
    """(digest of the words, SEEDS fingerprints of SHORT-word shingles, signature of k-word shingles) of a text."""
    joined = b" ".join((data or b"").lower().split())
    words = _word_hashes(joined)
    if not len(words):
        return xxhash.xxh128_digest(joined, SEED), [0] * SEEDS, bytes(8 * WIDE)
    seeded = lambda h, n: _scattered(h + np.arange(1, n + 1, dtype=np.uint64)[:, None] * _TIMES)
    short = majority(seeded(_shingles(words, SHORT), SEEDS))
    return xxhash.xxh128_digest(joined, SEED), short.view(np.int64).tolist(), majority(seeded(_shingles(words, k), WIDE)).tobytes()


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, content, words, fps, sig) of rows with an id, written: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [sketch(t, k) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.binary())], ["doc_id", "content", "words", "fps", "sig"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("content")).where("doc_id is not null")
    return written(rows.mapInArrow(run, "doc_id long, content long, words binary, fps array<long>, sig binary"), "sketches")


def _numbered(texts: DataFrame) -> DataFrame:
    """texts, one row for each `words`, with a number `node` that hangs on `words` alone: its hash, counted up where two share one."""
    among = Window.partitionBy("node").orderBy("words")
    return texts.withColumn("node", F.xxhash64("words")).withColumn("node", F.col("node") + (F.row_number().over(among) - 1))


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, grams array<long>), once per node, of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, k).view(np.int64) for t in as_bytes(b.column(1))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.LargeListArray.from_arrays(ends, np.concatenate(sets)).cast(pa.list_(pa.int64()))], ["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams"))


def _confirmed(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) whose shingle sets have at least this Jaccard similarity; two empty sets have it."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}"))
    both = spread_join(spread_join(links.select("u", "v"), side("u"), "u", "inner"), side("v"), "v", "inner")
    shared, total = F.size(F.array_intersect("grams_u", "grams_v")), F.size("grams_u") + F.size("grams_v")
    return both.where(shared >= F.lit(similarity) * (total - shared)).select("u", "v")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, split_over: int = 8192) -> DataFrame:
    """(doc_id, content, root, component_id): rows of docs with an id; documents of a component are tied by links of shingle similarity.

    Texts of the same words are one node. Nodes that agree in a fingerprint of short shingles up to SHORT_BUDGET bits, for one of SEEDS seeds, and in their
    signatures up to the last of WIDE_BUDGETS bits, are candidates; a spanning forest of them per group is kept. Then links are confirmed by the exact
    similarity of their shingle sets: first the closest link of each node, then all others whose ends are not tied yet. Every link is exact; of the pairs at the
    threshold a few in a hundred are no candidates. The order and partitioning of docs play no part. Texts without a word, null ones too, are one node. content is a hash of the text, root a number of the
    component, component_id its smallest id. An empty table gives no rows; repeated ids and rows keep theirs.
    """
    rows = _sketches(docs, id_col, text_col, k)
    nodes = rows.groupBy("words").agg(F.min(F.struct("doc_id", "content")).alias("of"), F.first("fps").alias("fps"), F.first("sig").alias("sig"))
    nodes = written(_numbered(nodes).select("node", "words", F.col("of.doc_id").alias("first"), F.col("of.content").alias("content"), "fps", "sig"), "simhash-nodes")
    seeded = nodes.select("node", "sig", F.posexplode("fps").alias("seed", "fp"))
    found = near_links(seeded, nodes.count(), SHORT_BUDGET, split_over, WIDE_BUDGETS, WIDE)
    links = written(found.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("far").alias("far")), "simhash-links")

    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = written(nodes.select("node", "first", "content").join(ends, "node"), "simhash-ends")
    text = docs.select(col(id_col).cast("long").alias("first"), F.xxhash64(col(text_col)).alias("content"), col(text_col).alias("text"))
    sets = written(_shingle_sets(text.join(small(wanted), ["first", "content"]), k), "simhash-sets")

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "far"))
    best = both.groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v"))
    best = written(best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-best")
    sure = written(_confirmed(best, sets, similarity), "simhash-sure")
    roots = component_roots(sure)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = links.join(best, ["u", "v"], "left_anti").join(root("u"), "u", "left").join(root("v"), "v", "left")
    rest = written(rest.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v"), "simhash-rest")
    every = sure.unionByName(_confirmed(rest, sets, similarity))
    by_node = _component_ids(nodes.select("node", "first"), component_roots(every))
    by_words = written(nodes.select("node", "words").join(by_node, "node").select("words", "root", "component_id"), "simhash-words")
    return spread_join(rows.select("doc_id", "content", "words"), by_words, "words").select("doc_id", "content", "root", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each component of similar(), all columns as they are: the one with the smallest id.

    Rows without an id stay. Of rows that repeat an id, those of one component are cut to one; others go or stay with their own component.
    Null and wordless texts are one component. An empty table stays empty.
    """
    found = written(similar(docs, id_col, text_col, k, similarity), "simhash-found")
    a, b = fresh(docs, n=2)
    named = lambda t: small(written(t.select(F.col("doc_id").alias(a), F.col("content").alias(b)).distinct(), "simhash-rows"))
    same = (col(id_col).cast("long") == F.col(a)) & (F.xxhash64(col(text_col)) == F.col(b))
    out = docs.join(named(found.where("doc_id <> component_id")), same, "left_anti")
    least = found.where("doc_id = component_id")
    again = written(least.groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-again")
    if again.isEmpty():
        return out
    least = written(least.join(small(again), "doc_id"), "simhash-repeated")
    keep = least.groupBy("doc_id", "root").agg(F.min("content").alias("keep"))
    out = out.join(named(least.join(keep, ["doc_id", "root"]).where("content <> keep")), same, "left_anti")
    twice = named(least.groupBy("doc_id", "content").count().where("count > 1"))
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
