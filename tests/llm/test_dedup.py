import random

import numpy as np
import pytest
import xxhash

from chainloom.llm import simhash


def plain(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, budget=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints(docs):
    for r in docs.select("text").collect():
        assert simhash.fingerprint(r["text"].encode() if r["text"] is not None else None) == plain(r["text"])


@pytest.mark.parametrize("budget", [0, 1, 4])
def test_trie_links_are_brute_force(budget):
    rng = random.Random(budget)
    for n in (0, 1, 2, 60, 300):
        centres = [rng.getrandbits(64) for _ in range(5)]
        fps = sorted({(rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7)))) & (1 << 64) - 1 for _ in range(n)} | {rng.getrandbits(64) for _ in range(n // 3)})
        i, j = simhash.forest_edges(np.zeros(len(fps), dtype=np.int64), np.array(fps, dtype=np.uint64), budget)
        assert all((fps[a] ^ fps[b]).bit_count() <= budget for a, b in zip(i.tolist(), j.tolist(), strict=True)) and len(i) < max(1, len(fps))
        assert tied(len(fps), zip(i.tolist(), j.tolist(), strict=True)) == classes(range(len(fps)), fps, budget)


def tied(n, links):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i in range(n):
        least.setdefault(find(i), i)
    return [least[find(i)] for i in range(n)]


def test_trie_with_repeated_values_and_signatures_is_brute_force():
    rng = np.random.default_rng(5)
    for n in (2, 40, 200):
        value = np.sort(rng.choice(rng.integers(0, 1 << 63, 6).astype(np.uint64), n) ^ (np.uint64(1) << rng.integers(0, 4, n).astype(np.uint64)))
        wide = rng.integers(0, 1 << 63, (3, 2)).astype(np.uint64)[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 60, (n, 2)).astype(np.uint64))
        i, j = simhash.forest_edges(np.zeros(n, dtype=np.int64), value, 2, wide, (2, 4))
        far = lambda a, b: sum(int(x).bit_count() for x in wide[a] ^ wide[b])  # noqa: B023, E731
        want = [(a, b) for a in range(n) for b in range(a) if int(value[a] ^ value[b]).bit_count() <= 2 and far(a, b) <= 4]
        got = list(zip(i.tolist(), j.tolist(), strict=True))
        assert {(max(p), min(p)) for p in got} <= set(want) and tied(n, got) == tied(n, want)


@pytest.mark.parametrize(("budget", "n"), [(0, 10), (4, 100), (4, 1 << 30), (5, 1 << 30)])
def test_every_block_plan_covers_all_near_pairs(budget, n):
    plan, rng = simhash.block_plan(budget, n), random.Random(n)
    assert max(64 - sum(w for _, w in c) for c in plan) < 64 and (n > 1 << 20) == (len(plan) > budget + 1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum({1 << rng.randrange(64) for _ in range(budget)})
        assert any(all(a >> s & (1 << w) - 1 == b >> s & (1 << w) - 1 for s, w in c) for c in plan)


@pytest.mark.parametrize("split_over", [8192, 3])
def test_components_are_brute_force(corpus, docs, none, split_over):
    for d in (corpus, docs):
        rows = simhash.near_duplicates(d, split_over=split_over).toPandas()
        fps = [int(x) & (1 << 64) - 1 for x in rows.fp]
        ids = [None if x != x else int(x) for x in rows.doc_id]
        assert [None if x != x else int(x) for x in rows.component_id] == classes(ids, fps)
        assert len(rows) == d.count()
    assert simhash.near_duplicates(none).count() == 0


def test_finer_blocks_give_the_same_components(corpus, monkeypatch):
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(corpus).collect()}
    monkeypatch.setattr(simhash, "GROUP", 0.01)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(corpus).collect()} == want


def grams(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def edited_copies():
    """Texts of random words, and copies with 0 to 20 words changed."""
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(800)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 300]))]
        for edits in (0, 1, 2, 3, 5, 8, 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


def test_the_order_of_rows_plays_no_part(spark):
    d = spark.createDataFrame(list(enumerate(edited_copies())), "doc_id long, text string")
    runs = [{tuple(r) for r in simhash.similar(x, split_over=7).collect()} for x in (d.repartition(5), d.orderBy(d.doc_id.desc()).coalesce(2))]
    assert runs[0] == runs[1]


def test_similar_texts_are_those_of_exact_similarity(spark):
    """Edited copies at all similarities: components of found links are within those of all pairs, and nearly all pairs are in them."""
    texts = edited_copies()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(d, split_over=7).collect()}
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = tied(len(texts), pairs)
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 200 and found >= 0.95 * len(pairs)
    assert all(want[i] == want[got[i]] for i in range(len(texts)))


def test_similar_on_the_smallest_table(corpus):
    rows = corpus.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(corpus).collect()}
    sets = [grams(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j]))]
    want = tied(len(rows), pairs)
    assert sum(got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in pairs) >= 0.95 * len(pairs)
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    assert all(want[place[d]] == want[place[c]] for d, c in got.items())
    left = {r["doc_id"] for r in simhash.deduplicate(corpus).collect()}
    assert left == set(got.values())


def test_one_row_of_each_group_stays(docs, none):
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [1, 3, 6, 7, 8, 10]
    assert left.where("doc_id is null").count() == 2
    assert simhash.deduplicate(none).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    long = " ".join(f"w{n}" for n in range(90))
    rows = [(2, long, "a"), (2, long, "a"), (2, long.upper(), "b"), (2, "another text of its own", "c"), (1, "something else", "d"), (3, long + " more", "e")]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, `_x0` string, `_gone` int, `a.b` int, node int")
    left = simhash.deduplicate(d)
    assert left.columns == d.columns
    got = sorted((r["doc_id"], r["text"].lower()[:9]) for r in left.collect())
    assert got == [(1, "something"), (2, "another t"), (2, long[:9])]
