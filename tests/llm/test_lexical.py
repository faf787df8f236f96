import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chainloom.llm import lexical, queries
from sql_rows import same_as_sql

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranks(docs, items, k=10):
    """Every document against every item, by the formula."""
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        words = plain_terms(text)
        hits = []
        for d, c, length in counted:
            m = 25 + (75 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def ranks(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_edge_rows_equal_brute_force(spark, docs, none):
    items = [(1, "The QUICK fox, the fox"), (2, None), (3, "é word"), (4, "nowhere"), (None, "x password"), (6, "seven seven tower")]
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranks(lexical.ranked(docs, q)) == plain_ranks([tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    assert lexical.ranked(none, q).count() == 0 and lexical.ranked(docs, q.where("false")).count() == 0


def random_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, share, k=rng.choice([3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("block, short", [(8 << 20, 32), (2000, 32), (2000, 2), (500, 10**9)])
def test_blocks_and_short_lists_change_nothing(spark, monkeypatch, block, short):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "SHORT_PART", short)
    docs = random_texts(1, 400)
    items = [(i, t) for i, t in random_texts(2, 12)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), pass_terms=300)
    assert ranks(got) == plain_ranks(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(None, "same words here")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(1, "words there")], "item_id long, text string"))
    assert {(r[1], r[2]) for r in ranks(got)} == {(i, i) for i in range(1, 11)}
    assert ranks(got) == plain_ranks(docs, [(1, "words there")])


def test_search_looks_long_lists_up_only_where_needed():
    rng = np.random.default_rng(0)
    lists = [(np.sort(rng.choice(4000, size, replace=False)), rng.integers(1, top, size)) for size, top in ((3000, 3), (2000, 10), (30, 5000), (20, 9000), (900, 400))]
    whole = np.zeros(4000, np.int64)
    for d, a in lists:
        whole[d] += a
    for floor in (1, 500, 5000, 9000, 10**6):
        here, scores = lexical.search_block(lists, 4000, floor)
        assert dict(zip(here.tolist(), scores.tolist(), strict=True)) == {i: int(s) for i, s in enumerate(whole) if s >= floor}


def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op13_lexical_search", queries)
