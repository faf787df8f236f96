import collections
import hashlib
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from chainloom.llm import queries, sharding
from sql_rows import same_as_sql


def plain_key(doc_id, text):
    return int(hashlib.md5(f"{'null' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:12], 16)


def plain_edit(shards_of, size_of, shards, into=None):
    """The edited map, slot by slot."""
    out, loads = dict(shards_of), [0] * shards
    for slot, shard in shards_of.items():
        loads[shard] += size_of.get(slot, 0)
    mean = sum(loads) / shards
    for slot in sorted(out, key=lambda s: (-size_of.get(s, 0), s)):
        b, own = size_of.get(slot, 0), out[slot]
        to = loads.index(min(loads)) if into is None else into
        if b and loads[own] > mean and loads[to] + b < loads[own] and (into is None or loads[to] + b <= mean):
            loads[own] -= b
            loads[to] += b
            out[slot] = to
    return out


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/map"


@pytest.mark.parametrize("hot", [500_000, 3])
def test_every_row_has_its_shard_and_place(docs, corpus, path, hot):
    for n, d in enumerate((docs, corpus)):
        out = sharding.sharded(d, 5, f"{path}{n}", hot_rows=hot).collect()
        texts = d.select("doc_id", "text").collect()
        assert sorted((r["key"], r["size"], r["text_crc32"]) for r in out) == sorted((plain_key(*t), len((t["text"] or "").encode()) + 8, zlib.crc32((t["text"] or "").encode())) for t in texts)
        sizes = collections.Counter()
        for r in out:
            sizes[r["virtual_slot"]] += r["size"]
        plain = plain_edit({s: s % 5 for s in range(sharding.SLOTS)}, sizes, 5)
        assert all(r["virtual_slot"] == r["key"] % sharding.SLOTS and r["shard"] == plain[r["virtual_slot"]] and r["version"] == 2 for r in out)
        for shard in {r["shard"] for r in out}:
            assert sorted(r["place"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_sizes_are_near_equal_and_the_map_keeps_its_versions(spark, corpus, path):
    out = sharding.sharded(corpus, 8, path)
    loads = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) < 1.02 * min(loads)
    again = sharding.sharded(corpus, 8, path).collect()  # nothing to move
    assert {r["version"] for r in again} == {3} and sorted((r["key"], r["shard"]) for r in again) == sorted((r["key"], r["shard"]) for r in out.collect())
    assert [sharding.stored_map(spark, path, v).count() for v in (1, 2, 3)] == [sharding.SLOTS] * 3
    assert {r["shard"] for r in sharding.stored_map(spark, path, 1).where("virtual_slot % 8 = 3").collect()} == {3}


def test_a_new_shard_takes_slots_only_into_itself(spark, corpus, path):
    sharding.sharded(corpus, 6, path).count()
    before, sizes = sharding.stored_map(spark, path), sharding.slot_sizes(sharding.records(corpus))
    grown = sharding.edited(before, sizes, 7, into=6)
    old, new = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (before, grown))
    size_of = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    assert new == plain_edit(old, size_of, 7, into=6)
    assert {new[s] for s in new if new[s] != old[s]} == {6}
    assert sum(size_of.get(s, 0) for s in new if new[s] == 6) > 0.8 * sum(size_of.values()) / 7


def test_no_rows(spark, none, path):
    assert sharding.sharded(none, 3, path).count() == 0
    assert sharding.stored_map(spark, path).count() == sharding.SLOTS


def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op12_sharding", queries)
