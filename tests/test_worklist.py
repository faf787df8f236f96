"""Work lists with state: batch, stream and a plain loop give the same."""

import json
import random

from chainloom.streaming import worklist


def plain(steps):
    state, out = {}, []
    for item, at, content, status in sorted(steps, key=lambda s: (s[1], s[3] is None, s[2] or "", s[3] or "")):
        known, last = state.get(item, (None, None))
        if status is not None:
            state[item] = (known, status if (content or "") == known else last)
            continue
        reason = "new" if known is None else "changed" if (content or "") != known else "again" if last == "failed" else None
        if reason:
            out.append((item, at, content, reason))
        state[item] = (content or "", "new" if reason else last)
    return sorted(out, key=str)


def steps(seed, n=150):
    rng = random.Random(seed)
    return [(rng.choice("abcd"), i, rng.choice(["x", "x", "y", None]), rng.choice([None, None, "done", "failed"])) for i in range(n)]


SCHEMA = "item string, at long, hash string, status string"


def test_batch(spark):
    s = steps(1) + [(None, 500, "x", None), (None, 501, "x", None), ("a", 600, "z", "failed"), ("a", 600, "z", None)]
    d = spark.createDataFrame(s, SCHEMA)
    assert sorted(map(tuple, worklist.due(d, "item").collect()), key=str) == plain(s)
    assert worklist.due(d.where("false"), "item").count() == 0


def test_stream_with_state_over_micro_batches(spark, tmp_path):
    s, src = steps(2), tmp_path / "in"
    src.mkdir()
    for n in range(0, len(s), 50):
        (src / f"{n:04}.json").write_text("\n".join(json.dumps(dict(zip(("item", "at", "hash", "status"), r, strict=True))) for r in s[n : n + 50]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", worklist.STATE_STORE)
    try:
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = worklist.due_stream(rows, "item").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(150) and q.exception() is None and len({p["batchId"] for p in q.recentProgress}) >= 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("item", "at", "hash", "reason").collect()), key=str) == plain(s)


def test_changed_content_is_pending(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("c", "1"), ("c", "1")], "item string, hash string")
    done = spark.createDataFrame([("a", "1"), ("b", "0"), (None, "1")], "item string, hash string")
    assert sorted(map(str, (r["item"] for r in worklist.pending(items, done, "item", "hash").collect()))) == ["None", "b", "c", "c"]
    assert sorted(map(str, (r["item"] for r in worklist.pending(items, done, "item").collect()))) == ["None", "c", "c"]
