"""Files of any layout, cut anywhere, against plain readers."""

import gzip
import io
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainloom.sources import dumps, readers, stores


@pytest.fixture
def cut(spark, monkeypatch):
    """Set the bytes of a range of a dump; tables that are written meanwhile are read as ever."""
    first_pass = dumps._pieces

    def put(n):
        def small(*args):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                return first_pass(*args)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")

        monkeypatch.setattr(dumps, "_pieces", small)

    return put


def decoded(text, shape):
    """Objects one by one."""
    if shape == "results":
        whole = json.loads(text)
        if isinstance(whole, dict) and isinstance(whole.get("results"), list):
            return [x for x in whole["results"] if isinstance(x, dict)]
        return [x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict)]
    out, i, dec = [], 0, json.JSONDecoder()
    while True:
        while i < len(text) and text[i].isspace():
            i += 1
        if i >= len(text):
            return out
        x, i = dec.raw_decode(text, i)
        out += [x] if isinstance(x, dict) else [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []


def got(spark, path, shape):
    rows = sorted(dumps.dump_records(spark, path, shape).collect(), key=lambda r: (r["file"], r["record"]))
    assert len({(r["file"], r["record"]) for r in rows}) == len(rows)
    return [json.loads(r["text"]) for r in rows]


JOINED = [
    '{"a": 1}\n{"a": 2}\n\n{"a": 3}', '{"a":"x}{y"}{"a":"z"}', '{"a":{"b":[{"c":1},{"d":"}"}]}}  {"a":"\\"}\\\\"}\t[{"a":1}, 4, "}", {"b":[{}]}, [{"no":1}]] {"e":{}}', "", "  \n", "[]", '{"é😀":"}é"}{"results":[{"x":1}]}', '{"a":1}{}{"b":[]}',
    '"{"{"a":"[{"}7{"b":"\\\\"}',
]
RESULTS = ['{"results": [{"a":1},{"a":{"b":"}"}}, 3, {"c":[{"d":2}]}]}', '{"info":{"x":[{}]},"results" :\n[ {"a":"]}"} ],"more":{"results":[{"z":1}]}}', '[{"a":1}, {"results":[{"b":1}]}]', '{"a":{"results":[{"b":2}]}}', '{"results":[]}', '{"b":"\\"results\\": [{","results":[{"k":1}]}\n']


@pytest.mark.parametrize("size", [7, 1000])
def test_dumps_are_those_of_a_decoder_wherever_files_are_cut(spark, tmp_path, cut, size):
    cut(size)
    for shape, texts in (("joined", JOINED), ("results", RESULTS)):
        folder = tmp_path / f"{shape}{size}"
        folder.mkdir()
        for n, text in enumerate(texts):
            (folder / f"{n}.json").write_text(text)
        assert got(spark, str(folder), shape) == [x for t in texts for x in decoded(t, shape)], shape


def test_compressed_dumps_and_broken_ends(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(JOINED[0])
    with gzip.open(tmp_path / "a.json.gz", "at") as f:  # a second member
        f.write("\n" + JOINED[2])
    assert got(spark, str(tmp_path / "a.json.gz"), "joined") == decoded(JOINED[0] + "\n" + JOINED[2], "joined")
    (tmp_path / "b.json").write_text('{"a":1}{"a":{"b":2}')
    (tmp_path / "c.json").write_text('{"a":1}{"a":"2')
    for name in "bc":
        assert got(spark, str(tmp_path / f"{name}.json"), "joined")[0] == {"a": 1}
    rows = readers.read_record_dump(spark, str(tmp_path / "a.json.gz"), "a:string", "joined").collect()
    assert len(rows) == len(decoded(JOINED[0] + JOINED[2], "joined"))


def test_a_long_file_lies_in_many_ranges(spark, tmp_path, cut):
    cut(4000)
    objects = [{"n": i, "s": "}{" * (i % 9), "l": [{"k": i}] * (i % 4)} for i in range(2000)]
    (tmp_path / "x.json").write_text(" ".join(map(json.dumps, objects)))
    found = dumps.dump_records(spark, str(tmp_path / "x.json"))
    assert sorted(json.loads(r["text"])["n"] for r in found.collect()) == list(range(2000))
    pieces = dumps._pieces(spark, str(tmp_path / "x.json"))
    assert pieces.select("block").distinct().count() > 10 and pieces.agg(F.max(F.length("text"))).first()[0] < 100


# ---------------------------------------------------------------- stores and files of groups


class Counting:
    """A file that counts the bytes that are read."""

    def __init__(self, data):
        self.f, self.n = io.BytesIO(data), 0

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()

    def seekable(self):
        return True

    def read(self, *a):
        out = self.f.read(*a)
        self.n += len(out)
        return out


def store_of(rows, **names):
    out = io.BytesIO()
    arrays = {"ids": np.array([r[0] for r in rows], dtype="U8"), "offsets": np.cumsum([0, *(len(r[1]) for r in rows)]), "values": np.concatenate([*(r[1] for r in rows), []]).astype(np.float16)}
    np.savez(out, **{names.get(k, k): v for k, v in arrays.items()})
    return out.getvalue()


ROWS = [(f"r{i}", [float(j % 7) for j in range(i * 37 % 101)]) for i in range(200)]


def test_store_rows_are_plain_slices_and_a_filter_reads_fewer_bytes():
    data = store_of(ROWS)
    read = {}
    for wanted in (None, frozenset(["r3", "r4", "r150"])):
        f = Counting(data)
        arrays = stores.blocks(f)
        f.n = 0
        got = [(i, v.tolist()) for ids, values in stores.store_rows(f, arrays, 0, len(ROWS), wanted, 256) for i, v in zip(ids, values, strict=True)]
        assert got == [r for r in ROWS if wanted is None or r[0] in wanted]
        read[wanted] = f.n
    few = sum(len(v) for i, v in ROWS if i in ("r3", "r4", "r150")) * 2
    values = sum(len(v) for _, v in ROWS) * 2
    assert read[frozenset(["r3", "r4", "r150"])] == read[None] - values + few
    f = Counting(data)
    arrays = stores.blocks(f)
    f.n = 0
    cut = stores.cuts(f, arrays["offsets"], 500)
    sizes = [sum(len(v) for _, v in ROWS[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    assert cut[0] == 0 and cut[-1] == len(ROWS) and max(sizes) <= 700 and len(sizes) > 10 and f.n < 8 * 10 * len(cut)


def test_store_files(spark, tmp_path):
    (tmp_path / "a.npz").write_bytes(store_of(ROWS))
    (tmp_path / "b.npz").write_bytes(store_of([]))
    d = stores.read_store(spark, str(tmp_path), part_bytes=1000)
    assert sorted((r["id"], r["values"]) for r in d.collect()) == sorted(ROWS) and d.rdd.getNumPartitions() > 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = stores.read_store(spark, str(tmp_path)).where(F.col("id").isin("r3", "r9") & (F.size("values") > 0))
        assert sorted((r["id"], r["values"]) for r in some.collect()) == [r for r in ROWS if r[0] in ("r3", "r9")]
        assert stores.read_store(spark, str(tmp_path)).where("id = 'no'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "c.npz").write_bytes(store_of([("x", [1.0])], ids="names"))
    assert stores.read_store(spark, str(tmp_path / "c.npz"), ids="names").first()["id"] == "x"
    squeezed = io.BytesIO()
    np.savez_compressed(squeezed, ids=np.array(["x"]))
    with pytest.raises(ValueError, match="compressed"):
        stores.blocks(io.BytesIO(squeezed.getvalue()))


def test_written_stores_read_back(spark, tmp_path):
    d = spark.createDataFrame([*ROWS, ("r0", [9.0]), (None, None)], "id string, values array<float>").repartition(3)
    for _ in range(2):  # the second takes the place of the first
        stores.write_store(d, str(tmp_path / "s"), part_bytes=2000)
    got = sorted((r["id"], r["values"]) for r in stores.read_store(spark, str(tmp_path / "s")).collect())
    assert got == sorted([*ROWS, ("r0", [9.0]), ("", [])])
    names = os.listdir(tmp_path / "s")
    assert len(names) > 3 and all(n.endswith(".npz") for n in names)


def test_files_of_groups(spark, tmp_path):
    rows = [("a", "x2"), ("a", "x1"), ("a", "x1"), ("b", "y"), ("c d/é", "z1"), ("c d/é", "z2"), (None, "n"), ("e", None)]
    d = spark.createDataFrame(rows, "base string, line string")
    path = str(tmp_path / "g")
    for _ in range(2):
        stores.write_groups(d, "base", "line", path, least=2)
    got = {r["base"]: (r["n"], r["file"]) for r in spark.read.csv(f"{path}/index.tsv", sep="\t", header=True, schema="base string, n long, file string").collect()}
    assert {b: n for b, (n, _) in got.items()} == {"a": 2, "c d/é": 2}
    assert open(f"{path}/{got['a'][1]}").read() == "x1\nx2\n" and open(f"{path}/{got['c d/é'][1]}").read() == "z1\nz2\n"
    assert sorted(x for _, _, files in os.walk(path) for x in files if x.endswith(".txt")) == sorted(f.split("/")[-1] for _, f in got.values())
    assert not os.path.exists(f"{path}/{stores.ATTEMPTS}")
    assert sorted((r["base"], r["line"]) for r in stores.read_groups(spark, path).where("base = 'a'").collect()) == [("a", "x1"), ("a", "x2")]


def test_an_attempt_that_fails_leaves_nothing(tmp_path):
    def batch(*lines):
        return pa.RecordBatch.from_arrays([pa.array(["a"] * len(lines)), pa.array(lines)], names=["base", "line"])

    def broken():
        yield batch("1", "2", "3")
        raise OSError("lost")

    w = stores.GroupWriter(str(tmp_path / "g"), True, 2, ".txt")
    with pytest.raises(OSError):
        w.write(broken())
    again, second = w.write(iter([batch("1", "2"), batch("3")])), w.write(iter([batch("1", "2", "3")]))  # the second is a speculative copy
    w.commit([again, None])
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "g") for f in fs]
    assert sorted(f.split("/")[-1] for f in files) == ["a.txt", "index.tsv"] and second.files == 1
    assert open(next(f for f in files if f.endswith("a.txt"))).read() == "1\n2\n3\n"
    w = stores.GroupWriter(str(tmp_path / "h"), True, 2, ".txt")
    w.write(iter([batch("1", "2")]))
    w.abort([None])
    assert not [f for _, _, fs in os.walk(tmp_path / "h") for f in fs]


def test_shapes_of_pieces_do_what_the_pieces_do():
    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ":", " ", '"results"', "a", "bc", "r", "1", "\u00e9", "\n"]) for _ in range(rng.randint(0, 12)))
        shape, now, closes = dumps._PLAIN.sub("x", text), rng.choice(["", "{", "[{", "{R"]), rng.randint(0, 2)
        for string in (False, True):
            found, end = dumps.brackets(text, string)
            c, o, open_ = dumps._effect(shape, string)
            assert open_ == end and dumps.reduced(closes, now, found) == (closes + max(0, c - len(now)), dumps.on(now, c, o))
            assert [x for _, x in found] == [x for _, x in dumps.brackets(shape, string)[0]]
