import hashlib
import re
import zlib

import pytest

from chainloom.llm import chat, media, mixing, queries, secrets

SF = "/root/testdata/sf0.001"


def test_secret_base_spans(docs, corpus, none):
    def plain(text):
        text, out = text or "", []
        for k, rx, ok in (
            (0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
        ):
            out += [(m.start(), k, m.end()) for m in re.finditer(rx, text, re.ASCII) if ok(m)]
        names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
        return [sum(k == j for _, k, _ in out) for j in range(3)], hashlib.sha256(names.encode()).hexdigest()

    for d in (docs, corpus):
        got = sorted(([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) for r in secrets.digest(secrets.secret_spans(d)).collect())
        assert got == sorted(plain(r["text"]) for r in d.select("text").collect())
    assert secrets.secret_spans(none).count() == 0


def test_ownership_tells_examples_from_live_tokens(spark):
    live, copied = "aB3dE6gH9jK2mN5pQ8sT1", "zY8xW5vU2tS9rQ6pO3nM0"
    rows = [(i, f"see {copied} here", f"s{i}") for i in range(5)] + [(10, f"use {live} now", "s1"), (11, f"use {live} now", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.secret_spans(d)).collect()}
    assert got == {**{i: "" for i in range(5)}, 10: "owned:4:25", 11: "owned:4:25"}
    r = {x["doc_id"]: x["text"] for x in secrets.redact(d).collect()}
    assert r[10] == "use [SECRET] now" and r[0] == f"see {copied} here"


def test_a_token_of_one_owner_is_live_in_however_many_documents(spark):
    copied, pasted = "aB3dE6gH9jK2mN5pQ8sT1", "kJ7hG4fD1sA8pO5iU2yT9"
    rows = [(i, f"use {copied} now", "s1") for i in range(50)] + [(100 + i, f"use {pasted} at {i}", "s1") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.digest(secrets.secret_spans(d)).collect()
    assert [(r["spans"], r["n_owned"], r["n_live"]) for r in got] == [("owned:4:25", 1, 1)] * 100
    assert {r["text"] for r in secrets.redact(d).collect()} == {"use [SECRET] now"} | {f"use [SECRET] at {i}" for i in range(50)}


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 10").first()["text"] == "[SECRET]\" and [SECRET] or [SECRET]"


def test_redaction_leaves_other_columns_whatever_their_names(spark):
    token = "aB3dE6gH9jK2mN5pQ8sT1"
    rows = [(1, f"é use {token} now", "s", 99, "keep", 7, 8, 9, 0.5), (None, f"use {token}", "s", 9, None, 7, 8, 9, 0.5), (3, None, None, None, "x", 7, 8, 9, 0.5), (1, "token=abcdefgh1", "s", 15, "y", 7, 8, 9, 0.5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `_new` string, `_id` int, `_content` int, `_x0` int, `a.b` double")
    out = secrets.redact(d)
    assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(1, "é use [SECRET] now", "s", 18, *rows[0][4:]), (None, "use [SECRET]", "s", 12, *rows[1][4:]), rows[2], (1, "[SECRET]", "s", 8, *rows[3][4:])]
    assert got == sorted(want, key=str)
    assert secrets.redact(d.where("false")).count() == 0


def test_ownership_is_that_of_plain_counts(spark):
    """Loose tokens over random owners, against sets in Python; hot hashes are dealt out."""
    import random

    rng = random.Random(4)
    tokens = ["".join(rng.choice("abcdefgh") + rng.choice("ABCDEFGH") + rng.choice("0123456789") for _ in range(7)) for _ in range(12)]
    rows = [(n, " ".join(["x", *rng.sample(tokens, rng.randrange(3))]), f"s{rng.randrange(3)}" if n % 7 else None) for n in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    owners = {t: {s for _, x, s in rows if t in x.split()} for t in tokens}
    want = {n: ",".join(f"owned:{x.index(t)}:{x.index(t) + 21}" for t in x.split()[1:] if len(owners[t]) == 1) for n, x, _ in rows}
    assert {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.secret_spans(d)).collect()} == want


def test_spans_of_a_long_text_with_many_candidates():
    import time

    text = " ".join(f"token=abcdefgh{n} aB3dE6gH9jK2mN5pQ8s{n}" for n in range(40_000))
    began = time.time()
    found = secrets.candidates(text)
    assert len(found) == 80_000 and time.time() - began < 10


def test_mixing_meets_its_targets(spark, corpus):
    rows = mixing.measured(corpus, queries.form())
    cells = mixing.cells_of(rows)
    targets = mixing.tempered_targets(cells, {"source": 0.5, "lang": 0.5, "topic": 0.5})
    raked, residuals = mixing.rake(cells, targets, 12)
    raked = raked.toPandas()
    for d, t in targets.items():
        want = t.toPandas().set_index(d)["target"]
        got = raked.groupby(d)["weight"].sum() / raked["weight"].sum()
        assert (got - want).abs().max() <= residuals[-1] + 1e-9 < 0.02
    assert residuals[-1] <= residuals[0]
    assert abs((raked.groupby("topic")["weight"].sum() - targets["topic"].toPandas().set_index("topic")["target"]).abs().max()) < 1e-9


def test_mixing_edge_cases(docs, none):
    power, topic = {"source": 0.7, "lang": 0.7, "topic": 0.7}, chat.F.col("row")
    m = mixing.mix(docs, topic, power, sweeps=2)
    assert m.count() == docs.count() and m.where("probability not between 0 and 1").count() == 0
    assert mixing.mix(none, topic, power, sweeps=1).count() == 0
    clash = docs.selectExpr("*", "1 as __mix_p", "2 as _x0", "3 as probability", "4 as `a.b`")
    s = mixing.sample(clash, topic, power, sweeps=2)
    assert s.columns == clash.columns and s.count() <= docs.count()


def test_mixing_meets_given_targets_and_tells_what_is_left(spark):
    rows = [(n, "word " * (1 + n % 5), f"s{n % 3}", ("en", "de")[n % 2], ("a", "b", "c")[n % 7 % 3]) for n in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    share = lambda name, **v: spark.createDataFrame(list(v.items()), f"{name} string, target double")
    targets = {"source": share("source", s0=0.2, s1=0.3, s2=0.5), "lang": share("lang", en=0.75, de=0.25), "topic": share("topic", a=0.5, b=0.25, c=0.25)}
    cells = mixing.cells_of(mixing.measured(d, chat.F.col("kind")))
    table, residuals = mixing.rake(cells, targets, 60)
    assert residuals[-1] < 1e-9 and len(residuals) < 60
    weight = {}
    for _, text, source, lang, kind in rows:  # the same in plain Python
        weight[source, lang, kind] = weight.get((source, lang, kind), 0) + len(text.split())
    want = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"en": 0.75, "de": 0.25}, "topic": {"a": 0.5, "b": 0.25, "c": 0.25}}
    for _ in range(60):
        for k, d_ in enumerate(want):
            for v, t in want[d_].items():
                now = sum(w for c, w in weight.items() if c[k] == v)
                weight |= {c: w * t / now for c, w in weight.items() if c[k] == v}
    assert all(abs(weight[r["source"], r["lang"], r["topic"]] - r["weight"]) < 1e-9 for r in table.collect())
    unmet = targets | {"lang": share("lang", en=0.5, fr=0.5)}
    assert mixing.rake(cells, unmet, 3)[1][-1] > 0.1
    cells, left = mixing.weights(mixing.measured(d, chat.F.col("kind")), targets=targets, sweeps=60)
    assert abs(left[0] - residuals[0]) < 1e-12 and left[-1] < 1e-9  # sums of doubles hang on the order
    want = sorted(map(tuple, mixing.mix(d, chat.F.col("kind"), targets=targets, sweeps=60).collect()))
    assert sorted(map(tuple, mixing.mix(d, chat.F.col("kind"), table=cells).collect())) == want
    drawn = sorted(r["doc_id"] for r in mixing.sample(d, chat.F.col("kind"), table=cells).collect())
    assert drawn == sorted(w[0] for w in want if w[-1]) and 0 < len(drawn) < 400


def test_media_round_trip(spark, docs, none):
    got = {}
    for r in media.media_features(media.stored_media(docs)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for d in docs.collect():
        text = (d["text"] or "").encode()
        payload = media.payload_of(text)
        want = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert want in {(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got[d["doc_id"]]}
        assert len(payload) % 64 == 0 and payload[: len(text)] == text and len(payload) >= 64
    assert media.stored_media(none).count() == 0


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_byte_ranges_read_each_member_once(spark, corpus, tmp_path, size):
    n = media.write_archives(corpus, str(tmp_path))
    rows = media.read_archives(spark, str(tmp_path), size)
    assert rows.count() == n == corpus.count() == rows.select("archive", "offset").distinct().count()


def test_a_damaged_member_is_tried_again_and_named(spark, corpus, tmp_path):
    media.write_archives(corpus, str(tmp_path))
    reader = media.ArchiveReader(str(tmp_path), 1 << 20)
    part = reader.partitions()[0]
    good = [r for b in reader.read(part) for r in b.to_pylist()]
    with open(part.path, "r+b") as f:
        f.seek(good[1]["offset"] + media.HEADER_BYTES + 5)
        f.write(b"\xff\xff")
    with pytest.raises(OSError, match=f"at {good[1]['offset']} "):
        list(reader.read(part))


def test_a_read_that_fails_is_tried_again_from_its_offset(spark, corpus, tmp_path, monkeypatch):
    media.write_archives(corpus, str(tmp_path))
    reader = media.ArchiveReader(str(tmp_path), 1 << 20)
    part = reader.partitions()[0]
    good = [r for b in reader.read(part) for r in b.to_pylist()]
    real, parsed, offsets = media._parse, [], []

    def flaky(raw, path, offset):
        parsed.append(offset)
        if parsed.count(good[2]["offset"]) in (1, 2) and offset == good[2]["offset"]:
            raise OSError("lost")
        return real(raw, path, offset)

    monkeypatch.setattr(media, "_parse", flaky)
    monkeypatch.setattr(media, "read_member", lambda fs, path, offset, end: (offsets.append(offset), media._parse(media._open(fs, path).read_at(end - offset, offset), path, offset))[1])
    assert [r for b in reader.read(part) for r in b.to_pylist()] == good
    assert offsets == [good[2]["offset"]] * 2


def test_an_archive_without_its_end_is_not_read(spark, corpus, tmp_path):
    media.write_archives(corpus, str(tmp_path))
    part = media.ArchiveReader(str(tmp_path), 1 << 20).partitions()[0]
    with open(part.path, "r+b") as f:
        f.truncate(part.end // 2)
    with pytest.raises(OSError, match="not whole"):
        list(media.ArchiveReader(str(tmp_path), 1 << 20).read(part))


def test_media_features_and_hashes(spark, docs):
    """Features by plain sums, and hashes of the stored form."""
    import zlib as z

    members = media.stored_media(docs)
    stored = {r["offset"]: r for r in members.where("doc_id = 9").collect()}
    (m,) = stored.values()
    (r,) = media.media_features(members).where("doc_id = 9").collect()
    text = docs.where("doc_id = 9").first()["text"].encode()
    x = text + bytes(-len(text) % 64)
    mean = sum(x) / len(x)
    want = {"rows": len(x) // 64, "mean": mean, "dev": (sum((b - mean) ** 2 for b in x) / len(x)) ** 0.5, "step": sum(abs(a - b) for a, b in zip(x, x[1:])) / (len(x) - 1), "zero": x.count(0) / len(x)}
    got = dict(f.split("=") for f in r["feature"].split(";"))
    assert set(got) == set(want) and all(abs(float(got[k]) - v) < 1e-4 for k, v in want.items())
    assert (r["media_bytes"], r["media_sha256"]) == (len(m["media"]), hashlib.sha256(bytes(m["media"])).hexdigest()) and z.crc32(x[-64:]) == r["tail_crc32"]


def test_chat_is_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op10_chat_formatting"])
    cols = sorted(want.columns)
    ours = queries.op10_chat_formatting(spark, SF).select(*cols).collect()
    assert sorted(map(tuple, ours)) == sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall())


def test_loss_is_read_by_the_spans_of_the_mask(spark):
    F = chat.F
    rows = [(1, 0, "user", "hi [x]"), (1, 1, "assistant", "é <b> \\\\ [1]"), (1, 2, "user", ""), (1, 3, "assistant", "second"), (1, 4, "assistant", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    chats = chat.format_chat(d)
    c = chats.first()
    cut = [c["formatted"][m["start"] : m["start"] + m["length"]] for m in c["loss"]]
    esc = lambda t: t.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")
    assert cut == [esc(t) for _, _, role, t in rows if role == "assistant"]
    want = "".join(t for _, _, role, t in rows if role == "assistant")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    r = chat.digest(chats).first()
    assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(want), sha(want), len(c["formatted"]))
    moved = chats.withColumn("loss", F.transform("loss", lambda m: F.struct(m["turn"].alias("turn"), (m["start"] + 1).alias("start"), m["length"].alias("length"))))
    none = chats.withColumn("loss", F.transform("loss", lambda m: F.struct(m["turn"].alias("turn"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))))
    assert chat.digest(moved).first()["loss_sha256"] != r["loss_sha256"] and chat.digest(none).first()["loss_chars"] == 0


def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_parts_and_mask(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see <|end|> \\ ["), part("image", ref="a.png", width=56, height=29), part("image", ref="b.png"), part("audio", ref="c.wav", seconds=2.0)]), (1, 1, "assistant", [part("text", text="<\\[x]\\\\"), part("document", ref="d.pdf", pages=3)]),
        (1, 2, None, None), (None, None, "assistant", [part(None, text=None)]),
    ]
    d = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    out = {r["conv_id"]: r for r in chat.format_chat(d).withColumn("read", chat.parse_chat(chat.F.col("formatted"))).collect()}
    c = out[1]
    assert [(t["role"], t["text"]) for t in c["read"]][0] == ("user", "see <|end|> \\ [<|image:1|><|image:2|><|audio:1|>")
    assert [(a["turn"], a["type"], a["number"], a["ref"], a["tokens"]) for a in c["attachments"]] == [(0, "image", 1, "a.png", 4), (0, "image", 2, "b.png", 1), (0, "audio", 1, "c.wav", 50), (1, "document", 1, "d.pdf", 768)]
    (m,) = c["loss"]
    assert c["formatted"][m["start"] : m["start"] + m["length"]].startswith("<\\\\\\[\\x]") and c["formatted"].count(chat.CLOSE) == 3
    assert out[None]["n_turns"] == 1
