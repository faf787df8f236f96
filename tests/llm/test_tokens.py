import random

import numpy as np
import public_tokenizers
import sentencepiece

from chainloom.llm import pieces, token_counts, unigram

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
P = pieces.load_pieces(MODEL)
ALPHABET = "abe  \n\n▁é中ゼ\x00😀thin<s>0x"


def texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  a", "\n", " \n ", "▁▁a", "a\n b"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_library(model):
    """The library with the same pieces and scores as a unigram model."""
    out = b""
    for i in range(P.size):
        kind = 6 if SP.is_byte(i) else 3 if SP.is_control(i) else 2 if SP.is_unknown(i) else 1
        out += field(1, field(1, SP.id_to_piece(i).encode()) + b"\x15" + np.float32(model.score[i]).tobytes() + b"\x18" + varint(kind))
    out += field(2, b"\x18\x01" + varint(35 << 3) + b"\x01")  # unigram, byte fallback
    return sentencepiece.SentencePieceProcessor(model_proto=out + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"))


def test_unigram_is_the_library_with_these_scores():
    model = unigram.Unigram(P)
    library = unigram_library(model)
    for t in texts():
        ours, theirs = model.encode(t).tolist(), library.encode(t)
        assert ours == theirs or abs(sum(model.score[i] for i in ours) - sum(model.score[i] for i in theirs)) < 1e-3, t
        assert model.decode(ours) == t.replace("▁", " ")


def test_unigram_is_the_best_of_all_segmentations():
    model = unigram.Unigram(P)

    def best(s):
        if not s:
            return 0.0
        options = [float(model.score[P.normal[s[:n]][0]]) + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in P.normal]
        return max(options) if s[:1] in P.normal else max([*options, float(model.unknown) + best(s[1:])])

    for w in ("the", "an", "thin", "zqx", "aé中", "in in"):
        s = "▁" + w.replace(" ", "▁")
        got = sum(float(model.score[i]) for i in model.encode(w).tolist() if not model.is_byte[i])
        if all(c in P.normal for c in s):
            assert abs(got - best(s)) < 1e-3


def test_encode_and_decode_tables(docs, none):
    got = unigram.encode(docs, MODEL)
    assert got.count() == docs.count() and got.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in unigram.decode(got.where("doc_id in (1, 4, 9)"), MODEL).collect()}
    assert back[4] == "" and back[9].endswith("indeed")
    assert unigram.encode(none, MODEL).count() == 0


def test_counts_are_those_of_the_library(docs, none, corpus):
    for d in (docs, corpus):
        text = d.select("doc_id", "text").collect()
        got = token_counts.token_counts(d, MODEL).collect()
        key = lambda i, n: (i is None, i, n)
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == sorted((r["doc_id"], len(SP.encode(r["text"] or ""))) for r in text if r["doc_id"] is not None), key
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.token_counts(none, MODEL).count() == 0


def test_every_prefix_count_is_exact():
    m = token_counts.PrefixCounts(P)
    for t in texts(120):
        assert m.table(t).tolist() == [len(SP.encode(t[:n])) for n in range(len(t) + 1)], t


def test_counts_stay_exact_when_the_table_of_pairs_is_full(monkeypatch):
    monkeypatch.setattr(token_counts, "SLOTS", 64)
    m = token_counts.PrefixCounts(P)
    rng = random.Random(2)
    keys = ["".join(rng.choice("abcdefghijABCDEFGHIJ0123456789+/") for _ in range(300)) for _ in range(40)]
    assert [m.count(t) for t in keys] == [len(SP.encode(t)) for t in keys]
    m.cache.fill(s for t in keys + texts() for s in pieces.segments(t, P.cuttable))  # more at once than the table holds
    for t in texts(60):
        assert m.table(t).tolist() == [len(SP.encode(t[:n])) for n in range(len(t) + 1)], t


def test_truncation_fits_the_budget(docs):
    r = {x["doc_id"]: x for x in token_counts.token_counts(docs, MODEL, budget=50).collect()}
    text = "word " * 30000
    n = r[7]["fit_chars"]
    assert len(SP.encode(text[:n])) <= 50 < len(SP.encode(text[: n + 1]))
    assert r[4]["fit_chars"] == 0 and r[10]["n_bytes"] == r[10]["fit_chars"] or r[10]["over_limit"]


def test_prefix_table(docs):
    r = {x["doc_id"]: x["counts"] for x in token_counts.prefix_counts(docs.where("doc_id in (4, 6, 10)"), MODEL).collect()}
    assert r[4] == [0] and r[10][-1] == len(SP.encode(docs.where("doc_id = 10").first()["text"]))


def test_long_words_go_through_in_stretches(monkeypatch):
    from chainloom.llm import trie

    model, m = unigram.Unigram(P), token_counts.PrefixCounts(P)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefABCDEF0123+/é中😀") for _ in range(n)) for n in (1, 5, 700, 3000)] + ["x" * 20_000, "the" * 5000]
    whole = [model.encode(w).tolist() for w in words]
    monkeypatch.setattr(trie, "STRETCH", 97)
    for w, ids in zip(words, whole, strict=True):
        s = ("▁" + w).encode()
        got = np.frombuffer(model._viterbi_long(s), dtype=np.int32).tolist()
        assert got == ids or abs(sum(model.score[i] for i in got) - sum(model.score[i] for i in ids)) < 1e-2
        assert model.decode(got) == w and m._dynamic_long(s)[-1] == len(SP.encode(w))
        if 1 < len(w) < 1000:
            n = len(w) // 2
            assert m.table(w)[n] == len(SP.encode(w[:n])) and list(m._dynamic_long(s))[n] == len(SP.encode(w[:n]))


def test_a_word_of_five_megabytes_fits_into_half_a_gigabyte():
    import subprocess
    import sys

    code = """
import random, resource, public_tokenizers
from chainloom.llm import pieces, token_counts, unigram
P = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
w = "".join(random.Random(0).choices("abcdefghijABCDEFGHIJ0123456789+/", k=5_000_000))
u = unigram.Unigram(P)
ids = u.encode(w)
assert u.decode(ids) == w
n = token_counts.PrefixCounts(P).count(w)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[1]) < 500


def test_the_cache_is_bounded_by_bytes():
    made = []
    c = pieces.Cache(lambda new: (made.append(len(new)), [b"v" * 50 for _ in new])[1], most=20_000)
    for k in range(50):
        c.fill([f"{k}-{i}" for i in range(20)])
        assert c.held <= 20_000 and all(f"{k}-{i}" in c for i in range(20))
    c.fill([f"49-{i}" for i in range(20)])
    assert sum(made) == 1000
