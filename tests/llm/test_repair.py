import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import queries, repair
from sql_rows import same_as_sql

FORM = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    """rows: (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, lines): every edit sequence row by row, best by cost and then letters for each of the roles written so far that still matter."""

    def put(best, way):
        written = "".join(role[:1] for role, _ in way[2])
        state = (written[-1:], written == "s") if FORM.fullmatch(written) or FORM.fullmatch(written + "a") or FORM.fullmatch(written + "ua") else None
        if state is not None and (state not in best or way[:2] < best[state][:2]):
            best[state] = way

    def with_inserts(best):
        for _ in range(3):
            for cost, audit, lines in list(best.values()):
                for role in ("user", "assistant"):
                    put(best, (cost + 5, audit + "I", [*lines, (role, "")]))
        return best

    best = {("", False): (0, "", [])}
    for (role, text), fault in zip(rows, plain_faults(rows), strict=True):
        after = {}
        for cost, audit, lines in with_inserts(best).values():
            put(after, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role[:1] in ("s", "u", "a"):
                    put(after, (cost + more, audit + "K", [*lines, (role, text)]))
                for other in ("user", "assistant"):
                    put(after, (cost + 1 + more, audit + "R", [*lines, (other, text)]))
        best = after
    return min(w for w in with_inserts(best).values() if FORM.fullmatch("".join(r[:1] for r, _ in w[2])))


def plain_digest(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, lines = plain_repair([r[1:] for r in rows])
    faults, turns = plain_faults([r[1:] for r in rows]), [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(seed, convs, lengths=(0, 1, 2, 3, 5, 9)):
    rng, out = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.choice(lengths)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u2"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c, None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 2]), role, rng.choice(["a.", "b!", "c? \n", "d", "", " \t", None, "é。", f"{t}.", f"{t}.", f"{t} {c}."])))
    return out


def grouped(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bits": 2, "group": 2, "fan_bits": 1}])
def test_equals_brute_force_in_pieces_of_any_size(spark, docs, sizes):
    rows = random_rows(3, 60) + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, None, None)] + [(99, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(70)] + [(98, 1, "user", "same.")] * 9
    d = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, key string, at int")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digest(repair.edited(d, **sizes)).collect()}
    assert got == {c: plain_digest(r) for c, r in grouped(rows).items()}


def test_messages_left_have_the_form(spark):
    rows = random_rows(5, 40)
    edits = repair.edited(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), bits=3)
    left = {}
    for r in sorted(repair.repaired(edits).collect(), key=lambda r: (r["at"], r["line"])):
        left[r["conv_id"]] = left.get(r["conv_id"], "") + r["role"][0]
    assert left and all(FORM.fullmatch(x) for x in left.values())
    assert edits.count() == len(rows)


def test_powers_are_products():
    for symbol in "suaoSUAOx":
        m = np.where(np.eye(4, dtype=bool), 0, repair.FAR)
        for n in range(1, 20):
            m = repair.product(m, repair.power(symbol, 0))
            assert (repair.advanced(np.where(np.eye(4, dtype=bool), 0, repair.FAR), symbol, n) == m).all()
            assert (repair.back(symbol, n, repair.at_end()) == (m + repair.at_end()).min(axis=1)).all()


def test_a_long_conversation_lies_in_many_pieces(spark):
    d = spark.range(3000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    flags = repair.flagged(repair.placed(d))
    assert repair.pieces(flags, 5).count() >= 3000 / 32
    one, many = (repair.digest(repair.edited(d, bits=bits, group=group, fan_bits=2)).first() for bits, group in ((20, 4096), (5, 4)))
    assert one == many and one["cost"] > 0
    rows = [(("assistant", "user", "assistant")[i % 3], f"t{i}.") for i in range(3000)]
    assert (one["cost"], one["audit"]) == plain_repair(rows)[:2]


def test_no_rows(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.edited(d).count() == 0 and repair.digest(repair.edited(d)).count() == 0


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    plain = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}} | {c: plain_digest(r) for c, r in grouped(plain_damage(rows)).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, sf_dir).collect()}
    assert got == plain


@pytest.mark.skipif("op11_conversation_repair" not in queries.oracle_sql(), reason="without SQL")
def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op11_conversation_repair", queries)
