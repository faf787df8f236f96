"""Conversation structure repair: cheapest edits that give roles of the form s?(ua)+ or nothing, by a dynamic program over runs.

A row is a symbol: the initial of its role, and whether it must go or is cut short. Equal consecutive symbols are one run. A symbol is a min-plus matrix over the
four states of the form, and a run of n symbols its n-th power, put together from cached binary powers. Products of matrices may be taken in any grouping, so a
conversation is worked out in pieces of fixed length wherever its rows lie: each piece gives its product, a scan over the products gives each piece the costs that
lie ahead of it, and with these each piece unrolls its own choices, for every state it may be entered in. No task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import col, spread_join, written

#: Costs of edits, and of a row that is cut short and stays.
RETURN_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_SHORT = 5
#: Rows of a piece, and pieces of a conversation that are put together in one group; with more, they are put together by FAN first.
PIECE_BITS, GROUP_PIECES, FAN_BITS = 13, 4096, 10
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may be inserted, or a row be made, in each state: the other speaker.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAR = 1 << 60
FAULTS = ("blank", "duplicate", "truncated")


def options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, state after it, cost) of a row, edits in order of their letters. Symbols: initial of the role, upper case if cut short; "x": must go; "o": other roles."""
    out = [("D", state, RETURN_COST["D"])]
    if symbol != "x":
        more = CUT_SHORT if symbol.isupper() else 0
        if (after := KEEP.get(symbol.lower(), {}).get(state)) is not None:
            out.append(("K", after, more))
        out.append(("R", NEXT[state], RETURN_COST["R"] + more))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of 4 x 4 matrices, or of a vector and a matrix."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), FAR)


@cache
def inserts() -> np.ndarray:
    """Cost of going from one state to another by insertions alone."""
    m = np.full((4, 4), FAR, np.int64)
    for p in range(4):
        cost, q = 0, p
        for _ in range(4):
            m[p, q] = min(m[p, q], cost)
            cost, q = cost + RETURN_COST["I"], NEXT[q]
    return m


def at_end() -> np.ndarray:
    """Cost from each state to the end of a conversation, where nothing or an assistant stands last."""
    return np.minimum(inserts()[:, NOTHING], inserts()[:, ASSISTANT])


@cache
def power(symbol: str, bit: int) -> np.ndarray:
    """The matrix of 2 ** bit rows of a symbol, insertions before each of them included."""
    if bit:
        return product(power(symbol, bit - 1), power(symbol, bit - 1))
    m = np.full((4, 4), FAR, np.int64)
    for p in range(4):
        for _, q, cost in options(symbol, p):
            m[p, q] = min(m[p, q], cost)
    return product(inserts(), m)


def advanced(m: np.ndarray, symbol: str, n: int) -> np.ndarray:
    """m times the n-th power of a symbol's matrix."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            m = product(m, power(symbol, bit))
    return m


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def whole(symbols: str) -> np.ndarray:
    """The product of the matrices of all symbols, run by run."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for s, n in runs(symbols):
        m = advanced(m, s, n)
    return m


def back(symbol: str, n: int, ahead: np.ndarray) -> np.ndarray:
    """Costs ahead of n rows of a symbol, from those behind them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            ahead = product(ahead, power(symbol, bit).T)
    return ahead


def unrolled(symbols: str, ahead: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """(plan, state at the end) of the cheapest edits from a state, of equal ones the plan whose audit is least; ahead: costs behind the symbols.

    Costs ahead of each run come from its binary powers; inside a run, from one step back a row. A plan has for each row its insertions ("u" or "a") and then its edit: K, D, or U and
    A for a new role. Behind the last piece, insertions at the end follow. The letters before a state settle it, so taking the least letter that keeps the cost gives the least audit.
    """
    ends = []
    for s, n in reversed(runs(symbols)):
        ends.append((s, n, ahead))
        ahead = back(s, n, ahead)
    plan, named = [], {USER: "u", ASSISTANT: "a"}
    for s, n, end in reversed(ends):
        inside = [end.tolist()]
        for _ in range(n):
            end = back(s, 1, end)
            inside.append(end.tolist())
        for k in range(n, 0, -1):
            here, after = inside[k], inside[k - 1]
            while True:
                (_, same, cost), *others = options(s, state)
                if cost + after[same] == here[state]:
                    plan.append("D")
                    break
                if RETURN_COST["I"] + here[NEXT[state]] == here[state]:
                    state = NEXT[state]
                    plan.append(named[state])
                    continue
                letter, state = next((e, q) for e, q, c in others if c + after[q] == here[state])
                plan.append("K" if letter == "K" else named[state].upper())
                break
    while last and state not in (NOTHING, ASSISTANT):
        state = NEXT[state]
        plan.append(named[state])
    return "".join(plan), state


@lru_cache(maxsize=1 << 14)
def short_plan(symbols: str) -> str:
    """The plan of a whole conversation; most are short, and many alike."""
    return unrolled(symbols, at_end(), NOTHING, True)[0]


def placed(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, turn, role, text, digest, at), written: at grows by conversation, turn (null first), role and text, by one within a task's rows.

    Null roles and texts are one space. Rows of a long conversation lie in many ranges.
    """
    m = rows.select(
        col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.concat(F.lit("="), col(conv_col).cast("string")), F.lit("null")).alias("key"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    m = m.withColumn("digest", F.md5(F.concat("key", F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    ranges = m.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text")
    return written(ranges.withColumn("at", F.monotonically_increasing_id()), "messages")


def flagged(messages: DataFrame) -> DataFrame:
    """(key, at, fault, symbol) of placed() rows, written: the first of blank, duplicate (role and text stand earlier in the conversation) and truncated, or null."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    slim = messages.select("key", "at", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 1).alias("initial"))
    firsts = written(slim.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return written(spread_join(slim, firsts, "digest").withColumn("fault", fault).select("key", "at", "fault", symbol.alias("symbol")), "symbols")


def pieces(flags: DataFrame, bits: int) -> DataFrame:
    """(key, place, start, symbols, matrix), written: one row for each conversation in each run of 2 ** bits places. matrix: only where the conversation may go on in another piece."""

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, i = rows.sort_values("at", kind="stable"), [], 0
        keys, at, symbols = rows["key"].tolist(), rows["at"].tolist(), "".join(rows["symbol"])
        for key, g in groupby(keys):
            n = len(list(g))
            edge = i == 0 or i + n == len(keys)
            out.append((key, at[0] >> bits, at[i], symbols[i : i + n], whole(symbols[i : i + n]).ravel().tolist() if edge else None))
            i += n
        return pd.DataFrame(out, columns=["key", "place", "start", "symbols", "matrix"])

    found = flags.select("key", "at", "symbol", F.shiftright("at", bits).alias("piece")).groupBy("piece").applyInPandas(look, "key string, place long, start long, symbols string, matrix array<long>")
    return written(found, "pieces")


def scanned(parts: DataFrame, start: np.ndarray, group: int = GROUP_PIECES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(key, place, vector): start times the matrices of all earlier places of a key. parts: (key, place, matrix).

    Up to `group` parts of a key are gone through in one group; with more, 2 ** fan_bits neighbouring places are multiplied first, those are scanned, and each neighbourhood begins with the vector before it.
    """
    schema = "key string, place long, vector array<long>"

    def through(rows: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
        rows, out = rows.sort_values("place"), []
        for m in rows["matrix"]:
            out.append(v.tolist())
            v = product(v, np.reshape(m, (4, 4)))
        return pd.DataFrame({"key": rows["key"], "place": rows["place"], "vector": out})

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.where(np.eye(4, dtype=bool), 0, FAR)
        for x in rows.sort_values("place")["matrix"]:
            m = product(m, np.reshape(x, (4, 4)))
        return pd.DataFrame({"key": rows["key"][:1], "place": rows["place"][:1].to_numpy() >> fan_bits, "matrix": [m.ravel().tolist()]})

    most = parts.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    if most <= group:
        return written(parts.groupBy("key").applyInPandas(lambda rows: through(rows, start), schema), "vectors")
    above = F.shiftright("place", fan_bits).alias("above")
    over = written(parts.groupBy("key", above).applyInPandas(folded, "key string, place long, matrix array<long>"), "products")
    before = scanned(over, start, group, fan_bits)
    both = parts.select("*", above).groupBy("key", "above").cogroup(before.select("key", F.col("place").alias("above"), "vector").groupBy("key", "above"))
    return written(both.applyInPandas(lambda rows, v: through(rows, np.array(v["vector"].iloc[0], np.int64)), schema), "vectors")


def plans(parts: DataFrame, group: int = GROUP_PIECES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(key, start, plan) of each row of pieces()."""
    edges = parts.where(F.col("matrix").isNotNull())
    many = written(edges.groupBy("key").agg(F.count("*").alias("n"), F.max("place").alias("last")).where("n > 1").select("key", "last"), "many")
    turned = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("matrix", (i % 4) * 4 + F.floor(i / 4).cast("int")))
    ahead = scanned(edges.join(many, "key").select("key", (-F.col("place")).alias("place"), turned.alias("matrix")), at_end(), group, fan_bits)
    known = parts.drop("matrix").join(ahead.select("key", (-F.col("place")).alias("place"), F.col("vector").alias("ahead")), ["key", "place"], "left").join(many, "key", "left")

    def unroll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.ahead is None:
                    out.append((r.key, r.place, r.start, [short_plan(r.symbols)], None))
                else:
                    ways = [unrolled(r.symbols, np.array(r.ahead, np.int64), p, r.place == r.last) for p in range(4)]
                    out.append((r.key, r.place, r.start, [w[0] for w in ways], [0 if q == w[1] else FAR for w in ways for q in range(4)]))
            yield pd.DataFrame(out, columns=["key", "place", "start", "ways", "matrix"])

    ways = written(known.mapInPandas(unroll, "key string, place long, start long, ways array<string>, matrix array<long>"), "ways")
    entered = scanned(ways.where(F.col("matrix").isNotNull()).select("key", "place", "matrix"), np.array([0, FAR, FAR, FAR]), group, fan_bits)
    entry = F.coalesce(F.array_position("vector", F.lit(0).cast("long")), F.lit(1)).cast("int")
    return ways.join(entered, ["key", "place"], "left").select("key", "start", F.element_at("ways", entry).alias("plan"))


def edited(rows: DataFrame, bits: int = PIECE_BITS, group: int = GROUP_PIECES, fan_bits: int = FAN_BITS, **names) -> DataFrame:
    """(conv_id, key, at, turn, role, text, fault, audit, lines array<struct<role, text>>): one row per row, in the order of `at` within a conversation.

    audit: the letters of the row's edits in order: I for each insertion before it (or behind it, at the end of a conversation), then K, D or R. lines: what stands there afterwards.
    The cheapest edits of a conversation are taken, of equal ones those whose letters, joined, are least. Rows go by turn, null turns first, equal ones by role and
    text; repeated rows are rows of their own (and duplicates). Null roles and texts are one space; null conversation ids are one conversation; a role that begins with none of s, u and a cannot be
    kept, nor an empty one. Long texts are read whole; other columns, whatever their names, are not read. An empty table gives no rows.
    """
    messages = placed(rows, **names)
    flags = flagged(messages)
    planned = plans(pieces(flags, bits), group, fan_bits).withColumn("steps", F.regexp_extract_all("plan", F.lit("[ua]*[KDUA]"), F.lit(0))).withColumn("tail", F.regexp_extract("plan", "[ua]*$", 0))
    steps = planned.select(F.size("steps").alias("n"), "start", "tail", F.posexplode("steps").alias("i", "step")).select((F.col("start") + F.col("i")).alias("at"), "step", F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail"))
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    added = lambda s: F.transform(F.regexp_extract_all(s, F.lit("[ua]"), F.lit(0)), lambda c: line(F.when(c == "u", "user").otherwise("assistant"), F.lit("")))
    edit = F.right("step", F.lit(1))
    own = F.when(edit == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(line(F.when(edit == "U", "user").when(edit == "A", "assistant").otherwise(F.col("role")), F.col("text"))))
    all_rows = messages.drop("digest").join(flags.select("at", "fault"), "at").join(steps, "at")
    return all_rows.select("conv_id", "key", "at", "turn", "role", "text", "fault", F.translate(F.concat("step", "tail"), "uaUA", "IIRR").alias("audit"), F.concat(added(F.col("step")), own, added(F.col("tail"))).alias("lines"))


def repaired(edits: DataFrame) -> DataFrame:
    """(conv_id, at, line, role, text): the messages that edited() rows leave, in the order of at and line."""
    return edits.select("conv_id", "at", F.posexplode("lines").alias("line", "message")).select("conv_id", "at", "line", "message.role", "message.text")


DIGEST = [("conv_id", pa.int64()), ("key", pa.string()), *((n, pa.int64()) for n in ("gaps", *FAULTS, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def digest(edits: DataFrame) -> DataFrame:
    """(conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation.

    A SHA-256 has to see its text in order: rows are sorted within partitions and streamed, so a task holds one batch and the letters of one conversation, however long.
    """
    schema = pa.schema(DIGEST)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def row() -> dict:
            turns = now["turns"]
            counts = {k: now[k] for k in (*FAULTS, "illegal", "cost")}
            return {"conv_id": now["conv_id"], "key": now["key"], "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, **counts, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now is not None:
                        done.append(row())
                    now = {"key": r["key"], "conv_id": r["conv_id"], "turns": None, "initial": None, "audit": [], "sha": hashlib.sha256(), "begun": False} | dict.fromkeys((*FAULTS, "illegal", "cost"), 0)
                if (t := r["turn"]) is not None:
                    first, most, n = now["turns"] or (t, t, 0)
                    now["turns"] = (first, t, n + (n == 0 or t != most))
                if r["fault"]:
                    now[r["fault"]] += 1
                initial = r["role"][:1]
                now["illegal"] += now["initial"] is not None and now["initial"] + initial not in ("su", "ua", "au")
                now["initial"] = initial
                now["audit"].append(r["audit"])
                now["cost"] += sum(map(RETURN_COST.get, r["audit"])) + (CUT_SHORT if r["fault"] == "truncated" and "D" not in r["audit"] else 0)
                for x in r["lines"]:
                    now["sha"].update((b"\n" if now["begun"] else b"") + f"{x['role']}:{x['text']}".encode())
                    now["begun"] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    slim = edits.select("conv_id", "key", "at", "turn", "role", "fault", "audit", "lines").repartition("key").sortWithinPartitions("key", "at")
    return slim.mapInArrow(stream, "conv_id long, key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
