"""Records out of JSON dumps of any layout: objects one after another, lists, or a list under "results"; files of any size, cut anywhere.

Spark's text reader cuts a file at every "}", so an object ends where a piece ends and at most one begins in a piece. What a piece does to the stack of open brackets and to the
question whether a string is open can be said without knowing what stands before it, for both answers to the question. A first pass says so for each piece, counted
from the start of its range of the file; what whole ranges do is put together in order; then each piece knows where it stands, whether a record begins in it and whether one ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import written

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\\?\Z)|[{}\[\]]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_COLON = re.compile(r"\s*:\s*")
#: Runs of characters that neither end a string nor are a bracket, a colon, a space or in "results": one of them stands for them all.
_PLAIN = re.compile(r'[^"\\{}\[\]:\sresult]+')
#: A list under the key "results" is "R" on the stack of open brackets.
_MARK = {"{": "{", "[": "[", "R": "R"}


def brackets(text: str, in_string: bool) -> tuple[list[tuple[int, str]], bool]:
    """((place, bracket) outside strings, whether a string is open at the end) of a piece; "R" for a bracket that opens a list under "results"."""
    out, at, before = [], 0, None
    if in_string:
        end = _STRING_END.match(text)
        if end is None:
            return [], True
        at = end.end()
    for m in _TOKEN.finditer(text, at):
        token = m.group()
        if token[0] == '"':
            if not m.group(1).startswith('"'):
                return out, True
            before = m if token == '"results"' else None
        else:
            listed = token == "[" and before is not None and _COLON.fullmatch(text, before.end(), m.start())
            out.append((m.start(), "R" if listed else token))
            before = None
    return out, False


def reduced(closes: int, opens: str, found: list[tuple[int, str]]) -> tuple[int, str]:
    """What stays open, and how much that stood before is closed, once the brackets have been read."""
    for _, b in found:
        if b in _MARK:
            opens += b
        elif opens:
            opens = opens[:-1]
        else:
            closes += 1
    return closes, opens


@lru_cache(1 << 16)
def _effect(shape: str, in_string: bool) -> tuple[int, str, bool]:
    """reduced() of a piece on an empty stack, and whether a string is open at its end; pieces that differ in plain characters only share it."""
    found, string = brackets(shape, in_string)
    return (*reduced(0, "", found), string)


@lru_cache(1 << 16)
def _borders(shape: str, in_string: bool, now: str) -> tuple[int, int, bool, bool, bool]:
    """Which bracket of a piece begins a record, as top-level object or in a list, and in results (-1: none), whether one ends, and whether a list of results begins, where `now` is the stack."""
    starts, ends, listed = {}, {}, False
    for at, (_, x) in enumerate(brackets(shape, in_string)[0]):
        if x in _MARK:
            if x == "{" and now in ("", "[", "R", "{R"):
                starts["results" if now == "{R" else "joined"] = at
            listed |= x == "R" and now == "{"
            now += x
        else:
            was, now = now, now[:-1]
            if x == "}" and was:
                ends["results" if now == "{R" else "joined"] = now in ("", "[", "R", "{R")
    return starts.get("joined", -1), starts.get("results", -1), ends.get("joined", False), ends.get("results", False), listed


def on(stack: str, closes: int, opens: str) -> str:
    """A stack after closes and opens; what closes an empty stack is passed over."""
    return stack[: max(0, len(stack) - closes)] + opens


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text, a, b, a_end, b_end), written: pieces, and where they and their ends stand, counted from the start of the range; a: with no string open there, b: with one."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    side = pa.struct([("string", pa.bool_()), ("closes", pa.int32()), ("opens", pa.string())])
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), *((n, side) for n in ("a", "b", "a_end", "b_end"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, states = None, {}
        for batch in batches:
            out = {name: [] for name in ("a", "b", "a_end", "b_end")}
            texts = [x + "}" for x in batch.column(3).to_pylist()]
            for file, block, text in zip(*(batch.column(i).to_pylist() for i in range(2)), texts, strict=True):
                if where != (file, block):
                    where, states = (file, block), {"a": (False, 0, ""), "b": (True, 0, "")}
                shape = _PLAIN.sub("x", text)
                for name, (string, closes, opens) in states.items():
                    out[name].append((string, closes, opens))
                    c, o, string = _effect(shape, string)
                    states[name] = (string, closes + max(0, c - len(opens)), on(opens, c, o))
                    out[f"{name}_end"].append(states[name])
            sides = [pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out[name], strict=True), side, strict=True)], names=[f.name for f in side]) if texts else pa.array([], side) for name in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), *sides], names=schema.names)

    kind = "struct<string:boolean,closes:int,opens:string>"
    return written(raw.mapInArrow(read, f"file string, block long, seq long, text string, a {kind}, b {kind}, a_end {kind}, b_end {kind}"), "pieces")


def _ranges(pieces: DataFrame) -> DataFrame:
    """(file, block, string, stack): where each range of a file begins. A file has one row a range."""

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows, string, stack, out = rows.sort_values("block"), False, "", []
        for a, b in zip(rows["a_end"], rows["b_end"], strict=True):
            out.append((string, stack))
            end = b if string else a
            string, stack = bool(end["string"]), on(stack, end["closes"], end["opens"])
        return pd.DataFrame({"file": rows["file"], "block": rows["block"], "string": [x[0] for x in out], "stack": [x[1] for x in out]})

    ends = pieces.groupBy("file", "block").agg(F.max_by(F.struct("a_end", "b_end"), "seq").alias("e")).select("file", "block", "e.a_end", "e.b_end")
    return ends.groupBy("file").applyInPandas(along, "file string, block long, string boolean, stack string")


def dump_records(spark: SparkSession, path: str, shape: str = "joined") -> DataFrame:
    """(file, record, text): the objects of dumps, numbered from 0 in each file.

    joined: top-level objects, and the objects of top-level lists; white space and anything else between them is passed over. results: in a file whose top-level object has a
    list under "results", the objects of that list instead. Braces in strings are no borders. Files may be compressed; a plain file is read in as many ranges as Spark cuts it in, wherever
    they fall. An object that the end of its file cuts off is left out; repeated objects are records of their own; empty files have none. A record is a row; no file is.
    """
    if shape not in ("joined", "results"):
        raise ValueError(f"unknown shape {shape!r}")
    pieces = _pieces(spark, path)
    side = F.when(F.col("string"), F.col("b")).otherwise(F.col("a"))
    placed = pieces.join(_ranges(pieces), ["file", "block"]).select("file", "block", "seq", "text", side.alias("side"), "stack").select("file", "block", "seq", "text", "side.string", "side.closes", "side.opens", "stack")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each piece: where a record would begin and whether one ends, as top-level object, in a list, and in results."""
        for rows in batches:
            out = []
            for text, string, closes, opens, stack in zip(rows["text"], rows["string"], rows["closes"], rows["opens"], rows["stack"], strict=True):
                joined, results, *rest = _borders(_PLAIN.sub("x", text), bool(string), on(stack, closes, opens))
                found = brackets(text, bool(string))[0] if joined >= 0 or results >= 0 else []
                out.append((*(found[k][0] if k >= 0 else -1 for k in (joined, results)), *rest))
            marks = pd.DataFrame(out, columns=["start_joined", "start_results", "ends_joined", "ends_results", "listed"])
            yield pd.concat([rows[["file", "block", "seq", "text"]].reset_index(drop=True), marks], axis=1)

    marked = written(placed.mapInPandas(place, "file string, block long, seq long, text string, start_joined int, start_results int, ends_joined boolean, ends_results boolean, listed boolean"), "marked")
    files = marked.groupBy("file").agg(F.max("listed").alias("of_results")) if shape == "results" else marked.select("file").distinct().withColumn("of_results", F.lit(False))
    rows = marked.join(files, "file").select(
        "file", "block", "seq", "text", F.when(F.col("of_results"), F.col("start_results")).otherwise(F.col("start_joined")).alias("start"), F.when(F.col("of_results"), F.col("ends_results")).otherwise(F.col("ends_joined")).alias("ends"),
    )
    order = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a range is a piece of a file of bounded size
    begun = F.coalesce(F.sum(F.col("ends").cast("long")).over(order), F.lit(0))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("begun", begun).join(ranges, ["file", "block"]).withColumn("record", F.col("before") + F.col("begun"))
    parts = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "start", "text"))).alias("p"), F.max("ends").alias("whole"))
    inside = F.aggregate("p", F.lit(""), lambda acc, x: F.when(x["start"] >= 0, F.substr(x["text"], x["start"] + 1)).when(acc != "", F.concat(acc, x["text"])).otherwise(acc))
    return parts.where("whole").select("file", "record", inside.alias("text")).where("text <> ''")


def read_records(spark: SparkSession, path: str, schema: str, shape: str = "joined") -> DataFrame:
    """The fields of dump_records(), by a schema; what is no JSON of it gives nulls."""
    return dump_records(spark, path, shape).select(F.from_json("text", f"struct<{schema}>").alias("r")).select("r.*")
