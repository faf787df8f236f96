"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates; whether one is live cannot be told from one document. So candidate hashes are counted
over the corpus: how many repositories and owners hold each. A value that many owners hold is an example that people
copy; one that a single owner holds looks live. Base kinds (assign, access, hex) stay whatever their
frequency; long mixed tokens without such a frame are added as spans of kind "owned" only where they look live.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.materialize import col, columns, fresh, small, spread_join, written
from .common import slices

# The base patterns, their order and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Loose tokens: 20 or more characters with lower case, upper case and digits.
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_WORDS = ("passw", "secret", "token", "api")
_MIXED = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points: base kinds, and loose tokens outside them as "owned"."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in out)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))  # reach: the furthest end so far
    for m in LOOSE.finditer(text):
        if all(p.search(m[0]) for p in _MIXED):
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():
                out.append(("owned", m.start(), m.end(), m[0]))
    return out


_ITEM = "struct<kind:string,start:int,end:int,hash:bigint>"


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(row, doc_id, repo, owner, content, found array<struct<kind, start, end, hash>>) for each row of docs, written to the shared folder."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e, "hash": xxhash.xxh64_intdigest(v.encode("utf-8", "replace")) - (1 << 63)} for k, s, e, v in candidates(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *b.columns[2:], pa.array(found, kind)], ["doc_id", "repo", "owner", "content", "found"])

    cols = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), col(repo_col).cast("string").alias("repo"), col(owner_col).cast("string").alias("owner"), F.xxhash64(col(text_col)).alias("content"))
    got = cols.mapInArrow(run, f"doc_id long, repo string, owner string, content long, found array<{_ITEM}>")
    return written(got.select(F.monotonically_increasing_id().alias("row"), "*"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repos, owners): distinct repositories and owners of each candidate hash; a null one counts as one.

    Distinct (hash, holder) pairs are made first, with partial aggregates, so a value that is everywhere is spread out.
    """
    held = found.select(F.explode("found.hash").alias("hash"), F.coalesce("repo", F.lit("\x00")).alias("repo"), F.coalesce("owner", F.lit("\x00")).alias("owner"))
    pairs = held.select("hash", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("repo").alias("who")), F.struct(F.lit(1).alias("level"), F.col("owner").alias("who")))).alias("h")).select("hash", "h.level", "h.who").distinct()
    return pairs.groupBy("hash").agg(F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("repos"), F.sum("level").alias("owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1) -> DataFrame:
    """(row, doc_id, content, spans array<struct<start, rank, kind, end, repos, owners, live>>): one row per row of docs.

    A value is live-looking if at most max_owners owners hold it, in however many repositories: copies of a text, and a key that
    one owner uses everywhere, stay live. All base spans are given; loose tokens only where they look live. Spans are in the order of start, then of KINDS. Null and empty texts have no spans; rows with
    a null or repeated id keep their rows; a null repository or owner counts as one of its own. Texts are read whole; an empty table gives no rows.
    """
    return judged_spans(scan(docs, id_col, text_col, repo_col, owner_col), max_owners)


def judged_spans(found: DataFrame, max_owners: int = 1) -> DataFrame:
    """The rows of scan() with the spans that stay, as secret_spans() gives them."""
    held = written(ownership(found), "owners")
    rank = F.coalesce(F.array_position(F.lit(list(KINDS)), F.col("f.kind")), F.lit(0)).cast("int")
    each = found.select("row", F.explode("found").alias("f")).select("row", F.col("f.hash").alias("hash"), F.col("f.start").alias("start"), F.when(rank == 0, len(KINDS) + 1).otherwise(rank).alias("rank"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end"))
    judged = spread_join(each, held, "hash", "inner").withColumn("live", F.col("owners") <= max_owners).where("live or kind <> 'owned'")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "repos", "owners", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return found.select("row", "doc_id", "content").join(spans, "row", "left").select("row", "doc_id", "content", F.coalesce("spans", none).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The counts and digests of secret_spans()."""
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count("owned"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with each span replaced by mark, spans that overlap one before by none."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1) -> DataFrame:
    """docs with each found span in its text replaced by `mark` (overlapping spans by one), other columns as they are, whatever their names.

    size_col, if there, becomes the new length. Only rows with spans change; null texts stay null, repeated rows and null ids keep their rows. Base spans
    need no other document and are cut where they are found. Rows with a loose token that looks live are found by id and a hash of the text, in
    a table of these rows alone; where that is small, no text is moved.
    """
    found = scan(docs, id_col, text_col, repo_col, owner_col)
    loose = found.withColumn("found", F.filter("found", lambda s: s["kind"] == "owned")).where(F.size("found") > 0)
    live = judged_spans(loose, max_owners).where(F.size("spans") > 0)
    a, b, more = fresh(docs, n=3)
    live = live.groupBy("doc_id", "content").agg(F.first("spans").alias("spans")).select(F.col("doc_id").alias(a), F.col("content").alias(b), F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias(more))
    live = small(written(live, "live"))
    joined = docs.join(live, col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(col(text_col)) == F.col(b)), "left").select(*columns(docs), F.col(more))
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            old, owned = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = []
            for t, extra in zip(old, owned, strict=True):
                spans = [(s, e) for k, s, e, _ in candidates(t or "") if k != "owned"] + [(s, e) for s, e in extra or []]
                new.append(cut_out(t, spans, mark) if spans else t)
            cols = batch.columns[:-1]
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                was = cols[size].to_pylist()
                cols[size] = pa.array([w if n is o or n == o else len(n) for n, o, w in zip(new, old, was, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=plain)

    plain = [f"c{k}" for k in range(len(docs.columns))]  # Arrow functions take no names with dots
    schema = StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(plain, docs.schema, strict=True)])
    return joined.toDF(*plain, "more").mapInArrow(run, schema).toDF(*docs.columns)
