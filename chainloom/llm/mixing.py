"""Mixing sources to target weights: iterative proportional fitting over cells, in DataFrame functions only.

Token counts of documents are added up by cell (source, language, topic). Raking scales the cells' weights to the target
marginals, one dimension after another. A cell's weight over its tokens is the ratio by which its documents are drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed, col, columns, fresh

DIMS = ("source", "lang", "topic")
#: Cells up to which their table is broadcast to the documents; beyond it, the join is dealt out by cell.
BROADCAST_CELLS = 100_000
NONE = "(none)"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def measured(docs: DataFrame, topic: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens): null sources, languages and topics are "(none)". topic is a column of docs, or an expression over them."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), _named(col(source_col)).alias("source"), _named(col(lang_col)).alias("lang"), _named(topic).alias("topic"), n_words(col(text_col)).alias("n_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): cells with tokens."""
    return rows.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")


def tempered_targets(cells: DataFrame, power: dict[str, float]) -> dict[str, DataFrame]:
    """For each dimension (value, target): shares to the given power, normalised. Powers below 1 lift what is rare."""
    out = {}
    for d in DIMS:
        raw = cells.groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(power[d])).alias("raw"))
        out[d] = checkpointed(raw.crossJoin(raw.agg(F.sum("raw").alias("total"))).select(d, (F.col("raw") / F.col("total")).alias("target")))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 6, tolerance: float = 1e-12) -> tuple[DataFrame, list[float]]:
    """(cells with their weight, residual after each sweep): shares of the whole, raked over the dimensions of targets, at most `sweeps` times.

    The residual is the largest distance of a marginal share from its target; raking stops where it is within the tolerance, since further sweeps change
    no weight beyond it. Values of a dimension without a target get weight 0; targets of values without cells cannot be met and show in the residual. A
    step is one partial aggregate by value and one join; each sweep is written once.
    """
    total = cells.agg(F.sum("tokens").alias("total"))
    now = checkpointed(cells.crossJoin(F.broadcast(total)).select(*DIMS, "tokens", (F.col("tokens") / F.col("total")).alias("weight")))
    residuals: list[float] = []
    while len(residuals) < sweeps and (not residuals or residuals[-1] > tolerance):
        for d, target in targets.items():
            factor = now.groupBy(d).agg(F.sum("weight").alias("is")).join(target, d, "left").select(d, F.coalesce(F.col("target") / F.nullif("is", F.lit(0.0)), F.lit(0.0)).alias("factor"))
            now = now.join(factor, d).select(*DIMS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        now = checkpointed(now)
        residuals.append(residual(now, targets))
    return now, residuals


def residual(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance between the weight share of a value and its target; 0 without cells."""
    far = None
    for d, target in targets.items():
        share = cells.groupBy(d).agg(F.sum("weight").alias("w")).crossJoin(F.broadcast(cells.agg(F.sum("weight").alias("all"))))
        one = share.join(target, d, "full_outer").select(F.abs(F.coalesce(F.try_divide("w", "all"), F.lit(0.0)) - F.coalesce("target", F.lit(0.0))).alias("far"))
        far = one if far is None else far.unionByName(one)
    return 0.0 if far is None else float(far.agg(F.max("far")).first()[0] or 0.0)


def calibrated(cells: DataFrame) -> DataFrame:
    """(source, lang, topic, ratio, probability): ratio of target to present share; probability is it over the largest one.

    With these probabilities the expected tokens of each marginal are in proportion to the raked weights.
    """
    whole = cells.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    ratio = cells.crossJoin(F.broadcast(whole)).select(*DIMS, ((F.col("weight") / F.col("w")) / (F.col("tokens") / F.col("t"))).alias("ratio"))
    top = ratio.agg(F.max("ratio").alias("top"))
    return checkpointed(ratio.crossJoin(F.broadcast(top)).select(*DIMS, "ratio", (F.col("ratio") / F.col("top")).alias("probability")))


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that hangs on the id and the seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Left join by cell: broadcast if the counted table is small, otherwise dealt out (and split where skewed) by Spark."""
    small = table.count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(table) if small else table, list(DIMS), "left")


def weights(rows: DataFrame, power: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = 6) -> tuple[DataFrame, list[float]]:
    """(calibrated() cells of measured() rows, residual after each sweep), raked to the given targets, or to shares to the given powers.

    mix() and sample() take the cells as `table`, so a user can look at the last residual before drawing. Without rows there are no cells.
    """
    cells = checkpointed(cells_of(rows))
    raked, residuals = rake(cells, tempered_targets(cells, power) if targets is None else targets, sweeps)
    return calibrated(raked), residuals


def mix(docs: DataFrame, topic: Column, power: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = 6, seed: int = 17, table: DataFrame | None = None, **names) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, ratio, probability, sampled): one row per row of docs.

    targets: for each of source, lang and topic a table (value, target) with target shares; or power, for tempered shares of what is there;
    or table, the cells that weights() gave.
    Documents without a token are in no cell with tokens unless others share it; alone they have ratio and probability 0. Null texts have no
    token. Repeated rows get the same draw; rows with a null id share one draw. Texts are counted whole; an empty table gives no rows.
    """
    rows = measured(docs, topic, **names)
    table = weights(rows, power, targets, sweeps)[0] if table is None else table
    out = with_cells(rows, table).withColumns({"ratio": F.coalesce("ratio", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))})
    return out.select("doc_id", *DIMS, "n_tokens", F.round("ratio", 6).alias("ratio"), F.round("probability", 6).alias("probability"), (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, topic: Column, power: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = 6, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", table: DataFrame | None = None) -> DataFrame:
    """Rows of docs drawn with their calibrated probability, columns as they are, whatever their names. Targets, null, repeated and empty rows as in mix()."""
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "lang_col": lang_col}
    *cell, p = fresh(docs, n=len(DIMS) + 1)
    table = weights(measured(docs, topic, **names), power, targets, sweeps)[0] if table is None else table
    table = table.select(*[F.col(d).alias(c) for d, c in zip(DIMS, cell, strict=True)], F.col("probability").alias(p))
    own = {"source": col(source_col), "lang": col(lang_col), "topic": topic}
    match = [_named(own[d]) == F.col(c) for d, c in zip(DIMS, cell, strict=True)]
    few = table.count() <= BROADCAST_CELLS
    joined = docs.join(F.broadcast(table) if few else table, match, "left")
    return joined.where(draw(col(id_col), seed) < F.coalesce(p, F.lit(0.0))).select(*columns(docs))
