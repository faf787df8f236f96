"""Sinks: annotation text, FASTA, CSV, JSON and partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import columns

#: Splits that a reference table is made for, each a copy of the others' entries.
MOST_SPLITS = 100


def annotation_blocks(residues: DataFrame) -> DataFrame:
    """(id, value): the text block of each chain, residues by position."""
    line = F.concat_ws(" ", "chain", "resnum", "aa", F.col("label").cast("string"))
    g = residues.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("r"))
    return g.select("id", F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.array_join("r.line", "\n")).alias("value"))


def write_annotations(residues: DataFrame, path: str, split: str | None = None) -> None:
    """Annotation blocks as text; with a split column, one folder for each of its values."""
    if split is None:
        annotation_blocks(residues).select("value").write.text(path)
    else:
        parts = residues.select("id", split).distinct()
        annotation_blocks(residues).join(parts, "id").select("value", split).write.partitionBy(split).text(path)


def wrapped(sequence: Column, width: int) -> Column:
    """A sequence in lines of this width."""
    return F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def write_fasta(rows: DataFrame, path: str, key: str, sequence: str, width: int = 60) -> None:
    """FASTA records as text."""
    rows.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), wrapped(F.col(sequence), width)).alias("value")).write.text(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A CSV with a header."""
    rows.write.csv(path, header=True)


def write_metrics(rows: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """One JSON object per key, with its metrics nested."""
    rows.select(key, F.struct(*columns).alias("metrics")).write.json(path)


def write_scores(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, one folder for each value of the columns `by`."""
    rows.write.partitionBy(*by).parquet(path)


def group_index(rows: DataFrame, base: str, member: str, least: int) -> DataFrame:
    """(base, n, members) of bases with enough members."""
    g = rows.groupBy(base).agg(F.array_sort(F.collect_set(member)).alias("m"))
    return g.where(F.size("m") >= least).select(base, F.size("m").alias("n"), F.array_join("m", ",").alias("members"))


def reference_db(entries: DataFrame, splits: DataFrame, entry: str = "Entry", split: str = "split") -> DataFrame:
    """For each held-out split, entries of the others; an entry that several have is kept from the first."""
    names = [r[0] for r in splits.select(split).where(F.col(split).isNotNull()).distinct().limit(MOST_SPLITS + 1).collect()]
    if len(names) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    hold = F.array(*map(F.lit, names)) if names else F.array().cast(f"array<{dict(entries.dtypes)[split]}>")
    pairs = entries.withColumn("holdout", F.explode(F.filter(hold, lambda h: h != F.col(split))))
    row = F.struct(*columns(entries))
    return pairs.groupBy("holdout", F.col(entry).alias("key")).agg(F.min(F.struct(F.col(split).alias("first"), row.alias("row"))).alias("m")).select("holdout", *[F.col("m.row").getField(c).alias(c) for c in entries.columns])


def universal(chains: DataFrame, residues: DataFrame, proteins: DataFrame, key: str = "id") -> DataFrame:
    """chains with their sequence, "chain:resnum" of positives, and protein fields, flat."""
    site = F.concat_ws(":", "chain", "resnum")
    r = residues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "aa", F.when(F.col("label") == 1, site).alias("site")))).alias("r"))
    flat = r.select(key, F.array_join("r.aa", "").alias("sequence"), F.array_join(F.array_compact("r.site"), ",").alias("sites"))
    return chains.join(flat, key).join(proteins, key, "left")


def cleaned_screen(rows: DataFrame, known: str, predicted: dict[str, str], drop: list[str]) -> DataFrame:
    """rows with positions written as text, for each threshold name the columns novel_sites_<t>, n_novel_<t> and any_novel_<t>, and without helpers.

    predicted: threshold name -> array column. Null arrays are empty.
    """
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    text = lambda a: F.array_join(F.array_sort(a), ", ")
    out = rows
    for t, c in predicted.items():
        new = F.array_except(empty(c), empty(known))
        out = out.withColumn(f"novel_sites_{t}", text(new)).withColumn(f"n_novel_{t}", F.size(new)).withColumn(f"any_novel_{t}", F.size(new) > 0)
    for c in [known, *predicted.values()]:
        out = out.withColumn(c, text(empty(c)))
    return out.drop(*drop)


def write_cleaned_screen(rows: DataFrame, path: str, *args, **options) -> None:
    """cleaned_screen() as tab-separated text with a header."""
    cleaned_screen(rows, *args, **options).write.csv(path, header=True, sep="\t")
