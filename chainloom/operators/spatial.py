"""Distance joins on a 3-D grid: points within a radius are in the same or a neighbouring cell."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import col, fresh
from .components import component_roots

XYZ = ("x", "y", "z")


def within(a: DataFrame, b: DataFrame, radius: float, keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Pairs of rows of a and b that agree in `keys`, columns prefixed a_ and b_, at most `radius` apart (less, unless closed), with their `distance`.

    The side b is repeated over 27 cells, a is not; both are joined by the keys and the cell, so only points of one entry in neighbouring cells ever meet. Rows with a
    null key or coordinate pair with none; repeated rows pair each; empty tables give no rows.
    """
    keys = keys or []
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(*[col(c).alias(f"a_{c}") for c in a.columns])
    names = fresh(left, b, n=len(keys) + 3)
    on, cells = names[: len(keys)], names[len(keys) :]
    left = left.select("*", *[col(f"a_{k}").alias(n) for k, n in zip(keys, on, strict=True)], *[cell(f"a_{c}").alias(n) for c, n in zip(XYZ, cells, strict=True)])
    shifts = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(XYZ, s, strict=True)]) for s in product((-1, 0, 1), repeat=3)])
    right = b.select(*[col(c).alias(f"b_{c}") for c in b.columns], *[col(k).alias(n) for k, n in zip(keys, on, strict=True)], F.explode(shifts).alias(cells[0] + "s"))
    right = right.select("*", *[(cell(f"b_{c}") + col(cells[0] + "s")[c]).alias(n) for c, n in zip(XYZ, cells, strict=True)]).drop(cells[0] + "s")
    d = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(2.0)) for c in XYZ), F.lit(0.0)))
    near = left.join(right, names).drop(*names).withColumn("distance", d)
    return near.where(F.col("distance") <= radius if closed else F.col("distance") < radius)


def contacts(atoms: DataFrame, entry: str, chain: str, radius: float, least: int) -> DataFrame:
    """(entry, chain_a, chain_b, n): chain pairs of an entry with `least` or more atom pairs less than the radius apart. Rows with a null entry or chain touch nothing."""
    p = within(atoms.select(entry, chain, *XYZ), atoms.select(entry, chain, *XYZ), radius, [entry], closed=False).where(F.col(f"a_{chain}") < F.col(f"b_{chain}"))
    return p.groupBy(F.col(f"a_{entry}").alias(entry), F.col(f"a_{chain}").alias("chain_a"), F.col(f"b_{chain}").alias("chain_b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


# Radii of alpha carbons and of heavy atoms, how many pairs of residues make a contact by each, and the heavy elements.
ALPHA_RADIUS, HEAVY_RADIUS, ALPHA_LEAST, HEAVY_LEAST = 8.0, 4.0, 4, 10
HEAVY = ("C", "N", "O", "S")


def chain_contacts(atoms: DataFrame, entry: str, chain: str, residue: str, name: str, element: str) -> DataFrame:
    """(entry, chain_a, chain_b, alpha, heavy): chains in contact: by residue pairs whose alpha carbons (name CA) are less than 8 apart, 4 or more, or of these by pairs with heavy atoms at most 4 apart, 10 or more.

    Rows with a null entry, chain or coordinate touch nothing; repeated atoms of a residue count once for a pair of residues.
    """
    at = [entry, chain, residue, *XYZ]
    key = [F.col(f"a_{entry}").alias(entry), F.col(f"a_{chain}").alias("chain_a"), F.col(f"b_{chain}").alias("chain_b"), F.col(f"a_{residue}").alias("residue_a"), F.col(f"b_{residue}").alias("residue_b")]
    ordered = F.col(f"a_{chain}") < F.col(f"b_{chain}")
    alphas, heavies = atoms.where(F.col(name) == "CA").select(*at), atoms.where(F.col(element).isin(*HEAVY)).select(*at)
    alpha = within(alphas, alphas, ALPHA_RADIUS, [entry], closed=False).where(ordered).select(*key).distinct()
    heavy = within(heavies, heavies, HEAVY_RADIUS, [entry]).where(ordered).select(*key).distinct().withColumn("heavy", F.lit(1))
    pairs = alpha.join(heavy, [entry, "chain_a", "chain_b", "residue_a", "residue_b"], "left")
    counts = pairs.groupBy(entry, "chain_a", "chain_b").agg(F.count("*").alias("alpha"), F.count("heavy").alias("heavy"))
    return counts.where((F.col("alpha") >= ALPHA_LEAST) | (F.col("heavy") >= HEAVY_LEAST))


def nearest_same_letter(a: DataFrame, b: DataFrame, key: str, letter: str, label: str, radius: float = 2.0, entry: list[str] | None = None) -> DataFrame:
    """(key, label): labels of a, or 1 where a point of b with the same letter and label 1 is within the radius; entry: columns of structures that lie in one frame.

    key tells the rows of a apart; rows with a null letter or coordinate keep their label; an empty b changes nothing.
    """
    (got,) = fresh(a)
    p = within(a, b, radius, entry).where(F.col(f"a_{letter}") == F.col(f"b_{letter}"))
    hit = p.groupBy(F.col(f"a_{key}").alias(key)).agg(F.max(f"b_{label}").alias(got))
    return a.join(hit, key, "left").select(key, F.greatest(F.col(label), F.coalesce(got, F.lit(0))).alias(label))


def largest_contact_component(atoms: DataFrame, entry: str, chain: str, radius: float, least: int) -> DataFrame:
    """(entry, chain): the chains of each entry's largest set in contact, directly or through others; its first chain where none touch.

    Of equally large sets, that with the first chain.
    """
    name = lambda c: F.concat_ws("\x1f", F.col(entry).cast("string"), c)
    touching = contacts(atoms, entry, chain, radius, least).select(name(F.col("chain_a")).alias("u"), name(F.col("chain_b")).alias("v"))
    every = atoms.select(entry, chain).distinct().withColumn("node", name(F.col(chain)))
    placed = every.join(component_roots(touching), "node", "left").select(entry, chain, F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy(entry, "root").agg(F.count("*").alias("n"))
    best = sizes.withColumn("r", F.row_number().over(Window.partitionBy(entry).orderBy(F.desc("n"), "root"))).where("r = 1").select(entry, "root")
    return placed.join(best, [entry, "root"]).select(entry, chain)
