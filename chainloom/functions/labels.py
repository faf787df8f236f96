"""Column builders: identities, class codes, position lists and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue groups in the order in which the first match decides; anything else is 7.
CHEMOTYPES = ("ILMVWF", "AGP", "QN", "KR", "S", "T", "DE")
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
# How ambiguous letters are read.
AMBIGUOUS = {"U": "C", "O": "K", "B": "D", "Z": "E", "J": "L", "X": "A"}
# Coarse classes of residues, and the weight of two letters of one class and of a pair with X.
COARSE = {"hyd": "AVLIMFWY", "pol": "GSTCNQP", "neg": "DE", "pos": "KRH"}
SAME_CLASS, UNKNOWN_RESIDUE = 0.7, 0.6
# Right-closed accessibility bins.
RSA_BINS = ((0.05, "buried"), (0.2, "partly"), (0.5, "intermediate"), (None, "exposed"))


def chain_id(identifier: Column, chain: Column) -> Column:
    """identifier_chain, unless the identifier ends with the chain already."""
    return F.when(F.endswith(identifier, F.concat(F.lit("_"), chain)), identifier).otherwise(F.concat_ws("_", identifier, chain))


def prefix(identifier: Column, last: bool = False) -> Column:
    """What stands before the first (or last) underscore; the whole where there is none."""
    if last:
        return F.regexp_replace(identifier, "_[^_]*$", "")
    return F.substring_index(identifier, "_", 1)


def isoform_base(identifier: Column) -> Column:
    """What stands before the first dash."""
    return F.substring_index(identifier, "-", 1)


def source_class(identifier: Column, leading_digit: bool = False) -> Column:
    """PDB for four alphanumerics (with a digit in front, in the older rule), AF otherwise."""
    rule = "^[0-9][A-Za-z0-9]{3}$" if leading_digit else "^[A-Za-z0-9]{4}$"
    return F.when(prefix(identifier).rlike(rule), "PDB").otherwise("AF")


def ec_level3(code: Column) -> Column:
    """First three parts where all are digits, else "not found"."""
    return F.when(code.rlike(r"^\d+\.\d+\.\d+(\.|$)"), F.substring_index(code, ".", 3)).otherwise("not found")


def ec_level(code: Column, n: int) -> Column:
    """First n parts; "Unknown" if one of them is missing or a dash."""
    parts = F.slice(F.split(code, r"\."), 1, n)
    bad = (F.size(parts) < n) | F.exists(parts, lambda p: ~p.rlike(r"^\d+$"))
    return F.when(bad | code.isNull(), "Unknown").otherwise(F.array_join(parts, "."))


def ec_top(code: Column, variant: str = "b") -> Column:
    """Top level of a class code; the variants differ in where they look and in what they say if there is none."""
    lead = F.nullif(F.regexp_extract(code, r"^\s*(\d+)", 1), F.lit(""))
    if variant == "a":
        return F.nullif(F.regexp_extract(code, r"\b([1-7])\s*\.", 1), F.lit(""))
    if variant == "b":
        return lead
    if variant == "c":
        return F.nullif(F.trim(F.substring_index(F.substring_index(code, ";", 1), ".", 1)), F.lit(""))
    first = F.regexp_extract(code, r"^\s*([1-7])(\.|$)", 1)
    if variant == "d":
        return F.when(F.coalesce(first, F.lit("")) == "", "Unknown").otherwise(first)
    if variant == "e":
        return F.when(lead.isNotNull(), F.concat(F.lit("EC"), lead))
    raise ValueError(f"unknown variant {variant!r}")


def chemotype(residues: Column) -> Column:
    """0 to 6: the first group with a letter in the set; 7 without one, or for an empty or null set."""
    out = None
    for n, letters in enumerate(CHEMOTYPES):
        hit = F.coalesce(F.arrays_overlap(residues, F.array(*map(F.lit, letters))), F.lit(False))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(7)


def rsa_bin(value: Column) -> Column:
    """Right-closed bins; null and NaN are in none."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for edge, name in RSA_BINS:
        out = out.otherwise(name) if edge is None else out.when(value <= edge, name)
    return out


def sanitize(sequence: Column, unknown: str | None = "X") -> Column:
    """Trimmed and upper case, with other letters as `unknown`; None: as it stands, ambiguous capitals read by AMBIGUOUS, and what is left over goes."""
    if unknown is not None:
        return F.regexp_replace(F.upper(F.regexp_replace(sequence, r"^\s+|\s+$", "")), f"[^{AMINO_ACIDS}]", unknown)
    mapped = F.translate(sequence, "".join(AMBIGUOUS), "".join(AMBIGUOUS.values()))
    return F.regexp_replace(mapped, f"[^{AMINO_ACIDS}]", "")

def positions(cell: Column) -> Column:
    """Sorted distinct positions of a cell: triplets ('0', 'A', '66') give the third field, other text all its numbers; 0 goes."""
    triplet = r"'[^']*'\s*,\s*'[^']*'\s*,\s*'(\d+)'"
    cell = F.coalesce(cell, F.lit(""))
    found = F.regexp_extract_all(cell, F.lit(triplet), F.lit(1))
    loose = F.regexp_extract_all(cell, F.lit(r"(\d+)"), F.lit(1))
    numbers = F.transform(F.when(F.size(found) > 0, found).otherwise(loose), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))


_ATOM = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[-+]?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][-+]?\d+)?|None|True|False)"""
_FLAT = rf"\s*(?:{_ATOM}\s*(?:,\s*{_ATOM}\s*)*,?\s*)?"
_ITEM = rf"(?:{_ATOM}|\({_FLAT}\)|\[{_FLAT}\])"


def count_sites(cell: Column) -> Column:
    """Sites of a cell. A literal list (in brackets, or items between commas) of a length that three divides has a site for three items, another one for each
    item that reads as a whole number, or, without such, for each item. Other text is cut at commas and counted likewise. Blank, nan and none have no sites.

    Lists may hold lists of plain items; deeper ones are read as text.
    """
    cell = F.trim(F.coalesce(cell, F.lit("")))
    inner = F.regexp_extract(cell, rf"^(?:\[(\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?)\]|\((\s*(?:{_ITEM}\s*,\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?)?)\)|({_ITEM}\s*,\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?))$", 0)
    bare = F.when(inner.rlike(r"^\[.*\]$|^\(.*\)$") & ~inner.rlike(rf"^{_ITEM}\s*,"), F.substr(inner, F.lit(2), F.greatest(F.length(inner) - 2, F.lit(0)))).otherwise(inner)
    items = F.regexp_extract_all(bare, F.lit(_ITEM), F.lit(0))
    whole = lambda x: x.rlike(r"""^\s*[-+]?\d+(_\d+)*\s*$""")
    number = lambda x: F.when(x.rlike("^['\"]"), whole(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x.rlike(r"^[-+\d]|^True$|^False$"))
    count = lambda xs, test: F.greatest(F.size(F.filter(xs, test)), F.when(F.size(F.filter(xs, test)) == 0, F.size(xs)).otherwise(0))
    tokens = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(F.size(items) % 3 == 0, F.floor(F.size(items) / 3)).otherwise(count(items, number))
    return F.when(F.lower(cell).isin("", "nan", "none"), 0).when(inner != "", listed).otherwise(count(tokens, whole)).cast("int")

def format_positions(values: Column, shift: int = 0) -> Column:
    """Positions, moved by shift, joined by commas."""
    return F.array_join(F.transform(values, lambda p: (p + shift).cast("string")), ", ")


def chain_ranges(text: Column) -> Column:
    """map<chain, struct<start, end>> of "A=1-100, B=2-90"; other parts are passed over, the last of a chain counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\w+=\d+-\d+$"))
    entry = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.struct(F.regexp_extract(p, r"=(\d+)-", 1).cast("int").alias("start"), F.regexp_extract(p, r"-(\d+)$", 1).cast("int").alias("end")).alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.greatest(F.size(entry), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def dense_labels(found: Column, length: Column) -> Column:
    """0/1 vector of a 0-based position set; empty for length 0."""
    every = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.array_contains(found, i).cast("int"))


def range_positions(starts_ends: Column) -> Column:
    """Positions covered by inclusive (start, end) structs, sorted and distinct; reversed ones cover nothing."""
    good = F.filter(starts_ends, lambda r: r["start"] <= r["end"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda r: F.sequence(r["start"], r["end"])))))


def hits_at(scores: Column, numbers: Column, tau: float) -> Column:
    """Numbers whose score is at least tau; NaN never is. Places 1..L stand in where the lengths differ."""
    ordinal = F.transform(scores, lambda s, i: i + 1)
    used = F.when(F.size(numbers) == F.size(scores), numbers).otherwise(ordinal)
    return F.transform(F.filter(F.arrays_zip(scores.alias("s"), used.alias("n")), lambda z: ~F.isnan(z["s"]) & (z["s"] >= tau)), lambda z: z["n"])


def scaled(text: Column, factor: float) -> Column:
    """A number in a text, times the factor; what is no number counts as 0."""
    number = text.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number) * factor


def floor_scores(scores: Column, least: float) -> Column:
    """Scores with those below `least`, and null and NaN ones, as 0."""
    return F.transform(scores, lambda s: F.when((s >= least) & ~F.isnan(s), s).otherwise(0.0))


def channel(scores: Column, index: int = -1) -> Column:
    """One class of an array of class scores per position; 1-based, -1 is the last."""
    return F.transform(scores, lambda s: F.element_at(s, index))


def log_weight(weight: Column, base: float, eps: float = 1e-12) -> Column:
    """Logarithm of a weight, of eps where it is less."""
    return F.log(float(base), F.greatest(weight, F.lit(eps)))


def coarse_class(letter: Column) -> Column:
    """Coarse class of a residue letter, null for other letters and X."""
    out = F.lit(None).cast("string")
    for name, letters in COARSE.items():
        out = F.when(letter.isin(*letters), name).otherwise(out)
    return out


def pair_weight(a: Column, b: Column) -> Column:
    """1 for the same letter, 0.6 if one is X, 0.7 for two letters of one coarse class, else 0; 0 with a null."""
    return F.when(a == b, 1.0).when((a == "X") | (b == "X"), UNKNOWN_RESIDUE).when(coarse_class(a) == coarse_class(b), SAME_CLASS).otherwise(0.0)

def msa_row(aligned: Column) -> Column:
    """Alignment row with dots as gaps and without insertions (lower case)."""
    return F.regexp_replace(F.translate(aligned, ".", "-"), "[a-z]", "")


def sites_in_text(text: Column) -> Column:
    """Positions after ACT_SITE, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"ACT_SITE\s+(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def evidence_codes(text: Column) -> Column:
    """Sorted distinct codes ECO:n of a text, as they stand."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(ECO:\d+)"), F.lit(1))))


def first_code(text: Column) -> Column:
    """What stands before the first semicolon, trimmed; "not found" for null, blank and nan, or if nothing stands there."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    first = F.trim(F.substring_index(clean, ";", 1))
    return F.when((F.lower(clean) == "nan") | (first == ""), "not found").otherwise(first)
