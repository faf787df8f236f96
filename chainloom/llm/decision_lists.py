"""Quality rules: decision lists learned by sequential covering, in DataFrame functions only.

Statistics of a text are native columns. Rules that reject are conjunctions of thresholds: each grows by the condition with the
most information gain over binned counts of the labelled rows (one small aggregate a step), is pruned on rows held
back, and takes the rows it covers out. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed, col, columns

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share")
_P = "__rule_"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more; windows: an array of hashes, by place."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(ranked: Column) -> Column:
        def twice(s: Column, j: Column) -> Column:
            same = lambda other: F.coalesce(F.get(ranked, other)["h"] == s["h"], F.lit(False))
            return F.when(same(j - 1) | same(j + 1), s["i"])

        return F.sort_array(F.filter(F.transform(ranked, twice), lambda i: i.isNotNull()))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["last"] - i + 1)).alias("n"), (i + 2).alias("last"))

    # the one-element transform keeps the sorted array from being worked out for every element
    places = F.flatten(F.transform(F.array(ranked), marked))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last")), step, lambda acc: acc["n"])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and its statistics, each in a column named __rule_<name>, which docs must not have (see keep_good()); null texts count as empty.

    Texts are read whole, however long. Base counts as the module's BASE, and shares: mean word length, symbols, repeated lines and words, A-Z, "!" and "?", distinct words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.col(f"{_P}words")
    one = docs.withColumn(f"{_P}text", text).withColumn(f"{_P}words", F.regexp_extract_all(F.col(f"{_P}text"), F.lit(WORD), F.lit(0)))
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col(f"{_P}text"), "\n"), lambda x: F.length(_without(x, " \t\n\x0b\f\r")) > 0)
    t = F.col(f"{_P}text")
    two = one.withColumns({f"{_P}windows": hashes, f"{_P}lines": lines, f"{_P}bare": _without(t, " \t\n\x0b\f\r")})
    win, ln, bare = F.col(f"{_P}windows"), F.col(f"{_P}lines"), F.col(f"{_P}bare")
    # a row number in one column keeps conditions on the statistics from being moved below this step and worked out anew for every word
    three = two.withColumns({
        f"{_P}n_words": F.when(F.monotonically_increasing_id() >= 0, n).otherwise(0).cast("long"), f"{_P}word_chars": F.length(bare).cast("long"), f"{_P}n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        f"{_P}n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"), f"{_P}n_lines": F.size(ln).cast("long"),
        f"{_P}n_repeat_words": F.when(F.size(F.array_distinct(win)) < F.size(win), _repeat_words(win)).otherwise(0).cast("long"),
        f"{_P}n_upper": F.regexp_count(bare, F.lit("[A-Z]")).cast("long"), f"{_P}n_marks": F.regexp_count(t, F.lit("[!?]")).cast("long"),
        f"{_P}n_distinct": F.size(F.array_distinct(words)).cast("long"),
    })
    share = lambda a, b: F.col(_P + a) / F.greatest(F.col(_P + b), F.lit(1))
    four = three.withColumns({
        f"{_P}mean_word": share("word_chars", "n_words"), f"{_P}symbol_share": share("n_symbols", "word_chars"), f"{_P}dup_line_share": share("n_dup_lines", "n_lines"), f"{_P}repeat_share": share("n_repeat_words", "n_words"),
        f"{_P}upper_share": share("n_upper", "word_chars"), f"{_P}mark_share": share("n_marks", "word_chars"), f"{_P}distinct_share": share("n_distinct", "n_words"),
    })
    return four.drop(*[_P + c for c in ("text", "words", "windows", "lines", "bare", "n_lines", "n_upper", "n_marks", "n_distinct")])


def base_failed() -> Column:
    words, again = F.col(f"{_P}n_words"), F.col(f"{_P}n_repeat_words")
    return (words < 50) | (100 * again > 50 * words)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def expression(self, prefix: str = _P) -> Column:
        c = F.col(prefix + self.feature).cast("double")
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each of which rejects what it covers; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def kept(self, prefix: str = _P) -> Column:
        out = None
        for rule in self.rules:
            covers = F.lit(True)
            for c in rule:
                covers = covers & c.expression(prefix)
            out = F.when(covers, F.lit(False)) if out is None else out.when(covers, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["keep otherwise"])


def _covers(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.expression()
    return out


def learn(labelled: DataFrame, label_col: str = "y", max_rules: int = 8, max_conditions: int = 3, bins: int = 24, least_precision: float = 0.9, least_covered: int = 3) -> DecisionList:
    """A decision list that rejects rows of label 0, from rows with the columns of with_statistics().

    labelled is small (the caller bounds it). Null labels are left out; without rows of both labels the list keeps all. Each step brings
    at most len(FEATURES) * bins counts to the driver.
    """
    cols = [F.col(_P + f).cast("double").alias(_P + f) for f in FEATURES]
    rows = checkpointed(labelled.where(F.col(label_col).isNotNull()).select(*cols, (F.col(label_col) == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(*[F.col(_P + f) for f in FEATURES]), F.lit(3)) < 2).alias("grow")))
    cuts = rows.agg(*[F.percentile_approx(_P + f, [k / bins for k in range(1, bins)], 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    binned = F.array(*[F.struct(F.lit(k).alias("f"), sum((F.when(F.col(_P + f) >= t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias("bin")) for k, f in enumerate(FEATURES)])
    rows = checkpointed(rows.withColumn("bins", binned))
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while len(rules) < max_rules:
        rule: list[Condition] = []
        grown = left.where("grow")
        while len(rule) < max_conditions:
            counts = grown.select("bad", F.explode("bins").alias("b")).groupBy("b.f", "b.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = _best(counts, cuts)
            if best is None:
                break
            rule.append(best)
            grown = grown.where(best.expression())
        if not rule:
            break
        held = left.where("not grow")
        sums = []
        for k in range(1, len(rule) + 1):
            sums += [F.coalesce(F.sum(F.when(_covers(rule[:k]), F.col("bad"))), F.lit(0)).alias(f"p{k}"), F.coalesce(F.sum(F.when(_covers(rule[:k]), 1)), F.lit(0)).alias(f"n{k}")]
        seen = held.agg(*sums).first()
        worth = [((2 * seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"n{k}"]), -k) for k in range(1, len(rule) + 1)]
        k = -max(worth)[1]
        if seen[f"n{k}"] < least_covered or seen[f"p{k}"] < least_precision * seen[f"n{k}"]:
            break
        rules.append(tuple(rule[:k]))
        left = left.where(~_covers(rule[:k]))
    return DecisionList(tuple(rules))


def _best(counts: list, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition with the most FOIL gain: bad rows covered times what their share's logarithm gains."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
    best, found = 1e-9, None
    for k, f in enumerate(FEATURES):
        table = by.get(k, {})
        p_all, n_all = (sum(v[i] for v in table.values()) for i in (0, 1))
        if not 0 < p_all < n_all:
            continue
        p_low = n_low = 0
        for b, t in enumerate(cuts[f]):
            p_low, n_low = p_low + table.get(b, (0, 0))[0], n_low + table.get(b, (0, 0))[1]
            for at_least, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p and n < n_all:
                    gain = p * (math.log2(p / n) - math.log2(p_all / n_all))
                    if gain > best:
                        best, found = gain, Condition(f, at_least, t)
    return found


def learn_from(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DecisionList:
    """A list from the texts of about fit_rows labelled documents, taken by hash of their id.

    The labels are broadcast: their number is bounded by fit_rows, which is checked by counting them. Null ids and labels are left out; an id
    with several labels counts with each, and a document that repeats counts as often. Without labels the list keeps all.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_labelled"), F.col(label_col).alias("y")).where("_labelled is not null and y is not null").distinct()
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("_labelled", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    texts = docs.select(col(id_col).cast("long").alias("_id"), col(text_col).alias("text")).join(F.broadcast(picked), F.col("_id") == F.col("_labelled")).select("text", "y")
    return learn(with_statistics(texts), "y", **options)


def judged(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, kept): one row per row of docs; null texts fail the base.

    Repeated rows and null ids keep their rows; an empty table gives no rows.
    """
    s = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return s.select("doc_id", *[F.col(_P + c).alias(c) for c in BASE], base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Rows of docs that pass the base and the rules, with docs' columns as they are, whatever their names.

    Null and empty texts fail the base. Repeated rows stay or go together; an empty table stays empty.
    """
    packed = docs.select(F.struct(*columns(docs)).alias("row"), col(text_col).alias("text"))
    kept = with_statistics(packed).where(~base_failed() & rules.kept())
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
