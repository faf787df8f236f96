"""Screening: predicted against known position sets, variants of a base record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import free_names, fresh, written
from .audit import keep_first
from .transfer import column_vote

#: Sequences of one block of a group; pairs of blocks are dealt out.
PAIR_BLOCK = 200


def novelty(rows: DataFrame, predicted: str, known: str) -> DataFrame:
    """rows with novel, n_novel, n_known, n_shared from two position arrays; nulls count as empty."""
    free_names(rows, "novel", "n_novel", "n_known", "n_shared", "n_predicted")
    p, k = F.coalesce(F.col(predicted), F.array().cast("array<int>")), F.coalesce(F.col(known), F.array().cast("array<int>"))
    t = rows.withColumn("novel", F.array_sort(F.array_except(p, k))).withColumn("n_known", F.size(F.array_distinct(k))).withColumn("n_shared", F.size(F.array_intersect(p, k)))
    return t.withColumn("n_novel", F.size("novel")).withColumn("n_predicted", F.size(F.array_distinct(p)))


def novelty_summary(novel: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, with_novel, novel_sites, without_known, micro_recall)."""
    return novel.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum((F.col("n_novel") > 0).cast("int")).alias("with_novel"), F.sum("n_novel").alias("novel_sites"), F.sum(((F.col("n_novel") > 0) & (F.col("n_known") == 0)).cast("int")).alias("without_known"),
        F.coalesce(F.try_divide(F.sum("n_shared"), F.sum("n_known")), F.lit(0.0)).alias("micro_recall"),
    )


def set_scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, precision, recall, f1): macro means of set overlaps; empty sets give 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    p, r, f = fresh(rows, n=3)
    t = rows.withColumn(p, ratio("n_shared", "n_predicted")).withColumn(r, ratio("n_shared", "n_known"))
    t = t.withColumn(f, F.coalesce(F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r)), F.lit(0.0)))
    return t.groupBy(*group).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def reference_member(rows: DataFrame, base: str, member: Column) -> DataFrame:
    """One row per base: the member that ends in -1, else of the least numeric suffix, else of the first name."""
    number = F.regexp_extract(member, r"-(\d+)$", 1).try_cast("int")
    order = [F.when(F.endswith(member, F.lit("-1")), 0).otherwise(1), F.coalesce(number, F.lit(1_000_000_000)), member]
    return keep_first(rows, [base], order)


def neighbour_positive(rows: DataFrame, chain: str, letter: str, pos: str, label: str, within: int = 10) -> DataFrame:
    """rows and `near`: another positive of the same letter within so many positions."""
    w = Window.partitionBy(chain, letter).orderBy(pos).rangeBetween(-within, within)
    return rows.withColumn("near", (F.sum(label).over(w) - F.col(label)) > 0)


def spread(aligned: DataFrame, base: str, ref_pos: str, score: str) -> DataFrame:
    """(base, spread): the widest range of scores at one reference position with two values or more, else 0."""
    per = aligned.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(base, ref_pos).agg((F.max(score) - F.min(score)).alias("r"), F.count("*").alias("n"))
    return per.groupBy(base).agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("r"))), F.lit(0.0)).alias("spread"))


def loss_categories(sites: DataFrame, pairs: DataFrame, scores: DataFrame, tau: float) -> DataFrame:
    """(base, member, retained, lost_aligned, lost_missing, category) for each other member of a base.

    sites: (base, member, ref_pos), each reference site once for each member. pairs: (base, member, ref_pos, pos, same). scores:
    (member, pos, score). A site without a pair of the same letter is missing, one with a score below tau is lost though aligned.
    """
    j = sites.join(pairs.where("same").select("base", "member", "ref_pos", "pos"), ["base", "member", "ref_pos"], "left").join(scores.select("member", "pos", "score"), ["member", "pos"], "left")
    kept = F.coalesce((F.col("score") >= tau) & ~F.isnan("score"), F.lit(False))
    g = j.groupBy("base", "member").agg(F.sum(kept.cast("int")).alias("retained"), F.sum((~kept & F.col("pos").isNotNull()).cast("int")).alias("lost_aligned"), F.sum((~kept & F.col("pos").isNull()).cast("int")).alias("lost_missing"))
    category = F.when((F.col("lost_aligned") == 0) & (F.col("lost_missing") == 0), "no_loss").when(F.col("lost_aligned") == 0, "loss_missing_only").otherwise("loss_aligned_present")
    return g.withColumn("category", category)


def explode_variants(records: DataFrame, accession: str, variants: str, carry: list[str]) -> DataFrame:
    """(variant, base, carry): distinct variant ids of each record."""
    return records.where(F.size(variants) >= 1).select(F.explode(F.array_distinct(variants)).alias("variant"), F.col(accession).alias("base"), *carry)


def loss_events(categories: DataFrame, base: str = "base") -> DataFrame:
    """(base, members, lost): bases of loss_categories() where a member has a site of the same letter that is not predicted."""
    g = categories.groupBy(base).agg(F.count("*").alias("members"), F.sum("lost_aligned").alias("lost"))
    return g.where("lost > 0")


def sequence_pairs(sequences: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(base, q, t, q_seq, t_seq): every pair of different sequences (base, id, seq) of a base, once, q before t.

    A base's sequences fall into blocks of about `block` by a hash of the id, and pairs of blocks are the join key: a base of any size is many tasks, each with two blocks.
    """
    n = sequences.groupBy("base").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1")  # most bases have one block: what is joined stays small
    placed = sequences.join(n, "base", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    left = placed.select("base", F.col("id").alias("q"), F.col("seq").alias("q_seq"), "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("base", "q", "q_seq", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "b")
    right = left.select("base", F.col("q").alias("t"), F.col("q_seq").alias("t_seq"), "low", "high", F.col("b").alias("t_b"))
    both = left.join(right, ["base", "low", "high"]).where((F.col("q") < F.col("t")) & ((F.col("low") == F.col("high")) | (F.col("b") != F.col("t_b"))))
    return both.select("base", "q", "t", "q_seq", "t_seq")


def member_losses(members: DataFrame, sites: DataFrame, align, block: int = PAIR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((base, source, target, pos, target_pos), (base, members, reason)): losses between any two members of a base, both ways, and the bases without a comparison.

    members: (base, member, seq); of a member with several rows the least sequence counts. sites: (base, member, pos), predicted positions from 0. A site of `source` is lost in `target` if it is aligned to
    the same letter there, which is no predicted site. align: pairs (base, q, t, q_seq, t_seq) -> (base, q, t, qpos, tpos) of aligned positions with the same letter. Sequences are aligned once for each pair of
    different ones of a base, used in both directions and by all members that share them. A member's sites go as one array, and both tables are read once. A base with one member, or with a member without a sequence, is compared not at all.
    Null bases and members are left out; sites outside a sequence are aligned to nothing; an empty table gives no rows.
    """
    hits = sites.where(F.col("base").isNotNull() & F.col("member").isNotNull()).groupBy("base", "member").agg(F.collect_set(F.col("pos").cast("int")).alias("hits"))
    one = members.where(F.col("base").isNotNull() & F.col("member").isNotNull()).groupBy("base", "member").agg(F.min("seq").alias("seq"), F.count_if(F.col("seq").isNull()).alias("lacks"))
    one = written(one.join(hits, ["base", "member"], "left").select("base", "member", F.unhex(F.md5(F.col("seq").cast("binary"))).alias("id"), "seq", "lacks", F.coalesce("hits", F.array().cast("array<int>")).alias("hits")), "members")
    sizes = one.groupBy("base").agg(F.count("*").alias("members"), F.count_if(F.coalesce(F.col("seq"), F.lit("")) == "").alias("lacks"))
    reason = F.when(F.col("members") < 2, "one member").when(F.col("lacks") > 0, "no sequence")
    sizes = written(sizes.withColumn("reason", reason), "sizes")
    named = one.join(sizes.where("reason is not null").select("base"), "base", "left_anti")
    distinct = written(named.groupBy("base", "id").agg(F.min("seq").alias("seq"), F.count("*").alias("n")), "sequences")
    found = named.select("base", "member", "id", F.explode("hits").alias("pos"))
    # ids are 16 bytes, and 32 letters only where pairs are aligned: they are most of what is shuffled
    letters = lambda c: F.lower(F.hex(c)).alias(c)
    pairs = sequence_pairs(distinct.select("base", "id", "seq"), block).select("base", letters("q"), letters("t"), "q_seq", "t_seq")
    ways = [F.struct(F.unhex(q).alias("q"), F.unhex(t).alias("t"), F.col(f"{q}pos").alias("qpos"), F.col(f"{t}pos").alias("tpos")) for q, t in ("qt", "tq")]
    both = align(pairs).select("base", F.explode(F.array(*ways)).alias("way")).select("base", "way.*")  # both ways from one alignment
    inside = distinct.where("n > 1").select("base", "id", F.length("seq").alias("length"))
    own = found.join(inside, ["base", "id"]).where((F.col("pos") >= 0) & (F.col("pos") < F.col("length"))).select("base", F.col("id").alias("q"), F.col("id").alias("t"), F.col("pos").alias("qpos"), F.col("pos").alias("tpos")).distinct()
    at = found.select("base", F.col("id").alias("q"), F.col("pos").alias("qpos"), F.col("member").alias("source"))
    targets = named.select("base", F.col("id").alias("t"), F.col("member").alias("target"), "hits")
    reached = both.unionByName(own).join(at, ["base", "q", "qpos"]).join(targets, ["base", "t"]).where("source <> target")
    lost = reached.where(~F.array_contains("hits", F.col("tpos").cast("int"))).select("base", "source", "target", F.col("qpos").alias("pos"), F.col("tpos").alias("target_pos"))
    return lost, sizes.where("reason is not null").select("base", "members", "reason")


# Least members of a column, and places around a site in which another one of its letter speaks against it.
QUORUM, NEARBY = 2, 10


def column_proposals(votes: DataFrame, positives: DataFrame, group: list[str], tau: float, quorum: int = QUORUM, nearby: int = NEARBY) -> DataFrame:
    """(member, pos): sites that the columns of alignments propose to their members, each once.

    votes: (group, col, member, pos, aa, label), a row for each member's letter in a column. The commonest letter of a column (of equally common ones the first by alphabet) with `quorum` members and a mean label
    of tau or more is proposed to all members that have it there, unless another positive of that member (member, pos, aa) with the same letter lies within `nearby` places. Such
    positives are met by buckets of that width, own and neighbouring ones, in an anti-join: no window over a chain. Null letters have no vote; repeated rows vote each; empty tables give no rows.
    """
    best = column_vote(votes.where(F.col("aa").isNotNull()), [*group, "col"], "aa", "label", quorum, tau).select(*group, "col", "aa")
    named = [F.col(f"v.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, "col", "aa"]]
    wanted = votes.alias("v").join(best.alias("b"), named, "left_semi").select("member", "pos", "aa").distinct()
    near = positives.select(F.col("member").alias("of"), F.col("pos").alias("at"), F.col("aa").alias("letter"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("pos") / nearby) + i)).alias("bucket"))
    close = (F.col("member") == F.col("of")) & (F.col("aa") == F.col("letter")) & (F.floor(F.col("pos") / nearby) == F.col("bucket")) & (F.col("pos") != F.col("at")) & (F.abs(F.col("pos") - F.col("at")) <= nearby)
    return wanted.join(near, close, "left_anti").select("member", "pos").distinct()
