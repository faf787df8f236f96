"""Evaluation queries: curves, top-k, sweeps, merges, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves, evaluate, merge, ranking, sweep
from ..operators.audit import keep_first
from .bindings import RESIDUES, RUNS, residues, runs
from .registry import Registry

query = Registry()


def weight_():
    return F.col("weight")



def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits, so that the order of sums does not show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def points_sql(score: str, by: str = "fold", weight: str = "weight", table: str = RESIDUES) -> str:
    """CTEs up to p(by, score, tp, fp, dtp, dfp, pos, neg)."""
    return f"""{table}, d AS (SELECT {by}, {score} AS s, sum({weight} * label)::DOUBLE AS dtp, sum({weight} * (1 - label))::DOUBLE AS dfp FROM res GROUP BY ALL),
    p AS (SELECT *, sum(dtp) OVER up AS tp, sum(dfp) OVER up AS fp, sum(dtp) OVER (PARTITION BY {by}) AS pos, sum(dfp) OVER (PARTITION BY {by}) AS neg FROM d WINDOW up AS (PARTITION BY {by} ORDER BY s DESC)),
    q AS (SELECT *, tp / (tp + fp) AS precision, tp / nullif(pos, 0) AS recall FROM p),
    z AS (SELECT *, lag(precision, 1, 1.0) OVER (PARTITION BY {by} ORDER BY s DESC) AS p0, lag(recall, 1, 0.0) OVER (PARTITION BY {by} ORDER BY s DESC) AS r0 FROM q)"""


AREA = "SELECT {by}, round(coalesce(sum((recall - r0) * (precision + p0) / 2), 0), 6) AS aucpr, round(coalesce(sum((recall - r0) * precision), 0), 6) AS ap, count(*) AS n_points FROM z GROUP BY {by}"


@query("WITH " + points_sql("score") + AREA.format(by="fold").replace("SELECT", " SELECT", 1))
def pr_auc_by_fold(spark, sf_dir):
    return rounded(curves.pr_summary(residues(spark, sf_dir), ["fold"], weight=weight_()))


@query("WITH " + points_sql("tied", "split") + " " + AREA.format(by="split"))
def pr_auc_ties(spark, sf_dir):
    return rounded(curves.pr_summary(residues(spark, sf_dir), ["split"], score="tied", weight=weight_()))


@query("WITH " + points_sql("quantity", "chain", "1.0") + " SELECT chain, round(coalesce(sum((recall - r0) * precision), 0), 6) AS ap FROM z GROUP BY chain")
def avg_precision_per_chain(spark, sf_dir):
    return rounded(curves.pr_summary(residues(spark, sf_dir), ["chain"], score="quantity", buckets=2).select("chain", "ap"))


@query("WITH " + points_sql("tied", "fold") + """, f AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM q)
SELECT fold, s AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(f1, 12) DESC, s) AS r FROM f) WHERE r = 1""")
def best_f1_threshold(spark, sf_dir):
    return rounded(curves.best_f1(residues(spark, sf_dir), ["fold"], score="tied", weight=weight_()), "threshold")


_VAL = "WITH " + points_sql("tied", "split") + """, f AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM q WHERE split = 'val'),
t AS (SELECT s AS tau FROM f ORDER BY round(f1, 12) DESC, s LIMIT 1)"""


@query(_VAL + """, c AS (SELECT split, tau, sum(CASE WHEN tied >= tau AND label = 1 THEN weight ELSE 0 END) AS tp, sum(CASE WHEN tied >= tau AND label = 0 THEN weight ELSE 0 END) AS fp, sum(CASE WHEN tied < tau AND label = 1 THEN weight ELSE 0 END) AS fn FROM res, t WHERE split <> 'val' GROUP BY split, tau)
SELECT split, tau, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def prf_at_tau_from_other_split(spark, sf_dir):
    r = residues(spark, sf_dir)
    tau = curves.best_f1(r.where("split = 'val'"), ["split"], score="tied", weight=weight_()).select(F.col("threshold").alias("tau"))
    rows = r.where("split <> 'val'").crossJoin(F.broadcast(tau))
    c = curves.confusion(rows, ["split", "tau"], curves.passes(F.col("tied"), F.col("tau")), weight=weight_())
    return rounded(c.select("split", "tau", "tp", "fp", "fn", "precision", "recall", "f1"), "tau")


@query("WITH " + points_sql("score", "split") + " SELECT split, round(sum((dfp / neg) * (2 * tp - dtp) / pos / 2), 6) AS roc_auc FROM p GROUP BY split")
def roc_auc_weighted(spark, sf_dir):
    return rounded(curves.roc_auc(residues(spark, sf_dir), ["split"], weight=weight_()))


KS = [1, 2, 3, 5, 10]
_TOPK = f"""WITH {RESIDUES}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, pos) AS rank FROM res),
per AS (SELECT chain, fold, weight, k, count(*) AS length, sum(label) AS npos, sum(CASE WHEN rank <= k THEN label ELSE 0 END) AS tp, least(k, count(*)) AS kk FROM r, (SELECT unnest({KS}) AS k) GROUP BY chain, fold, weight, k)"""


def _topk(spark, sf_dir) -> DataFrame:
    per = ranking.at_k(residues(spark, sf_dir), ["chain"], KS, ["fold", "weight"])
    return rounded(ranking.topk_metrics(per, ["fold"], weight_()))


@query(_TOPK + " SELECT fold, k, round(sum(weight * CASE WHEN npos > 0 THEN tp / least(npos, kk) ELSE 0 END) / sum(weight), 6) AS max_precision FROM per GROUP BY fold, k")
def max_precision_at_k(spark, sf_dir):
    return _topk(spark, sf_dir).select("fold", "k", "max_precision")


@query(_TOPK + " SELECT fold, k, round(sum(weight * tp) / sum(weight * least(npos, k)), 6) AS f FROM per GROUP BY fold, k")
def f_at_k_micro(spark, sf_dir):
    return _topk(spark, sf_dir).select("fold", "k", "f")


@query(_TOPK + """ SELECT fold, k, round(sum(weight * tp / kk) / sum(weight), 6) AS precision, round(sum(CASE WHEN npos > 0 THEN weight * tp / npos END) / sum(CASE WHEN npos > 0 THEN weight END), 6) AS recall,
round(sum(CASE WHEN npos > 0 AND tp > 0 THEN weight WHEN npos > 0 THEN 0 END) / sum(CASE WHEN npos > 0 THEN weight END), 6) AS hit FROM per GROUP BY fold, k""")
def prec_rec_hit_at_k(spark, sf_dir):
    return _topk(spark, sf_dir).select("fold", "k", "precision", "recall", "hit")


@query(f"""WITH {RESIDUES} SELECT chain, sum(CASE WHEN score >= 40000 THEN label ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score >= 40000 THEN 1 - label ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN score < 40000 THEN label ELSE 0 END)::DOUBLE AS fn,
sum(CASE WHEN score < 40000 THEN 1 - label ELSE 0 END)::DOUBLE AS tn, max(CASE WHEN score >= 40000 AND label = 0 THEN score END) AS max_fp FROM res GROUP BY chain""")
def chain_confusion(spark, sf_dir):
    return evaluate.chain_confusion(residues(spark, sf_dir), ["chain"], 40000.0)


@query(f"""WITH {RESIDUES}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, pos) AS rank FROM res)
SELECT chain, sum(CASE WHEN rank <= 2 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN rank <= 2 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN rank > 2 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
sum(CASE WHEN rank <= 2 AND label = 0 AND score >= 50000 THEN 1 ELSE 0 END)::BIGINT AS confident_fp, max(CASE WHEN rank <= 2 AND label = 0 THEN score END) AS max_fp FROM r GROUP BY chain""")
def topk_confusion(spark, sf_dir):
    return ranking.chain_confusion_topk(residues(spark, sf_dir), ["chain"], 2, 50000.0)


@query(f"""WITH {RESIDUES}, b AS (SELECT *, CASE WHEN rsa <= 0.05 THEN 'buried' WHEN rsa <= 0.2 THEN 'partly' WHEN rsa <= 0.5 THEN 'intermediate' ELSE 'exposed' END AS bin FROM res),
c AS (SELECT bin, sum(CASE WHEN score >= 40000 AND label = 1 THEN weight ELSE 0 END) AS tp, sum(CASE WHEN score >= 40000 AND label = 0 THEN weight ELSE 0 END) AS fp, sum(CASE WHEN score < 40000 AND label = 1 THEN weight ELSE 0 END) AS fn, sum(CASE WHEN score < 40000 AND label = 0 THEN weight ELSE 0 END) AS tn FROM b GROUP BY bin)
SELECT bin, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM c""")
def confusion_by_bin(spark, sf_dir):
    from ..functions.labels import rsa_bin

    r = residues(spark, sf_dir).withColumn("bin", rsa_bin(F.col("rsa")))
    return rounded(curves.confusion(r, ["bin"], curves.passes(F.col("score"), 40000.0), weight=weight_()))


TAUS = [10000.0, 20000.0, 30000.0, 40000.0, 50000.0, 60000.0, 70000.0, 80000.0, 90000.0]
_SWEEP = f"""WITH {RESIDUES}, per AS (SELECT chain, weight AS w, tau, sum(label) AS npos, sum(CASE WHEN score >= tau THEN label ELSE 0 END) AS tp, sum(CASE WHEN score >= tau THEN 1 - label ELSE 0 END) AS fp FROM res, (SELECT unnest({TAUS}::DOUBLE[]) AS tau) GROUP BY chain, weight, tau),
s AS (SELECT tau, sum(w * tp)::DOUBLE AS tp, sum(w * fp)::DOUBLE AS fp, sum(w * (npos - tp))::DOUBLE AS fn, round(coalesce(sum(w * tp) / nullif(sum(w * (tp + fp)), 0), 0), 6) AS precision, round(sum(w * tp) / sum(w * npos), 6) AS recall, round(sum(w * (tp + fp)) / sum(w), 6) AS avg_pred,
round(sum(w * fp) / sum(w), 6) AS avg_fp, round(sum(CASE WHEN tp + fp > 3 THEN w ELSE 0 END) / sum(w), 6) AS over_budget, round(sum(CASE WHEN fp >= 1 THEN w ELSE 0 END) / sum(w), 6) AS any_fp FROM per GROUP BY tau)"""


def _swept(spark, sf_dir) -> DataFrame:
    return rounded(sweep.threshold_sweep(residues(spark, sf_dir), TAUS), "tau")


@query(_SWEEP + " SELECT tau, tp, fp, fn, precision, recall, avg_pred, over_budget FROM s")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).select("tau", "tp", "fp", "fn", "precision", "recall", "avg_pred", "over_budget")


@query(_SWEEP + " SELECT tau, avg_fp, any_fp, avg_pred FROM s")
def fp_load_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).select("tau", "avg_fp", "any_fp", "avg_pred")


@query(f"""WITH {RESIDUES}, v AS (SELECT fold, quantity AS v, sum(weight) AS w FROM res GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY fold ORDER BY v) AS cw, sum(w) OVER (PARTITION BY fold) AS tw FROM v)
SELECT fold, q, min(v) AS quantile FROM c, (SELECT unnest([0.25, 0.5, 0.95]::DOUBLE[]) AS q) WHERE cw >= q * tw - 1e-12 GROUP BY fold, q""")
def weighted_quantile(spark, sf_dir):
    return sweep.weighted_quantile(residues(spark, sf_dir), "quantity", "weight", [0.25, 0.5, 0.95], ["fold"])


@query(_SWEEP + " SELECT tau, avg_pred, recall, recall > coalesce(max(recall) OVER (ORDER BY avg_pred, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) + 1e-12 AS frontier FROM s")
def pareto_frontier(spark, sf_dir):
    return sweep.pareto(_swept(spark, sf_dir), "avg_pred", "recall").select("tau", "avg_pred", "recall", "frontier")


@query(_SWEEP + """, m AS (SELECT *, max(recall) OVER () AS top FROM s) SELECT 'conservative' AS point, tau, recall, avg_pred FROM (SELECT * FROM m WHERE recall >= 0.60 * top ORDER BY avg_pred, recall DESC, tau DESC LIMIT 1)
UNION ALL SELECT 'balanced', tau, recall, avg_pred FROM (SELECT * FROM m ORDER BY round(recall / ln(1 + avg_pred + 1e-6) - 0.005 * over_budget, 12) DESC, recall DESC, tau DESC LIMIT 1)
UNION ALL SELECT 'discovery', tau, recall, avg_pred FROM (SELECT * FROM m ORDER BY (avg_pred <= 15) DESC, recall DESC, tau DESC LIMIT 1)""")
def operating_points(spark, sf_dir):
    """As its SQL has it: the share over budget where the formula has p95; operating_points_p95 is the whole formula."""
    return sweep.operating_points(_swept(spark, sf_dir), tail="over_budget")


def _swept_on_grid(spark, sf_dir) -> DataFrame:
    """Sweep over the 400 quantiles of scores in [0, 1] with the reference's anchors."""
    r = residues(spark, sf_dir).withColumn("score", F.col("score") / 110000.0)
    taus = [t["tau"] for t in sweep.threshold_grid(r, "score", 400, [0.35, 0.50, 0.65, 0.26, 0.0612]).collect()]
    return sweep.threshold_sweep(r, taus)


_GRID = f"""WITH {RESIDUES}, r AS (SELECT chain, label, weight AS w, score / 110000.0 AS s FROM res), t AS (SELECT DISTINCT round(tau, 9) AS tau FROM (SELECT unnest(list_concat(quantile_cont(least(greatest(s, 0), 1), {[k / 399 for k in range(400)]}), [0, 1, 0.35, 0.50, 0.65, 0.26, 0.0612])) AS tau FROM r)),
l AS (SELECT chain, w, list(s) AS ss, list(label) AS ys FROM r GROUP BY chain, w), per AS (SELECT chain, w, tau, len(list_filter(list_zip(ss, ys), lambda z: z[1] >= tau AND z[2] = 1)) AS tp, len(list_filter(list_zip(ss, ys), lambda z: z[1] >= tau AND z[2] = 0)) AS fp, list_sum(ys) AS npos FROM l, t),
k AS (SELECT tau, kind, w, CASE kind WHEN 'tp' THEN tp WHEN 'fp' THEN fp ELSE tp + fp END AS c FROM per, (SELECT unnest(['fp', 'pred']) AS kind)), g AS (SELECT tau, kind, c, sum(w) AS w FROM k GROUP BY ALL), o AS (SELECT *, sum(w) OVER (PARTITION BY tau, kind ORDER BY c) AS cw, sum(w) OVER (PARTITION BY tau, kind) AS tw FROM g),
q AS (SELECT tau, kind, min(c) FILTER (cw >= 0.95 * tw - 1e-12)::DOUBLE AS p95 FROM o GROUP BY ALL),
a AS (SELECT tau, kind, sum(w * c) / sum(w) AS avg, sum(CASE WHEN c > 3 THEN w ELSE 0 END) / sum(w) AS over, sum(CASE WHEN c >= 1 THEN w ELSE 0 END) / sum(w) AS any, avg(c) AS avg_raw, quantile_cont(c, 0.95) AS p95_raw, avg((c > 3)::INT) AS over_raw, avg((c >= 1)::INT) AS any_raw FROM k GROUP BY ALL),
b AS (SELECT tau, sum(w * tp)::DOUBLE AS tp, sum(w * fp)::DOUBLE AS fp, sum(w * (npos - tp))::DOUBLE AS fn FROM per GROUP BY tau),
s AS (SELECT b.tau, b.tp, b.fp, b.fn, coalesce(b.tp / nullif(b.tp + b.fp, 0), 0) AS precision, coalesce(b.tp / nullif(b.tp + b.fn, 0), 0) AS recall, n.avg AS avg_pred, nq.p95 AS p95_pred, n.over AS over_budget, f.avg AS avg_fp, fq.p95 AS p95_fp, f.any AS any_fp,
n.avg_raw AS avg_pred_raw, n.p95_raw AS p95_pred_raw, n.over_raw AS over_budget_raw, f.avg_raw AS avg_fp_raw, f.p95_raw AS p95_fp_raw, f.any_raw AS any_fp_raw
FROM b JOIN a n ON n.tau = b.tau AND n.kind = 'pred' JOIN q nq ON nq.tau = b.tau AND nq.kind = 'pred' JOIN a f ON f.tau = b.tau AND f.kind = 'fp' JOIN q fq ON fq.tau = b.tau AND fq.kind = 'fp')"""
_LOADS = [f"{x}{raw}" for raw in ("", "_raw") for x in ("avg_pred", "p95_pred", "over_budget", "avg_fp", "p95_fp", "any_fp")]


@query(_GRID + f" SELECT round(tau, 9) AS tau, tp, fp, fn, {', '.join(f'round({c}, 6) AS {c}' for c in ['precision', 'recall', *_LOADS])} FROM s")
def threshold_sweep_p95(spark, sf_dir):
    """Candidates and false positives by threshold: mean, p95 and shares, weighted and raw, on the quantile grid."""
    return rounded(_swept_on_grid(spark, sf_dir), "tau").withColumn("tau", F.round("tau", 9))


@query(_GRID + """, m AS (SELECT *, max(recall) OVER () AS top FROM s), c AS (SELECT 'conservative' AS point, tau, recall, avg_pred FROM (SELECT * FROM m WHERE recall >= 0.60 * top ORDER BY round(avg_pred, 9), recall DESC, tau DESC LIMIT 1)
UNION ALL SELECT 'balanced', tau, recall, avg_pred FROM (SELECT * FROM m ORDER BY round(recall / ln(1 + avg_pred + 1e-6) - 0.005 * p95_pred, 9) DESC, recall DESC, tau DESC LIMIT 1)
UNION ALL SELECT 'discovery', tau, recall, avg_pred FROM (SELECT * FROM m ORDER BY (avg_pred <= 15 AND p95_pred <= 30) DESC, recall DESC, tau DESC LIMIT 1)) SELECT point, round(tau, 9) AS tau, round(recall, 6) AS recall, round(avg_pred, 6) AS avg_pred FROM c""")
def operating_points_p95(spark, sf_dir):
    return rounded(sweep.operating_points(_swept_on_grid(spark, sf_dir)), "tau").withColumn("tau", F.round("tau", 9))


@query(f"""WITH {RESIDUES}, c AS (SELECT chain, sum(CASE WHEN score >= 40000 THEN 1 - label ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN score < 40000 THEN label ELSE 0 END)::BIGINT AS fn FROM res GROUP BY chain)
SELECT chain, fp, fn, (fp + 2 * fn)::DOUBLE AS error FROM c ORDER BY error DESC, fn DESC, chain LIMIT 20""")
def worst_cases(spark, sf_dir):
    c = evaluate.cases(evaluate.chain_confusion(residues(spark, sf_dir), ["chain"], 40000.0), "chain", "worst", 20)
    return c.select("chain", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), "error")


@query(f"WITH {RESIDUES} SELECT aa, pos, round(avg(score) + 1e-9, 6) AS score, count(DISTINCT fold) AS n_folds, array_to_string(list_sort(list(DISTINCT fold::VARCHAR)), ',') AS folds FROM res GROUP BY aa, pos")
def merge_folds_dedupe_mean(spark, sf_dir):
    m = merge.merge_folds(residues(spark, sf_dir), ["aa", "pos"], "fold", "score")
    return m.withColumn("score", F.round(F.col("score") + 1e-9, 6))  # means of prices can end in a 5 exactly


@query(f"WITH {RESIDUES} SELECT aa, pos, median(score) AS score, count(DISTINCT fold) AS n_folds, array_to_string(list_sort(list(DISTINCT fold::VARCHAR)), ',') AS folds FROM res GROUP BY aa, pos")
def merge_folds_dedupe_median(spark, sf_dir):
    return merge.merge_folds(residues(spark, sf_dir), ["aa", "pos"], "fold", "score", "median")


@query(f"""WITH {RUNS} SELECT config, seed, fold AS label, round(avg(value), 6) AS score FROM runs GROUP BY config, seed, fold HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM runs)""")
def ensemble_mean(spark, sf_dir):
    r = runs(spark, sf_dir)
    n = r.agg(F.count_distinct("model").alias("_n"))
    rows = r.select("config", "seed", "fold", F.col("fold").alias("label"), "model", "value")
    g = merge.ensemble_mean(rows.crossJoin(F.broadcast(n)), ["config", "seed", "fold", "_n"], "model", "value", "label", F.col("_n"))
    return rounded(g.select("config", "seed", "label", F.col("value").alias("score")))


@query(f"WITH {RUNS}, v AS (SELECT model, seed, avg(value) AS value FROM runs GROUP BY ALL) SELECT model, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM v GROUP BY model")
def seed_summary(spark, sf_dir):
    return rounded(merge.seed_summary(runs(spark, sf_dir).groupBy("model", "seed").agg(F.avg("value").alias("value")), ["model"], "value"))


@query(f"""WITH {RUNS}, v AS (SELECT model, fold, seed, avg(value) AS value FROM runs GROUP BY ALL), s AS (SELECT model, fold, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM v GROUP BY ALL)
SELECT a.fold, round(a.mean, 6) AS mean, round(b.mean, 6) AS base, round(a.std, 6) AS std, round((a.mean - b.mean) / greatest(a.std, 1e-12), 6) AS snr FROM s a JOIN s b ON a.fold = b.fold WHERE a.model = 'purchase' AND b.model = 'view'""")
def snr_vs_baseline(spark, sf_dir):
    v = runs(spark, sf_dir).groupBy("model", "fold", "seed").agg(F.avg("value").alias("value"))
    s = lambda m: merge.seed_summary(v.where(F.col("model") == m), ["fold"], "value")
    return rounded(merge.snr(s("purchase"), s("view"), ["fold"]))


@query(f"WITH {RUNS}, g AS (SELECT model, config, seed, count(DISTINCT fold) AS n_folds, count(*) AS n_runs, avg(value) AS value FROM runs GROUP BY ALL) SELECT model, config, seed, n_folds, n_runs, round(value, 6) AS value, CASE WHEN n_folds < 5 THEN 'missing_folds' WHEN n_runs > n_folds THEN 'duplicate_runs' ELSE 'ok' END AS status FROM g")
def run_completeness(spark, sf_dir):
    return rounded(merge.leaderboard(runs(spark, sf_dir), ["model", "config"], "seed", "fold", "value", 5)[0])


@query(f"""WITH {RUNS}, r AS (SELECT DISTINCT ON (config, seed, fold) * FROM runs ORDER BY config, seed, fold, run), g AS (SELECT config, seed, count(DISTINCT fold) AS n_folds, count(*) AS n_runs, avg(value) AS value FROM r GROUP BY ALL), o AS (SELECT *, CASE WHEN n_folds >= 5 AND n_runs = n_folds THEN value END AS ok FROM g)
SELECT config, count(ok) AS n_ok, round(avg(ok), 6) AS mean, round(stddev_samp(ok), 6) AS std FROM o GROUP BY config""")
def config_leaderboard(spark, sf_dir):
    """Mean and deviation of each configuration over its complete seeds; of several runs of a fold the first counts."""
    first = keep_first(runs(spark, sf_dir), ["config", "seed", "fold"], [F.col("run")])
    return rounded(merge.leaderboard(first, ["config"], "seed", "fold", "value", 5)[1])


@query(f"""WITH {RUNS}, g AS (SELECT fold, seed, avg(CASE WHEN model = 'purchase' THEN value END) AS a, avg(CASE WHEN model = 'view' THEN value END) AS b FROM runs GROUP BY ALL)
SELECT fold, seed, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS diff FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def ab_pairs(spark, sf_dir):
    return rounded(merge.pair_models(runs(spark, sf_dir), ["fold", "seed"], "model", "purchase", "view", "value"))


@query(f"""WITH {RUNS} SELECT model, round(avg(value) FILTER (fold = 0), 6) AS "0", round(avg(value) FILTER (fold = 1), 6) AS "1", round(avg(value) FILTER (fold = 2), 6) AS "2", round(avg(value) FILTER (fold = 3), 6) AS "3", round(avg(value) FILTER (fold = 4), 6) AS "4" FROM runs GROUP BY model""")
def model_by_fold_matrix(spark, sf_dir):
    return rounded(evaluate.pivot_mean(runs(spark, sf_dir), "model", "fold", [0, 1, 2, 3, 4], "value"))


@query(f"""WITH {RESIDUES}, c AS (SELECT chain, split, weight, count(*) AS length, sum(label) AS npos FROM res GROUP BY ALL)
SELECT split, count(*) AS n, round(sum(weight), 6) AS weight, round(pow(sum(weight), 2) / sum(weight * weight), 6) AS n_eff, round(sum(CASE WHEN npos > 0 THEN weight ELSE 0 END) / sum(weight), 6) AS fraction FROM c GROUP BY split""")
def group_eval_table(spark, sf_dir):
    from ..operators.audit import effective_size

    c = residues(spark, sf_dir).groupBy("chain", "split", "weight").agg(F.sum("label").alias("npos"))
    return rounded(effective_size(c, ["split"], "weight", F.col("npos") > 0))


@query(f"""WITH {RESIDUES}, r AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY quantity DESC) AS d FROM res) SELECT fold, d AS rank, count(*) AS n FROM r GROUP BY ALL""")
def interest_dense_rank(spark, sf_dir):
    return ranking.dense_ranks(residues(spark, sf_dir), ["fold"], "quantity").select("fold", "rank", "n")


def entry(spark, sf_dir) -> DataFrame:
    """AUCPR and top-k precision by fold."""
    r = residues(spark, sf_dir)
    auc = curves.pr_summary(r, ["fold"], weight=weight_())
    top = ranking.topk_metrics(ranking.at_k(r, ["chain"], [1, 5], ["fold", "weight"]), ["fold"], weight_())
    wide = top.groupBy("fold").agg(F.max(F.when(F.col("k") == 1, F.col("max_precision"))).alias("mp_at_1"), F.max(F.when(F.col("k") == 5, F.col("max_precision"))).alias("mp_at_5"))
    return rounded(auc.join(wide, "fold").select("fold", "aucpr", "mp_at_1", "mp_at_5"))
