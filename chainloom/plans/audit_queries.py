"""Audit, assignment and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, components, folds, merge
from .bindings import CHAINS, RESIDUES, chains, residues, table
from .metric_queries import rounded
from .registry import Registry

query = Registry()
_ROLL = f"{RESIDUES}, roll AS (SELECT chain, fold, split, weight, count(*) AS length, sum(label)::BIGINT AS npos FROM res GROUP BY ALL)"


def _roll(spark, sf_dir):
    return residues(spark, sf_dir).groupBy("chain", "fold", "split", "weight").agg(F.count("*").alias("length"), F.sum("label").alias("npos"))


@query(f"WITH {RESIDUES} SELECT chain, count(*) AS length, sum(label)::BIGINT AS n_positive, array_to_string(coalesce(list_sort(list(DISTINCT aa) FILTER (label = 1)), []), '') AS residues FROM res GROUP BY chain")
def chain_rollup(spark, sf_dir):
    return audit.chain_rollup(residues(spark, sf_dir)).withColumn("residues", F.array_join("residues", ""))


@query(f"""WITH {RESIDUES}, s AS (SELECT chain, coalesce(list(DISTINCT aa) FILTER (label = 1), []) AS r FROM res GROUP BY chain)
SELECT CASE WHEN list_has_any(r, ['I','L','M','V','W','F']) THEN 0 WHEN list_has_any(r, ['A','G','P']) THEN 1 WHEN list_has_any(r, ['Q','N']) THEN 2 WHEN list_has_any(r, ['K','R']) THEN 3 WHEN list_has_any(r, ['S']) THEN 4 WHEN list_has_any(r, ['T']) THEN 5 WHEN list_has_any(r, ['D','E']) THEN 6 ELSE 7 END AS chemotype, count(*) AS n FROM s GROUP BY 1""")
def chemotype_distribution(spark, sf_dir):
    return audit.chain_rollup(residues(spark, sf_dir)).groupBy(L.chemotype(F.col("residues")).alias("chemotype")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ROLL} SELECT coalesce(split, 'all') AS split, count(*) AS chains, sum(length)::BIGINT AS residues, sum(npos)::BIGINT AS positives, round(avg(length), 6) AS mean_length, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.75) AS p75,
sum(weight) AS weight, round(sum(npos) / sum(length), 6) AS fraction FROM roll GROUP BY GROUPING SETS ((split), ())""")
def overview_grouping_sets(spark, sf_dir):
    return rounded(audit.overview(_roll(spark, sf_dir), "split", "length", "npos", "weight"))


@query("SELECT p_type, count(*) AS n, sum(p_retailprice) AS weight, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS pct, round(100.0 * sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS weight_pct FROM part GROUP BY p_type".replace("sum(p_retailprice) AS weight", "round(sum(p_retailprice), 6) AS weight"))
def class_distribution_pct(spark, sf_dir):
    return rounded(audit.distribution(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice"))


_FIVE = [f"split{k}" for k in range(5)]


@query(f"""WITH {CHAINS}, c AS (SELECT segment, {", ".join(f"count(*) FILTER (split = '{s}')::DOUBLE AS {s}" for s in _FIVE)}, count(*)::DOUBLE AS total FROM chains GROUP BY segment) SELECT segment, {", ".join(f"round({s} / total, 6) AS {s}" for s in _FIVE)}, total FROM c""")
def class_by_split_pivot(spark, sf_dir):
    return rounded(audit.pivot_share(chains(spark, sf_dir), "segment", "split", _FIVE, F.count(F.lit(1))))


@query("SELECT p_size, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 61))::INT AS p_size) LEFT JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY 1) USING (p_size)")
def zero_filled_counts(spark, sf_dir):
    return audit.zero_filled(table(spark, sf_dir, "part"), "p_size", list(range(61)))


@query(f"WITH {_ROLL} SELECT least(length, 6)::BIGINT AS bin, count(*) AS n FROM roll WHERE length <> 0 GROUP BY 1")
def capped_histogram(spark, sf_dir):
    return audit.capped_histogram(_roll(spark, sf_dir), "length", 6)


@query("""SELECT l_returnflag, CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5)::BIGINT + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def fixed_bin_histogram(spark, sf_dir):
    return audit.fixed_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 10)


@query("SELECT c_mktsegment, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS high, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def box_statistics(spark, sf_dir):
    return rounded(audit.box_statistics(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal"))


@query("""WITH g AS (SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority)))
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM g""")
def label_frequency_rollup(spark, sf_dir):
    return rounded(audit.frequency_rollup(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query("WITH g AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag), 6) AS cdf FROM g")
def ecdf(spark, sf_dir):
    return rounded(audit.ecdf(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"))


@query(f"WITH {RESIDUES} SELECT aa, count(*) AS n, sum(label)::BIGINT AS positives, round(count(*) / (SELECT count(*) FROM res), 6) AS share, round(sum(label) / (SELECT sum(label) FROM res), 6) AS positive_share FROM res GROUP BY aa")
def residue_distribution(spark, sf_dir):
    return rounded(audit.letter_distribution(residues(spark, sf_dir), "aa", "label"))


@query(f"""WITH {CHAINS}, d AS (SELECT cluster_1, substr(ec, 1, 1) AS d, count(*) AS n FROM chains GROUP BY ALL), m AS (SELECT cluster_1, d AS mode FROM (SELECT *, row_number() OVER (PARTITION BY cluster_1 ORDER BY n DESC, d) AS r FROM d) WHERE r = 1)
SELECT chain, cluster_1, ec, mode, CASE WHEN substr(ec, 1, 1) = mode THEN ec ELSE 'not found' END AS repaired FROM chains JOIN m USING (cluster_1)""")
def majority_override(spark, sf_dir):
    rows = chains(spark, sf_dir).select("chain", "cluster_1", "ec")
    return audit.majority_override(rows, "cluster_1", "ec", L.ec_top(F.col("ec"), "b")).select("chain", "cluster_1", "ec", "mode", "repaired")


@query(f"""WITH {CHAINS}, p AS (SELECT DISTINCT 'cluster_1' AS "column", cluster_1::VARCHAR AS value, split AS s FROM chains UNION SELECT DISTINCT 'parent', parent::VARCHAR, split FROM chains)
SELECT "column", value, count(*) AS n_splits, array_to_string(list_sort(list(s)), ',') AS splits FROM p GROUP BY ALL HAVING count(*) > 1""")
def leakage_check(spark, sf_dir):
    return audit.leakage(chains(spark, sf_dir), ["cluster_1", "parent"], "split")


@query(f"WITH {CHAINS} SELECT parent, count(*) AS n, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT split) AS n_splits FROM chains GROUP BY parent HAVING count(DISTINCT split) > 1")
def overlap_report(spark, sf_dir):
    return audit.overlap_report(chains(spark, sf_dir), "parent", "split")


@query(f"""WITH {CHAINS}, m AS (SELECT cluster_2, least(count(DISTINCT cluster_1), 100)::DOUBLE AS w_top, count(DISTINCT cluster_1) AS m FROM chains GROUP BY 1), p AS (SELECT cluster_1, count(DISTINCT parent) AS p FROM chains GROUP BY 1),
s AS (SELECT cluster_1, parent, count(DISTINCT chain) AS s FROM chains GROUP BY ALL)
SELECT chain, w_top, round(w_top / m, 6) AS w_mid, round(w_top / m / p, 9) AS w_seq, round(w_top / m / p / s, 9) AS w_struct FROM chains JOIN m USING (cluster_2) JOIN p USING (cluster_1) JOIN s USING (cluster_1, parent)""")
def hierarchical_weights(spark, sf_dir):
    w = audit.hierarchical_weights(chains(spark, sf_dir).select("chain", "cluster_2", "cluster_1", "parent"), "cluster_2", "cluster_1", "parent", "chain")
    return w.select("chain", "w_top", F.round("w_mid", 6).alias("w_mid"), F.round("w_seq", 9).alias("w_seq"), F.round("w_struct", 9).alias("w_struct"))


@query(f"""WITH {CHAINS} SELECT parent, round(sum(price), 4) AS total, round(sum(CASE WHEN status = 'F' THEN price ELSE 0 END), 4) AS class_F, round(sum(CASE WHEN status = 'O' THEN price ELSE 0 END), 4) AS class_O, round(sum(CASE WHEN status = 'P' THEN price ELSE 0 END), 4) AS class_P FROM chains GROUP BY parent""")
def component_class_matrix(spark, sf_dir):
    m = audit.component_class_matrix(chains(spark, sf_dir), "parent", "status", "price", ["F", "O", "P"])
    return m.select("parent", *[F.round(c, 4).alias(c) for c in ("total", "class_F", "class_O", "class_P")])


_SHARED = """e AS (SELECT doc_id AS node, 't:' || md5(text) AS key FROM documents UNION ALL SELECT doc_id, 'l:' || md5(split_part(text, chr(10), 1)) FROM documents)"""


@query(f"""WITH RECURSIVE {_SHARED}, h AS (SELECT key, min(node) AS hub FROM e GROUP BY key), x AS (SELECT DISTINCT node AS u, hub AS v FROM e JOIN h USING (key)), b AS (SELECT u, v FROM x UNION SELECT v, u FROM x),
r(node, root) AS (SELECT DISTINCT node, node FROM e UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v) SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    keys = F.explode(F.array(F.concat(F.lit("t:"), F.md5(F.col("text").cast("binary"))), F.concat(F.lit("l:"), F.md5(F.substring_index("text", "\n", 1).cast("binary"))))).alias("key")
    return components.shared_key_components(d.select(F.col("doc_id").alias("node"), keys), "node", "key")


@query(f"""WITH RECURSIVE {_SHARED}, h AS (SELECT key, min(node) AS hub FROM e GROUP BY key), x AS (SELECT DISTINCT node AS u, hub AS v FROM e JOIN h USING (key)), b AS (SELECT u, v FROM x UNION SELECT v, u FROM x),
r(node, root) AS (SELECT DISTINCT node, node FROM e UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT component, count(DISTINCT lang) AS n_groups, array_to_string(list_sort(list(DISTINCT lang)), ',') AS groups FROM c JOIN documents ON doc_id = node GROUP BY component""")
def component_purity(spark, sf_dir):
    c = connected_components(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "lang")
    return audit.purity(c.join(d, "node"), "component", "lang")


@query(f"""WITH {CHAINS}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster_2, cluster_1 ORDER BY md5(chain::VARCHAR || ':1'), chain) AS turn FROM chains), p AS (SELECT *, row_number() OVER (PARTITION BY cluster_2 ORDER BY turn, cluster_1, chain) AS place FROM t)
SELECT chain, cluster_2, cluster_1 FROM p WHERE place <= 200""")
def round_robin_cap(spark, sf_dir):
    return folds.round_robin_cap(chains(spark, sf_dir).select("chain", "cluster_2", "cluster_1"), "cluster_2", "cluster_1", "chain", 200)


_MATRIX = f"WITH {CHAINS}, m AS (SELECT parent, status, count(*) AS w FROM chains GROUP BY ALL), k AS (SELECT parent, sum(w)::BIGINT AS total, arg_max(status, (w, status)) AS cls FROM m GROUP BY parent)"


@query(_MATRIX + """, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY total DESC, parent) - 1 AS i FROM k) SELECT parent, CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END::INT AS fold, cls, total FROM r""")
def serpentine_folds(spark, sf_dir):
    per = chains(spark, sf_dir).groupBy("parent", "status").agg(F.count("*").alias("w"))
    m = per.groupBy("parent").agg(F.sum("w").alias("total"), F.max_by("status", F.struct("w", "status")).alias("cls"))
    return folds.serpentine_folds(m, "parent", "total", "cls")


@query(f"""WITH {CHAINS}, t AS (SELECT parent, sum(price) AS w, md5(parent::VARCHAR || ':1') AS h FROM chains GROUP BY parent), s AS (SELECT parent, coalesce(sum(w) OVER (ORDER BY h, parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS share FROM t)
SELECT parent, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'val' ELSE 'test' END AS "set" FROM s""")
def ratio_split(spark, sf_dir):
    return folds.ratio_split(chains(spark, sf_dir), "parent", "price", {"train": 0.6, "val": 0.2, "test": 0.2})


@query("SELECT o_orderkey AS item, (o_orderkey % 5)::INT AS split, r::INT AS rotation, CASE WHEN o_orderkey % 5 = (r + 4) % 5 THEN 'test' WHEN o_orderkey % 5 = (r + 3) % 5 THEN 'val' ELSE 'train' END AS role FROM orders, range(5) t(r)")
def rotating_cv_schedule(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 5).cast("int").alias("split"))
    return merge.rotating_schedule(items, "split").select("item", "split", "rotation", "role")


_OVERLAP = "WITH a AS (SELECT DISTINCT o_custkey AS k, (o_orderkey % 5)::INT AS fold_a FROM orders), b AS (SELECT DISTINCT o_custkey AS k, (o_custkey % 5)::INT AS fold_b FROM orders), o AS (SELECT fold_a, fold_b, count(*) AS n FROM a JOIN b USING (k) GROUP BY ALL)"


def _overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.select(F.col("o_custkey").alias("k"), (F.col(c) % 5).cast("int").alias("fold")) for c in ("o_orderkey", "o_custkey"))
    return merge.fold_overlap(a, b, "k", "fold")


@query(_OVERLAP + " SELECT * FROM o")
def fold_overlap_matrix(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(_OVERLAP + """, p AS (SELECT a, b, c, d, e FROM range(5) t1(a), range(5) t2(b), range(5) t3(c), range(5) t4(d), range(5) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
u AS (SELECT concat_ws(',', a, b, c, d, e) AS perm, unnest([0, 1, 2, 3, 4]) AS fold_a, unnest([a, b, c, d, e]) AS fold_b FROM p), s AS (SELECT perm, coalesce(sum(n), 0)::BIGINT AS aligned FROM u LEFT JOIN o USING (fold_a, fold_b) GROUP BY perm)
SELECT perm, ((SELECT sum(n) FROM o) - aligned)::BIGINT AS leak, aligned FROM s ORDER BY leak, perm LIMIT 1""")
def best_schedule(spark, sf_dir):
    return merge.best_schedule(_overlap(spark, sf_dir))


@query(f"""WITH {RESIDUES}, d AS (SELECT chain, sum(CASE WHEN prior = 0 THEN 1 ELSE 0 END)::BIGINT AS before, sum(CASE WHEN prior = 0 OR label = 1 THEN 1 ELSE 0 END)::BIGINT AS after, array_to_string(coalesce(list_sort(list(pos) FILTER (prior <> 0 AND label = 1)), []), ',') AS new_positions FROM res GROUP BY chain)
SELECT * FROM d WHERE new_positions <> ''""")
def label_diff(spark, sf_dir):
    r = residues(spark, sf_dir)
    b = r.select("chain", "pos", (F.col("prior") == 0).cast("int").alias("y"))
    a = r.select("chain", "pos", ((F.col("prior") == 0) | (F.col("label") == 1)).cast("int").alias("y"))
    return merge.label_diff(b, a, "chain", "pos", "y")


@query(f"WITH {RESIDUES}, m AS (SELECT chain FROM res GROUP BY chain HAVING count(DISTINCT aa) > 1) SELECT chain, pos, aa FROM res SEMI JOIN m USING (chain)")
def varies_within_group(spark, sf_dir):
    return audit.varies_within(residues(spark, sf_dir), "chain", "aa").select("chain", "pos", "aa")


@query(f"WITH {_ROLL} SELECT chain, split FROM roll WHERE npos > 0")
def drop_without_positives(spark, sf_dir):
    return audit.with_positives(_roll(spark, sf_dir), "npos").select("chain", "split")


@query("""SELECT coalesce(c_custkey, o_custkey) AS key, CASE WHEN o_custkey IS NULL THEN 'left' WHEN c_custkey IS NULL THEN 'right' ELSE 'both' END AS side FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""")
def set_reconciliation(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return audit.reconcile(a, b, "key")


@query("""SELECT l_orderkey, l_linenumber, reason FROM (SELECT *, unnest(list_filter([CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END, CASE WHEN NOT l_quantity >= 2 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)""")
def assertion_rejects(spark, sf_dir):
    return audit.rejects(table(spark, sf_dir, "lineitem"), {"discount": F.col("l_discount") <= 0.08, "quantity": F.col("l_quantity") >= 2}).select("l_orderkey", "l_linenumber", "reason")


@query("""SELECT p_partkey, CASE WHEN count(DISTINCT p_type) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || substr(sha1(p_type), 1, 8) ELSE p_name END AS name FROM part""")
def sequence_collisions(spark, sf_dir):
    return audit.sequence_collisions(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type").select("p_partkey", "name")


@query("""WITH h AS (SELECT lower(c_name) AS k, list(DISTINCT c_mktsegment) AS have FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN list_contains(have, 'BUILDING') THEN 'BUILDING' WHEN list_contains(have, 'MACHINERY') THEN 'MACHINERY' ELSE 'none' END AS route FROM customer LEFT JOIN h ON lower(c_name) = k""")
def route_by_availability(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return audit.routed(c, c.where("c_acctbal > 0").select("c_name", "c_mktsegment"), "c_name", "c_mktsegment", ["BUILDING", "MACHINERY"], "none").select("c_custkey", "route")


_BAD = f"WITH {RESIDUES}, b AS (SELECT chain, pos, weight, CASE WHEN quantity >= 48 THEN 'nan'::DOUBLE ELSE quantity END AS s FROM res)"


def _bad(spark, sf_dir):
    return residues(spark, sf_dir).select("chain", "pos", "weight", F.when(F.col("quantity") >= 48, float("nan")).otherwise(F.col("quantity")).alias("s"))


@query(_BAD + ", m AS (SELECT chain, coalesce(median(s) FILTER (NOT isnan(s)), 0) AS m, bool_or(isnan(s)) AS bad FROM b GROUP BY chain) SELECT chain, pos, CASE WHEN bad THEN 0 ELSE weight END::DOUBLE AS weight, CASE WHEN isnan(s) THEN m ELSE s END AS s FROM b JOIN m USING (chain)")
def nonfinite_chain_median(spark, sf_dir):
    return audit.nonfinite(_bad(spark, sf_dir), "b", "chain", "s", "weight").select("chain", "pos", "weight", "s")


@query(_BAD + ", m AS (SELECT coalesce(median(s) FILTER (NOT isnan(s)), 0) AS m FROM b) SELECT chain, pos, CASE WHEN isnan(s) THEN 0 ELSE weight END::DOUBLE AS weight, CASE WHEN isnan(s) THEN m ELSE s END AS s FROM b, m")
def nonfinite_global_median(spark, sf_dir):
    return audit.nonfinite(_bad(spark, sf_dir), "a", "chain", "s", "weight").select("chain", "pos", "weight", "s")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) WHERE r = 1""")
def priority_dedup(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return audit.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], [rank, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
