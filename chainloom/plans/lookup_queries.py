"""Lookup joins, evaluation tables, reports and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, containment, evaluate, lookup, screen, transfer
from ..sources import readers, writers
from . import screen_queries
from .audit_queries import _MATRIX, _ROLL, _SHARED, _roll, connected_components, serpentine_folds
from .bindings import CHAINS, RESIDUES, RUNS, SCREENS, chains, residues, runs, screens, table
from .materialize import written
from .metric_queries import AREA, points_sql, rounded
from .registry import Registry

query = Registry()


# ---------------------------------------------------------------- lookups


@query(f"WITH {_ROLL} SELECT chain, length, npos, o_orderstatus AS status FROM roll JOIN orders ON chain = o_orderkey")
def one_to_one_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_orderstatus").alias("status"))
    return lookup.one_to_one(_roll(spark, sf_dir).select("chain", "length", "npos"), o, ["chain"])


@query("SELECT o_orderkey, o_custkey AS c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return lookup.many_to_one(o, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query("""WITH a AS (SELECT c_custkey AS k, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1)
SELECT CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS keys, coalesce(sum(a), 0)::BIGINT AS left_rows, coalesce(sum(b), 0)::BIGINT AS right_rows FROM a FULL JOIN b USING (k) GROUP BY 1""")
def join_report(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return lookup.join_report(a, b, ["k"])


@query("""SELECT o_orderkey AS member, c_nationkey AS cluster_1, n_regionkey AS cluster_2, CASE WHEN c_nationkey IS NULL THEN 'first' WHEN n_regionkey IS NULL THEN 'second' END AS missing
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def two_hop_lookup(spark, sf_dir):
    """Orders to nations through customers in credit, and on to regions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), F.col("o_custkey").alias("k"))
    first = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("cluster_1"))
    second = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster_1"), F.col("n_regionkey").alias("cluster_2"))
    return lookup.two_hop(o, "k", first, "cluster_1", second, "cluster_2").select("member", "cluster_1", "cluster_2", "missing")


_OWN = "WITH p AS (SELECT DISTINCT source, md5(text) AS structure FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


def _structures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.array(F.md5(F.col("text").cast("binary"))).alias("structures"))


@query(_OWN + " SELECT structure, count(*) AS owners FROM p GROUP BY structure")
def ownership_count(spark, sf_dir):
    """How many sources have each text."""
    return lookup.ownership_count(_structures(spark, sf_dir), "source", "structures")


@query(_OWN + " SELECT min(source) AS source, structure FROM p GROUP BY structure HAVING count(*) = 1")
def exclusive_structures(spark, sf_dir):
    return lookup.exclusive_structures(_structures(spark, sf_dir), "source", "structures")


_CREDIT = "t AS (SELECT c_custkey AS k, c_mktsegment AS value FROM customer WHERE c_acctbal > 0)"


@query(f"""WITH {_CREDIT}, a AS (SELECT c_custkey AS k, min(CASE WHEN c_acctbal > 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey) AS other FROM customer)
SELECT o_orderkey AS item, coalesce(t.value, u.value) AS value, CASE WHEN t.value IS NOT NULL THEN 'key' WHEN u.value IS NOT NULL THEN 'alias' END AS found
FROM orders LEFT JOIN t ON o_custkey = t.k LEFT JOIN a ON o_custkey = a.k LEFT JOIN t u ON a.other = u.k""")
def alias_lookup(spark, sf_dir):
    """Segment of a customer in credit, else that of the first such customer of the nation."""
    c = table(spark, sf_dir, "customer")
    t = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"))
    first = c.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min("c_custkey").alias("other"))
    alias = c.join(first, "c_nationkey").select(F.col("c_custkey").alias("k"), "other")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("k"))
    return lookup.with_alias(items, "k", t, "value", alias, "other").select("item", "value", "found")


@query(f"""WITH {_ROLL}, c AS (SELECT l_orderkey AS chain, count(DISTINCT l_linenumber) AS n, sum(l_quantity) AS a FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey AS chain, o_totalprice AS b FROM orders)
SELECT chain, CASE WHEN n = length AND a IS NOT NULL THEN a ELSE b END AS value, CASE WHEN n = length AND a IS NOT NULL THEN 'cache' WHEN b IS NOT NULL THEN 'fallback' END AS origin FROM roll LEFT JOIN c USING (chain) LEFT JOIN f USING (chain)""")
def cached_value(spark, sf_dir):
    """Quantity of an order where its line numbers are as many as its lines, else its price."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg(F.count_distinct("l_linenumber").alias("length"), F.sum("l_quantity").alias("value"))
    prices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_totalprice").alias("value"))
    return lookup.cached_or(_roll(spark, sf_dir).select("chain", "length"), "chain", "length", lines, prices, "value").select("chain", "value", "origin")


@query("SELECT o_orderkey AS id, s.best, s.best IS NOT NULL AS scored FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON o_orderkey = l_orderkey")
def manifest_scores(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("best"))
    return lookup.manifest_scores(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), s, ["id"], ["best"])


@query("""SELECT o_orderkey AS id, coalesce(w.c_acctbal, 1.0) AS weight, coalesce(n.c_name, o_custkey::VARCHAR) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) w ON o_custkey = w.c_custkey
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') n ON o_custkey = n.c_custkey""")
def weight_and_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    w, n = c.where("c_acctbal > 0").select("k", F.col("c_acctbal").alias("weight")), c.where("c_mktsegment <> 'BUILDING'").select("k", F.col("c_name").alias("name"))
    return lookup.weight_of(o, "k", w, "weight", n, "name").select("id", "weight", "name")


@query(f"WITH {RUNS} SELECT config, model, fold FROM (SELECT DISTINCT config FROM runs), (SELECT DISTINCT model FROM runs), (SELECT DISTINCT fold FROM runs) EXCEPT SELECT config, model, fold FROM runs")
def grid_gaps(spark, sf_dir):
    """Models and folds that a configuration has no run for."""
    return lookup.grid_gaps(runs(spark, sf_dir), "config", ["model", "fold"])


_SECOND = "regexp_extract(p_name, '^\\S+ (\\S+)', 1)"


@query(f"WITH k AS (SELECT DISTINCT {_SECOND} AS key FROM part WHERE {_SECOND} <> '') SELECT p_partkey AS id, key, CASE WHEN key = split_part(p_name, ' ', 1) THEN 'both' ELSE 'contained' END AS found FROM part JOIN k ON contains(p_name, key)")
def contained_keys(spark, sf_dir):
    """Second words of part names that stand anywhere in a part's name, and whether a join by the first word finds them as well."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = p.select(F.regexp_extract("p_name", r"^\S+ (\S+)", 1).alias("key"))
    found = containment.containing(p, "p_partkey", "p_name", keys, "key")
    joined = lookup.by_prefix(p.withColumnRenamed("p_partkey", "id"), "p_name", r"^(\S+)", keys.where("key <> ''").distinct(), "key").select("id", "key")
    apart = containment.disagreements(found, joined)
    return apart.select("id", "key", F.col("only").alias("found")).unionByName(found.join(joined, ["id", "key"], "left_semi").select("id", "key", F.lit("both").alias("found")))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON TRY_CAST(regexp_extract(c_name, '#(\\d+)$', 1) AS BIGINT) = o_custkey")
def prefix_key_join(spark, sf_dir):
    """Orders of the customers whose number stands in their name."""
    return lookup.by_prefix(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", r"#(\d+)$", table(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query(_MATRIX + ", r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY total DESC, parent) - 1 AS i FROM k), f AS (SELECT parent, CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END::INT AS fold FROM r) SELECT chain, parent, fold FROM chains LEFT JOIN f USING (parent)")
def propagated_folds(spark, sf_dir):
    """The fold of each chain's component."""
    return lookup.propagated(chains(spark, sf_dir).select("chain", "parent"), "parent", serpentine_folds(spark, sf_dir), "fold").select("chain", "parent", "fold")


@query("SELECT 'customer' AS origin, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier")
def concat_with_provenance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return lookup.with_provenance({"customer": c, "supplier": s})


@query(f"WITH {RUNS}, g AS (SELECT config, seed, count(DISTINCT model) AS m, min(fold) AS lo, max(fold) AS hi FROM runs GROUP BY ALL) SELECT CASE WHEN m <> (SELECT count(DISTINCT model) FROM runs) THEN 'missing_model' WHEN lo <> hi THEN 'labels_differ' ELSE 'kept' END AS reason, count(*) AS n FROM g GROUP BY 1")
def agreement_report(spark, sf_dir):
    """Configurations and seeds that every model has, on one day, and what stands against the others."""
    r = runs(spark, sf_dir)
    n = r.agg(F.count_distinct("model").alias("n"))
    return lookup.agreement_report(r.crossJoin(F.broadcast(n)), ["config", "seed", "n"], "model", "fold", F.col("n"))


@query("WITH s AS (SELECT o_custkey AS k, count(*) AS score FROM orders GROUP BY 1) SELECT c_custkey, coalesce(score, 0)::BIGINT AS score FROM customer LEFT JOIN s ON c_custkey = k WHERE coalesce(score, 0) > 3")
def looked_up_score_filter(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("score"))
    return lookup.score_above(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", s, "score", 3).select("c_custkey", F.col("score").cast("long").alias("score"))


@query("WITH f AS (SELECT p_brand, arg_min(len(p_name), p_partkey) AS n FROM part GROUP BY 1) SELECT p_partkey, p_brand, p_name FROM part JOIN f USING (p_brand) WHERE len(p_name) = n")
def same_length_as_first(spark, sf_dir):
    return lookup.same_length_as_first(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_partkey", "p_name")


@query("""WITH g AS (SELECT DISTINCT p_partkey AS k, p_brand AS b, substr(p_name, i, 4) AS gram FROM (SELECT *, unnest(range(1, greatest(len(p_name) - 3, 0) + 1)) AS i FROM part)), n AS (SELECT k, b, count(*) AS grams FROM g GROUP BY ALL),
h AS (SELECT q.k AS q, t.k AS t, count(*) AS shared FROM g q JOIN g t USING (gram) WHERE q.k % 20 = 0 AND q.k <> t.k GROUP BY ALL HAVING count(*) >= 6),
i AS (SELECT q, t, shared / n.grams AS identity FROM h JOIN n ON n.k = q JOIN n m ON m.k = t WHERE n.b <> m.b AND shared / n.grams >= 0.9), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY identity DESC, t) AS r FROM i)
SELECT n.k AS q, r.t, round(r.identity, 6) AS identity FROM (SELECT DISTINCT k FROM n WHERE k % 20 = 0) n LEFT JOIN r ON r.q = n.k AND r.r = 1""")
def top_hit_selection(spark, sf_dir):
    """The best template of each query part: of another brand, with 9 of 10 grams shared."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s"), F.col("p_brand").alias("b"))
    q = p.where("k % 20 = 0")
    pairs = transfer.kmer_texts(q, p, "s", 4, 6, 500).withColumn("identity", F.col("shared") / F.col("grams")).where("identity >= 0.9")
    best = transfer.best_of_texts(written(pairs, "hits"), q, p, "k", "s", "identity", "b")
    return rounded(q.where(F.length("s") >= 4).select(F.col("k").alias("q")).join(best.select("q", "t", "identity"), "q", "left"))


# ---------------------------------------------------------------- audit tables


@query(f"""WITH {_ROLL}, c AS (SELECT roll.split, nullif(regexp_extract(ec, '^\\s*(\\d+)', 1), '') AS top, length, npos FROM roll JOIN chains USING (chain)) SELECT split, top, count(*) AS chains, sum((npos > 0)::INT)::BIGINT AS with_sites, sum(length)::BIGINT AS residues, round(sum(npos) / sum(length), 6) AS fraction FROM c GROUP BY split, top""".replace("WITH ", f"WITH {CHAINS}, ", 1))
def class_by_split_table(spark, sf_dir):
    c = chains(spark, sf_dir).select("chain", L.ec_top(F.col("ec"), "b").alias("top"))
    return rounded(audit.class_by_split(_roll(spark, sf_dir).join(c, "chain"), "split", "top", "length", "npos"))


@query(f"""WITH RECURSIVE {_SHARED}, h AS (SELECT key, min(node) AS hub FROM e GROUP BY key), x AS (SELECT DISTINCT node AS u, hub AS v FROM e JOIN h USING (key)), b AS (SELECT u, v FROM x UNION SELECT v, u FROM x),
r(node, root) AS (SELECT DISTINCT node, node FROM e UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT component, count(*) AS n, sum(n_chars)::BIGINT AS weight FROM c JOIN documents ON doc_id = node GROUP BY component""")
def component_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "n_chars")
    return audit.component_sizes(connected_components(spark, sf_dir).join(d, "node"), "component", "n_chars")


@query("""WITH n AS (SELECT c_mktsegment, c_custkey, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_mktsegment, count(*) AS accessions, round(avg((n >= 1)::INT), 6) AS with_any, round(avg((n = 1)::INT), 6) AS with_one, round(avg((n >= 2)::INT), 6) AS with_more, max(n)::INT AS most FROM n GROUP BY 1""")
def structure_coverage(spark, sf_dir):
    """How many kinds of order the customers of a segment have."""
    kinds = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("kinds"))
    return rounded(audit.coverage(table(spark, sf_dir, "customer").join(kinds, "c_custkey", "left"), "c_custkey", "kinds", ["c_mktsegment"]))


@query(f"""WITH {CHAINS}, {_ROLL}, s AS (SELECT chains.split, CASE WHEN ends_with(ec, '-') THEN 'AF' ELSE 'PDB' END AS source, length FROM roll JOIN chains USING (chain)) SELECT source, split, count(*) AS chains, sum(length)::BIGINT AS residues FROM s GROUP BY ALL""")
def source_by_split(spark, sf_dir):
    """Chains and positions by split, and by whether the class code is whole."""
    c = chains(spark, sf_dir).select("chain", F.col("split").alias("part"), F.when(F.endswith("ec", F.lit("-")), "AF").otherwise("PDB").alias("source"))
    return audit.source_by_split(_roll(spark, sf_dir).join(c, "chain").drop("split").withColumnRenamed("part", "split"), "source", "split", "length")


@query(f"""WITH {SCREENS}, {CHAINS}, c AS (SELECT parent AS id, min(ec) AS ec FROM chains GROUP BY 1), s AS (SELECT coalesce(nullif(regexp_extract(ec, '^\\s*(\\d+)', 1), ''), 'No EC') AS code, (len(list_filter(predicted, lambda x: NOT list_contains(known, x))) > 0)::INT AS new FROM screens LEFT JOIN c USING (id))
SELECT code, CASE WHEN regexp_matches(code, '^[1-7]$') THEN code::INT WHEN code = 'No EC' THEN 9 ELSE 8 END::INT AS ord, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share, sum(new)::BIGINT AS n_novel, round(sum(new) / (SELECT sum(new) FROM s), 6) AS novel_share FROM s GROUP BY code""")
def code_distribution(spark, sf_dir):
    """Class codes of users that are customers, overall and among those with novel hours, in the order of codes."""
    c = chains(spark, sf_dir).groupBy(F.col("parent").alias("id")).agg(F.min("ec").alias("ec"))
    n = screen.novelty(screens(spark, sf_dir), "predicted", "known").join(c, "id", "left")
    return rounded(audit.code_distribution(n, L.ec_top(F.col("ec"), "b"), F.col("n_novel") > 0))


@query("WITH l AS (" + screen_queries.query.sql["loss_categories"] + ") SELECT base, count(*) AS members, sum(lost_aligned)::BIGINT AS lost FROM l GROUP BY base HAVING bool_or(lost_aligned > 0)")
def loss_events(spark, sf_dir):
    """Bases with a predicted site that is aligned to the same letter in a member, but not predicted there."""
    return screen.loss_events(screen_queries.loss_categories(spark, sf_dir))


@query(f"""WITH {CHAINS}, s AS (SELECT DISTINCT split FROM chains) SELECT split, regexp_extract(split, '(\\d+)', 1)::INT AS ord FROM s""")
def split_order(spark, sf_dir):
    return chains(spark, sf_dir).select("split").distinct().withColumn("ord", audit.split_order(F.col("split")))


@query(f"""WITH {SCREENS}, n AS (SELECT id, nullif(len(list_filter(predicted, lambda x: NOT list_contains(known, x))), 0) AS n_novel, len(known) AS n_known FROM screens), r AS (SELECT *, row_number() OVER (ORDER BY n_novel DESC NULLS LAST, n_known DESC NULLS LAST, id) AS place FROM n)
SELECT id, n_novel::INT AS n_novel, n_known::INT AS n_known, place::INT AS place FROM r WHERE place <= 100""")
def novel_ranking(spark, sf_dir):
    """A report of the 100 users with most novel hours; those without any come last."""
    n = screen.novelty(screens(spark, sf_dir), "predicted", "known").select("id", F.nullif("n_novel", F.lit(0)).alias("n_novel"), "n_known")
    return audit.top_rows(n, [F.desc_nulls_last("n_novel"), F.desc_nulls_last("n_known"), F.asc("id")], 100)


@query(f"WITH {_ROLL}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY length, chain) AS rank FROM roll) SELECT split, chain, length, rank::INT AS rank FROM r WHERE rank <= 10")
def shortest_chains(spark, sf_dir):
    """A report of the ten shortest chains of each split."""
    return audit.top_per_group(_roll(spark, sf_dir).select("split", "chain", "length"), ["split"], [F.asc("length"), F.asc("chain")], 10)


@query(f"""WITH {SCREENS} SELECT id, array_to_string(list_sort(known), ', ') AS known, array_to_string(list_sort(predicted), ', ') AS predicted, array_to_string(list_sort(list_filter(predicted, lambda x: NOT list_contains(known, x))), ', ') AS novel_sites_t50,
len(list_filter(predicted, lambda x: NOT list_contains(known, x)))::INT AS n_novel_t50, len(list_filter(predicted, lambda x: NOT list_contains(known, x))) > 0 AS any_novel_t50 FROM screens""")
def cleaned_screen(spark, sf_dir):
    return writers.cleaned_screen(screens(spark, sf_dir).withColumn("helper", F.lit(1)), "known", {"t50": "predicted"}, ["helper"])


@query("SELECT doc_id, 0.5 * coalesce(try_cast(split_part(text, ' ', 1) AS DOUBLE), 0) AS scaled FROM documents")
def scaled_numbers(spark, sf_dir):
    """The number that a text begins with, halved; 0 where it begins with none, or is null."""
    return table(spark, sf_dir, "documents").select("doc_id", L.scaled(F.substring_index("text", " ", 1), 0.5).alias("scaled"))


@query("""WITH s AS (SELECT c_nationkey AS store, list(c_name ORDER BY c_custkey) AS ids, list(ceil(abs(c_acctbal)) % 4 ORDER BY c_custkey) AS n FROM customer GROUP BY 1), e AS (SELECT store, unnest(ids) AS id, unnest(n)::INT AS n, unnest(range(1, len(ids) + 1)) AS i FROM s)
SELECT id, n::INT AS n, coalesce(sum(n) OVER (PARTITION BY store ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS first FROM e""")
def ragged_store_rows(spark, sf_dir):
    """Rows read back out of offsets and values of a store for each nation; values are their own places."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", (F.ceil(F.abs("c_acctbal")) % 4).cast("int").alias("n"))
    store = readers.ragged_pieces(c, "c_nationkey", "c_custkey", "c_name", "n")
    places = F.when(F.col("size") > 0, F.sequence(F.col("begin"), F.col("begin") + F.col("size") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = readers.ragged_rows(store.withColumn("values", places), begin="begin")
    return rows.select("id", F.size("values").alias("n"), F.coalesce(F.get("values", F.lit(0)), "at").cast("int").alias("first"))


# ---------------------------------------------------------------- evaluation


def _topk_sql(by: str, ks: list[int]) -> str:
    mp = lambda k: f"sum(CASE WHEN npos > 0 THEN weight * least(tp{k}, npos) / least(npos, least({k}, length)) ELSE 0 END) / sum(weight) AS mp_at_{k}"
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, pos) AS rank FROM res), ch AS (SELECT chain, {by}, weight, count(*) AS length, sum(label) AS npos, {", ".join(f"sum(CASE WHEN rank <= {k} THEN label ELSE 0 END) AS tp{k}" for k in ks)} FROM rk GROUP BY chain, {by}, weight),
mp AS (SELECT {by}, count(*) AS n, sum(npos)::BIGINT AS n_positive, sum(npos) / sum(length) AS prevalence, sum(weight) AS weight, pow(sum(weight), 2) / sum(weight * weight) AS n_eff, quantile_cont(npos, 0.5) AS median_npos, {", ".join(mp(k) for k in ks)} FROM ch GROUP BY {by})"""


@query("WITH " + points_sql("score", "split") + ", au AS (" + AREA.format(by="split") + "), " + _topk_sql("split", [1, 5]) + f""", ci AS (SELECT * FROM ({screen_queries.query.sql["bootstrap_ci"]}))
SELECT split, mp.n, n_positive, round(prevalence, 6) AS prevalence, weight, round(n_eff, 6) AS n_eff, median_npos, round(mp_at_1, 6) AS mp_at_1, round(mp_at_5, 6) AS mp_at_5, aucpr, low, high FROM mp JOIN au USING (split) LEFT JOIN ci USING (split)""")
def group_evaluation(spark, sf_dir):
    """The whole table for each split, with intervals of the tied scores."""
    ci = screen_queries.intervals(spark, sf_dir, "split")
    return rounded(evaluate.group_evaluation(residues(spark, sf_dir), "split", "chain", [1, 5], intervals=ci))


@query("WITH " + points_sql("score", "chain", "1.0") + ", ap AS (SELECT chain, coalesce(sum((recall - r0) * precision), 0) AS ap FROM z GROUP BY chain), " + _topk_sql("split", [1, 3, 5]) + """
SELECT chain, split, weight, length, npos::BIGINT AS npos, round(ap, 6) AS ap, """ + ", ".join(f"round(CASE WHEN npos > 0 THEN tp{k} / least(npos, least({k}, length)) ELSE 0 END, 6) AS mp_at_{k}" for k in (1, 3, 5)) + ", o_orderstatus AS status FROM ch JOIN ap USING (chain) LEFT JOIN orders ON o_orderkey = chain")
def chain_metric_table(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_orderstatus").alias("status"))
    return rounded(evaluate.chain_table(residues(spark, sf_dir), "chain", [1, 3, 5], ["split", "weight"], names=names))


_BOTH = f"{RESIDUES.replace('res AS', 'one AS', 1)}, res AS (SELECT * REPLACE (fold::VARCHAR AS fold) FROM one UNION ALL SELECT * REPLACE ('all' AS fold) FROM one)"


@query("WITH " + points_sql("tied", "fold", table=_BOTH) + ", au AS (" + AREA.format(by="fold") + """), ra AS (SELECT *, row_number() OVER (PARTITION BY fold, chain ORDER BY tied DESC, pos) AS rank FROM res), ch AS (SELECT fold, chain, split, weight, sum(label) AS npos, sum(CASE WHEN rank = 1 THEN label ELSE 0 END) AS tp FROM ra GROUP BY ALL),
sp AS (SELECT fold, split, count(*) AS n FROM ch GROUP BY ALL), si AS (SELECT fold, sum(n)::BIGINT AS n, arg_min(split, (-n, split)) AS split FROM sp GROUP BY fold), mp AS (SELECT fold, sum(CASE WHEN npos > 0 THEN weight * tp ELSE 0 END) / sum(weight) AS mp FROM ch GROUP BY fold)
SELECT fold, si.n, si.split, round(aucpr, 3) AS aucpr, round(1 - aucpr, 3) AS loss, round(mp, 3) AS mp FROM si JOIN au USING (fold) JOIN mp USING (fold)""")
def cross_fold_table(spark, sf_dir):
    return evaluate.fold_table(residues(spark, sf_dir), "fold", "chain", "split", 1, score="tied")


_GRID_SQL = ", ".join(f"round(avg(value) FILTER (fold = {v}), 6) AS mean_{v}, round(stddev_pop(value) FILTER (fold = {v}), 6) AS std_{v}" for v in range(5))


@query(f"WITH {RUNS} SELECT model, {_GRID_SQL} FROM runs GROUP BY model")
def metric_grid(spark, sf_dir):
    return rounded(evaluate.metric_grid(runs(spark, sf_dir), "model", "fold", list(range(5)), "value"))


@query(f"""WITH {RESIDUES}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, pos) AS rank FROM res), c AS (SELECT chain, fold, weight, sum(CASE WHEN rank = 1 THEN label ELSE 0 END)::INT AS success FROM r GROUP BY ALL) SELECT fold, success, count(*) AS n, sum(weight) AS weight FROM c GROUP BY fold, success""")
def top1_success(spark, sf_dir):
    return evaluate.top1_groups(residues(spark, sf_dir), "chain", ["fold"], "weight")


_CASES = f"WITH {RESIDUES}, c AS (SELECT chain, sum(CASE WHEN score >= 40000 THEN 1 - label ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN score < 40000 THEN label ELSE 0 END)::DOUBLE AS fn, max(CASE WHEN score >= 40000 AND label = 0 THEN score END) AS max_fp FROM res GROUP BY chain), e AS (SELECT *, fp + 2 * fn AS error FROM c)"


def _confusion(spark, sf_dir):
    return evaluate.chain_confusion(residues(spark, sf_dir), ["chain"], 40000.0)


@query(_CASES + " SELECT chain, fp, fn, error, max_fp, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY fp DESC, max_fp DESC NULLS LAST, error DESC, chain) AS place FROM e) WHERE place <= 20")
def false_positive_cases(spark, sf_dir):
    return evaluate.cases(_confusion(spark, sf_dir), "chain", "false_positives", 20)


@query(_CASES + " SELECT chain, fp, fn, error, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY fn DESC, error DESC, chain) AS place FROM e) WHERE place <= 20")
def missed_cases(spark, sf_dir):
    return evaluate.cases(_confusion(spark, sf_dir), "chain", "missed", 20)


@query(_CASES + " SELECT chain, fp, fn, error, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY error, chain) AS place FROM e) WHERE place <= 20")
def best_cases(spark, sf_dir):
    return evaluate.cases(_confusion(spark, sf_dir), "chain", "best", 20)


@query(f"""WITH {RESIDUES}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, pos) AS rank FROM res), f AS (SELECT *, row_number() OVER (ORDER BY score DESC, chain, pos) AS place FROM r WHERE rank <= 3 AND label = 0)
SELECT chain, pos, aa, score, rank::INT AS rank, place::INT AS place FROM f WHERE place <= 50""")
def confident_false_positives(spark, sf_dir):
    return evaluate.confident_false_positives(residues(spark, sf_dir), ["chain"], 3, 50, ["aa"])
