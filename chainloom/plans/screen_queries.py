"""Screening, label transfer, parsing, resampling and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, curves, merge, resample, screen, search, spatial, transfer, votes
from ..sources import readers, writers
from ..streaming import worklist
from .bindings import CHAINS, RESIDUES, RUNS, SCREENS, chains, residues, runs, screens, table
from .materialize import written
from .metric_queries import AREA, points_sql, rounded, weight_
from .registry import Registry

query = Registry()


@query(f"""WITH {SCREENS}, n AS (SELECT *, len(list_filter(predicted, lambda x: NOT list_contains(known, x))) AS n_novel, len(list_intersect(predicted, known)) AS n_shared, len(known) AS n_known FROM screens)
SELECT (id % 5)::BIGINT AS grp, count(*) AS n, sum((n_novel > 0)::INT)::BIGINT AS with_novel, sum(n_novel)::BIGINT AS novel_sites, sum((n_novel > 0 AND n_known = 0)::INT)::BIGINT AS without_known, round(coalesce(sum(n_shared) / nullif(sum(n_known), 0), 0), 6) AS micro_recall FROM n GROUP BY 1""")
def set_recall_novel(spark, sf_dir):
    n = screen.novelty(screens(spark, sf_dir), "predicted", "known").withColumn("grp", F.col("id") % 5)
    return rounded(screen.novelty_summary(n, ["grp"]))


@query(f"""WITH {SCREENS} SELECT id, array_to_string(list_sort(list_filter(predicted, lambda x: NOT list_contains(known, x))), ', ') AS novel, len(predicted) AS n_predicted, len(known) AS n_known FROM screens""")
def novel_sites(spark, sf_dir):
    n = screen.novelty(screens(spark, sf_dir), "predicted", "known")
    return n.select("id", L.format_positions(F.col("novel")).alias("novel"), F.col("n_predicted").cast("long").alias("n_predicted"), F.col("n_known").cast("long").alias("n_known"))


@query(f"""WITH {SCREENS}, s AS (SELECT id, len(list_intersect(predicted, known))::DOUBLE AS o, len(predicted) AS p, len(known) AS k FROM screens), r AS (SELECT id, coalesce(o / nullif(p, 0), 0) AS a, coalesce(o / nullif(k, 0), 0) AS b FROM s)
SELECT (id % 5)::BIGINT AS grp, round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(coalesce(2 * a * b / nullif(a + b, 0), 0)), 6) AS f1 FROM r GROUP BY 1""")
def macro_set_scores(spark, sf_dir):
    n = screen.novelty(screens(spark, sf_dir), "predicted", "known").withColumn("grp", F.col("id") % 5)
    return rounded(screen.set_scores(n, ["grp"]))


@query("""WITH m AS (SELECT p_brand AS base, p_brand || '-' || p_partkey::VARCHAR AS member, p_partkey FROM part) SELECT base, member FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN ends_with(member, '-1') THEN 0 ELSE 1 END, p_partkey, member) AS r FROM m) WHERE r = 1""")
def reference_member(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("base"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("member"))
    return screen.reference_member(p, "base", F.col("member"))


@query(f"WITH {RESIDUES} SELECT chain, pos, (coalesce(sum(label) OVER (PARTITION BY chain, aa ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 0) - label) > 0 AS near FROM res")
def neighbour_window(spark, sf_dir):
    return screen.neighbour_positive(residues(spark, sf_dir), "chain", "aa", "pos", "label").select("chain", "pos", "near")


@query(f"WITH {RESIDUES}, p AS (SELECT fold, pos, aa, max(quantity) - min(quantity) AS r, count(*) AS n FROM res GROUP BY ALL) SELECT fold, aa, coalesce(max(r) FILTER (n >= 2), 0) AS spread FROM p GROUP BY fold, aa")
def spread_score(spark, sf_dir):
    r = residues(spark, sf_dir).withColumn("base", F.concat_ws(":", "fold", "aa"))
    s = screen.spread(r, "base", "pos", "quantity")
    return s.select(F.substring_index("base", ":", 1).cast("int").alias("fold"), F.substring_index("base", ":", -1).alias("aa"), "spread")


@query(f"""WITH {RESIDUES}, o AS (SELECT o_orderkey, o_custkey FROM orders), r AS (SELECT res.*, o_custkey AS base FROM res JOIN o ON o_orderkey = chain), ref AS (SELECT base, min(chain) AS ref FROM r GROUP BY base),
s AS (SELECT r.base, r.pos AS ref_pos, r.aa FROM r JOIN ref ON r.base = ref.base AND r.chain = ref.ref WHERE label = 1), m AS (SELECT DISTINCT r.base, r.chain AS member FROM r JOIN ref USING (base) WHERE chain <> ref),
j AS (SELECT m.base, m.member, s.ref_pos, x.pos, x.score FROM m JOIN s USING (base) LEFT JOIN r x ON x.chain = m.member AND x.pos = s.ref_pos AND x.aa = s.aa),
g AS (SELECT base, member, sum((coalesce(score, 0) >= 30000)::INT)::BIGINT AS retained, sum((pos IS NOT NULL AND score < 30000)::INT)::BIGINT AS lost_aligned, sum((pos IS NULL)::INT)::BIGINT AS lost_missing FROM j GROUP BY ALL)
SELECT *, CASE WHEN lost_aligned = 0 AND lost_missing = 0 THEN 'no_loss' WHEN lost_aligned = 0 THEN 'loss_missing_only' ELSE 'loss_aligned_present' END AS category FROM g""")
def loss_categories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_custkey").alias("base"))
    r = residues(spark, sf_dir).join(o, "chain")
    ref = r.groupBy("base").agg(F.min("chain").alias("ref"))
    sites = r.join(ref, "base").where("chain = ref and label = 1").select("base", F.col("pos").alias("ref_pos"), F.col("aa").alias("ref_aa"))
    members = r.join(ref, "base").where("chain <> ref").select("base", F.col("chain").alias("member")).distinct()
    wanted = members.join(sites, "base")
    at = r.select(F.col("chain").alias("member"), "pos", "aa", "score")
    pairs = wanted.join(at, (wanted["member"] == at["member"]) & (wanted["ref_pos"] == at["pos"])).select("base", wanted["member"], "ref_pos", "pos", (F.col("aa") == F.col("ref_aa")).alias("same"))
    return screen.loss_categories(wanted.select("base", "member", "ref_pos"), pairs, at, 30000.0)


@query(f"""WITH {RESIDUES}, v AS (SELECT fold, pos, aa, count(*) AS votes, avg(label) AS share FROM res GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY fold, pos ORDER BY votes DESC, aa) AS r FROM v)
SELECT fold, pos, aa, votes, round(share, 6) AS share FROM m WHERE r = 1 AND votes >= 2 AND share >= 0.3""")
def column_vote(spark, sf_dir):
    return rounded(transfer.column_vote(residues(spark, sf_dir), ["fold", "pos"], "aa", "label", 2, 0.3))


_KNN = """WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS q, e.vec_id AS t, e.label AS label, 100 * list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
s AS (SELECT q, max(score) AS mx, quantile_cont(score, 0.95) AS pc FROM p GROUP BY q), w AS (SELECT p.*, least(mx / 2, pc, mx - 1e-6) AS thr, pc FROM p JOIN s USING (q) WHERE score >= 10),
v AS (SELECT q, t, label, greatest(0, (score - thr) / greatest(pc - thr, 1)) AS w, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS r FROM w WHERE score > thr)"""


@query(_KNN + " SELECT q, round(sum(w * (label % 2)) / sum(w), 6) AS score FROM v WHERE r <= 32 GROUP BY q")
def knn_weighted_vote(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all: the stated query set, in blocks, with merged summaries of scores."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), F.col("embedding").alias("v"))
    q, t = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "v"), e.select(F.col("vec_id").alias("t"), "v", "label")
    return rounded(transfer.weighted_vote(votes.vector_votes(q, t, cutoff=10.0), ["q"], "w", "label"))


@query()
def alignment_transfer(spark, sf_dir):
    """Labels of an order's lines, read as letters, carried to the orders of the same customer by local alignment with affine gaps and a matrix."""
    r = residues(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_custkey").alias("base"))
    s = r.groupBy("chain").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "aa"))).getField("aa"), "").alias("seq")).join(o, "chain")
    ref = s.groupBy("base").agg(F.min_by(F.struct(F.col("chain").alias("t"), F.col("seq").alias("t_seq")), "chain").alias("r")).select("base", "r.*")
    pairs = transfer.align_pairs(s.join(ref, "base").where("chain <> t"), "chain", "t", "seq", "t_seq", matrix=search.class_matrix(), gap=search.GAP, extend=search.EXTEND, local=True)
    labels = r.select(F.col("chain").alias("t"), F.col("pos").alias("tpos"), "label")
    return transfer.transfer_labels(pairs, labels, "same").where("label = 1").groupBy("q").agg(F.count("*").alias("n_transferred"))


@query(f"""WITH {RESIDUES}, {CHAINS}, r AS (SELECT res.chain, pos, label, aa, parent AS base, price FROM res JOIN chains ON chains.chain = res.chain), ref AS (SELECT base, min(chain) AS ref FROM r GROUP BY base), b AS (SELECT r.* FROM r JOIN ref ON r.chain = ref.ref),
v AS (SELECT b.chain AS target, b.pos, h.chain AS hit, h.label, h.aa = b.aa AS same FROM b JOIN r h ON h.base = b.base AND h.pos = b.pos AND h.chain <> b.chain WHERE h.price > 100000), n AS (SELECT target, count(DISTINCT hit) AS n FROM v GROUP BY target), s AS (SELECT target, pos, sum(label) AS s FROM v WHERE same GROUP BY ALL)
SELECT b.chain AS target, b.pos, CASE WHEN label = 1 OR coalesce(s / n, 0) >= 0.05 THEN 1 ELSE 0 END AS label FROM b LEFT JOIN s ON s.target = b.chain AND s.pos = b.pos LEFT JOIN n ON n.target = b.chain""")
def cluster_propagation(spark, sf_dir):
    """Labels of a customer's other orders, line by line, averaged onto the first one."""
    r = residues(spark, sf_dir).select("chain", "pos", "label", "aa").join(chains(spark, sf_dir).select("chain", F.col("parent").alias("base"), "price"), "chain")
    ref = r.groupBy("base").agg(F.min("chain").alias("target"))
    base = r.join(ref, "base").where("chain = target").select("base", "target", "pos", "label", F.col("aa").alias("target_aa"))
    hits = r.select("base", F.col("chain").alias("hit"), "pos", "label", "aa", "price")
    votes = hits.join(base.drop("label"), ["base", "pos"]).where("hit <> target").withColumn("same", F.col("aa") == F.col("target_aa"))
    return transfer.cluster_propagation(votes, base, "target", "pos", "hit", "label", "price", "same", 100000.0, 0.05)


@query()
def template_hits(spark, sf_dir):
    """The most alike other name of every part whose id is divisible by 20, by a search with seeds and affine gaps among all parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s"))
    q = p.where("k % 20 = 0")
    hits = search.search_texts(transfer.texts(q, "s"), transfer.texts(p, "s"), "id", "s", search.letter_matrix("abcdefghijklmnopqrstuvwxyz ", 2.0, -1.0), other=-1.0, word=4, least=8.0, drop=8.0, trigger=14.0, cutoff=20.0)
    good = written(hits.where("aligned >= 9").withColumn("identity", F.col("same") / F.col("aligned")).where("identity >= 0.5"), "hits")
    best = transfer.best_of_texts(good, q, p, "k", "s", "identity")
    return rounded(best.select("q", "t", "score", "aligned", "same", "identity"))


@query("""WITH g AS (SELECT DISTINCT p_partkey AS k, substr(s, i, 4) AS gram FROM (SELECT p_partkey, p_name AS s, unnest(range(1, greatest(len(p_name) - 3, 0) + 1)) AS i FROM part)), q AS (SELECT * FROM g WHERE k % 20 = 0)
SELECT q.k AS q, g.k AS t, count(*) AS shared FROM q JOIN g USING (gram) WHERE q.k <> g.k GROUP BY ALL HAVING count(*) >= 6""")
def kmer_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s"))
    return transfer.kmer_candidates(p.where("k % 20 = 0"), p, "k", "s", 4, 6, 500)


def _atoms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") % 2).alias("entry"), F.col("label").cast("string").alias("chain"), F.col("vec_id").alias("atom"), *[(F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate(spatial.XYZ)])


_ATOMS = "WITH a AS (SELECT label % 2 AS entry, label::VARCHAR AS chain, vec_id AS atom, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"


@query(_ATOMS + """ SELECT a.entry, a.chain AS chain_a, b.chain AS chain_b, count(*) AS n FROM a JOIN a b ON a.entry = b.entry AND a.chain < b.chain AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 8 GROUP BY ALL HAVING count(*) >= 2""")
def spatial_contacts(spark, sf_dir):
    return spatial.contacts(_atoms(spark, sf_dir), "entry", "chain", 8.0, 2)


@query(f"""WITH {CHAINS} SELECT chain, CASE WHEN regexp_matches(ec, '^\\d+\\.\\d+\\.\\d+(\\.|$)') THEN array_to_string(string_split(ec, '.')[1:3], '.') ELSE 'not found' END AS level3, nullif(regexp_extract(ec, '^\\s*(\\d+)', 1), '') AS top,
CASE WHEN regexp_matches('C' || lpad((chain % 1000)::VARCHAR, 3, '0'), '^[A-Za-z0-9]{{4}}$') THEN 'PDB' ELSE 'AF' END AS source FROM chains""")
def id_decompose(spark, sf_dir):
    c = chains(spark, sf_dir)
    name = F.concat(F.lit("C"), F.lpad((F.col("chain") % 1000).cast("string"), 3, "0"), F.lit("_A"))
    return c.select("chain", L.ec_level3(F.col("ec")).alias("level3"), L.ec_top(F.col("ec"), "b").alias("top"), L.source_class(name).alias("source"))


@query("SELECT event_id, coalesce(CAST(props->>'$.k' AS INT), -1) AS k, coalesce(props->>'$.name', event_type, 'not found') AS name FROM events")
def json_coalesce(spark, sf_dir):
    p = F.from_json("props", "k int, name string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(p["name"], F.col("event_type"), F.lit("not found")).alias("name"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT doc_id, string_split(trim(line), ' ') AS f FROM l) SELECT doc_id, count(*) AS n_lines, sum(len(f))::BIGINT AS n_fields FROM f WHERE len(f) >= 4 GROUP BY doc_id""")
def block_text_explode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    f = lines.select("doc_id", F.size(F.split(F.trim("line"), " ")).alias("n")).where("n >= 4")
    return f.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_fields"))


@query(f"""WITH {RESIDUES}, p AS (SELECT chain, '>C' || chain::VARCHAR || '_A' AS header, list('A ' || pos::VARCHAR || ' ' || aa || ' ' || label::VARCHAR ORDER BY pos) AS lines FROM res GROUP BY chain)
SELECT 'C' || chain::VARCHAR || '_A' AS id, len(lines)::BIGINT AS n, md5(array_to_string(list_prepend(header, lines), chr(10))) AS block FROM p""")
def annotation_round_trip(spark, sf_dir):
    """Chains written as annotation blocks and parsed again, with the digest of the text."""
    r = residues(spark, sf_dir).select(F.concat(F.lit("C"), F.col("chain").cast("string"), F.lit("_A")).alias("id"), "pos", F.lit("A").alias("chain"), F.col("pos").cast("string").alias("resnum"), "aa", "label")
    blocks = writers.annotation_blocks(r).select(F.lit("").alias("file"), F.split("value", "\n").alias("v"))
    parsed = readers.residue_rows(blocks.select("file", F.regexp_replace(F.col("v")[0], "^>", "").alias("header"), F.slice("v", 2, F.size("v")).alias("lines")))
    again = writers.annotation_blocks(parsed)
    return again.select("id", (F.size(F.split("value", "\n")) - 1).cast("long").alias("n"), F.md5(F.col("value").cast("binary")).alias("block"))


@query("SELECT o_orderkey AS item FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def incremental_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item"))
    return worklist.pending(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), done, "item")


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, n_chars + 2 AS cost, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM documents WHERE n_chars IS NOT NULL),
walk(p, batch, used, n) AS (SELECT 0::BIGINT, -1::BIGINT, 0::BIGINT, 16 UNION ALL SELECT t.p, CASE WHEN n >= 16 OR used + cost > 20000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 16 OR used + cost > 20000 THEN cost ELSE used + cost END, CASE WHEN n >= 16 OR used + cost > 20000 THEN 1 ELSE n + 1 END FROM walk JOIN t ON t.p = walk.p + 1)
SELECT doc_id, batch FROM t JOIN walk USING (p)""")
def token_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return worklist.token_batches(d, "doc_id", "n_chars", 20000).select("doc_id", "batch")


@query("SELECT p_brand AS base, count(DISTINCT p_name)::INT AS n, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS members FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) >= 2")
def group_index(spark, sf_dir):
    return writers.group_index(table(spark, sf_dir, "part").select(F.col("p_brand").alias("base"), F.col("p_name").alias("member")), "base", "member", 2)


@query("""WITH e AS (SELECT c_custkey AS entry, (c_custkey % 5)::INT AS split FROM customer UNION ALL SELECT o_custkey, (o_orderkey % 5)::INT FROM orders), p AS (SELECT h::INT AS holdout, entry, split FROM e, range(5) t(h) WHERE split <> h)
SELECT holdout, entry, min(split) AS split FROM p GROUP BY ALL""")
def leave_one_split_out(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), (F.col("c_custkey") % 5).cast("int").alias("split"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry"), (F.col("o_orderkey") % 5).cast("int").alias("split"))
    e = c.unionByName(o)
    return writers.reference_db(e, e.select("split"), "entry", "split").select("holdout", "entry", "split")


def _ab(spark, sf_dir):
    from ..operators.merge import pair_models

    return written(pair_models(runs(spark, sf_dir), ["fold", "seed"], "model", "purchase", "view", "value"), "pairs")


_DIFFS = f"""WITH {RUNS}, d AS (SELECT fold, seed, avg(CASE WHEN model = 'purchase' THEN value END) - avg(CASE WHEN model = 'view' THEN value END) AS diff FROM runs GROUP BY ALL HAVING diff IS NOT NULL)"""
_U = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


@query(_DIFFS + f""", o AS (SELECT avg(m) AS d FROM (SELECT avg(diff) AS m FROM d GROUP BY fold)),
s AS (SELECT perm, avg(m) AS s FROM (SELECT perm, fold, avg(CASE WHEN {_U.format("'1:' || perm || ':' || fold || ':' || seed")} < 0.5 THEN -diff ELSE diff END) AS m FROM d, range(200000) t(perm) GROUP BY perm, fold) GROUP BY perm)
SELECT round(d, 6) AS d, count(*) AS n, round((sum((abs(s) >= abs(d) - 1e-12)::INT) + 1) / (count(*) + 1), 6) AS p_two, round((sum((s >= d - 1e-12)::INT) + 1) / (count(*) + 1), 6) AS p_greater, round((sum((s <= d + 1e-12)::INT) + 1) / (count(*) + 1), 6) AS p_less FROM s, o GROUP BY d""")
def signflip_test(spark, sf_dir):
    return rounded(resample.signflip_test(_ab(spark, sf_dir), "fold", "seed", "diff", 200_000))


@query(_DIFFS + f""", f AS (SELECT fold, list(diff ORDER BY seed) AS diffs FROM d GROUP BY fold), a AS (SELECT list(diffs ORDER BY fold) AS folds FROM f),
k AS (SELECT boot, k, folds[floor({_U.format("'2:' || boot || ':' || k")} * len(folds))::BIGINT + 1] AS diffs FROM a, range(50000) t(boot), (SELECT unnest(range(1, len(folds) + 1)) AS k FROM a)),
m AS (SELECT boot, k, avg(diffs[floor({_U.format("'3:' || boot || ':' || k || ':' || j")} * len(diffs))::BIGINT + 1]) AS m FROM (SELECT *, unnest(range(1, len(diffs) + 1)) AS j FROM k) GROUP BY boot, k), b AS (SELECT avg(m) AS m FROM m GROUP BY boot)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b""")
def hierarchical_bootstrap(spark, sf_dir):
    return rounded(resample.hierarchical_bootstrap(_ab(spark, sf_dir), "fold", "seed", "diff", 50_000))


@query(f"""WITH {RESIDUES}, c AS (SELECT split, chain, tied, label, sum(weight) AS w FROM res GROUP BY ALL), h AS (SELECT chain, b, md5('3:' || chain || ':' || b) AS h FROM (SELECT DISTINCT chain FROM c), range(50) t(b)),
n AS (SELECT chain, (4 * b + i)::INT AS boot, len(list_filter({resample.poisson_edges()}::BIGINT[], lambda e: e <= ('0x' || substr(h, 1 + 8 * i, 8))::BIGINT)) AS times FROM h, range(4) t(i)),
r AS (SELECT split, boot, tied, label, sum(w * times) AS weight FROM c JOIN n USING (chain) WHERE times > 0 GROUP BY ALL), d AS (SELECT split, boot, tied, sum(weight * label)::DOUBLE AS dtp, sum(weight * (1 - label))::DOUBLE AS dfp FROM r GROUP BY ALL),
p AS (SELECT *, sum(dtp) OVER up AS tp, sum(dfp) OVER up AS fp, sum(dtp) OVER (PARTITION BY split, boot) AS pos FROM d WINDOW up AS (PARTITION BY split, boot ORDER BY tied DESC)), q AS (SELECT *, tp / (tp + fp) AS precision, tp / nullif(pos, 0) AS recall FROM p),
z AS (SELECT *, lag(precision, 1, 1.0) OVER o AS p0, lag(recall, 1, 0.0) OVER o AS r0 FROM q WINDOW o AS (PARTITION BY split, boot ORDER BY tied DESC)), a AS (SELECT split, boot, coalesce(sum((recall - r0) * (precision + p0) / 2), 0) AS aucpr FROM z GROUP BY ALL)
SELECT split, round(quantile_cont(aucpr, 0.025), 6) AS low, round(quantile_cont(aucpr, 0.975), 6) AS high, count(*) AS draws FROM a GROUP BY split""")
def bootstrap_ci(spark, sf_dir):
    """Percentile interval of AUCPR over Poisson draws of chains, by split."""
    return rounded(intervals(spark, sf_dir, "split"))


def intervals(spark, sf_dir, group: str):
    r = written(resample.bootstrap_sums(residues(spark, sf_dir), [group], ["chain"], ["tied", "label"], weight_(), 200), "boot")
    a = curves.pr_summary(r, [group, "boot"], score="tied", weight=weight_(), buckets=4)
    return a.groupBy(group).agg(F.percentile("aucpr", F.lit(0.025)).alias("low"), F.percentile("aucpr", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))


_RANDOM = points_sql("score", table=f"""{RESIDUES.replace("res AS", "plain AS", 1)}, res AS (SELECT * REPLACE (({_U.format("'4:' || chain || ':' || pos")} < 0.3)::INT AS label) FROM plain)""", weight="1.0")


@query("WITH " + _RANDOM + " " + AREA.format(by="fold"))
def random_label_baseline(spark, sf_dir):
    """AUCPR against random labels is near their share."""
    r = resample.random_labels(residues(spark, sf_dir), 0.3, "chain", "pos")
    return rounded(curves.pr_summary(r, ["fold"], label="random_label"))


@query(f"WITH {CHAINS}, s AS (SELECT cluster_1, count(DISTINCT chain) AS chains, count(DISTINCT parent) AS parents FROM chains GROUP BY 1) SELECT cluster_1, chains, parents FROM s")
def cluster_statistics(spark, sf_dir):
    return audit.cluster_statistics(chains(spark, sf_dir), "cluster_1", ["chain", "parent"]).withColumnsRenamed({"n_chain": "chains", "n_parent": "parents"})


@query("SELECT quality, toxic, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM labels), 6) AS pct FROM labels GROUP BY ALL")
def outcome_counts(spark, sf_dir):
    return rounded(audit.distribution(table(spark, sf_dir, "labels"), ["quality", "toxic"]))


@query(f"""WITH {RUNS}, r AS (SELECT run, CASE WHEN k % 3 = 0 THEN '' ELSE model END AS model, config FROM runs), t AS (SELECT config, min(model) AS model FROM runs GROUP BY config)
SELECT run, coalesce(nullif(trim(r.model), ''), t.model) AS model FROM r LEFT JOIN t USING (config)""")
def enrich_blank_fields(spark, sf_dir):
    from ..operators.merge import enrich

    r = runs(spark, sf_dir)
    blank = r.select("run", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("model")).alias("model"), "config")
    return enrich(blank, r.groupBy("config").agg(F.min("model").alias("model")), ["config"], ["model"]).select("run", "model")


@query(f"""WITH {RESIDUES}, a AS (SELECT chain, pos, label FROM res), s AS (SELECT chain, pos, score FROM res WHERE label = 0)
SELECT chain, count(*) AS n, count(score) AS covered, round(coalesce(sum(score), 0), 4) AS total FROM a LEFT JOIN s USING (chain, pos) GROUP BY chain""")
def ordinal_residue_join(spark, sf_dir):
    """Annotated positions with the scores that there are, and their coverage."""
    r = residues(spark, sf_dir)
    j = merge.ordinal_join(r.select("chain", "pos", "label"), r.where("label = 0").select("chain", "pos", "score"), "chain", "pos")
    return merge.score_coverage(j, "chain", "score").withColumn("total", F.round("total", 4))


@query(f"""WITH {SCREENS} SELECT id, '[' || array_to_string(list_transform(list_sort(predicted), lambda p: '''0'', ''A'', ''' || p::VARCHAR || ''''), ', ') || ']' AS cell, array_to_string(list_sort(list_filter(predicted, lambda p: p > 0)), ', ') AS parsed FROM screens""")
def position_cell_parse(spark, sf_dir):
    """Position sets written as cells of triplets and parsed again."""
    s = screens(spark, sf_dir).select("id", F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("predicted"), lambda p: F.concat(F.lit("'0', 'A', '"), p.cast("string"), F.lit("'"))), ", "), F.lit("]")).alias("cell"))
    return s.select("id", "cell", L.format_positions(L.positions(F.col("cell"))).alias("parsed"))


@query("WITH " + points_sql("tied", "seed") + """, c AS (SELECT seed, recall AS x, precision AS y, ceil(recall * 500) AS k FROM q WHERE recall IS NOT NULL), g AS (SELECT seed, g FROM (SELECT DISTINCT seed FROM c), range(501) t(g)),
v AS (SELECT g.seed, g.g, max((x, y)) FILTER (k <= g.g) AS a, min((x, y)) FILTER (k > g.g) AS b FROM g JOIN c USING (seed) GROUP BY ALL),
r AS (SELECT g, CASE WHEN a IS NULL THEN b[2] WHEN b IS NULL OR g / 500 <= a[1] THEN a[2] ELSE a[2] + (b[2] - a[2]) * (g / 500 - a[1]) / (b[1] - a[1]) END AS y FROM v)
SELECT round(g / 500, 6) AS g, round(avg(y), 6) AS precision FROM r GROUP BY g""")
def mean_pr_curve(spark, sf_dir):
    """PR curves of the seeds read at 501 recalls, averaged."""
    from ..operators.sweep import interpolated_mean

    p = curves.pr_points(residues(spark, sf_dir), ["seed"], score="tied", weight=weight_())
    return rounded(interpolated_mean(p, "seed", "recall", "precision", 501))


@query("WITH RECURSIVE " + _ATOMS.removeprefix("WITH ") + """, e AS (SELECT a.entry, a.chain AS u, b.chain AS v FROM a JOIN a b ON a.entry = b.entry AND a.chain < b.chain AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 2 GROUP BY ALL HAVING count(*) >= 1),
g AS (SELECT entry, u, v FROM e UNION SELECT entry, v, u FROM e), c(entry, chain, root) AS (SELECT DISTINCT entry, chain, chain FROM a UNION SELECT c.entry, g.v, c.root FROM c JOIN g ON c.entry = g.entry AND c.chain = g.u WHERE c.root < g.v),
m AS (SELECT entry, chain, min(root) AS root FROM c GROUP BY ALL), s AS (SELECT entry, root, row_number() OVER (PARTITION BY entry ORDER BY count(*) DESC, root) AS r FROM m GROUP BY entry, root) SELECT m.entry, m.chain FROM m JOIN s USING (entry, root) WHERE r = 1""")
def largest_contact_component(spark, sf_dir):
    return spatial.largest_contact_component(_atoms(spark, sf_dir), "entry", "chain", 2.0, 1)


@query(f"""WITH {RESIDUES}, {CHAINS}, r AS (SELECT parent AS base, res.chain AS member, pos, aa, score >= 30000 AS hit FROM res JOIN chains ON chains.chain = res.chain)
SELECT a.base, a.member AS source, b.member AS target, a.pos, b.pos AS target_pos FROM r a JOIN r b ON a.base = b.base AND a.member <> b.member AND a.pos = b.pos AND a.aa = b.aa WHERE a.hit AND NOT b.hit""")
def member_losses(spark, sf_dir):
    """Sites of an order that another order of the same customer has with the same letter, but not predicted, between all of them; letters are aligned place by place."""
    r = residues(spark, sf_dir).select("chain", "pos", "aa", "score").join(chains(spark, sf_dir).select("chain", F.col("parent").alias("base")), "chain")
    letters = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "aa"))).getField("aa"), "")
    each = written(r.groupBy("base", F.col("chain").alias("member")).agg(letters.alias("seq"), F.collect_list(F.when(F.col("score") >= 30000, F.col("pos"))).alias("hits")), "chains")
    members, sites = each.select("base", "member", "seq"), each.select("base", "member", F.explode("hits").alias("pos"))

    def by_place(pairs):
        at = F.explode(F.sequence(F.lit(0), F.least(F.length("q_seq"), F.length("t_seq")) - 1)).alias("qpos")
        each = pairs.select("base", "q", "t", "q_seq", "t_seq", at)
        return each.where(F.substr("q_seq", F.col("qpos") + 1, F.lit(1)) == F.substr("t_seq", F.col("qpos") + 1, F.lit(1))).withColumn("tpos", F.col("qpos"))

    return screen.member_losses(members, sites, by_place)[0]


@query(f"""WITH {RESIDUES}, v AS (SELECT fold, pos AS col, aa, count(*) AS votes, avg(label) AS share FROM res GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY fold, col ORDER BY votes DESC, aa) AS r FROM v),
w AS (SELECT res.* FROM res JOIN m ON m.fold = res.fold AND m.col = res.pos AND m.aa = res.aa WHERE r = 1 AND votes >= 2 AND share >= 0.3)
SELECT DISTINCT chain AS member, pos FROM w WHERE NOT EXISTS (SELECT 1 FROM res p WHERE p.chain = w.chain AND p.aa = w.aa AND p.label = 1 AND p.pos <> w.pos AND abs(p.pos - w.pos) <= 3)""")
def column_proposals(spark, sf_dir):
    """Sites that columns of a fold propose to its chains, but for those near another positive of the same letter."""
    r = residues(spark, sf_dir)
    votes = r.select("fold", F.col("pos").alias("col"), F.col("chain").alias("member"), "pos", "aa", "label")
    return screen.column_proposals(votes, r.where("label = 1").select(F.col("chain").alias("member"), "pos", "aa"), ["fold"], 0.3, nearby=3)


@query(_ATOMS + """, b AS (SELECT entry, chain, atom // 3 AS residue, CASE WHEN atom % 3 = 0 THEN 'CA' ELSE 'N' END AS name, CASE WHEN atom % 5 = 0 THEN 'H' ELSE 'C' END AS element, x, y, z FROM a),
p AS (SELECT a.entry, a.chain AS ca, b.chain AS cb, a.residue AS ra, b.residue AS rb, a.name AS na, b.name AS nb, a.element AS ea, b.element AS eb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM b a JOIN b ON a.entry = b.entry AND a.chain < b.chain),
k AS (SELECT entry, ca, cb, ra, rb, max((na = 'CA' AND nb = 'CA' AND d < 8)::INT) AS alpha, max((ea = 'C' AND eb = 'C' AND d <= 4)::INT) AS heavy FROM p GROUP BY ALL)
SELECT entry, ca AS chain_a, cb AS chain_b, count(*) AS alpha, sum(heavy)::BIGINT AS heavy FROM k WHERE alpha = 1 GROUP BY ALL HAVING count(*) >= 4 OR sum(heavy) >= 10""")
def chain_contacts(spark, sf_dir):
    """Contacts of chains by alpha carbons and heavy atoms of their residues."""
    a = _atoms(spark, sf_dir).select("entry", "chain", *spatial.XYZ, F.floor(F.col("atom") / 3).alias("residue"), F.when(F.col("atom") % 3 == 0, "CA").otherwise("N").alias("name"), F.when(F.col("atom") % 5 == 0, "H").otherwise("C").alias("element"))
    return spatial.chain_contacts(a, "entry", "chain", "residue", "name", "element")
