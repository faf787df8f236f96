"""Queries of values: run names, command lines, run logs, site cells, codes in texts, pairs of letters and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import logs
from ..operators import sweep
from ..sources import dumps, stores
from ..streaming import worklist
from .bindings import RESIDUES, residues, table
from .materialize import shared_dir
from .metric_queries import _GRID, rounded
from .registry import Registry

query = Registry()
TRACEBACK = "Traceback (most recent call last):"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("v"))


def _case(n: Column, *values: str | Column) -> Column:
    """The n-th of the values."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (n % len(values) + 1).cast("int"))


@query("""WITH e AS (SELECT event_id, user_id, floor(value)::BIGINT AS v FROM events)
SELECT event_id, 'm' || (user_id % 7)::VARCHAR AS model_name, CASE WHEN v % 3 = 0 THEN NULL ELSE 'esm2_t36_3B' END AS esm2_version, CASE WHEN v % 4 = 0 THEN NULL ELSE (user_id % 40)::VARCHAR END AS esm2_layer, '64-' || (user_id % 9)::VARCHAR AS hidden_dims,
(v % 5)::VARCHAR AS cv_fold, CASE WHEN v % 2 = 0 THEN '9' ELSE (user_id % 3)::VARCHAR END AS seed FROM e""")
def run_name_decode(spark, sf_dir):
    """Run folders read back: parts known by how they begin, lists with blanks, unknown parts, and a seed that some names give twice."""
    e = _events(spark, sf_dir)
    text = lambda c: c.cast("string")
    name = logs.run_name(
        F.concat(F.lit("m"), text(F.col("user_id") % 7)), F.when(F.col("v") % 3 != 0, F.lit("esm2_t36_3B")), F.when(F.col("v") % 4 != 0, F.col("user_id") % 40),
        {"hd": F.concat(F.lit("64 "), text(F.col("user_id") % 9)), "odd": F.lit("1"), "fold": F.col("v") % 5, "seed": F.col("user_id") % 3},
    )
    path = F.concat(F.lit("/runs/"), name, F.when(F.col("v") % 2 == 0, "__seed=9/").otherwise(""))
    f = e.select("event_id", logs.run_fields(path).alias("f"))
    return f.select("event_id", *[F.col("f")[k].alias(k) for k in ("model_name", "esm2_version", "esm2_layer", "hidden_dims", "cv_fold", "seed")])


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN NULL ELSE (user_id % 3)::VARCHAR END AS lr, CASE WHEN event_id % 5 >= 3 THEN NULL ELSE '4-8' END AS hidden_dims,
CASE WHEN event_id % 5 >= 3 THEN NULL WHEN event_id % 5 = 1 THEN 'it''s "so"' ELSE 'a b' END AS name, CASE WHEN event_id % 5 >= 3 THEN NULL ELSE 'true' END AS amp, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 <> 3 END AS closed FROM events""")
def command_decode(spark, sf_dir):
    """Flags of command lines: quoted words, a flag given twice, a list, a bare flag, quotes that do not close, and no command at all."""
    e = _events(spark, sf_dir)
    name = _case(F.col("event_id") % 5, "'a b'", "'it'\\''s '\\\"so\\\"", "\"a b\"", "'a b", "")
    line = F.concat(F.lit("[INFO] x\n[CMD]  python train.py --lr 7 --hidden_dims 4 8 --name "), name, F.lit(" --amp --lr "), (F.col("user_id") % 3).cast("string"), F.lit("\n[INFO] y"))
    f = e.select("event_id", logs.command_flags(F.when(F.col("event_id") % 5 != 4, line)).alias("f"))
    closed = F.when(F.col("f")["cmd"].isNotNull(), F.size("f") > 1)
    return f.select("event_id", *[F.col("f")[k].alias(k) for k in ("lr", "hidden_dims", "name", "amp")], closed.alias("closed"))


_OUT = f"""e AS (SELECT event_id, floor(value)::BIGINT AS v, '[INFO] CSV_PATH=/grid/' || (user_id % 5)::VARCHAR || '.csv' || chr(10) || '[INFO] Running row ' || (user_id + 1)::VARCHAR || '/960' || chr(10) || CASE event_id % 7
WHEN 0 THEN '[SKIP] Existing run found: /r/' || user_id::VARCHAR || chr(10) WHEN 1 THEN '[INFO] OUT_DIR=/o/' || user_id::VARCHAR || chr(10) || '[SUMMARY] validation AUCPR=0.25' || chr(10) || '[SUMMARY] Test AUCPR=0.5' || chr(10) || '[SUMMARY] test AUCPR=.75' || chr(10) || '--- DONE in 1.5 h ---'
WHEN 2 THEN '[SUMMARY] test  AUCPR=0.5' WHEN 3 THEN 'Error: odd' WHEN 4 THEN 'a' || chr(10) || '{TRACEBACK}' || chr(10) || 'KeyError: x' WHEN 5 THEN '[SUMMARY] train AUCPR=1' ELSE 'DONE in 2 h' END AS out,
CASE floor(value)::BIGINT % 6 WHEN 0 THEN 'slurmstepd: error: Killed' WHEN 1 THEN 'step' || chr(10) || chr(10) || 'Valueerror: y' || chr(10) WHEN 2 THEN 'unfailed warning' WHEN 3 THEN '{TRACEBACK}' || chr(10) || 'x' WHEN 4 THEN NULL ELSE 'CUDA  error' END AS err FROM events)"""


@query(f"""WITH {_OUT}, f AS (SELECT *, contains(out, '[SKIP]') AS skipped, contains(out, '{TRACEBACK}') OR contains(coalesce(err, ''), '{TRACEBACK}') AS traced, regexp_matches(out, '--- DONE in [0-9]*\\.?[0-9]+ h ---') AS done,
regexp_extract_all(out, '(?i:\\[SUMMARY\\]\\s+test)\\s+AUCPR=([0-9]*\\.?[0-9]+)', 1)[-1]::DOUBLE AS test, regexp_extract_all(out, '(?i:\\[SUMMARY\\]\\s+validation)\\s+AUCPR=([0-9]*\\.?[0-9]+)', 1)[-1]::DOUBLE AS validation, regexp_extract_all(out, '(?i:\\[SUMMARY\\]\\s+train)\\s+AUCPR=([0-9]*\\.?[0-9]+)', 1)[-1]::DOUBLE AS train,
regexp_matches(coalesce(err, ''), '(?i)\\b(traceback|runtimeerror|valueerror|assertionerror|keyerror|indexerror|typeerror|exception|slurmstepd: error|segmentation fault|killed|out of memory|oom|cuda error|failed)\\b') AS wrong FROM e)
SELECT event_id, regexp_extract(out, 'CSV_PATH=(\\S+)', 1) AS csv_path, regexp_extract(out, 'Running row (\\d+)/', 1)::BIGINT AS row_idx_1based, 960::BIGINT AS row_total, coalesce(nullif(regexp_extract(out, 'run found: (\\S+)', 1), ''), nullif(regexp_extract(out, 'OUT_DIR=(\\S+)', 1), '')) AS run_dir,
train AS train_aucpr, validation AS validation_aucpr, test AS test_aucpr, nullif(regexp_extract(out, '--- DONE in ([0-9.]+) h ---', 1), '')::DOUBLE AS done_hours,
CASE WHEN skipped THEN 'skipped' WHEN done OR test IS NOT NULL OR validation IS NOT NULL THEN CASE WHEN traced THEN 'failed' ELSE 'success' END WHEN traced OR wrong THEN 'failed' ELSE 'incomplete' END AS status,
CASE WHEN wrong THEN array_to_string(list_filter(string_split(err, chr(10)), lambda x: trim(x) <> ''), chr(10)) WHEN contains(out, '{TRACEBACK}') THEN '{TRACEBACK}' || chr(10) || 'KeyError: x' ELSE '' END AS error_snippet FROM f""")
def log_metrics(spark, sf_dir):
    """Row, folder, figures, status and error lines out of pairs of run logs, one pair written for each event."""
    e = _events(spark, sf_dir)
    user, n = F.col("user_id").cast("string"), F.col("event_id")
    ends = _case(
        n, F.concat(F.lit("[SKIP] Existing run found: /r/"), user, F.lit("\n")), F.concat(F.lit("[INFO] OUT_DIR=/o/"), user, F.lit("\n[SUMMARY] validation AUCPR=0.25\n[SUMMARY] Test AUCPR=0.5\n[SUMMARY] test AUCPR=.75\n--- DONE in 1.5 h ---")),
        "[SUMMARY] test  AUCPR=0.5", "Error: odd", f"a\n{TRACEBACK}\nKeyError: x", "[SUMMARY] train AUCPR=1", "DONE in 2 h",
    )
    out = F.concat(F.lit("[INFO] CSV_PATH=/grid/"), (F.col("user_id") % 5).cast("string"), F.lit(".csv\n[INFO] Running row "), (F.col("user_id") + 1).cast("string"), F.lit("/960\n"), ends)
    err = _case(F.col("v"), "slurmstepd: error: Killed", "step\n\nValueerror: y\n", "unfailed warning", f"{TRACEBACK}\nx", F.lit(None).cast("string"), "CUDA  error")
    return e.select("event_id", logs.log_metrics(out, err).alias("m")).select("event_id", "m.*")


@query("""WITH e AS (SELECT event_id, (floor(value)::BIGINT % 5 + 1)::INT AS n FROM events)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN n WHEN 1 THEN CASE WHEN n % 3 = 0 THEN n // 3 ELSE n END WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN CASE WHEN n % 3 = 0 THEN n // 3 ELSE n END WHEN 5 THEN CASE WHEN n = 1 THEN 1 WHEN n % 3 = 0 THEN n // 3 ELSE n END WHEN 6 THEN n WHEN 7 THEN 0 ELSE 1 END::INT AS n_sites FROM e""")
def cell_site_counts(spark, sf_dir):
    """Sites of cells in all their forms: flat triplets, lists of numbers, nan, text with digits, lists of tuples, bare numbers, numbers that are no literals, blanks, words with numbers."""
    e = _events(spark, sf_dir).select("event_id", (F.col("v") % 5 + 1).cast("int").alias("n"))
    times = lambda s, sep=", ": F.array_join(F.array_repeat(F.lit(s), F.col("n")), sep)
    listed = lambda s: F.concat(F.lit("["), times(s), F.lit("]"))
    cell = _case(F.col("event_id"), listed("'0', 'A', '243'"), listed("17"), "nan", "a12b3", listed("('0', 'A', '66')"), times("243", ","), times("007", ","), "  ", "nan, 5")
    return e.select("event_id", L.count_sites(cell).alias("n_sites"))


_CLASS = "(VALUES " + ", ".join(f"('{letter}', '{name}')" for name, letters in {"hyd": "AVLIMFWY", "pol": "GSTCNQP", "neg": "DE", "pos": "KRH"}.items() for letter in letters) + ")"


@query(f"""WITH {RESIDUES}, n AS (SELECT CASE WHEN pos % 7 = 3 THEN 'X' ELSE aa END AS a, lead(aa) OVER (PARTITION BY chain ORDER BY pos) AS b FROM res)
SELECT a, b, count(*) AS n, CASE WHEN a = b THEN 1.0 WHEN a = 'X' OR b = 'X' THEN 0.6 WHEN x.c = y.c THEN 0.7 ELSE 0.0 END::DOUBLE AS pair_weight FROM n LEFT JOIN {_CLASS} x(l, c) ON x.l = a LEFT JOIN {_CLASS} y(l, c) ON y.l = b GROUP BY a, b, x.c, y.c""")
def pair_weights(spark, sf_dir):
    """Neighbouring letters of chains, some unknown, with how far they may stand for each other; the last letter of a chain has no neighbour."""
    r = residues(spark, sf_dir)
    after = r.select("chain", (F.col("pos") - 1).alias("pos"), F.col("aa").alias("b"))
    pairs = r.select("chain", "pos", F.when(F.col("pos") % 7 == 3, "X").otherwise(F.col("aa")).alias("a")).join(after, ["chain", "pos"], "left")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("pair_weight", L.pair_weight(F.col("a"), F.col("b")))


@query("""SELECT l_orderkey, l_linenumber, [l_partkey::INT, l_suppkey::INT] AS sites, list_sort(list_distinct(['ECO:' || l_suppkey::VARCHAR, 'ECO:' || (l_partkey % 10)::VARCHAR])) AS codes,
CASE WHEN l_returnflag = 'R' THEN 'not found' WHEN l_returnflag = 'A' THEN 'not found' ELSE l_linenumber::VARCHAR || '.1' END AS code FROM lineitem""")
def site_texts(spark, sf_dir):
    """Positions and evidence codes of site texts, and the first code of lists of codes."""
    li = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = F.concat(F.lit("ACT_SITE "), part, F.lit('; /evidence="ECO:'), supp, F.lit("|ECO:"), (F.col("l_partkey") % 10).cast("string"), F.lit('"; ACT_SITE   '), supp, F.lit('; /evidence="ECO:'), supp, F.lit('"; SITE 4'))
    codes = F.when(F.col("l_returnflag") == "R", "NaN").when(F.col("l_returnflag") == "A", " ; 1.2").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(".1 ; 2.2")))
    return li.select("l_orderkey", "l_linenumber", L.sites_in_text(text).alias("sites"), L.evidence_codes(text).alias("codes"), L.first_code(codes).alias("code"))


@query(_GRID + """, w AS (SELECT tau, sum(CASE WHEN tp + fp > 8 THEN w ELSE 0 END) / sum(w) AS over_8, sum(CASE WHEN tp + fp > 15 THEN w ELSE 0 END) / sum(w) AS over_15 FROM per GROUP BY tau), m AS (SELECT s.*, over_8, over_15 FROM s JOIN w USING (tau)),
fits AS (SELECT 'strict' AS budget, * FROM m WHERE avg_pred <= 3 AND p95_pred <= 12 AND over_8 <= 0.10 UNION ALL SELECT 'discover', * FROM m WHERE avg_pred <= 8 AND p95_pred <= 25 AND over_8 <= 0.30 UNION ALL SELECT 'wide', * FROM m WHERE avg_pred <= 15 AND p95_pred <= 35 AND over_15 <= 0.30)
SELECT budget, round(tau, 9) AS tau, round(recall, 6) AS recall, round(avg_pred, 6) AS avg_pred FROM fits QUALIFY row_number() OVER (PARTITION BY budget ORDER BY recall DESC, avg_pred, tau DESC) = 1""")
def budget_points(spark, sf_dir):
    """Thresholds that keep the budgets of candidates, on the quantile grid."""
    r = residues(spark, sf_dir).withColumn("score", F.col("score") / 110000.0)
    taus = [t["tau"] for t in sweep.threshold_grid(r, "score", 400, [0.35, 0.50, 0.65, 0.26, 0.0612]).collect()]
    return rounded(sweep.budget_points(sweep.threshold_sweep(r, taus, over=(8, 15))), "tau").withColumn("tau", F.round("tau", 9))


@query("""SELECT o_orderkey, 'x}{"' || o_orderpriority || '\\[' AS note, o_orderkey % 3 AS part, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer FROM orders""")
def record_dump(spark, sf_dir):
    """Orders written as JSON objects after one another, some with line ends and lists between them, and read back."""
    o = table(spark, sf_dir, "orders")
    note = F.concat(F.lit('x}{"'), "o_orderpriority", F.lit("\\["))
    record = F.to_json(F.struct("o_orderkey", note.alias("note"), F.struct((F.col("o_orderkey") % 3).alias("part"), F.array(F.lit("]"), F.lit("}")).alias("odd")).alias("more"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("customer")))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("[ "), record, F.lit(" , 4, \"{\" ]\n"))).when(F.col("o_orderkey") % 7 == 1, F.concat(record, F.lit("\n\t"))).otherwise(record)
    path = f"{shared_dir(spark)}/chainloom-dump-{uuid.uuid4().hex}"
    o.select(text).write.option("lineSep", " ").text(path)
    return dumps.read_records(spark, path, "o_orderkey:long, note:string, more:struct<part:long>, customer:long").select("o_orderkey", "note", "more.part", "customer")


@query("""SELECT c_name AS id, (c_custkey % 4)::INT AS n, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey::DOUBLE END AS first, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_nationkey + c_custkey % 4 - 1)::DOUBLE END AS last FROM customer""")
def store_round_trip(spark, sf_dir):
    """Arrays of customers written to a store of ragged arrays and read back by ranges."""
    c = table(spark, sf_dir, "customer")
    n = (F.col("c_custkey") % 4).cast("int")
    values = F.when(n > 0, F.sequence(F.col("c_nationkey").cast("long"), F.col("c_nationkey").cast("long") + n - 1)).otherwise(F.array().cast("array<bigint>"))
    path = f"{shared_dir(spark)}/chainloom-store-{uuid.uuid4().hex}"
    stores.write_store(c.select(F.col("c_name").alias("id"), values.cast("array<float>").alias("values")), path, part_bytes=1 << 20)
    return stores.read_store(spark, path).select("id", F.size("values").alias("n"), F.get("values", 0).cast("double").alias("first"), F.try_element_at("values", F.lit(-1)).cast("double").alias("last"))


@query("""WITH g AS (SELECT DISTINCT p_brand AS base, p_name AS line FROM part), n AS (SELECT base, count(*) AS n FROM g GROUP BY base HAVING count(*) >= 3) SELECT base, n, line FROM n JOIN g USING (base)""")
def group_files(spark, sf_dir):
    """A file of part names for each brand with three or more, read back by the index."""
    path = f"{shared_dir(spark)}/chainloom-groups-{uuid.uuid4().hex}"
    stores.write_groups(table(spark, sf_dir, "part"), "p_brand", "p_name", path, least=3)
    return stores.read_groups(spark, path).select("base", "n", "line")


_STEPS = """e AS (SELECT user_id AS item, event_id AS "at", md5((value > 80)::VARCHAR) AS hash, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status FROM events),
l AS (SELECT *, last_value(CASE WHEN status IS NULL THEN hash END IGNORE NULLS) OVER (PARTITION BY item ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM e),
r AS (SELECT *, lag(coalesce(status, 'new')) OVER (PARTITION BY item ORDER BY "at") AS before FROM l WHERE status IS NULL OR hash = known)"""


@query(f"""WITH {_STEPS} SELECT item, "at", CASE WHEN known IS NULL THEN 'new' WHEN known <> hash THEN 'changed' ELSE 'again' END AS reason FROM r WHERE status IS NULL AND (known IS NULL OR known <> hash OR before = 'failed')""")
def due_items(spark, sf_dir):
    """What is due of each user's events: contents that are new or changed, and those whose last outcome is a failure."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    steps = e.select(F.col("user_id").alias("item"), F.col("event_id").alias("at"), F.md5((F.col("value") > 80).cast("string").cast("binary")).alias("hash"), status.alias("status"))
    return worklist.due(steps, "item").select("item", "at", "reason")
