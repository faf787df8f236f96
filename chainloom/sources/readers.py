"""Readers of the text and JSON shapes that the data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import run_fields
from ..operators.prefix import row_places
from ..plans.materialize import columns
from .dumps import read_records

METADATA_13 = [f"c{i}" for i in range(1, 14)]


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, lines): records that begin with ">" at a line's start, one row per record."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace(F.col("value"), r"^>|\s+$", "").alias("v")).where("v <> ''")
    lines = F.split("v", r"\r?\n")
    return raw.select("file", lines[0].alias("header"), F.slice(lines, 2, F.size(lines)).alias("lines"))


def residue_rows(blocks: DataFrame, exact: bool = False, integer_positions: bool = False) -> DataFrame:
    """(file, id, pos, chain, resnum, aa, label) of (file, header, lines): lines with four fields and a numeric label.

    exact: four fields and no more. integer_positions: residue numbers with insertion codes are passed over. pos counts kept lines from 0.
    """
    fields = F.transform("lines", lambda x: F.split(F.trim(x), r"\s+"))
    good = lambda f: ((F.size(f) == 4) if exact else (F.size(f) >= 4)) & f[3].try_cast("int").isNotNull() & (f[1].rlike(r"^-?\d+$") if integer_positions else F.lit(True))
    kept = blocks.select("file", F.substring_index(F.trim("header"), " ", 1).alias("id"), F.filter(fields, good).alias("f"))
    return kept.select("file", "id", F.posexplode("f").alias("pos", "f")).select("file", "id", "pos", F.col("f")[0].alias("chain"), F.col("f")[1].alias("resnum"), F.col("f")[2].alias("aa"), F.col("f")[3].cast("int").alias("label"))


def read_annotations(spark: SparkSession, path: str, **options) -> DataFrame:
    """residue_rows() of annotation files."""
    return residue_rows(_blocks(spark, path), **options)


def duplicate_ids(residues: DataFrame) -> DataFrame:
    """(id, files): ids that more than one file has."""
    return residues.select("id", "file").distinct().groupBy("id").agg(F.count("*").alias("files")).where("files > 1")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, accession, header, sequence): the accession of db|ACC|name, else the first token."""
    h = F.substring_index("header", " ", 1)
    acc = F.when(h.rlike(r"^\w+\|[^|]+\|"), F.split(h, r"\|")[1]).otherwise(h)
    return _blocks(spark, path).select("file", acc.alias("accession"), "header", F.regexp_replace(F.array_join("lines", ""), r"\s", "").alias("sequence"))


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, start, aligned): start is the eighth further token of the header, or 0."""
    tokens = F.split(F.trim("header"), " ")
    start = F.coalesce(F.try_element_at(tokens, F.lit(9)).try_cast("int"), F.try_element_at(tokens, F.lit(8)).try_cast("int"), F.lit(0))
    return _blocks(spark, path).select("file", tokens[0].alias("id"), start.alias("start"), F.array_join("lines", "").alias("aligned"))


def a3m_columns(rows: DataFrame) -> DataFrame:
    """(file, id, col, aa, pos): alignment columns with the sequence position they hold; insertions move the position on."""
    letters = F.filter(F.split("aligned", ""), lambda c: c != "")
    each = rows.select("file", "id", "start", F.posexplode(letters).alias("i", "c"))
    w = Window.partitionBy("file", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda cond: F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0))
    out = each.withColumn("col", n(~F.col("c").rlike("[a-z]"))).withColumn("pos", F.col("start") + n(F.col("c").rlike("[A-Za-z]")))
    return out.where(F.col("c").rlike("[A-Z]")).select("file", "id", F.col("col").cast("int").alias("col"), F.col("c").alias("aa"), F.col("pos").cast("int").alias("pos"))


def read_metadata_csv(spark: SparkSession, path: str, schema: str, key: str = "Sequence_ID") -> DataFrame:
    """A CSV with a header, first row of each key in the order of files and, within a file, of blocks and rows; the key column must be there.

    Rows with a null key are one key. An empty file gives no rows.
    """
    if key not in schema:
        raise ValueError(f"{key} is missing")
    rows = spark.read.csv(path, header=True, schema=schema)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(F.struct(*columns(rows)).alias("row"), place.alias("at"))
    return rows.groupBy(F.col("row")[key]).agg(F.min_by("row", "at").alias("row")).select("row.*")


def read_tsv(spark: SparkSession, path: str, columns: list[str], types: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """A table without a header and with forced names (clusters, search hits, fixed-arity metadata); strict: other arities are errors."""
    schema = ", ".join(f"`{c}` {(types or {}).get(c, 'string')}" for c in columns)
    reader = spark.read.option("sep", "\t").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("nullValue", "\x00")
    return reader.csv(path, schema=schema)


HITS = ["qseqid", "sseqid", "pident", "length", "evalue", "bitscore"]
HIT_TYPES = {"pident": "double", "length": "int", "evalue": "double", "bitscore": "double"}


def sniff_table(spark: SparkSession, path: str) -> DataFrame:
    """All strings, read by tab or by comma: what gives more columns."""
    tab, comma = (spark.read.csv(path, header=True, sep=s, inferSchema=False) for s in ("\t", ","))
    return tab if len(tab.columns) >= len(comma.columns) else comma


def read_dictionary_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value): entries of JSON files that hold one object each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def read_record_dump(spark: SparkSession, path: str, schema: str, shape: str) -> DataFrame:
    """Records of a dump: "results" ({results: [...]} or a list), "lines" (one a line) or "joined" (objects after each other); the last two and lists by dumps.read_records()."""
    return spark.read.json(path, schema=schema) if shape == "lines" else read_records(spark, path, schema, shape)


def length_report(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """rows whose arrays differ in length, with `lengths`; a null array has length -1."""
    n = F.array(*[F.coalesce(F.size(c), F.lit(-1)) for c in arrays])
    return rows.withColumn("lengths", n).where(F.size(F.array_distinct("lengths")) > 1)


def ragged_rows(stores: DataFrame, ids: str = "ids", offsets: str = "offsets", values: str = "values", begin: str | None = None) -> DataFrame:
    """(id, values) of ragged stores: row i of a store has the values from offsets[i] up to offsets[i + 1].

    A store may come in pieces, each a row with offsets from 0 of its own; `begin` is then the place of a piece's first value in the whole store, and `at`, that of each row's first value, is added.
    """
    at = [] if begin is None else [lambda i: (F.col(begin) + F.get(offsets, i)).alias("at")]
    cut = F.transform(F.col(ids), lambda x, i: F.struct(x.alias("id"), F.slice(F.col(values), F.get(offsets, i) + 1, F.get(offsets, i + 1) - F.get(offsets, i)).alias("values"), *[f(i) for f in at]))
    return stores.select(F.explode(cut).alias("r")).select("r.*")


def ragged_pieces(rows: DataFrame, store: str, order: str, id_col: str, n: str, piece: int = 4096) -> DataFrame:
    """(store, ids, offsets, begin, size): rows with n values each as stores in pieces of `piece` rows, in the order of a unique number; no store is one row.

    offsets has an entry more than ids and counts from the piece's first value, whose place in the store is begin; size is the number of the piece's values. Rows with a null order are left out; a null n counts as 0.
    """
    cost = rows.select(store, order, F.col(id_col).alias("id"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n"))
    placed = row_places(cost, [store], order, order, descending=False, cost="n")
    r = placed.groupBy(store, F.floor(F.col("place") / piece).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("place", "before", "n", "id"))).alias("r"), F.min("before").alias("begin"), F.sum("n").alias("size"))
    starts = F.transform("r", lambda x: x["before"] - F.col("begin"))
    return r.select(store, F.col("r.id").alias("ids"), F.transform(F.concat(starts, F.array("size")), lambda x: x.cast("int")).alias("offsets"), "begin", "size")


def split_db_rows(stores: DataFrame) -> DataFrame:
    """(split, id, aa, labels, index_map map<int,int>, weight) of stores (split, ids, aa, labels, maps, weights), whose arrays run alongside each other."""
    zipped = F.arrays_zip(F.col("ids"), F.col("aa"), F.col("labels"), F.col("maps"), F.col("weights"))
    return stores.select("split", F.explode(zipped).alias("z")).select("split", F.col("z.ids").alias("id"), F.col("z.aa").alias("aa"), F.col("z.labels").alias("labels"), F.col("z.maps").alias("index_map"), F.coalesce(F.col("z.weights"), F.lit(1.0)).alias("weight"))


def discover_runs(spark: SparkSession, path: str, result: str) -> DataFrame:
    """(run, file, fields map): folders below path that hold a file named `result`, with what their names say; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", result).load(path).select("path")
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select(folder.alias("run"), F.col("path").alias("file"), run_fields(folder).alias("fields"))


def chain_scores(rows: DataFrame, on_mismatch: str = "cut") -> DataFrame:
    """Long rows (pos, label, score) of array columns label and score; longer ones are cut, or rows left out ("drop"); see length_report()."""
    if on_mismatch == "drop":
        rows = rows.where(F.size("label") == F.size("score"))
    n = F.least(F.size("label"), F.size("score"))
    pairs = F.arrays_zip(F.slice("label", 1, n).alias("label"), F.slice("score", 1, n).alias("score"))
    carry = [c for c in rows.columns if c not in ("label", "score")]
    zipped = rows.select(*carry, F.posexplode(pairs).alias("pos", "z"))
    return zipped.select(*carry, "pos", F.col("z.label"), F.col("z.score"))


def union_shards(spark: SparkSession, paths: list[str], schema: str, key: str, shard: str = r"(\d+)") -> DataFrame:
    """JSON shards with their number; of a key that several have, the last shard counts. Missing shards are passed over."""
    rows = spark.read.option("ignoreMissingFiles", "true").json([p for p in paths if _there(spark, p)], schema=schema).withColumn("shard", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), shard, 1).cast("int"))
    return rows.select(F.struct(*columns(rows)).alias("row")).groupBy(F.col("row")[key]).agg(F.max_by("row", F.col("row.shard")).alias("row")).select("row.*")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(stem, out, err) of *.out and *.err files, joined by stem."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value")
    name = F.element_at(F.split("f", "/"), -1)
    raw = raw.select(F.regexp_replace(name, r"\.(out|err)$", "").alias("stem"), F.regexp_extract(name, r"\.(out|err)$", 1).alias("kind"), "value")
    return raw.groupBy("stem").agg(F.max(F.when(F.col("kind") == "out", F.col("value"))).alias("out"), F.max(F.when(F.col("kind") == "err", F.col("value"))).alias("err"))


def first_class_code(desc: Column) -> Column:
    """First code by branch: recommended, alternative, includes, contains, fragments; else "not found".

    Branches are arrays of code arrays, null for names without codes. Of a branch the first name with a code array counts; if that is empty, the next branch does.
    """
    head = lambda b: F.get(F.get(F.filter(desc[b], lambda codes: codes.isNotNull()), 0), 0)
    return F.coalesce(*[head(b) for b in ("recommended", "alternative", "includes", "contains", "fragments")], F.lit("not found"))


def all_class_codes(*arrays: Column) -> Column:
    """All codes of the arrays, trimmed, each once, in order; null arrays have none."""
    joined = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(joined, lambda c: F.trim(c)), lambda c: c != "")))


def record_filter(score: Column, features: Column, least: float = 2, kind: str = "Active site") -> Column:
    """Whether a record is scored above `least` and has a feature of this kind."""
    return (score > least) & F.exists(features, lambda f: f["type"] == kind)


def exact_sites(features: Column, sequence: Column, kind: str = "Active site") -> Column:
    """Sorted distinct (pos, aa, description) of sites of one residue with exact borders."""
    exact = lambda m: F.coalesce(F.upper(m) == "EXACT", F.lit(True))
    one = F.filter(features, lambda f: (f["type"] == kind) & (f["location"]["start"]["value"] == f["location"]["end"]["value"]) & exact(f["location"]["start"]["modifier"]) & exact(f["location"]["end"]["modifier"]))
    return F.array_sort(F.array_distinct(F.transform(one, lambda f: F.struct(f["location"]["start"]["value"].alias("pos"), F.substring(sequence, f["location"]["start"]["value"].cast("int"), F.lit(1)).alias("aa"), f["description"].alias("description")))))


def keep_human_reviewed(taxon: Column, kind: Column, wanted: int = 9606) -> Column:
    """The taxon or none; entry types that begin with "review", or unknown ones."""
    return F.coalesce(taxon == wanted, F.lit(True)) & F.coalesce(F.lower(kind).startswith("review"), F.lit(True))
