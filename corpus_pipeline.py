"""The corpus pipeline: quality rules, near-dedup, secret scans, source mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm import decision_lists, mixing, queries, secrets, simhash, unigram
from chainloom.llm.common import documents, ship_code
from chainloom.plans.materialize import written

#: Bytes of rows that go to a Python worker at once. Spark's own limit is 64 MB, which a task holds several times over, in the JVM and in its worker.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """Code for the workers, and Arrow batches of BATCH_BYTES at most; a smaller limit that the session has stays.

    The limit is a setting of the session, since stages are run after they are returned; it changes how rows are cut into batches, never the rows.
    """
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    at_most = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if not 0 < at_most <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the learned rules. Null and empty texts fail; repeated rows stay or go together."""
    prepared(spark)
    rules = decision_lists.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_lists.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and of texts with a five-word similarity of 0.8 or more.

    Candidates come from the trie join over several fingerprints of shorter shingles; each link is confirmed by the exact similarity. Rows without an id stay.
    """
    prepared(spark)
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and their length anew; null texts stay null."""
    prepared(spark)
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights; null ones are a value of their own."""
    prepared(spark)
    return mixing.sample(docs, queries.form(), queries.POWER, sweeps=queries.SWEEPS, seed=queries.SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_fallback, round_trip) of what is left, one row per row; null and empty texts have no ids."""
    prepared(spark)
    return unigram.encode(docs, queries.model_path())


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("source mixing", source_mixing), ("SentencePiece tokens", tokens)]
#: SQL has no SimHash and no unigram lattice; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
