"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import shared_dir
from . import chat, decision_lists, language_id, lexical, media, mixing, quality_trees, repair, secrets, sharding, simhash, token_counts, unigram
from .common import documents, ship_code

POWER = {"source": 0.9, "lang": 0.9, "topic": 0.9}
SWEEPS, SEED = 6, 17
SHARDS = 24


def model_path() -> str:
    """The public vocabulary that token counts and encoding are stated for."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def form() -> Column:
    """The topic of a document of these tables, which have no column for it: what kind of page it is, by its form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text == "", "empty").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("@")), "web")
        .when(F.contains(text, F.lit("rights reserved")) | F.contains(text, F.lit("icense")), "legal").when(F.contains(text, F.lit("\n")), "article").otherwise("note")
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, counts and round trip of the unigram encoding of every document. The vocabulary has no probabilities and is not trained here: scores follow Zipf's law of the rank."""
    return unigram.encode(documents(spark, sf_dir), model_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    langs, net = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 5) != 0))
    out = language_id.identify(docs, langs, net)
    return out.select("doc_id", F.coalesce(language_id.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_positions")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability and draw of every document; the topic is the form of the page."""
    return mixing.mix(documents(spark, sf_dir), form(), POWER, sweeps=SWEEPS, seed=SEED)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = documents(spark, sf_dir)
    rules = decision_lists.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_lists.judged(docs, rules)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), model_path())


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; the owner is the source, the repository the document."""
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from three of four folds."""
    stats = quality_trees.document_statistics(documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(language_id.fold(F.col("doc_id"), 4) != 2)
    out = quality_trees.classify(stats, quality_trees.train(stats, labels))
    held = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in an archive, read back and described."""
    return media.media_features(media.stored_media(documents(spark, sf_dir)))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from its output."""
    ship_code(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    messages = rows.unionByName(own).withColumn("parts", chat.text_part(F.col("text")))
    return chat.digest(chat.format_chat(messages))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): conversation rows, some of them dropped, emptied, without their ends, repeated or given to the user, by a checksum of id and turn."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("kind")
    some = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    some = some.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return some.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and the cheapest edits that mend its structure."""
    ship_code(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = repair.digest(repair.edited(damaged(rows)))
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("there")).drop("there").withColumnRenamed("conv_id", "id")
    zeros = {n: F.lit(0).cast("long") for n in ("gaps", *repair.FAULTS, "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *[F.coalesce(n, zero).alias(n) for n, zero in zeros.items()])


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by a slot map that is edited to bytes, and its place within the shard. Law: sizes of shards are near equal."""
    rows = sharding.sharded(documents(spark, sf_dir), SHARDS, f"{shared_dir(spark)}/chainloom-slot-map-{uuid.uuid4().hex}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents after all stages."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sentencepiece, op2_language_id, op3_source_mixing, op4_simhash, op5_quality_rules, op6_token_counts, op7_secret_scans, op8_quality_classifier, op9_media_columns, op10_chat_formatting, op11_conversation_repair, op12_sharding, op13_lexical_search, pipeline)
    return {f.__name__: f for f in ops}


def _mixing_sql() -> str:
    """Raking unrolled: a common table expression for every step."""
    steps = [
        """docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
        CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '://') OR contains(text, '@') THEN 'web'
        WHEN contains(text, 'rights reserved') OR contains(text, 'icense') THEN 'legal' WHEN contains(text, chr(10)) THEN 'article' ELSE 'note' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM docs) AS weight FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    steps += [f"t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {POWER[d]}) / sum(pow(sum(tokens), {POWER[d]})) OVER () AS target FROM w0 GROUP BY {d})" for d in mixing.DIMS]
    n = 0
    for _ in range(SWEEPS):
        for d in mixing.DIMS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * (target / sum(weight) OVER (PARTITION BY {d})) AS weight FROM w{n} JOIN t_{d} USING ({d}))")
            n += 1
    steps.append(f"r AS (SELECT source, lang, topic, (weight / (SELECT sum(weight) FROM w{n})) / (tokens / (SELECT sum(tokens) FROM w{n})) AS ratio FROM w{n})")
    steps.append("p AS (SELECT *, ratio / (SELECT max(ratio) FROM r) AS probability FROM r)")
    return f"""WITH {", ".join(steps)} SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(ratio, 0), 6) AS ratio, round(coalesce(probability, 0), 6) AS probability,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(probability, 0) AS sampled
    FROM docs LEFT JOIN p USING (source, lang, topic)"""


_CHAT_SQL = """WITH m AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role || chr(10) || text || chr(10) AS block, ceil(len(text) / 4)::BIGINT AS tokens, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
len(role) + len(text) + len(regexp_replace(role || text, '[^<[\\\\]', '', 'g')) + len('<|turn|><|says|><|end|>') AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(block, '' ORDER BY turn, role, text)) AS turns_sha256, sum(len(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(tokens)::BIGINT AS n_tokens FROM e GROUP BY conv_id"""


#: CRC-32 of a text in SQL: its table is worked out bit by bit, then bytes are folded over it.
_CRC_TABLE = """crc_bits(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM crc_bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    """Needs crc_table.crcs in reach."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def _sharding_sql() -> str:
    """The pass over slots as a recursion, one step a slot that holds records."""
    return f"""WITH RECURSIVE {_CRC_TABLE},
    recs AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + {sharding.OVERHEAD} AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS key FROM documents, crc_table),
    slots AS MATERIALIZED (SELECT key % {sharding.SLOTS} AS virtual_slot, sum(size)::BIGINT AS bytes, (key % {sharding.SLOTS} % {SHARDS})::INT AS shard, row_number() OVER (ORDER BY sum(size) DESC, key % {sharding.SLOTS}) AS step FROM recs GROUP BY key % {sharding.SLOTS}),
    fold(step, loads, virtual_slot, shard) AS (SELECT 0, (SELECT list(coalesce(b, 0)::BIGINT ORDER BY s) FROM range({SHARDS}) r(s) LEFT JOIN (SELECT shard, sum(bytes) AS b FROM slots GROUP BY shard) ON s = shard), NULL::BIGINT, NULL::INT
    UNION ALL SELECT step, CASE WHEN moves THEN list_transform(loads, lambda x, i: x + CASE WHEN i = light THEN bytes WHEN i = shard + 1 THEN -bytes ELSE 0 END) ELSE loads END, virtual_slot, CASE WHEN moves THEN light - 1 ELSE shard END::INT
    FROM (SELECT s.step, loads, s.virtual_slot, s.bytes, s.shard, list_position(loads, list_min(loads)) AS light, loads[s.shard + 1] * {SHARDS} > list_sum(loads) AND list_min(loads) + s.bytes < loads[s.shard + 1] AS moves FROM fold JOIN slots s ON s.step = fold.step + 1))
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, key, doc_id NULLS FIRST, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, virtual_slot
    FROM recs JOIN fold ON key % {sharding.SLOTS} = virtual_slot"""


_FLAT = "[\\x20\\x09-\\x0D]"


def _repair_sql() -> str:
    """One step a row, for all conversations at once; of each state the cheapest edits so far, of equal ones the least letters. States: 0 nothing, 1 s, 2 u, 3 a."""
    return f"""WITH RECURSIVE {_CRC_TABLE},
    r AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_table),
    d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE kind <> 0)),
    f AS MATERIALIZED (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?]{_FLAT}*\\z') THEN 'truncated' END AS fault FROM d),
    ins(p, q, letters, cost, lines) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']),
        (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 2, 'II', 10, ['assistant:', 'user:']), (3, 3, 'II', 10, ['user:', 'assistant:'])),
    ops(q, s, letter, cost, needs, role) AS (VALUES (0, 0, 'D', 2, NULL, NULL), (1, 1, 'D', 2, NULL, NULL), (2, 2, 'D', 2, NULL, NULL), (3, 3, 'D', 2, NULL, NULL), (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (3, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL),
        (0, 2, 'R', 1, NULL, 'user'), (1, 2, 'R', 1, NULL, 'user'), (3, 2, 'R', 1, NULL, 'user'), (2, 3, 'R', 1, NULL, 'assistant')),
    steps AS MATERIALIZED (SELECT p, s, ins.letters || letter AS letters, letter, ins.cost + ops.cost AS cost, lines, needs, role FROM ins JOIN ops USING (q)),
    walk(conv_id, n, state, cost, audit, lines) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM f
    UNION ALL SELECT conv_id, n, state, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
        SELECT w.conv_id, f.n, t.s AS state, w.cost + t.cost + CASE WHEN f.fault = 'truncated' AND t.letter <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || t.letters AS audit,
        w.lines || t.lines || CASE WHEN t.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(t.role, f.role) || ':' || f.text] END AS lines
        FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN steps t ON t.p = w.state WHERE (t.letter = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (t.needs IS NULL OR t.needs = f.initial))) WHERE best = 1),
    ends AS (SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.letters AS audit, w.lines || i.lines AS lines FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n JOIN ins i ON i.p = w.state WHERE i.q IN (0, 3)
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.letters) = 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


_TERMS_SQL = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
_LEXICAL_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents), q AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
dt AS MATERIALIZED (SELECT r, doc_id, {_TERMS_SQL} FROM d), qt AS MATERIALIZED (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, {_TERMS_SQL} FROM q) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), len AS MATERIALIZED (SELECT r, count(*) AS n FROM dt GROUP BY r), whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM len),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
hits AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all))))::BIGINT AS score FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN len USING (r), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM hits WHERE score > 0 QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": _repair_sql(), "op12_sharding": _sharding_sql(), "op13_lexical_search": _LEXICAL_SQL, "op3_source_mixing": _mixing_sql(), "op10_chat_formatting": _CHAT_SQL}
