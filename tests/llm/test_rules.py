import re

import numpy as np
from pyspark.sql import functions as F

from chainloom.llm import decision_lists, language_id, quality_trees


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts(docs, corpus, none):
    for d in (docs, corpus):
        got = decision_lists.judged(d, decision_lists.DecisionList()).select(*decision_lists.BASE, "base_failed").collect()
        # collect order of a narrow plan is that of the rows
        assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(base(r["text"]) for r in d.select("text").collect())
    assert decision_lists.judged(none, decision_lists.DecisionList()).count() == 0


def test_rules_find_a_planted_conjunction(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(not (a > 0.5 and b < 0.3))) for a, b in rng.random((1500, 2))]
    d = spark.createDataFrame(rows, "a double, b double, y int")
    d = d.select(*[(F.col("a") if f == "symbol_share" else F.col("b") if f == "upper_share" else F.lit(1.0)).alias("__rule_" + f) for f in decision_lists.FEATURES], "y")
    rules = decision_lists.learn(d)
    wrong = d.where(rules.kept().cast("int") != F.col("y")).count()
    assert rules.rules and wrong < 100
    assert decision_lists.learn(d.where("false")).rules == ()


def test_junk_is_rejected_and_clean_text_kept(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = decision_lists.learn_from(docs, labels)
    j = decision_lists.judged(docs, rules).join(labels, "doc_id").where("not base_failed")
    assert j.where("quality = 1 and not kept").count() <= 0.02 * j.where("quality = 1").count()
    assert j.where("quality = 0 and kept").count() <= 0.3 * j.where("quality = 0").count()
    assert decision_lists.keep_good(docs, rules).columns == docs.columns


def test_trees_learn_and_are_flat(docs, none):
    rng = np.random.default_rng(1)
    x = rng.random((2000, 20))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    t = quality_trees.fit_trees(x[:1500], y[:1500])
    assert ((t.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    row = x[1600]
    total = t.start
    for node in t.roots:
        while t.feature[node] >= 0:
            node = t.left[node] + int(row[t.feature[node]] > t.threshold[node])
        total += t.value[node]
    assert abs(1 / (1 + np.exp(-total)) - t.score(row[None])[0]) < 1e-12
    assert quality_trees.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    s = quality_trees.document_statistics(docs)
    assert s.count() == docs.count() and quality_trees.classify(s, t).where("score between 0 and 1").count() == docs.count()
    assert quality_trees.document_statistics(none).count() == 0


def test_quality_on_held_out_rows(spark):
    from chainloom.llm import queries

    sf = "/root/testdata/sf0.01"
    j = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (j.predicted == j.quality).mean() > 0.93


def test_language_network_gradient():
    net = language_id.GatedNetwork(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(97, 101, (5, 9)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(x, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        v = net.p[k][at]
        net.p[k][at] = v + 1e-3
        a = net.gradients(x, y)[0]
        net.p[k][at] = v - 1e-3
        b = net.gradients(x, y)[0]
        net.p[k][at] = v
        assert abs((a - b) / 2e-3 - g[k][at]) < 1e-4


def test_fast_forward_pass_is_the_plain_one():
    net = language_id.GatedNetwork(4)
    x = np.random.default_rng(0).integers(0, 256, (7, language_id.WINDOW)).astype(np.uint8)
    logits = net.states(x) @ net.p["out"] + net.p["bias"]
    want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    assert np.abs(net.probabilities(x).transpose(0, 2, 1) - want).max() < 1e-4


def test_every_byte_is_labelled_once():
    net = language_id.GatedNetwork(3)
    texts = [b"", b"a", b"x" * 64, b"y" * 65, b"z" * 1000]
    prob, marks = language_id.predict(net, texts, most=3)
    assert marks.sum(axis=1).tolist() == [1, 1, 64, 65, 1000] and np.allclose(prob.sum(axis=1), 1, atol=1e-4)


def test_language_on_held_out_rows(spark, docs, none):
    from chainloom.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    langs, net = language_id.train(docs, steps=5)
    out = {r["doc_id"]: r for r in language_id.identify(docs, langs, net).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[5]["lang_pred"] == "und" and out[1]["lang_pred"] in langs
    assert language_id.identify(docs, *language_id.train(none)).where("lang_pred <> 'und'").count() == 0


def test_letters_are_those_of_the_unicode_categories():
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        assert language_id.has_letter(c) == unicodedata.category(c).startswith("L"), hex(ord(c))
    assert not language_id.has_letter("1 ² ½ ① Ⅷ _ !") and not language_id.has_letter(None) and language_id.has_letter("1 é")


def test_folds_are_those_of_crc32(spark):
    import zlib

    from chainloom.llm import queries

    sf = "/root/testdata/sf0.001"
    for op, folds, held in ((queries.op2_language_id, 5, 0), (queries.op8_quality_classifier, 4, 2)):
        rows = op(spark, sf).select("doc_id", "held_out").collect()
        assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)


def test_pooling_is_the_mean_over_all_positions():
    net = language_id.GatedNetwork(3, seed=3)
    texts = [b"hello there", bytes(range(200)) * 2, b"x" * 64]
    prob, marks = language_id.predict(net, texts)
    for t, got, mark in zip(texts, prob, marks, strict=True):
        whole, counts = np.zeros(3), np.zeros(3, dtype=int)
        for a in range(0, len(t), language_id.WINDOW):
            at = max(0, min(a, len(t) - language_id.WINDOW))
            x = np.frombuffer(t[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), dtype=np.uint8)[None]
            logits = net.states(x) @ net.p["out"] + net.p["bias"]
            p = (np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True))[:, 0]
            used = p[a - at : min(len(t) - at, language_id.WINDOW)]
            whole += used.sum(axis=0)
            counts += np.bincount(used.argmax(axis=1), minlength=3)
        assert np.allclose(got, whole / len(t), atol=1e-4) and mark.tolist() == counts.tolist()


def test_statistics_of_documents_are_plain_counts(corpus):
    import math

    for r in corpus.select("text").limit(60).collect():
        t = (r["text"] or "").encode()
        got = dict(zip(quality_trees.FEATURES, quality_trees.statistics(t), strict=True))
        words, lines, n = t.split(), [x for x in t.split(b"\n") if x.strip()], len(t)
        if not n:
            assert not any(got.values())
            continue
        share = lambda ok: sum(map(ok, t)) / n  # noqa: B023, E731
        pairs = [tuple(words[i : i + 2]) for i in range(len(words) - 1)]
        want = {
            "log_bytes": math.log(1 + n), "log_words": math.log(1 + len(words)), "word_bytes": sum(b != 32 for b in t) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)),
            "lower": share(lambda b: 97 <= b <= 122), "upper": share(lambda b: 65 <= b <= 90), "digit": share(lambda b: 48 <= b <= 57), "space": share(lambda b: b == 32), "newline": share(lambda b: b == 10),
            "punctuation": share(lambda b: b in b".,;:?'\"()-"), "symbol": share(lambda b: b in b"#*$%&|<>@^_~=+{}[]\\/"), "high_byte": share(lambda b: b >= 128), "exclamation": share(lambda b: b == 33), "pipe": share(lambda b: b == 124),
            "top_word": max((words.count(w) for w in set(words)), default=0) / max(1, len(words)), "distinct_lines": len(set(lines)) / max(1, len(lines)), "mean_line": n / max(1, len(lines)),
            "byte_entropy": -sum(t.count(b) / n * math.log2(t.count(b) / n) for b in set(t)), "repeated_pair": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, "longest_word": max(map(len, words), default=0),
        }
        assert set(want) == set(got) and all(abs(got[k] - v) < 1e-9 for k, v in want.items()), r


def test_repeated_rows_do_not_multiply_what_is_learned_from(spark):
    d = spark.createDataFrame([(i % 10, f"text {i % 10} " * 5) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    real = quality_trees.fit_trees
    try:
        quality_trees.fit_trees = lambda x, y, **k: (seen.append(len(x)), real(x, y, **k))[1]
        quality_trees.train(quality_trees.document_statistics(d), labels)
    finally:
        quality_trees.fit_trees = real
    assert seen == [10]


def test_rules_hold_on_documents_they_were_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rules = decision_lists.learn_from(known, labels.where("doc_id % 2 = 0"))
    j = decision_lists.judged(known, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good, bad = j.where("quality = 1"), j.where("quality = 0")
    assert good.where("not kept").count() <= 0.05 * good.count() and bad.where("kept").count() <= 0.35 * bad.count()


def test_kept_rows_keep_their_columns_whatever_their_names(docs):
    d = docs.selectExpr("*", "1 as __rule_text", "2 as __rule_n_words", "3 as `a.b`", "4 as text2")
    out = decision_lists.keep_good(d, decision_lists.DecisionList())
    assert out.columns == d.columns and out.where("`a.b` <> 3 or __rule_text <> 1").count() == 0
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in decision_lists.judged(docs, decision_lists.DecisionList()).where("kept").collect())
