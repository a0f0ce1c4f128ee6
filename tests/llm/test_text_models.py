"""Language model, toxicity and language identification."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import tokens
from pyspark.sql import functions as F

from trailhound.llm import op1_hmm, op8_toxicity, op9_language
from trailhound.llm.common import STEP_BYTES, STEP_ROWS

SF = "/root/testdata/sf0.001"


def fold(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds


def test_base_score_is_the_smoothed_unigram(spark):
    rows = {r["doc_id"]: r for r in op1_hmm.op1_hmm(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    train = [tokens(r["text"]) for r in docs if fold(r["doc_id"], 10)]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    assert len(rows) == len(docs)
    for r in docs:
        words, got = tokens(r["text"]), rows[r["doc_id"]]
        seen = [counts[w] for w in words] + [len(train)]
        assert got["held_out"] == (fold(r["doc_id"], 10) == 0)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(seen), sum(c > 0 for c in seen), n)
        assert got["base_score"] == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in seen), abs=1e-6)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_forward_and_expected_counts_equal_brute_force():
    rng = np.random.default_rng(0)
    states, symbols = 3, 4
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = op1_hmm.Markov(norm(rng.random((2, states)), 1), norm(rng.random((states, states)), 1),
                           norm(rng.random((symbols, states)), 0))
    lines = [rng.integers(0, symbols, n) for n in (1, 5, 3, 5, 2)]
    offsets = np.cumsum([0, *map(len, lines)])
    group = op1_hmm.Lockstep(np.concatenate(lines), offsets)
    later = np.array([False, True, False, False, True])
    start = model.start[later.astype(int)]
    sums = {"start": np.zeros((2, states)), "move": np.zeros((states, states)), "emit": np.zeros((symbols, states))}
    total = group.expected(model, start, later, sums)
    want = {"start": np.zeros((2, states)), "move": np.zeros((states, states)), "emit": np.zeros((symbols, states))}
    likelihoods = []
    for line, first, late in zip(lines, start, later):
        paths = [(p, np.prod([(first[p[0]] if t == 0 else model.move[p[t - 1], p[t]]) * model.emit[o, p[t]]
                              for t, o in enumerate(line)])) for p in np.ndindex(*[states] * len(line))]
        whole = sum(w for _, w in paths)
        likelihoods.append(math.log(whole))
        for p, w in paths:
            want["start"][int(late), p[0]] += w / whole
            for t, o in enumerate(line):
                want["emit"][o, p[t]] += w / whole
                if t:
                    want["move"][p[t - 1], p[t]] += w / whole
    assert total == pytest.approx(sum(likelihoods))
    assert np.allclose(group.log_likelihood(group.forward(model, start)[1]), likelihoods)
    for name in sums:
        assert np.allclose(sums[name], want[name])


def test_scores_sum_to_one_over_one_word_texts(spark, make_docs, monkeypatch):
    """All known words, and one unseen word for each tail symbol, with the end after any of them."""
    monkeypatch.setattr(op1_hmm, "OWN", 2)
    monkeypatch.setattr(op1_hmm, "KNOWN", 3)
    train = make_docs([(i, t) for i, t in enumerate(["a b c d a a", "a b e a", "b c a"])])
    counts, vocabulary = op1_hmm.learn_words(train)
    shares = vocabulary.shares()
    by_symbol = {}
    for r in counts.collect():
        word = r["word"].encode()
        symbol = vocabulary.words.index(word) if word in vocabulary.words[:2] else 2 + op1_hmm.tail_symbol(word)
        by_symbol.setdefault(symbol, []).append(r["n"])
    for symbol, ns in by_symbol.items():
        mass = sum(ns) + 0.1 * len(ns)
        if symbol >= 2:
            assert vocabulary.tail_mass[symbol - 2] == pytest.approx(mass)
    assert shares.sum() == pytest.approx(1) and (shares > 0).all()


def test_language_model_edges(spark, make_docs):
    docs = make_docs([(1, None), (1, None), (2, ""), (None, "x y"), (3, "a " * 30_000), (4, "A a b")]).withColumn(
        "held_out", F.lit(False)).withColumn("symbols", F.lit("clash"))
    rows = op1_hmm.score(docs, docs, rounds=1).collect()
    assert len(rows) == 6 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    nothing = op1_hmm.score(docs, docs.limit(0), rounds=1).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)
    assert op1_hmm.score(docs.limit(0), docs, rounds=1).collect() == []


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op8_toxicity.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    hits = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hits / sum(labels[r["doc_id"]] for r in rows) > 0.9
    assert hits / sum(r["predicted"] for r in rows) > 0.9


def test_grammar_reads_clauses():
    model = op8_toxicity.Model({"fool": 2.0, "idio*": 3.0})
    clause = lambda text: {k: v for k, v in model.clause(text.split()).items() if v}
    assert clause("what a fool") == {"plain": 2.0}
    assert clause("you are such a fool") == {"aimed": 2.0}
    assert clause("what idiots you are") == {"aimed": 3.0}
    assert clause("you are not a fool") == {"negated": 2.0}
    assert clause("she said that the idiot came") == {"reported": 3.0}
    assert clause("i will kill you") == {"threat": 1.0}
    assert clause("kill the lights in here now please you") == {}
    one, two = (model.features(t) for t in ("fool. fool.", "fool fool."))
    assert one[0] > two[0]
    assert model.features("A not-so-foolish foolery")[1] == 0.0
    assert model.features("") @ np.ones(len(op8_toxicity.FEATURES)) == 0


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(["you fool", "fine day", None, "", "x" * 100_000])]).withColumn(
        "score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0), labels.filter("toxic = 0")):
        rows = op8_toxicity.score(docs, op8_toxicity.learn(docs, given)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert op8_toxicity.score(docs.limit(0), op8_toxicity.Model()).collect() == []


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op9_language.op9_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in docs if fold(r["doc_id"], 5) == 0]
    assert all(rows[r["doc_id"]]["held_out"] for r in held)
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert sum(r["rejected"] for r in rows.values()) / len(rows) < 0.01


def test_language_edges(spark, make_docs):
    rng = random.Random(0)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    train = make_docs([(i, " ".join(word("abcd") for _ in range(20))) for i in range(60)]).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")).withColumn(
        "text", F.when(F.col("lang") == "xx", F.translate("text", "abcd", "stuv")).otherwise(F.col("text")))
    docs = make_docs([(0, None), (1, ""), (2, "12 34 !"), (3, "stuv vuts"), (4, "ABCD dcba"), (None, "dcba"), (5, "漢字")]).withColumn(
        "score", F.lit("clash"))
    got = [(r["text"], r["lang_pred"], r["score"]) for r in op9_language.predict(docs, op9_language.learn(train)).collect()]
    assert {t: p for t, p, _ in got if t != "漢字"} == {
        None: "und", "": "und", "12 34 !": "und", "stuv vuts": "xx", "ABCD dcba": "yy", "dcba": "yy"}
    assert all(0 <= s <= 1 for _, _, s in got)
    blank = op9_language.predict(docs, op9_language.learn(train.limit(0))).collect()
    assert {r["lang_pred"] for r in blank} == {"und"} and all(r["rejected"] for r in blank)
    assert op9_language.predict(docs.limit(0), op9_language.learn(train)).collect() == []


def test_classifiers_hold_little_of_a_batch_at_once(spark, make_docs, monkeypatch):
    docs = make_docs([(0, "x")]).select("doc_id", "text")
    rows = [(i, None if i % 7 == 0 else f"du {i} fool " * (1 + i % 400)) for i in range(3000)]
    ids, values = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["doc_id", "text"])
    weights = np.random.default_rng(0).normal(size=(1 << op9_language.BUCKET_BITS, 3)).astype(np.float32)
    language = op9_language.Model(["de", "en", "fr"], weights, np.zeros(3))
    steps = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: steps.append(run))
    op8_toxicity.score(docs, op8_toxicity.Model({"fool": 2.0}))
    op9_language.predict(docs, language)
    for run in steps:
        out = list(run(iter([batch.slice(0, 0), batch.slice(5, 2990), batch.slice(2995)])))
        assert all(len(x) <= STEP_ROWS and sum(len(t or "") for t in x.column("text").to_pylist()) <= STEP_BYTES for x in out)
        got = [r for x in out for r in x.to_pylist()]
        assert got == [r for i in range(5, 3000) for x in run(iter([batch.slice(i, 1)])) for r in x.to_pylist()]
        assert [(r["doc_id"], r["text"]) for r in got] == rows[5:]
    column = pa.array(["ab cd " * 1000] * 400)  # 2.4 MB
    tracemalloc.start()
    language.scores(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6
