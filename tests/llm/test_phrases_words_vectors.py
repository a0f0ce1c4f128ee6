"""Collocations, spelling variants and nearest neighbours against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailhound.llm import op11_collocations, op12_spelling, op13_neighbours


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, longest, top):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i: i + size]))
                    counts[key] = counts.get(key, 0) + 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i: i + len(x)] == x for i in range(len(y) - len(x) + 1))
    found = []
    for (lang, words), a in candidates.items():
        if any(m == lang and len(other) > len(words) and inside(words, other) and b >= a for (m, other), b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, " ".join(words), a, left, right, sizes[lang], score))
    out = []
    for lang in sizes:
        best = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(lang, i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(out)


def phrase_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "cat", "dog", "new", "york", "city", "ß", "x" * 3000, "a\x00b"]
    fixed = ["new york city", "New York", "the the the the", "of\tthe  dog", "cat, dog", "cat\ndog", "über cat dog new york city hall"]
    rows = []
    for _ in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "!\r\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " . , "), ("en", "new york city " * 2000)] * 2


@pytest.mark.parametrize("least, longest, top", [(5, 5, 2000), (20, 4, 7), (2, 2, 50)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, prefix string").repartition(5)
    got = op11_collocations.collocations(df, least=least, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, longest, top)


def test_collocations_with_a_filter_that_lets_all_through(spark, monkeypatch):
    """The filter saves work only: rows are the same when it holds nothing back, and when steps hold a text each."""
    rows = phrase_rows(6)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = plain_collocations(rows, 5, 5, 2000)
    monkeypatch.setattr(op11_collocations, "bit_map", lambda slots: np.full(1 << op11_collocations.FILTER_BITS - 3, 255, np.uint8))
    assert sorted(tuple(r) for r in op11_collocations.collocations(df, least=5).collect()) == want


def test_collocations_of_phrases_with_one_hash(monkeypatch):
    import pyarrow as pa

    langs, texts = pa.array(["en"]), pa.array(["a b a c a b"])
    step = next(op11_collocations.byte_steps(texts))
    tokens = op11_collocations.tokenized(langs, *step)
    tokens.hashes[:] = 7
    at, counts = op11_collocations.grams(tokens, 2, None)
    words = [tokens.words[i].as_py() for i in tokens.ids]
    assert {(words[i], words[i + 1]): n for i, n in zip(at.tolist(), counts.tolist(), strict=True)} == {
        ("a", "b"): 2, ("b", "a"): 1, ("a", "c"): 1, ("c", "a"): 1}


def test_collocations_of_large_counts(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7)],
                                    "lang string, phrase string, size int, a long")
    sizes = spark.createDataFrame([("en", 90 * big)], "lang string, n long")
    row = op11_collocations.scored(phrases.filter("size > 1"), phrases, sizes).first()
    assert row["score"] == 1000 * (big - 1) * 90 * big // (big * (big + 7))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert op11_collocations.collocations(empty).collect() == []
    assert op11_collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).collect() == []


def plain_words(rows, shortest=5, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, out = {}, []
    for w, n in words.items():
        others = [(-words[v], v) for v in words if v != w and near(w, v)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
        out.append((w, form[w], n, len(others), -best[0] if form[w] else None))
    final = []
    for w, f, n, k, fn in out:
        root = w
        while form[root]:
            root = form[root]
        final.append((w, f, root, n, k, fn))
    return sorted(final, key=str)


def word_rows(seed=9):
    rng = random.Random(seed)
    letters, words = "abcéÿ×", []
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
        words += [w, w, w.upper()]
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w + w[-1]]))
    words += ["mmmmm"] * 24 + ["mmmmn"] * 8 + ["mmmpn"] * 2  # a form of a form
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaab"] * 3 + ["ÀÉÎÕÜ", "àéîõü"] * 4 + ["b" * 4000, "b" * 4001] * 4
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "1", ". ", "Ā", "ı"]) for _ in range(40))) for i in range(120)]
    return rows + [(None, "aaaaa aaaaaa"), (None, None), (3, ""), (3, "ß÷zzzz"), (200, "1 2 3")]


def test_spelling_equals_brute_force(spark):
    rows = word_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = op12_spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain_words(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_spelling_pairs_meet_once_and_groups_stay_small(spark):
    words = sorted({w for r in plain_words(word_rows()) for w in [r[0]]})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = op12_spelling.pair_dictionary(op12_spelling.numbered(df))
    assert pairs.groupBy("p", "s").count().agg(F.max("count")).first()[0] <= 10  # nine letters and the word without any
    assert pairs.filter("kind = 0").groupBy("p", "s").count().filter("count > 1").isEmpty()


def test_trie_nodes_name_beginnings_across_ranges(spark):
    words = sorted({"".join(w) for w in np.random.default_rng(2).choice(list("abé"), (400, 7))} | {"a", "ab", "é" * 3000})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for key, turned in ((F.col("word"), lambda w: w), (F.reverse("word"), lambda w: w[::-1])):
        named = {}
        for r in op12_spelling.trie_nodes(df, key, "nodes").collect():
            word = turned(r["word"])
            assert len(r["nodes"]) == len(word)
            for i, node in enumerate(r["nodes"]):
                assert named.setdefault(node, word[: i + 1]) == word[: i + 1]
        assert len(named) == len({turned(w)[: i + 1] for w in words for i in range(len(w))})


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12_spelling.spelling_variants(empty).collect() == []
    assert op12_spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect() == []


def clustered(n=3000, d=12, seed=4):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, d))
    vectors[: n // 3] = vectors[0]  # a third of all rows is one vector
    vectors[n // 3: n // 2] = vectors[1] + rng.normal(size=(n // 2 - n // 3, d)) / 50
    vectors[-10:] *= 20
    rng.shuffle(vectors)
    return vectors


def plain_nearest(vectors, ids, queries, k):
    out = []
    for q in queries:
        scores = [(-float((vectors[q] * vectors[j]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]]
        out += [(ids[q], rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vector_frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], "x", 7) for i, v in zip(ids, vectors, strict=True)],
                                 "vec_id long, embedding array<double>, shard string, leaf int").repartition(4)


def test_neighbours_are_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(op13_neighbours, "SHARD_VALUES", 12 * 300)
    monkeypatch.setattr(op13_neighbours, "LEAF", 16)
    monkeypatch.setattr(op13_neighbours, "BLOCK", 16)
    monkeypatch.setattr(op13_neighbours, "LANE", 2)
    monkeypatch.setattr(op13_neighbours, "SAMPLE", 500)
    vectors = clustered()
    ids = list(range(len(vectors)))
    got = op13_neighbours.nearest(vector_frame(spark, ids, vectors), F.col("vec_id") % 20 == 0, factor=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    want = plain_nearest(vectors, ids, range(0, len(ids), 20), 20)
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in rows], [r[3] for r in want], rtol=1e-12)


def test_neighbours_recall_at_the_query_factor(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = pq.read_table(path)
    vectors, ids = np.stack(t["embedding"].to_numpy()).astype(float), t["vec_id"].to_pylist()
    got = {(r["query_id"], r["vec_id"]) for r in op13_neighbours.op13_neighbours(spark, "/root/testdata/sf0.1").collect()}
    want = {(r[0], r[2]) for r in plain_nearest(vectors, ids, [i for i, v in enumerate(ids) if v % 20 == 0], 20)}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_smaller_factor_looks_at_less():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    points = op13_neighbours.lifted(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8)) / 20, 10.0)
    order, nodes = op13_neighbours.grow(points, 16)
    seen = {}
    for factor in (1.0, 0.3):
        best = op13_neighbours.Best(points[:40, :-1], np.full(40, -1), 5, 10.0, np.full(40, -np.inf))
        look, looked = best.look, []
        best.look = lambda which, vectors, ids, look=look, looked=looked: (looked.append(len(which) * len(ids)), look(which, vectors, ids))
        op13_neighbours.search(best, factor, points[order], order, nodes)
        seen[factor] = sum(looked)
    assert seen[0.3] < seen[1.0] < 40 * 2000


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]),
             (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (11, [1.0]), (40, [2.0]), (60, None), (80, [-1.0, 0.0])]
    df = vector_frame(spark, *zip(*cases, strict=True)).unionByName(
        spark.createDataFrame([(None, [1.0, 1.0], "x", 7)], "vec_id long, embedding array<double>, shard string, leaf int"))
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op13_neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert rows == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 4, 0.0), (0, 4, 80, -1.0), (20, 1, 0, 1.0), (20, 2, 3, 1.0),
                    (20, 3, 4, 0.0), (20, 4, 80, -1.0), (40, 1, 11, 2.0), (80, 1, 4, 0.0), (80, 2, 0, -1.0), (80, 3, 3, -1.0), (80, 4, 20, -1.0)]
    assert op13_neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
