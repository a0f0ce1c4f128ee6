"""MinHash, embeddings and suffix-array dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import near_groups, repeated_bytes, roots
from pyspark.sql import functions as F

from trailhound.llm import op3_minhash, op4_suffix_array, op6_embeddings
from trailhound.llm.graph import components
from trailhound.llm.op3_minhash import rows_per_band, sketches
from trailhound.llm.suffixes import base_ranks, suffix_ranks


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocabulary, k=rng.randint(20, 120)) for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for edits in (0, 1, 2, 4, 8):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    big = rng.choices(vocabulary, k=200)
    for _ in range(40):  # one large group of near copies that link in chains
        big = list(big)
        big[rng.randrange(len(big))] = rng.choice(vocabulary)
        texts.append(" ".join(big))
    return texts + [None, "", "  \n", "one", "ONE", "one two", "one two", "Ünï one two", "Ünï ONE two", "x" * 50_000]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, make_docs, size, percent):
    texts = corpus()
    got = {r["doc_id"]: r for r in op3_minhash.near_duplicates(make_docs(enumerate(texts)), size, percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == near_groups(texts, size, percent)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_minhash_edges(spark, make_docs):
    docs = make_docs([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, "A B C D"), (9, None), (None, None)])
    rows = op3_minhash.near_duplicates(docs.withColumn("n", F.lit(1)).withColumn("a", F.lit("x"))).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True, True]
    assert op3_minhash.near_duplicates(docs.limit(0)).collect() == []


def test_minhash_ids_on_several_texts_and_of_any_type(spark, make_docs):
    t, u = " ".join(f"t{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(5, t), (5, u), (9, t + " more"), (11, u + " more")]
    got = {(r["doc_id"], r["component_id"]) for r in op3_minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == {(5, 5), (9, 5), (11, 5)}
    named = make_docs(rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 2, "0")))
    got = {(r["doc_id"], r["component_id"]) for r in op3_minhash.near_duplicates(named).collect()}
    assert got == {("d05", "d05"), ("d09", "d05"), ("d11", "d05")}


def test_long_regular_words_are_told_apart(spark, make_docs):
    """Thue-Morse words collide under any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = op3_minhash.near_duplicates(make_docs([(1, word), (2, other), (3, word)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (2, 2), (3, 1)]


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(3)
    shared, one, other = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    a, b = np.sort(np.concatenate((shared, one))), np.sort(np.concatenate((shared, other)))
    values = np.concatenate((a, b, a[:1], a[:0]))
    out = sketches(values, np.array([0, 800, 1600, 1601, 1601]), 256)
    full = np.uint64((1 << 64) - 1)
    assert (out[:3] != full).all() and (out[3] == full).all()
    assert abs((out[0] == out[1]).mean() - 0.6) < 0.12
    assert (1 - 0.85 ** rows_per_band(85)) ** 40 <= 1e-8


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    want = roots(400, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(200):
        v = base[k % 20] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35, 0.5])
        rows.append((1000 + k, v.astype(np.float32).tolist(), (k % 20) % 3))
    rows += [(2000 + k, rows[0][1], 0) for k in range(30)] + [(2100, (3 * np.array(rows[0][1])).tolist(), 0)]
    rows += [(3000, rows[0][1], None), (3001, None, 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] + [1.0] * 15, 0),
             (3004, [float("inf")] + [1.0] * 15, 0), (3005, [None] + [1.0] * 15, 0), (3006, [], 0), (3007, [1.0] * 4, 0),
             (3008, [1.0] * 4, 0)]
    return rows


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op6_embeddings, "TILE", 16)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(0))
    got = {r["vec_id"]: r for r in op6_embeddings.near_duplicates(frame).collect()}

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)
             if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    root = roots(len(rows), pairs)
    for i, (key, _, _) in enumerate(rows):
        assert got[key]["n_links"] == sum(i in p for p in pairs)
        assert got[key]["component_id"] == rows[root[i]][0]
        assert got[key]["kept"] == (root[i] == i)
    assert op6_embeddings.near_duplicates(frame.limit(0)).collect() == []


def test_suffix_ranks_equal_sorted_suffixes(spark):
    rng = random.Random(11)
    for n in (1, 2, 20, 61, 62, 63):
        names = [rng.choice([1, 1, 2, 3]) for _ in range(n)]
        want = sorted(range(n), key=lambda i: names[i:])
        assert np.argsort(base_ranks(np.array(names))).tolist() == want
        if n > 2:
            frame = spark.createDataFrame(list(enumerate(names)), "pos long, name long").repartition(3)
            ranks = dict(suffix_ranks(frame, n, base_rows=8).collect())
            assert sorted(range(n), key=ranks.get) == want and sorted(ranks.values()) == list(range(n))


def test_suffix_levels_shrink_and_order_many_texts(spark, monkeypatch):
    from trailhound.llm import suffixes

    rng, rows, named = random.Random(3), [], suffixes.named
    monkeypatch.setattr(suffixes, "named", lambda heads, *keys: rows.append(heads.count()) or named(heads, *keys))
    names = [rng.choice([1, 2, 3]) for _ in range(200)] + [4] * 60 + [5, 6] * 40
    ranks = dict(suffix_ranks(spark.createDataFrame(list(enumerate(names)), "pos long, name long"), len(names), base_rows=16).collect())
    assert sorted(ranks, key=ranks.get) == sorted(range(len(names)), key=lambda i: names[i:])
    assert rows and sum(rows) < len(names)  # all levels together
    texts = {(7, 0): names[:90], (7, 95): names[20:70], (9, 0): [4] * 30, (9, 40): [4] * 31, (11, 3): [5, 6] * 9 + [7]}
    frame = spark.createDataFrame([(t, p + i, x) for (t, p), own in texts.items() for i, x in enumerate(own)],
                                  "text long, pos long, name long").repartition(3)
    order, _ = suffixes.suffix_order(frame, frame.count(), base_rows=8)
    suffix = {(t, p + i): own[i:] for (t, p), own in texts.items() for i in range(len(own))}
    got = [suffix.pop((r["text"], r["pos"])) for r in order.collect()]
    assert not suffix and got == sorted(got)


def passages(seed=4):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäé漢 "
    make = lambda n: "".join(rng.choices(letters, k=n))
    shared, other = make(150), make(90)
    texts = [make(rng.randint(0, 300)) for _ in range(12)]
    texts += [make(40) + shared + make(30), shared, make(5) + shared[10:] + make(70), shared[:60] + make(50) + shared[70:]]
    texts += [other + make(20) + other, "ab" * 200, "a" * 150, "a" * 41, None, "", make(300)]
    return texts + [texts[0], texts[-1], texts[-1]]


@pytest.mark.parametrize("base_rows", [1 << 18, 12])
def test_suffix_array_equals_brute_force(spark, make_docs, base_rows):
    texts, span = passages(), 40
    docs = make_docs(enumerate(texts)).withColumn("row_key", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in
           op4_suffix_array.digests(docs, span=span, gram=20, block=4, base_rows=base_rows).collect()}
    assert [got[i] for i in range(len(texts))] == repeated_bytes(texts, span)


def test_suffix_array_edges(spark, make_docs):
    long = "".join(random.Random(1).choices("abcdef ", k=900))
    docs = make_docs([(None, long), (1, long), (1, "é" * 300 + long[:450]), (3, None)])
    cut = op4_suffix_array.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in cut.collect() if r["text"] is not None) == [
        (0, "", 0), (1, "", 0), (1, "", 0)]  # the run of one character repeats within itself
    assert [r["n_chars"] for r in cut.filter("text is null").collect()] == [0]
    assert op4_suffix_array.digests(docs.limit(0)).collect() == []


def repeated_word_bytes(text, texts, span):
    """Flags of the bytes of ``text`` that a string of ``span`` words covers which starts twice in all texts."""
    seen = Counter(tuple(w[i: i + span]) for w in (t.encode().split() for t in texts) for i in range(len(w) - span + 1))
    data = text.encode()
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    gone = [False] * len(data)
    for i in range(len(at) - span + 1):
        if seen[tuple(data[a:b] for a, b in at[i: i + span])] > 1:
            a, b = at[i][0], at[i + span - 1][1]
            gone[a:b] = [True] * (b - a)
    return gone


@pytest.mark.parametrize("base_rows", [1 << 18, 12])
def test_word_spans_equal_brute_force(spark, make_docs, base_rows):
    rng = random.Random(7)
    make = lambda n: rng.choices(["a", "bb", "ccc", "é", "漢字", "delta", "echo", "fox"], k=n)
    shared = make(30)
    texts = [" ".join(make(rng.randint(0, 60))) for _ in range(10)]
    texts += [" ".join(make(9) + shared + make(5)), "\n ".join(shared), " ".join(shared[3:15] + make(9) + shared[17:]), "a " * 90, "", "  "]
    for span in (6, 13):
        got = {r["row"]["doc_id"]: r["spans"] for r in op4_suffix_array.removed_spans(
            make_docs([*enumerate(texts), (99, None)]), span=400, word_span=span, base_rows=base_rows).collect()}
        assert got.pop(99) == []
        for i, text in enumerate(texts):
            gone = [False] * len(text.encode())
            for s in got[i]:
                gone[s["first"]: s["last"]] = [True] * (s["last"] - s["first"])
            assert gone == repeated_word_bytes(text, texts, span)


def test_blocks_link_components_and_not_their_members(spark):
    members = np.arange(100, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(rep, bytearray(members)) for rep in range(40)], "rep long, members binary")
    dealt = spark.createDataFrame([(key, rep, rep % 2, rep // 20, 2) for key in (7, 8) for rep in range(40)],
                                  "key long, rep long, component long, chunk int, chunks int")
    got = op3_minhash.linked_in_blocks(dealt, sets, 85).collect()
    assert {(r["u"], r["v"]) for r in got} == {(1, 0)}
    assert len(got) == 6  # one for each two blocks of a bucket


def test_stored_tables_leave_no_shuffle_files(spark):
    from trailhound.llm.common import CLEANUP, stored

    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, held = spark.conf.get(CLEANUP), shuffles.size()
    rows = stored(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    assert shuffles.size() <= held and rows.count() == 7 and spark.conf.get(CLEANUP) == before
