"""Winnowing, BPE, packing, sharding and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import near_groups, without_passages
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trailhound.llm import op2_winnow, op5_bpe, op7_packing, op10_sharding

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
CODEC = op5_bpe.Codec(op5_bpe.read_vocabulary(VOCABULARY))
ODD = [(1, None), (2, ""), (2, ""), (3, "a"), (4, "é漢🙂 " * 40), (5, "z" * 30_000), (None, "no id"), (7, "tie"), (8, "tie")]


def slow_marks(text, k, window):
    """Kept positions by looking at every window."""
    k = min(k, len(text))
    start = np.arange(len(text) - k + 1) if text else np.zeros(0, int)
    prefix = op2_winnow.prefix_hash(op2_winnow.code_points(text))
    hashes = (op2_winnow.cut_hash(prefix, start, start + k) >> np.uint64(20)).tolist() if text else []
    window = min(window, len(hashes))
    return sorted({max(range(i, i + window), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - window + 1)} if hashes else set())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé", max_size=120))
def test_windows_keep_the_rightmost_minimum(text):
    assert op2_winnow.winnow(op2_winnow.code_points(text), 4, 6)[1].tolist() == slow_marks(text, 4, 6)


def test_long_texts_are_cut_in_overlapping_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("ab", k=3000))
    whole = op2_winnow.winnow(op2_winnow.code_points(text), 5, 8)[1].tolist()
    monkeypatch.setattr(op2_winnow, "PIECE", 64)
    assert op2_winnow.winnow(op2_winnow.code_points(text), 5, 8)[1].tolist() == whole == slow_marks(text, 5, 8)


def test_edits_come_from_the_next_document(spark, make_docs):
    rng = random.Random(3)
    texts = {i: "".join(rng.choices("abcdef éx", k=rng.randint(0, 200))) for i in rng.sample(range(500), 60)}
    rows = {r["doc_id"]: r for r in op2_winnow.with_edits(make_docs(texts.items()), ranges=9).collect()}
    order = sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    for here, after in zip(order, order[1:] + order[:1]):
        text, n = texts[here], len(texts[here])
        edited = text[: n - n // 3] + texts[after][: n // 3]
        got = rows[here]
        assert (got["n_chars"], got["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        marks = [set(op2_winnow.winnow(op2_winnow.code_points(t))[0].tolist()) for t in (text, edited, texts[after])]
        like = [len(marks[0] & m) / len(marks[0] | m) if marks[0] | m else 1.0 for m in marks[1:]]
        assert [got["near_edited"], got["near_next"]] == pytest.approx(like)


def test_winnow_edges(spark, make_docs):
    docs = make_docs(ODD).withColumn("guest", F.lit("clash"))
    rows = op2_winnow.with_edits(docs).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert op2_winnow.with_edits(docs.limit(0)).collect() == []
    assert len(op2_winnow.with_edits(docs.filter("doc_id = 4")).collect()) == 1
    kept = op2_winnow.fingerprints(docs.withColumn("hashes", F.lit(1))).collect()
    assert len(kept) == len(ODD) and all(len(r["hashes"]) == len(r["positions"]) for r in kept)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(text):
    ids = CODEC.encode(text).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "aab" * 3000, "<|endoftext|>x<|endoftext|>", "I'll  don't\n\n 12ab", "\u0000�"])
def test_bpe_on_long_words_and_special_tokens(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip_and_edges(spark, make_docs):
    docs = make_docs(ODD).withColumn("ids", F.lit("clash"))
    rows = op5_bpe.digests(docs, VOCABULARY).collect()
    assert len(rows) == len(ODD)
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] == 1] == [
        (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())]
    by_text = {r["doc_id"]: r for r in rows}
    for i, t in dict(ODD).items():
        if sum(j == i for j, _ in ODD) == 1:
            ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
            want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
            assert (by_text[i]["n_tokens"], by_text[i]["ids_sha256"], by_text[i]["decoded_sha256"]) == want
    back = op5_bpe.decode(op5_bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert op5_bpe.digests(docs.limit(0), VOCABULARY).collect() == []


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == capacity for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r["start"]: r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= capacity
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = op7_packing.pack(docs, VOCABULARY).collect()
    used = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 1024)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_edges(spark, make_docs):
    docs = make_docs([(i, t) for i, t in ODD if i not in (2, None)] + [(None, "no id")])
    rows = op7_packing.pack(docs, VOCABULARY, capacity=16).collect()
    check_packing(rows, {i: t for i, t in ODD if i not in (2, None)} | {None: "no id"}, 16)
    assert len(op7_packing.pack(make_docs([(1, "x"), (1, "x")]), VOCABULARY).collect()) == 2
    assert op7_packing.pack(docs.limit(0), VOCABULARY).collect() == []


def test_packing_shuffles_no_ids(spark, make_docs):
    packed = op7_packing.pack(make_docs(ODD), VOCABULARY, capacity=16, with_ids=True)
    assert all(len(r["ids"]) == r["length"] for r in packed.collect())
    plan = packed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below, found = None, []  # what stands below an exchange is indented further
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :*+-"))
        below = None if below is not None and depth <= below else below
        found += [line] if below is not None and "Scan" in line else []
        below = depth if below is None and "Exchange" in line else below
    assert found and not any("ids#" in line.split("]")[0] for line in found)


def test_workers_forget_words_after_packing(spark, make_docs, tmp_path):
    docs, text, found = make_docs((i, f"word{i} other{i}") for i in range(200)), op5_bpe.read_vocabulary(VOCABULARY), {}
    for forget in (False, True):
        own = tmp_path / f"{forget}.json"
        own.write_text(text + "\n" * (1 + forget))  # not the same text as any other test's: a codec of its own in each worker
        source = own.read_text()

        def held(batches, source=source):
            import pyarrow as pa

            for _ in batches:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([len(op5_bpe.codec_of(source).words)])], ["n"])

        rows = op7_packing.pieces(docs, str(own), forget=forget).select("doc_id", "length", "ids_crc32").collect()
        most = max(r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect())
        found[forget] = (sorted(rows), most > 0)
    assert found[False][0] == found[True][0]
    assert found[False][1] and not found[True][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_places_every_piece(lengths):
    histogram = np.bincount(lengths, minlength=25)
    planned = op7_packing.plan(histogram, 24)
    got = np.zeros(25, int)
    for contents, count in planned:
        assert sum(contents) <= 24
        np.add.at(got, list(contents), count)
    assert (got == histogram).all()
    assert sum(n for _, n in planned) <= -(-sum(lengths) // 24) * 1.25 + 1


def test_shards_follow_the_key_law(spark):
    rows = op10_sharding.op10_sharding(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["grown_shard"] == 16 for r in rows) / len(rows)
    assert 0.02 < moved < 0.1
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"]) if r["shard"] == 3]
    assert ids != sorted(ids)


def test_shards_edges_and_files(spark, make_docs, tmp_path):
    docs = make_docs(ODD).withColumn("shard", F.lit("clash")).withColumn("bucket", F.create_map(F.lit("a"), F.lit(1)))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows = op10_sharding.shuffle_into_shards(docs, "doc_id", size, shards=3, bucket_bytes=100).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(ODD) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, (r["row"]["text"] for r in rows))) == sorted(str(t) for _, t in ODD)
    assert all(r["row"]["shard"] == "clash" and r["row"]["bucket"] == {"a": 1} for r in rows)
    assert op10_sharding.shuffle_into_shards(docs.limit(0), "doc_id", size).collect() == []
    op10_sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", size, shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (r["text"] for r in back.select("row.*").collect()))) == sorted(str(t) for _, t in ODD)


def test_rows_that_are_all_alike_spread_over_buckets(spark):
    df = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("the same").alias("text"))
    rows = op10_sharding.shuffle_into_shards(df, "doc_id", F.octet_length("text"), shards=4, bucket_bytes=600).collect()
    assert {r["shard"] for r in rows} == {rows[0]["shard"]}
    sizes = Counter(r["bucket"] for r in rows)
    assert len(sizes) == 10 and max(sizes.values()) < 450
    assert sorted(r["slot"] for r in rows) == list(range(3000))


def test_shards_stay_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = op10_sharding.shuffled(docs, "doc_id", F.octet_length("text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_copies", "repeated_passages", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(kept)
        if name == "near_copies":
            ids = sorted(kept)
            root = near_groups([kept[i] for i in ids], 5, 80)
            assert sorted(after) == [i for k, i in enumerate(ids) if root[k] == k]
        if name == "repeated_passages":
            ids = sorted(kept)
            assert [after[i] for i in ids] == without_passages([kept[i] for i in ids], 400, 51)
            assert any(after[i] != kept[i] for i in ids)
        docs, kept = out, after
    rows = corpus_pipeline.packing(spark, docs, sf).collect()
    check_packing(rows, kept, 1024)
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == r["length"]
        ids[r["doc_id"]] += r["ids"]
    assert {i: CODEC.decode(np.array(x[:-1], np.int64)) for i, x in ids.items()} == kept


def test_pipeline_edges(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None), (2, "", "en"), (3, "the same words here again and again", "en"),
            (3, "the same words here again and again", "en"), (None, "with no id at all", None),
            (4, "the same words here again and again", "en"), (5, "12 34", "en")] + [
            (10 + i, f"plain text number {i} of the lot with words {i * 7}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"score": F.lit("x"), "rejected": F.lit("y"), "row": F.lit(1), "n": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        for given_docs in (docs, docs.limit(0)):
            out = stage(spark, given_docs, sf)
            assert out.columns == docs.columns
            assert out.count() <= given_docs.count()
    shared = [(1, "one text of six plain words"), (5, "one text of six plain words"), (5, "another text that stands alone here")]
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(shared, "doc_id long, text string"), sf).collect()
    assert sorted(tuple(r) for r in left) == [shared[0], shared[2]]  # a text of its own stays, whatever else its id stands on
    copies = corpus_pipeline.near_copies(spark, docs, sf).filter("doc_id in (3, 4)").collect()
    assert [r["doc_id"] for r in copies] == [3]
    assert corpus_pipeline.packing(spark, docs, sf).count() == len(rows)


def test_pipeline_cuts_passages_of_over_50_words(spark, make_docs):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))
    passage, short = make(55), make(50)
    assert 300 < len(passage) < 400
    ends = [make(40) for _ in range(8)]
    texts = [f"{a} {p} {b}" for p, a, b in zip([passage, passage, short, short], ends[::2], ends[1::2])]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, make_docs(enumerate(texts)), "").collect()}
    assert [got[i] for i in range(4)] == [f"{ends[0]}  {ends[1]}", f"{ends[2]}  {ends[3]}", *texts[2:]]


def test_written_rows_are_not_shuffled_again(spark, make_docs, tmp_path):
    docs = make_docs(enumerate(["a", "b", None]))
    path = str(tmp_path / "shards")
    op10_sharding.write_shards(docs, path, "doc_id", F.lit(1))
    rows = op10_sharding.read_shards(spark, path, docs.schema)
    assert "strategy=broadcast" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 3


def test_plain_sets_split_texts_like_the_pattern():
    near = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for text in ("".join(near), " ".join(near), "".join(f"a{c}1 {c}{c}\n{c} \t" for c in near)):
        assert CODEC.find_plain(text) == CODEC.find_any(text)
    plain = "".join(f"{chr(i)}{chr(j)}x 's'll" for i in range(128) for j in range(128))
    assert CODEC.find_ascii(plain) == CODEC.find_any(plain)
    assert CODEC.find("a \U0001d7d8\U00020000 b") == CODEC.find_any("a \U0001d7d8\U00020000 b") == ["a", " \U0001d7d8", "\U00020000", " b"]
