"""The corpus pipeline: from ``documents`` to packed sequences, in stages that are each written and read back.

Toxicity and language identification drop the rows that they reject, MinHash keeps one document of each group of
near-copies (five-word shingles, similarity of 0.8 or more), suffix-array dedup cuts repeated passages out of the texts
that are left, and packing lays their tokens into sequences. All stages but the last return the columns that they were
given. A stage judges what its predecessor kept; labels come from the tables of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhound.llm import op3_minhash, op4_suffix_array, op7_packing, op8_toxicity, op9_language
from trailhound.llm.common import discard, stored, table

SHINGLE = 5
PERCENT = 80
#: Words of a passage that may not occur twice: over 50.
PASSAGE = 51
#: Words that a worker keeps encoded while it packs: fewer than the operator's own, for what the other stages hold beside them.
REMEMBERED = 250_000


def apart(docs: DataFrame) -> DataFrame:
    """``row`` with all columns but the text, beside ``doc_id`` and ``text``: no name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the clause grammar, learned from ``labels``, does not call toxic. Empty and null texts stay."""
    model = op8_toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return together(op8_toxicity.score(apart(docs), model).filter("predicted = 0"), docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language; those without a letter, and those scored below the calibrated threshold, go."""
    model = op9_language.learn(docs)
    return together(op9_language.predict(apart(docs), model).filter("not rejected"), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-copies; repeated rows count as copies.

    A row goes by its own text, also where its id stands on other texts as well. Rows without an id stay.
    """
    groups = op3_minhash.near_duplicates(docs, SHINGLE, PERCENT)
    found = stored(groups.filter("doc_id is not null"), "found")
    discard(*groups.behind)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    repeated = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    own = op3_minhash.text_hash()
    kept = docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (own == F.col("gone_hash")), "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(
            kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every passage of over 50 words or of 400 bytes that occurs elsewhere cut out of all texts that hold it.

    Bytes catch what has few spaces; words, whatever their length, the rest.
    """
    return op4_suffix_array.without_repeats(docs, word_span=PASSAGE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their ids, and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return op7_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True,
                            remembered=REMEMBERED, forget=True)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
