"""Spelling variants by a dictionary of trie-node pairs.

The distinct words are put in order twice, forward and reversed, and the nodes of both tries get numbers on the way: a word
shares with the word before it the nodes of their common beginning and adds new ones for the rest. Each word then stands in the dictionary
under pairs (node of a beginning, node of an ending): once for each character left out between the two, and once for each
place between two characters. Words that meet under a pair differ by one character there: two left-out characters, a
replacement; one left out against nothing, an insertion or deletion. Numbers stand for the very strings, so the neighbours
are exact. A pair leaves one character open, so under it stand at most one word for each letter of the alphabet and the
word without any. Of equal characters in a row only the first may be left out against nothing, so two words meet once.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhound.llm.common import byte_steps, partitions, stored, table
from trailhound.llm.op11_collocations import LOWER, string_array

SHORTEST = 5
LEAST = 3
#: One run in so many loses a character.
DAMAGED = 97
#: A word's form occurs at least so many times as often.
FORM_TIMES = 2
#: Bytes of text that a task looks at in one numpy step, and the rows they may stand in.
STEP = 4 << 20
#: Node numbers that a task gathers before it hands them on; one word's stay together.
HELD = 1 << 20
#: First byte of U+00C0 to U+00FF in UTF-8; a continuation byte follows it.
LATIN = 0xC3


def damaged(word: bytes, crc: int) -> str:
    text = word.decode()
    cut = crc % len(text)
    return text[:cut] + text[cut + 1:]


def word_counts(df: DataFrame, id_col: str, text: str, shortest: int, least: int) -> DataFrame:
    """``word``, ``n``: the words of all texts, some with a character lost by the rule of ``DAMAGED``, that are long and frequent enough."""
    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [zlib.crc32(i.encode() + b":") for i in batch.column("id").to_pylist()]
            for first, last, data, offsets in byte_steps(batch.column("text"), STEP, STEP):
                letter = (LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A)
                lead = data == LATIN
                letter |= lead
                letter[1:] |= lead[:-1]
                rows = offsets[:-1][offsets[:-1] < len(data)]
                begins = letter.copy()
                begins[1:] &= ~letter[:-1]
                begins[rows] = letter[rows]
                start = np.flatnonzero(begins)
                if not len(start):
                    continue
                ends = letter.copy()
                ends[:-1] &= ~letter[1:]
                tails = offsets[1:][offsets[1:] > 0] - 1
                ends[tails] = letter[tails]
                lengths = np.flatnonzero(ends) + 1 - start
                coded = string_array(LOWER[data], letter, lengths).dictionary_encode()
                size = len(coded.dictionary)
                row = np.searchsorted(offsets, start, side="right") - 1
                pair, counts = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(pair, size)
                plain = coded.dictionary.cast(pa.binary()).to_pylist()
                crcs = np.fromiter((zlib.crc32(plain[w], seeds[first + r]) for r, w in zip(row.tolist(), word.tolist(), strict=True)),
                                   np.int64, len(pair))
                hit = crcs % DAMAGED == 0
                kept = np.bincount(word[~hit], counts[~hit], size).astype(np.int64)
                lost: Counter[str] = Counter()
                for w, crc, n in zip(word[hit].tolist(), crcs[hit].tolist(), counts[hit].tolist(), strict=True):
                    lost[damaged(plain[w], crc)] += n
                found = np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(found)), pa.array(kept[found])], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(lost), pa.string()), pa.array(list(lost.values()), pa.int64())],
                                                 ["word", "n"])

    parts = texts.mapInArrow(run, "word string, n long").filter(F.char_length("word") >= shortest)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def trie_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """``word`` and ``name``: for each beginning of its ``key``, shortest first, the number of that beginning's node.

    Tasks number the nodes of their own range of keys. The first keys of a range may share beginnings with ranges before
    it; the driver sees a row for each range (first and last key, nodes of the last) and passes those numbers on.
    """
    spark = words.sparkSession
    ordered = words.select("word", key.alias("key")).repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, before, nodes = TaskContext.get().partitionId(), 0, "", []
        for batch in batches:
            keys, out, bounds, first = batch.column("key").to_pylist(), [], [0], 0
            for at, k in enumerate(keys):
                shared = len(os.path.commonprefix((before, k)))
                new = len(k) - shared
                nodes = nodes[:shared] + list(range(made + 1, made + new + 1))
                made += new
                before = k
                out += nodes
                bounds.append(len(out))
                if len(out) >= HELD or at + 1 == len(keys):
                    rows = len(bounds) - 1
                    yield pa.RecordBatch.from_arrays([
                        batch.column("word").slice(first, rows), batch.column("key").slice(first, rows), pa.array([part] * rows, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int64()))], ["word", "key", "part", "nodes"])
                    out, bounds, first = [], [0], at + 1

    local = stored(ordered.mapInArrow(run, "word string, key string, part int, nodes array<long>"), "nodes")
    ranges = local.groupBy("part").agg(F.min("key").alias("first"), F.max(F.struct("key", "nodes")).alias("last")).orderBy("part")
    before, nodes, base, carried = "", [], 0, []
    for r in ranges.collect():
        shared = len(os.path.commonprefix((before, r["first"])))
        carry = nodes[:shared]
        carried.append((r["part"], base, carry))
        before, made = r["last"]["key"], r["last"]["nodes"]
        nodes = [carry[x - 1] if x <= shared else base + x for x in made]
        base += made[-1]
    starts = spark.createDataFrame(carried, "part int, base long, carry array<long>")
    number = F.transform("nodes", lambda x: F.when(x <= F.size("carry"), F.get("carry", x.cast("int") - 1)).otherwise(x + F.col("base")))
    return local.join(starts, "part").select("word", number.alias(name))


def numbered(words: DataFrame) -> DataFrame:
    """``id`` (a number that orders as the word does), ``word``, ``n``, ``head`` and ``tail``: node numbers by length of beginning and ending."""
    forward, backward = trie_nodes(words, F.col("word"), "head"), trie_nodes(words, F.reverse("word"), "tail")
    joined = words.join(forward, "word").join(backward, "word")
    return joined.select(F.element_at("head", -1).alias("id"), "word", "n", "head", "tail")


def pair_dictionary(words: DataFrame) -> DataFrame:
    """``p``, ``s``: nodes of a beginning and an ending; ``id``, ``n``; ``kind``: 0 nothing between them, 1 a character, 2 one that may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            heads, tails = (batch.column(c).flatten().to_numpy() for c in ("head", "tail"))
            code = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            length = batch.column("head").value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(length) - length
            for between in (0, 1):  # places between characters, then the characters themselves
                each = length + 1 - between
                word = np.repeat(np.arange(len(length)), each)
                i = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
                rest = length[word] - i - between
                p = np.where(i > 0, heads[start[word] + np.maximum(i, 1) - 1], 0)
                s = np.where(rest > 0, tails[start[word] + np.maximum(rest, 1) - 1], 0)
                kind = np.zeros(len(word), np.int32)
                if between:
                    kind += 1
                    kind[i == 0] = 2
                    kind[1:][code[1:] != code[:-1]] = 2
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, s, ids[word], counts[word], kind)], ["p", "s", "id", "n", "kind"])

    return words.select("id", "n", "word", "head", "tail").mapInArrow(run, "p long, s long, id long, n long, kind int")


def neighbours(words: DataFrame) -> DataFrame:
    """``id``, ``n_near``, and of the near word of largest count ``near_id`` and ``near_n``."""
    # at most one row a letter and one more: the pair leaves a single character open
    groups = pair_dictionary(words).groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("rank"), "id", "kind"))).alias("rows")).filter(F.size("rows") > 1)
    each = groups.select("rows", F.explode("rows").alias("x"))
    near = F.filter("rows", lambda y: (y["id"] != F.col("x.id")) & (
        ((F.col("x.kind") > 0) & (y["kind"] > 0)) | ((F.col("x.kind") == 0) & (y["kind"] == 2))
        | ((F.col("x.kind") == 2) & (y["kind"] == 0))))
    met = each.select(F.col("x.id").alias("id"), near.alias("near")).filter(F.size("near") > 0).select(
        "id", F.size("near").alias("found"), F.struct(F.get("near", F.lit(0))["rank"].alias("rank"),
                                                      F.get("near", F.lit(0))["id"].alias("id")).alias("best"))
    return met.groupBy("id").agg(F.sum("found").alias("n_near"), F.min("best").alias("best")).select(
        "id", "n_near", F.col("best.id").alias("near_id"), (-F.col("best.rank")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``id``, ``root``: the end of the forms from ``id`` on; ``forms``: id, form. Each round doubles the steps taken.

    A form is twice as frequent as its word, so a chain has no more steps than the largest count has bits.
    """
    links = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = stored(links.join(on, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = joined.select("id", "root")
        if joined.filter("moved").isEmpty():
            return links


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``shortest`` code points and ``least`` occurrences.

    Null and empty texts have no words, an empty table gives no rows; a null id counts as empty text in the rule that
    takes characters out. Repeated rows count again. Texts and words of any length are taken whole. Of near words with
    equal counts the first in code-point order is the form. Only the two named columns are read.
    """
    words = stored(word_counts(df, id_col, text, shortest, least), "words")
    known = stored(numbered(words), "numbered")
    near = stored(neighbours(known), "near")
    formed = near.join(known.select("id", "n"), "id").filter(
        F.col("near_n") >= FORM_TIMES * F.col("n")).select("id", F.col("near_id").alias("form"), F.col("near_n").alias("form_n"))
    forms = stored(formed, "forms")
    named = lambda column: known.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"))
    ends = forms.join(roots(forms), "id").join(named("form"), "form").join(named("root"), "root")
    found = ends.select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    return known.join(near.select("id", "n_near"), "id", "left").join(found, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("form_n").cast("long").alias("form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``documents``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The same rows with patterns of words less a character, and CRC-32 folded byte by byte.
ORACLE = """
with recursive steps as (
  select i as byte, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as value
  from (select unnest(range(256)) as i)),
crc_table as (select list(value order by byte) as t from steps),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
counted as (select doc_id, run, count(*) as times from runs group by all),
hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, (unicode(c) - 64)::bigint] end))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from counted, crc_table),
final as (
  select case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, times
  from hashed),
words as (select word, sum(times)::bigint as n from final where length(word) >= 5 group by word having sum(times) >= 3),
skips as (
  select word, n, i, substring(word, 1, i) as head, substring(word, i + 2) as tail
  from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word, b.word as other, b.n as other_n from skips a join skips b using (i, head, tail) where a.word <> b.word
  union select a.word, w.word, w.n from skips a join words w on w.word = a.head || a.tail
  union select w.word, a.word, a.n from skips a join words w on w.word = a.head || a.tail),
near as (select word, count(*) as n_near, max(other_n) as near_n from pairs group by word),
first_near as (select p.word, min(p.other) as form, any_value(near_n) as near_n, any_value(n_near) as n_near
  from pairs p join near using (word) where p.other_n = near_n group by p.word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then form end as form,
    case when near_n >= 2 * w.n then near_n end as form_n
  from words w left join first_near using (word)),
chain as (
  select word, word as at, form as next from formed
  union all select c.word, f.word, f.form from chain c join formed f on f.word = c.next)
select f.word, f.form, c.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join chain c on c.word = f.word and c.next is null
"""
