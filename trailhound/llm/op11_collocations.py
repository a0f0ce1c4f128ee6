"""Phrase collocations by the stripes pattern.

Each prefix of zero to four words keys a stripe: a counter of the words that follow it. Tasks fill stripes from their own
texts, stripes of one prefix meet and are added word by word, and everything is read off the sum: a phrase's extensions
are the words of its stripe, its total is its counter in the stripe of the words before its last one, a language's word
count is the sum of the stripe of no words, and what subsumes a phrase is the largest counter of its own stripe and the
largest of all entries that end in it.

Stripes are filled by length. A phrase cannot be more frequent than a part of it, so a task fills a stripe only for a
prefix, and only with a word, whose phrases of one word less pass a filter of all frequent ones. The filter is a bit map of
fixed size: it lets some rare phrases through, which the exact counts then drop, and never holds a frequent one back.
For two words or more only the stretches of text are read, from a stored table, whose word pairs all pass a filter of frequent
pairs, which is made from counts of their hashes. The stripe of a heavy prefix is cut into segments by the hash of its words,
so that many tasks add it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailhound.llm.common import BASE, byte_steps, cut_hash, discard, mix, prefix_hash, stored, table, tidied

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bytes of text whose stripes a task fills at once, and the rows they may stand in.
STEP = 8 << 20
#: Bytes of text whose frequent stretches a task looks for at once: nothing is summed there, so that small steps cost no rows.
STRETCH_STEP = 1 << 20
#: Bits of a filter as a power of two, of one row of it, and of the numbers that pairs are counted by.
FILTER_BITS = 26
CHUNK_BITS = 15
SLOT_BITS = 40
#: Segments of the stripe of no words and of a heavy prefix: one that makes up one word in ``HEAVY`` of the corpus, so that there
#: are at most so many of any length.
SEGMENTS = (256, 64)
HEAVY = 1000
#: Groups that each give their best phrases before a language's best are chosen.
RANK_GROUPS = 64

#: What each byte is: part of a word, between words (space, tab), or between pieces (`.,;:!?` and line ends).
WORD, GAP, STOP = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Tokens:
    """Words laid end to end: their numbers in ``words``, language codes, hashes with the language, and whether each goes on a piece."""

    words: pa.StringArray
    ids: np.ndarray
    langs: np.ndarray
    hashes: np.ndarray
    joined: np.ndarray


def string_array(data: np.ndarray, keep: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """The kept bytes as strings of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep])))


def string_hashes(strings: pa.StringArray) -> np.ndarray:
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, _, data, offsets = next(byte_steps(strings, 1 << 31, len(strings)))
    return cut_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def tokenized(langs: pa.Array, first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = KIND[data]
    keep = kind == WORD
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    begins[rows] = keep[rows]
    start = np.flatnonzero(begins)
    ends = keep.copy()
    ends[:-1] &= ~keep[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = keep[tails]
    end = np.flatnonzero(ends) + 1
    coded = string_array(LOWER[data], keep, end - start).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        joined[1:] = kind[end[:-1]] == GAP
        wide = np.flatnonzero(start[1:] - end[:-1] > 1)
        if len(wide):
            between = np.stack((end[wide], start[wide + 1]), axis=1).reshape(-1)
            joined[wide + 1] = np.maximum.reduceat(kind, between)[::2] == GAP
    heads = np.searchsorted(start, offsets)
    joined[heads[:-1][heads[:-1] < len(start)]] = False
    row = np.repeat(np.arange(last - first), np.diff(heads))
    named = langs.slice(first, last - first).dictionary_encode()
    codes = named.indices.to_numpy().astype(np.int64)[row]
    lang_hashes = string_hashes(named.dictionary)
    hashes = mix(string_hashes(coded.dictionary)[ids] ^ mix(lang_hashes)[codes]) if len(ids) else np.zeros(0, np.uint64)
    return Tokens(coded.dictionary, ids, codes, hashes, joined)


def phrase_hashes(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they stand in one piece."""
    hashes, inside = tokens.hashes, np.ones(len(tokens.ids), bool)
    for k in range(1, size):
        hashes = mix(hashes[:-1] * BASE + tokens.hashes[k:])
        inside = inside[:-1] & tokens.joined[k:]
    return hashes, inside


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def grams(tokens: Tokens, size: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct phrase of ``size`` words stands first, and how often it occurs; parts must pass the filter."""
    if size == 1:
        key = tokens.langs * len(tokens.words) + tokens.ids
        counts = np.bincount(key)
        first = np.zeros(len(counts), np.int64)
        first[key[::-1]] = np.arange(len(key) - 1, -1, -1)
        found = np.flatnonzero(counts)
        return first[found], counts[found]
    hashes, inside = phrase_hashes(tokens, size)
    if bits is not None:
        part, whole = phrase_hashes(tokens, size - 1)
        live = whole & passing(bits, part)
        inside = inside & live[:-1] & live[1:]
    at = np.flatnonzero(inside)
    _, first, inverse, counts = np.unique(hashes[at], return_index=True, return_inverse=True, return_counts=True)
    alike = at[first][inverse]
    if not ((tokens.langs[at] == tokens.langs[alike]).all() and all(
            (tokens.ids[at + k] == tokens.ids[alike + k]).all() for k in range(size))):  # two phrases of one hash: number the phrases themselves
        columns = [tokens.langs[at], *[tokens.ids[at + k] for k in range(size)]]
        _, first, counts = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], counts


def stripes_of(tokens: Tokens, langs: pa.Array, size: int, at: np.ndarray, counts: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
    """Phrases gathered under their prefixes, those of heavy prefixes (by hash) in segments.

    A stripe's words travel as one string and its counts as another: words hold no space, and an array of strings would take
    some 16 bytes more for each of them through the shuffle.
    """
    following = tokens.ids[at + size - 1]
    segment = (string_hashes(tokens.words)[following] % np.uint64(SEGMENTS[0 if size == 1 else 1])).astype(np.int64)
    if size > 1:
        segment[~np.isin(phrase_hashes(tokens, size - 1)[0][at], heavy)] = 0
    columns = [segment, *[tokens.ids[at + k] for k in range(size - 2, -1, -1)], tokens.langs[at]]
    order = np.lexsort(columns)
    fresh = np.zeros(len(at), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    head = np.flatnonzero(fresh)
    places = at[order][head]
    if size == 1:
        prefix = pa.array([""] * len(head), pa.string())
    else:
        prefix = pc.binary_join_element_wise(*[tokens.words.take(pa.array(tokens.ids[places + k])) for k in range(size - 1)], " ")
    bounds = pa.array(np.append(head, len(at)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        langs.take(pa.array(tokens.langs[places])), prefix, pa.array(columns[0][order][head].astype(np.int32)),
        pc.binary_join(pa.ListArray.from_arrays(bounds, tokens.words.take(pa.array(following[order]))), " "),
        pc.binary_join(pa.ListArray.from_arrays(bounds, pa.array(counts[order].astype(np.int64)).cast(pa.string())), " ")],
        ["lang", "prefix", "segment", "next", "n"])


def stripes(texts: DataFrame, size: int, bits: np.ndarray | None, heavy: np.ndarray | None = None) -> DataFrame:
    """Summed stripes of prefixes of ``size - 1`` words, as rows (lang, prefix, next, n); ``texts``: lang, text."""
    shared = texts.sparkSession.sparkContext.broadcast((bits, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for first, last, data, offsets in byte_steps(batch.column("text"), STEP, STEP):
                tokens = tokenized(langs, first, last, data, offsets)
                if len(tokens.ids) < size:
                    continue
                at, counts = grams(tokens, size, shared.value[0])
                if len(at):
                    named = langs.slice(first, last - first).dictionary_encode().dictionary
                    yield stripes_of(tokens, named, size, at, counts, shared.value[1])

    filled = texts.mapInArrow(tidied(run), "lang string, prefix string, segment int, next string, n string")
    # the exchange by segment also serves the sums by word within a segment
    dealt = filled.repartition("lang", "prefix", "segment")
    both = F.arrays_zip(F.split("next", " ").alias("next"), F.split("n", " ").alias("n"))
    entries = dealt.select("lang", "prefix", "segment", F.explode(both).alias("e"))
    return entries.select("lang", "prefix", "segment", F.col("e.next").alias("next"), F.col("e.n").cast("long").alias("n")).groupBy(
        "lang", "prefix", "segment", "next").agg(F.sum("n").alias("n")).drop("segment")


def stretches(texts: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """Runs of words all of whose phrases of ``size`` words pass the filter: no frequent phrase reaches beyond one."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for first, last, data, offsets in byte_steps(batch.column("text"), STRETCH_STEP, STEP):
                tokens = tokenized(langs, first, last, data, offsets)
                if len(tokens.ids) < size:
                    continue
                hashes, inside = phrase_hashes(tokens, size)
                live = inside & passing(shared.value, hashes)
                turn = np.diff(np.concatenate(([False], live, [False])).astype(np.int8))
                begin, end = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0) + size - 1
                if not len(begin):
                    continue
                lengths = end - begin
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                places = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], lengths)
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), tokens.words.take(pa.array(tokens.ids[places])))
                named = langs.slice(first, last - first).dictionary_encode().dictionary
                yield pa.RecordBatch.from_arrays([named.take(pa.array(tokens.langs[begin])), pc.binary_join(runs, " ")], ["lang", "text"])

    return texts.mapInArrow(tidied(run), "lang string, text string")


def bit_map(slots: DataFrame) -> np.ndarray:
    """The bits of all numbers in ``slot``: 2^``FILTER_BITS`` of them, whatever the number of rows."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            chunk, slot = slot >> CHUNK_BITS, slot & (1 << CHUNK_BITS) - 1
            for c in np.unique(chunk).tolist():
                held.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))[slot[chunk == c]] = True
        packed = [np.packbits(held[c], bitorder="little").tobytes() for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    bits = np.zeros((1 << FILTER_BITS - CHUNK_BITS, 1 << CHUNK_BITS - 3), np.uint8)
    dealt = slots.select("slot").distinct().repartition(F.shiftright("slot", CHUNK_BITS))
    packed = stored(dealt.mapInArrow(chunks, "chunk long, bits binary"), "bits")  # a shuffle behind the iterator would keep its files
    for r in packed.toLocalIterator():
        bits[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    discard(packed)
    return bits.reshape(-1)


def filter_of(phrases: DataFrame, size: int) -> np.ndarray:
    """The bit map of all phrases (lang, phrase) of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_steps(batch.column("phrase"), STEP, STEP):
                tokens = tokenized(batch.column("lang"), first, last, data, offsets)
                hashes, inside = phrase_hashes(tokens, size)
                yield pa.RecordBatch.from_arrays([pa.array((hashes[inside] >> np.uint64(64 - FILTER_BITS)).astype(np.int64))], ["slot"])

    return bit_map(phrases.select("lang", "phrase").mapInArrow(tidied(run), "slot long"))


def pair_filter(texts: DataFrame, bits: np.ndarray, least: int) -> np.ndarray:
    """A bit map that holds all word pairs of ``least`` occurrences, from counts by a number of ``SLOT_BITS`` bits of their hash.

    Most pairs are rare, and numbers are much smaller than stripes of them. Pairs that share a number only add to it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_steps(batch.column("text"), STEP, STEP):
                tokens = tokenized(batch.column("lang"), first, last, data, offsets)
                hashes, inside = phrase_hashes(tokens, 2)
                live = passing(shared.value, tokens.hashes)
                pairs = hashes[inside & live[:-1] & live[1:]] >> np.uint64(64 - SLOT_BITS)
                slot, n = np.unique(pairs.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    counted = texts.mapInArrow(tidied(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return bit_map(counted.select(F.shiftright("slot", SLOT_BITS - FILTER_BITS).alias("slot")))


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times, as (lang, prefix, next, phrase, size, a), and words by language."""
    words = stored(stripes(texts, 1, None), "words")
    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))

    def level(counted: DataFrame, size: int) -> DataFrame:
        return stored(counted.filter(F.col("n") >= least).select(
            "lang", "prefix", "next", phrase.alias("phrase"), F.lit(size).alias("size"), F.col("n").alias("a")), "phrases")

    levels = [level(words, 1)]
    discard(words)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    while len(levels) < longest and not levels[-1].isEmpty():
        bits = filter_of(levels[-1], len(levels))
        heavy = heavy_prefixes(levels[-1], len(levels), total)
        if len(levels) == 1:
            texts = stored(stretches(texts, 2, pair_filter(texts, bits, least)), "stretches")
        levels.append(level(stripes(texts, len(levels) + 1, bits, heavy), len(levels) + 1))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, sizes


def heavy_prefixes(phrases: DataFrame, size: int, total: int) -> np.ndarray:
    """Hashes of the phrases that make up one word in ``HEAVY`` of the corpus: at most so many rows come to the driver."""
    rows = phrases.filter(F.col("a") * HEAVY >= total).select("lang", "phrase").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    langs, texts = (pa.array([r[c] for r in rows], pa.string()) for c in ("lang", "phrase"))
    step = next(byte_steps(texts, 1 << 31, len(rows)))
    hashes, inside = phrase_hashes(tokenized(langs, *step), size)
    return hashes[inside]


def undominated(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more without a longer one around them that is as frequent.

    One word more is enough to look at: a longer phrase around it is at most as frequent as those between.
    """
    suffix = F.expr("substring_index(phrase, ' ', 1 - size)")
    around = phrases.filter("size > 2").select("lang", "a", F.explode(F.array("prefix", suffix)).alias("phrase"))
    most = around.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.filter("size > 1").join(most, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")


def scored(candidates: DataFrame, phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each candidate at its lowest-scoring cut: lang, phrase, a, l, r, n, score. Products have up to 38 digits."""
    parts = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "size", "a", parts.alias("parts"),
                             F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    sides = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("parts", 1, F.col("cut")), " ").alias("left"),
                        F.array_join(F.slice("parts", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"))
    total = phrases.select("lang", "phrase", "a")
    with_left = sides.join(total.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    with_both = with_left.join(total.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = with_both.join(sizes, "lang").select("lang", "phrase", "a", "cut", "l", "r", "n", score.alias("score"))
    return best.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select(
        "lang", "phrase", *[f"b.{c}" for c in ("a", "l", "r", "n", "score")])


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    Null texts are empty and a null language is ``und``; empty texts and tables have no phrases. Repeated rows count
    again. Texts of any length are taken whole, words of any length too. Ties go to the larger count, then to the phrase
    that comes first by bytes. Only the two named columns are read, so others may have any name.
    """
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    phrases, sizes = frequent_phrases(texts, least, longest)
    out = scored(undominated(phrases), phrases, sizes)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    some = out.withColumn("group", group).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(
        F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of ``documents`` by language."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same rows by plain counting of every phrase of every piece.
ORACLE = """
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
split as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as words from pieces),
grams as (
  select lang, size, array_to_string(words[pos:pos + size - 1], ' ') as phrase
  from (select lang, words, size, unnest(range(1, len(words) - size + 2)) as pos
        from split, (select unnest([1, 2, 3, 4, 5]) as size))),
counted as (select lang, size, phrase, count(*) as f from grams group by all),
sizes as (select lang, sum(f) as n from counted where size = 1 group by lang),
candidates as (select * from counted where size >= 2 and f >= 100),
around as (
  select distinct c.lang, c.phrase from candidates c join candidates o
  on o.lang = c.lang and o.size > c.size and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') and 100 * o.f >= 100 * c.f),
cuts as (
  select lang, phrase, size, f, unnest(range(1, size)) as cut, string_split(phrase, ' ') as words
  from candidates anti join around using (lang, phrase)),
scores as (
  select c.lang, c.phrase, c.f as a, c.cut, x.f as l, y.f as r, n,
    (1000::hugeint * c.f * n) // (x.f::hugeint * y.f) as score
  from cuts c
  join counted x on x.lang = c.lang and x.phrase = array_to_string(c.words[1:c.cut], ' ')
  join counted y on y.lang = c.lang and y.phrase = array_to_string(c.words[c.cut + 1:], ' ')
  join sizes s on s.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best qualify rank <= 2000
"""
