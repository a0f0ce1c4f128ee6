"""Language-model scoring with a hidden Markov model.

Words are counted over all training rows. The ``OWN`` most frequent words are symbols of their own; all others share
``TAIL`` symbols by their last three bytes, within which a word has its smoothed share of the symbol's count. A hidden
Markov model of ``STATES`` states emits symbols up to and including the end. Baum-Welch trains it: each partition sums its
expected counts per symbol and state, the sums are added by a grouped aggregate, and the driver holds one table whose size
is fixed by these parameters. Training covers every token, in segments of ``SEGMENT`` tokens (later segments of a text
start from a distribution of their own); scoring runs the scaled forward recursion over whole texts and is exact.

Counts of the ``KNOWN`` most frequent words travel with the model. All rarer words of a text are joined with the full table
of counts by a shuffle, so that every word gets its exact count however large the vocabulary is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import fold, stored, table, texts

STATES = 12
OWN = 8192
TAIL = 2048
KNOWN = 131_072  # at most
ROUNDS = 6
SEGMENT = 256
#: Tokens that one lockstep of the recursions holds at most, besides a single longer text.
LOCKSTEP = 300_000
#: Smoothing of the base model, and pseudo-counts by which states lean on the words' overall shares.
ADD = 0.1
LEAN = 50.0
LN10 = float(np.log(10.0))


def split_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_symbol(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


def word_counts(rows: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all texts, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column("text")):
                seen.update(split_words(text.as_py()))
                if len(seen) > 400_000:
                    yield from emitted(seen)
        yield from emitted(seen)

    def emitted(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(seen.keys()), list(seen.values())
        seen.clear()
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k: k + 50_000], pa.binary()).cast(pa.string()),
                                              pa.array(counts[k: k + 50_000], pa.int64())], ["word", "n"])

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What is known of the words: the most frequent with their counts, symbol masses, and the totals."""

    words: list[bytes]
    counts: np.ndarray
    tail_mass: np.ndarray
    total: int
    distinct: int
    ends: int

    @property
    def own(self) -> int:
        return min(OWN, len(self.words))

    @property
    def end(self) -> int:
        return self.own + TAIL

    @property
    def symbols(self) -> int:
        return self.end + 1

    def shares(self) -> np.ndarray:
        """The overall share of each symbol; a tail symbol's mass holds one unseen word."""
        mass = np.concatenate((self.counts[: self.own] + ADD, self.tail_mass + ADD, [self.ends + ADD]))
        return mass / mass.sum()


def learn_words(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The stored table of all counts, and the part of it that is of fixed size."""
    counts = stored(word_counts(train), "counts")
    ends = train.count()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # the lowest step of counts from which on there are no more than KNOWN words; there are some hundred steps
    step = F.floor(F.log("n") * 32).cast("int")
    room, lowest = KNOWN, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        room -= r["words"]
        if room < 0:
            lowest = r["step"] + 1
            break
    top = sorted(counts.filter(step >= lowest).collect(), key=lambda r: (-r["n"], r["word"]))
    words = [r["word"].encode() for r in top]
    own = set(words[:OWN])
    symbol = (F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % TAIL).alias("symbol")
    mass = np.zeros(TAIL)
    for r in counts.groupBy(symbol).agg(F.sum(F.col("n") + ADD).alias("mass")).collect():
        mass[r["symbol"]] = r["mass"]
    for word, r in zip(words[:OWN], top):
        if word in own:
            mass[tail_symbol(word)] -= r["n"] + ADD
    return counts, Vocabulary(words, np.array([r["n"] for r in top], np.int64), np.maximum(mass, 0.0),
                              int(sums["n"]) + ends, sums["v"] + (ends > 0), ends)


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each text as symbols, with the sums that its frequent words give and the list of its rarer words.

    ``row_key`` is made here and is stable once the table is written.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([
        T.StructField("row_key", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("symbols", T.ArrayType(T.ShortType(), False)), T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("within", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()),
                                                        T.StructField("n", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        place = {w: i for i, w in enumerate(v.words)}
        own, log_count = v.own, np.log10(v.counts + ADD)
        symbol_of = np.arange(len(v.words))
        symbol_of[own:] = [own + tail_symbol(w) for w in v.words[own:]]
        log_mass = np.log10(v.tail_mass + ADD)
        within_of = np.where(np.arange(len(v.words)) < own, 0.0, log_count - log_mass[np.maximum(symbol_of - own, 0) % TAIL])
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                symbols, scalars, rare_words, rare_counts, rare_sizes = [], [], [], [], []
                for text in texts(part.column("text")):
                    words = split_words(text.as_py())
                    at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    found = at >= 0
                    line = np.empty(len(words) + 1, np.int16)
                    line[:-1][found] = symbol_of[at[found]]
                    line[-1] = v.end
                    missing = np.flatnonzero(~found)
                    rare = [words[i] for i in missing]
                    tails = [tail_symbol(w) for w in rare]
                    line[missing] = np.array(tails, np.int64) + own
                    counted = Counter(rare)
                    symbols.append(line)
                    scalars.append((len(line), int(found.sum()) + (v.ends > 0),
                                    float(log_count[at[found]].sum() + np.log10(v.ends + ADD)),
                                    float(within_of[at[found]].sum() - log_mass[tails].sum())))
                    rare_words.extend(counted.keys())
                    rare_counts.extend(counted.values())
                    rare_sizes.append(len(counted))
                tokens, known, base, within = zip(*scalars)
                lists = lambda sizes, values: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)
                pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()),
                                                    pa.array(rare_counts, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + len(part))), part.column("doc_id"), part.column("held_out"),
                     pa.array(tokens, pa.int64()), lists(map(len, symbols), pa.array(np.concatenate(symbols))),
                     pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()),
                     lists(rare_sizes, pairs)], schema.names)
                key += len(part)

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Markov:
    """Start distributions of texts and of later segments (2 x states), transitions, and emissions (symbols x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Lockstep:
    """Sequences of symbols side by side, longest first, laid out by time: step t holds those that last so long."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray) -> None:
        lengths = np.diff(offsets)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        longest = int(self.lengths[0])
        alive = np.searchsorted(-self.lengths, -np.arange(1, longest + 1), side="right")
        self.at = np.concatenate(([0], np.cumsum(alive)))
        row = np.repeat(np.arange(len(lengths)), self.lengths)
        time = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        source = np.repeat(offsets[:-1][self.order], self.lengths) + time
        self.symbols = np.empty(len(row), np.int64)
        self.symbols[self.at[time] + row] = symbols[source]
        self.row = np.empty(len(row), np.int64)
        self.row[self.at[time] + row] = row

    def forward(self, model: Markov, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables and emissions (states x symbols), and scales; ``start``: a row for each sequence.

        All arrays have the model's precision.
        """
        emissions = np.take(np.ascontiguousarray(model.emit.T), self.symbols, axis=1)
        alpha, scale = np.empty_like(emissions), np.empty(emissions.shape[1], emissions.dtype)
        before, move = start[self.order].T, np.ascontiguousarray(model.move.T)
        for t in range(len(self.at) - 1):
            a, b = self.at[t], self.at[t + 1]
            now = (move @ before[:, : b - a] if t else before) * emissions[:, a:b]
            total = now.sum(axis=0, out=scale[a:b])
            before = np.divide(now, total, out=alpha[:, a:b])
        return alpha, scale, emissions

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        """The sum of log scales of each sequence, in the order in which they were given."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.row, np.log(scale), len(self.order))
        return out

    def expected(self, model: Markov, start: np.ndarray, later: np.ndarray, sums: dict[str, np.ndarray]) -> float:
        """Adds expected counts of starts, transitions and emissions to ``sums``; returns the log likelihood."""
        alpha, scale, emissions = self.forward(model, start)
        steps = len(self.at) - 1
        emissions /= scale
        gamma = alpha.copy()  # the last step of a sequence keeps its forward variable
        beta = np.ones((len(alpha), self.at[steps] - self.at[steps - 1]), alpha.dtype)
        moves = np.zeros(model.move.shape)
        for t in range(steps - 2, -1, -1):
            a, b, c = self.at[t], self.at[t + 1], self.at[t + 2]
            carried = emissions[:, b:c] * beta
            moves += alpha[:, a: a + c - b] @ carried.T  # of sequences that go on; beta of the others is 1
            going = model.move @ carried
            gamma[:, a: a + c - b] *= going
            if b - a > c - b:
                beta = np.ones((len(alpha), b - a), alpha.dtype)
                beta[:, : c - b] = going
            else:
                beta = going
        sums["move"] += model.move * moves
        first = gamma[:, : self.at[1]]
        later = later[self.order]
        sums["start"][0] += first[:, ~later].sum(axis=1)
        sums["start"][1] += first[:, later].sum(axis=1)
        for s in range(len(gamma)):
            sums["emit"][:, s] += np.bincount(self.symbols, gamma[s], len(sums["emit"]))
        return float(np.log(scale).sum())


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0]: offsets[-1]].astype(np.int64), offsets - offsets[0]


def locksteps(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, Lockstep]]:
    """Groups of sequences of similar length and bounded size, with the numbers of their sequences."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    group = np.cumsum(lengths[order]) // LOCKSTEP
    for g in np.unique(group):
        chosen = order[group == g]
        sizes = lengths[chosen]
        cut = np.concatenate(([0], np.cumsum(sizes)))
        index = np.repeat(offsets[chosen] - cut[:-1], sizes) + np.arange(cut[-1])
        yield chosen, Lockstep(values[index], cut)


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the segments of all sequences, and whether each is a later one of its text."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // SEGMENT)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(offsets[:-1], pieces) + number * SEGMENT
    return np.append(starts, offsets[-1]), number > 0


def first_model(vocabulary: Vocabulary, seed: int) -> Markov:
    """States that tend to stay, each with the overall shares shaken by seeded noise."""
    rng = np.random.default_rng(seed)
    shares = vocabulary.shares()
    emit = shares[:, None] * np.exp(rng.normal(0, 1, (len(shares), STATES)))
    move = np.full((STATES, STATES), 0.2 / (STATES - 1))
    np.fill_diagonal(move, 0.8)
    return Markov(np.full((2, STATES), 1 / STATES), move, emit / emit.sum(axis=0))


def baum_welch(sequences: DataFrame, model: Markov, shares: np.ndarray) -> Markov:
    """One round: expected counts of all partitions, added by symbol, give the next model."""
    # single precision carries scaled variables well, and counts are added in double
    single = Markov(*[x.astype(np.float32) for x in (model.start, model.move, model.emit)])
    shared = sequences.sparkSession.sparkContext.broadcast(single)
    states = [f"s{k}" for k in range(STATES)]
    schema = "symbol int, " + ", ".join(f"{s} double" for s in states)
    moves, starts = -1, -1 - STATES  # rows of transitions and of starts have numbers below 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = {"start": np.zeros((2, STATES)), "move": np.zeros((STATES, STATES)), "emit": np.zeros(model.emit.shape)}
        for batch in batches:
            if not len(batch):
                continue
            values, offsets = lists_of(batch.column("symbols"))
            cuts, later = segments(offsets)
            for chosen, group in locksteps(values, cuts):
                group.expected(model, model.start[later[chosen].astype(int)], later[chosen], sums)
        seen = np.flatnonzero(sums["emit"].any(axis=1))
        numbers = np.concatenate((seen, moves - np.arange(STATES), starts - np.arange(2))).astype(np.int32)
        rows = np.concatenate((sums["emit"][seen], sums["move"], sums["start"]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *[pa.array(rows[:, k]) for k in range(STATES)]],
                                         ["symbol", *states])

    summed = sequences.select("symbols").mapInArrow(run, schema).groupBy("symbol").agg(*[F.sum(s).alias(s) for s in states])
    emit, move, start = np.zeros(model.emit.shape), np.zeros((STATES, STATES)), np.zeros((2, STATES))
    for r in summed.collect():  # a row for each symbol, of which there is a fixed number
        row = [r[s] for s in states]
        if r["symbol"] >= 0:
            emit[r["symbol"]] = row
        elif r["symbol"] > starts:
            move[moves - r["symbol"]] = row
        else:
            start[starts - r["symbol"]] = row
    emit = (emit + LEAN * shares[:, None]) / (emit.sum(axis=0) + LEAN)
    move, start = move + 1, start + 1
    return Markov(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit)


def forward_scores(coded: DataFrame, model: Markov) -> DataFrame:
    """``coded`` with ``log_symbols``: the log10 probability of the whole sequence of symbols under the model."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    kept = ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "within"]
    schema = T.StructType([*[coded.schema[c] for c in kept], T.StructField("log_symbols", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            values, offsets = lists_of(batch.column("symbols"))
            out = np.zeros(len(batch))
            for chosen, group in locksteps(values, offsets):
                scale = group.forward(model, np.repeat(model.start[:1], len(chosen), axis=0))[1]
                out[chosen] = group.log_likelihood(scale) / LN10
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out)], schema.names)

    return coded.select(*kept, "symbols").mapInArrow(run, schema)


def score(docs: DataFrame, train: DataFrame, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Scores of ``docs`` (``doc_id``, ``held_out``, ``text``) under models of ``train`` (``text``).

    Null text counts as empty: one token, the end. Without training rows every text has base probability 1 of its
    unseen words, and the hidden states are all alike. Repeated rows are scored each.
    """
    counts, vocabulary = learn_words(train)
    coded = stored(encoded(docs, vocabulary), "encoded")
    model, shares = first_model(vocabulary, seed), vocabulary.shares()
    sequences = coded.filter(~F.col("held_out"))
    for _ in range(rounds):
        model = baum_welch(sequences, model, shares)
    rare = coded.select("row_key", F.explode("rare").alias("r")).select("row_key", "r.word", "r.n")
    met = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    sums = met.groupBy("row_key").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    whole = stored(forward_scores(coded, model), "forward").join(sums, "row_key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    per_token = float(np.log10(vocabulary.total + ADD * (vocabulary.distinct + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("log_symbols") + F.col("within") + rare_log).alias("score"))


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``, learned outside fold 0 of 10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "text")
    return score(docs, docs.filter(~F.col("held_out")))
