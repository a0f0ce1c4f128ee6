"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

A text's subwords are the 2-, 3- and 4-byte runs of its lower-cased letters, with everything else as one blank. Each is
hashed to a row of an embedding table; the average of a text's rows goes through a linear softmax. Table and softmax are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE`` for each language), of
which a fifth is set aside to fit the temperature and the score below which a text is rejected. For scoring the two layers
are multiplied out to one table of fixed size, which is broadcast; texts are scored whole, where they are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import byte_steps, fold, in_steps, table, texts, tidied

#: Rows of the embedding table and numbers in a row.
BUCKET_BITS = 15
DIMENSIONS = 16
#: Bytes of text whose table rows are looked up at once, a number for each byte and language.
LOOKED_UP = 1 << 18
#: Labelled rows for each language that the model is fitted on, about; every language is learned.
SAMPLE = 400
EPOCHS = 12
RATE = 0.5
#: Share of rightly labelled calibration rows that rejection may lose.
LOSS = 0.001


def blanks() -> np.ndarray:
    """Bytes by themselves, with ASCII other than lower-case letters as a blank."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


BLANKS = blanks()


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: table rows of the runs at all bytes, and whether the run counts (has a letter, ends in its row)."""
    n = len(data)
    padded = np.concatenate((BLANKS[data], np.full(3, 32, np.uint8)))
    run = padded[:n].astype(np.uint32)
    letter = padded != 32
    any_letter = letter[:n].copy()
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for size in (2, 3, 4):
        run |= padded[size - 1: size - 1 + n].astype(np.uint32) << np.uint32(8 * (size - 1))
        any_letter |= letter[size - 1: size - 1 + n]
        mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(13)
        yield (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS), any_letter & (left >= size)


@dataclass
class Model:
    """Languages, the multiplied-out table, its bias and temperature, and the score below which texts are rejected."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """A row of logits for each text; a text without subwords gets the bias."""
        out = np.zeros((len(column), len(self.languages)))
        for first, last, data, offsets in byte_steps(pc.utf8_lower(texts(column)), LOOKED_UP):
            sums = np.zeros((last - first, len(self.languages)))
            counts = np.zeros(last - first)
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                for rows, counted in subwords(data, offsets):
                    values = self.weights[rows]
                    values[~counted] = 0
                    sums[full] += np.add.reduceat(values, offsets[full], axis=0)
                    counts[full] += np.add.reduceat(counted.astype(np.int64), offsets[full])
            out[first:last] = sums / np.maximum(counts, 1)[:, None] + self.bias
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(docs: DataFrame) -> DataFrame:
    """``lang``, ``calibrate`` and the text's subword counts as two arrays: at most one entry for each table row."""
    schema = "lang string, calibrate boolean, rows array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = [], []
            for _, _, data, offsets in byte_steps(pc.utf8_lower(texts(batch.column("text"))), 1):
                total = np.zeros(1 << BUCKET_BITS, np.int64)
                if len(data):
                    for hashed, counted in subwords(data, offsets):
                        total += np.bincount(hashed[counted], minlength=1 << BUCKET_BITS)
                present = np.flatnonzero(total)
                rows.append(present.astype(np.int32))
                counts.append(np.minimum(total[present], (1 << 31) - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("calibrate"), pa.array(rows, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))], ["lang", "calibrate", "rows", "counts"])

    return docs.select("lang", "calibrate", "text").mapInArrow(run, schema)


def learn(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE, seed: int = 9) -> Model:
    """Fit on rows with text and language outside the held-out fold; about ``sample`` rows for each language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    counts = dict(usable.groupBy("lang").count().collect())  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, sample / n) * (1 << 30)))])
    drawn = usable.filter(draw < share[F.col("lang")]).withColumn(
        "calibrate", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0)
    rows = features(drawn).collect()  # bounded: sample rows for each language, table rows for each
    return fit(rows, languages, seed)


def fit(rows: list, languages: list[str], seed: int) -> Model:
    """Two layers by plain SGD, one text at a time in a fresh order each epoch, then temperature and rejection."""
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(languages)}
    kept = [(np.array(r["rows"], np.int64), np.array(r["counts"], np.float64), place[r["lang"]], r["calibrate"])
            for r in rows if len(r["rows"])]
    train = [r for r in kept if not r[3]] or kept
    table_rows = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    head, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    share = np.bincount([r[2] for r in train], minlength=len(languages))
    weight = len(train) / np.maximum(share, 1) / max(1, (share > 0).sum())
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            index, count, label, _ = train[i]
            rate = RATE * weight[label] * (1 - done / steps)
            done += 1
            mean = count / count.sum()
            hidden = mean @ table_rows[index]
            error = softmax((hidden @ head + bias)[None])[0]
            error[label] -= 1
            back = head @ error
            head -= rate * np.outer(hidden, error)
            bias -= rate * error
            # a row's share of the text is small, so rows move by the square root of it, as adaptive rates would have it
            table_rows[index] -= rate * np.sqrt(mean)[:, None] * back
    model = Model(languages, (table_rows @ head).astype(np.float32), bias)
    held = [r for r in kept if r[3]] or kept
    if held:
        logits = np.array([(c / c.sum()) @ model.weights[i] + bias for i, c, _, _ in held])
        labels = np.array([r[2] for r in held])
        heats = np.geomspace(0.05, 20, 60)
        losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in heats]
        # of temperatures that are as good, the warmest: scores that are no surer than the rows warrant
        model.temperature = float(heats[np.array(losses) <= min(losses) + 0.001][-1])
        scores = softmax(logits / model.temperature)
        right = scores.argmax(axis=1) == labels
        if right.any():
            model.reject_below = float(min(0.5, np.quantile(scores.max(axis=1)[right], LOSS)))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    Null text, text without a letter, and any text under a model that has learned nothing are ``und`` with score 0, and
    rejected. Other texts get a learned language, and are rejected where the calibrated score is below the threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in in_steps(batches):
            column = texts(batch.column("text"))
            spoken = np.array([any(map(str.isalpha, x)) for x in column.to_pylist()], bool) & bool(model.languages)
            if model.languages:
                scores = model.scores(column)
                best, top = scores.argmax(axis=1), np.where(spoken, scores.max(axis=1), 0.0)
            else:
                best, top = np.zeros(len(column), int), np.zeros(len(column))
            names = [model.languages[b] if s else "und" for b, s in zip(best, spoken)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(top, pa.float64()),
                 pa.array(~spoken | (top < model.reject_below))], schema.names)

    return kept.mapInArrow(tidied(run), schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    held = (fold("doc_id", 5) == 0).alias("held_out")
    out = predict(docs.select("doc_id", "text", held), learn(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
