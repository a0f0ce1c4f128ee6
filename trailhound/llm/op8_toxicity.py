"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses, and a clause's words into symbols: insult, threat, target, negation, reported speech, other.
Small transducers read the symbols: one remembers a negation for a few words, one a verb of speech for the rest of the
clause, one a person spoken of or to, one an insult that still lacks its person, one a threat that does. They are composed
into one table of states; what it emits for a clause is a list of matches (an insult: aimed or not, negated or not,
reported or not; a threat with its target), each with the weight of its lexicon entry. A text's score is a logistic
function of what its matched clauses weigh.

The insult lexicon (words, and word beginnings marked by ``*``) and all weights are learned from a bounded sample of
labelled rows: ``SAMPLE`` of either class, about. The small closed lists below name words of grammar, in four languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import fold, in_steps, stored, table, texts, tidied

#: Labelled rows of either class that lexicon and weights are fitted on, about.
SAMPLE = 3000
#: Entries of the lexicon at most; shortest and longest word beginning; rows of the toxic class that an entry needs.
ENTRIES = 400
BEGINNINGS = (4, 8)
SUPPORT = 4
#: An entry's log ratio of rates, less two standard errors, is at least this.
SURE = 1.5
#: A score from which a text is called toxic.
CUT = 0.3

THREATS = "kill hurt destroy shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = ("you your he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils elles lui "
           "tú usted ustedes ellos ellas él").split()
NEGATIONS = "not no never isn aren wasn don nicht kein keine nie niemals ne pas jamais non nunca jamás ni".split()
REPORTS = ("said says say called calls wrote quoted claims claimed sagte sagt schrieb nannte dit écrit appelé "
           "dijo dice escribió llamó").split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
GRAMMAR = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")

#: What a transducer may say of a symbol.
NEGATED, REPORTED, AIMED, LATE_AIM, THREATENED = 1, 2, 4, 8, 16


def countdown(start: int, span: int, on: int, says: int) -> list[list[tuple[int, int]]]:
    """After symbol ``start`` the transducer says ``says`` of the symbol ``on`` for the next ``span`` symbols."""
    table = []
    for state in range(span + 1):
        row = []
        for symbol in range(6):
            said = says if symbol == on and state else 0
            row.append((span if symbol == start else max(0, state - 1), said))
        table.append(row)
    return table


def latched(start: int, on: int, says: int) -> list[list[tuple[int, int]]]:
    """After symbol ``start`` the transducer says ``says`` of ``on`` until the clause ends."""
    return [[(1 if state or symbol == start else 0, says if symbol == on and state else 0) for symbol in range(6)]
            for state in (0, 1)]


def composed(first: list, second: list) -> list[list[tuple[int, int]]]:
    """Both transducers at once: pairs of states, and everything that either says."""
    width = len(second)
    return [[(first[a][s][0] * width + second[b][s][0], first[a][s][1] | second[b][s][1]) for s in range(6)]
            for a in range(len(first)) for b in range(width)]


def grammar() -> list[list[tuple[int, int]]]:
    out = countdown(NEGATION, 3, INSULT, NEGATED)
    for part in (latched(REPORT, INSULT, REPORTED), countdown(TARGET, 4, INSULT, AIMED),
                 countdown(INSULT, 4, TARGET, LATE_AIM), countdown(THREAT, 4, TARGET, THREATENED)):
        out = composed(out, part)
    return out


#: Features of a text: how many matched clauses, whether any; matched clauses and their weight for each word of the
#: text; and what insults of each kind and threats weigh.
KINDS = ["plain", "aimed", "negated", "reported", "threat"]
FEATURES = ["clauses", "any", "share", "density", *KINDS]


def beginnings(word: str) -> Iterator[str]:
    for n in range(BEGINNINGS[0], min(len(word), BEGINNINGS[1] + 1)):
        yield word[:n] + "*"


def as_pattern(entries: list[str]) -> str:
    """One expression for all entries at the start of a word, shared beginnings tried once."""
    root: dict = {}
    for entry in entries:
        node = root
        for c in entry.rstrip("*"):
            node = node.setdefault(c, {})
        node["*" if entry.endswith("*") else "$"] = {}

    def write(node: dict) -> str:
        if "*" in node:
            return r"[^\W\d_]*"
        ways = [re.escape(c) + write(n) for c, n in node.items() if c != "$"]
        if "$" in node:
            ways.append(r"(?![^\W\d_])")
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return r"(?<![^\W\d_])" + write(root)


@dataclass
class Model:
    """Lexicon weights (log ratios), and the weight of each feature with an intercept in front."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def __post_init__(self) -> None:
        self.table = grammar()
        starts = [*self.lexicon, *THREATS]
        self.find = re.compile(as_pattern(starts)).finditer

    def __reduce__(self):
        return Model, (self.lexicon, self.weights)

    def insult(self, word: str) -> float:
        """The weight of a word as an insult, 0 for other words."""
        return max([self.lexicon.get(word, 0.0), *(self.lexicon.get(b, 0.0) for b in beginnings(word))])

    def clause(self, words: list[str]) -> dict[str, float]:
        """What the composed transducers emit for one clause."""
        out = dict.fromkeys(KINDS, 0.0)
        state, last, last_kind = 0, 0.0, ""
        for word in words:
            weight = 0.0
            symbol = GRAMMAR.get(word)
            if symbol is None:
                weight = self.insult(word)
                symbol = INSULT if weight else OTHER
            state, said = self.table[state][symbol]
            if symbol == INSULT:
                last_kind = "negated" if said & NEGATED else "reported" if said & REPORTED else \
                    "aimed" if said & AIMED else "plain"
                last = weight
                out[last_kind] += weight
            elif said & LATE_AIM and last_kind == "plain":
                out["plain"] -= last
                out["aimed"] += last
                last_kind = ""
            if said & THREATENED:
                out["threat"] += 1.0
        return out

    def features(self, text: str) -> np.ndarray:
        """The features of a whole text; only clauses in which the lexicon occurs are read word by word."""
        text = text.lower()
        sums, clauses, done = dict.fromkeys(KINDS, 0.0), 0, 0
        for match in self.find(text):
            if match.start() < done:
                continue  # its clause has been read
            first = done
            for end in CLAUSE_END.finditer(text, done, match.start()):
                first = end.end()
            end = CLAUSE_END.search(text, match.end())
            done = end.start() if end else len(text)
            found = self.clause(WORD.findall(text, first, done))
            if any(found.values()):
                clauses += 1
                for kind, weight in found.items():
                    sums[kind] += weight
        spaces = 1 + text.count(" ") + text.count("\n")
        return np.array([math.log1p(clauses), float(clauses > 0), math.log1p(100 * clauses / spaces),
                         math.log1p(100 * sum(sums.values()) / spaces), *(math.log1p(max(0.0, sums[k])) for k in KINDS)])

    def score(self, text: str) -> float:
        z = float(self.weights[0] + self.features(text) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int, seed: int) -> tuple[DataFrame, float]:
    """``text`` and ``toxic`` of about ``sample`` labelled rows of either class, and the log odds that the draw has moved.

    Labels are 0 or 1; of a document's repeated labels the largest holds.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = dict(usable.groupBy("toxic").count().collect())
    share = {k: min(1.0, sample / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(share.get(1, 1.0) * (1 << 30))).otherwise(int(share.get(0, 1.0) * (1 << 30)))
    drawn = usable.filter(draw < limit)
    # about twice ``sample`` ids, whatever the size of the tables
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    moved = math.log(share.get(1, 1.0) / share.get(0, 1.0))
    return stored(picked, "labelled"), moved


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Words and word beginnings that toxic rows have far more often than others, by rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
                words = set(WORD.findall(text.as_py().lower())).difference(GRAMMAR)
                seen[toxic].update(words)
                seen[toxic].update({b for w in words for b in beginnings(w)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from emitted(seen)
        yield from emitted(seen)

    def emitted(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for toxic, counts in enumerate(seen):
            items = list(counts.items())
            counts.clear()
            for k in range(0, len(items), 50_000):
                part = items[k: k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()),
                     pa.array([n for _, n in part], pa.int64())], ["entry", "toxic", "n"])

    rows = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_other = rows.get(1, 0), rows.get(0, 0)
    counted = sample.mapInArrow(run, "entry string, toxic int, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_other + 1.0))
    sure = ratio - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counted.filter(F.col("a") >= SUPPORT).select("entry", "a", ratio.alias("ratio"), sure.alias("sure")).filter(
        F.col("sure") >= SURE).orderBy(F.desc(F.col("sure") * F.sqrt("a")), "entry").limit(entries)
    found = {r["entry"]: (r["ratio"], r["sure"]) for r in best.collect()}
    kept: dict[str, float] = {}
    for entry, (ratio_, sure_) in sorted(found.items(), key=lambda x: (len(x[0].rstrip("*")), x[0])):
        covered = [kept[b] for b in beginnings(entry.rstrip("*")) if b in kept]
        if not covered or sure_ > max(covered):  # a longer entry must tell more than its own beginning does
            kept[entry] = sure_
    return {e: found[e][0] for e in kept}


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE, seed: int = 8) -> Model:
    """Lexicon, then weights by ridge-penalised logistic regression. Without rows of both classes nothing is toxic."""
    drawn, moved = labelled_sample(docs, labels, folds, held, sample, seed)
    model = Model(learn_lexicon(drawn))
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py()) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = drawn.mapInArrow(run, schema).collect()  # a few numbers for each sampled row
    labels_seen = {r["toxic"] for r in rows}
    if labels_seen != {0, 1}:
        model.weights[0] = 30.0 if labels_seen == {1} else -30.0
        return model
    x = np.array([[1.0, *r["x"]] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    penalty = np.full(x.shape[1], 0.1)
    penalty[0] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[0] -= moved  # back to the odds before the draw
    model.weights = w
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced. Null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            scores = np.array([shared.value.score(t.as_py()) for t in texts(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= CUT).astype(np.int32))],
                                             schema.names)

    return kept.mapInArrow(tidied(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = (fold("doc_id", 4) == 2).alias("held_out")
    return score(docs.select("doc_id", "text", held), model).select("doc_id", "held_out", "score", "predicted")
