"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult, threat, target, negation, reported speech, clause end, other.  A first transducer reads the
clause backwards and marks the words that a target still follows.  Four more read words and marks forwards: what is said (insult
or threat), the scope of a negation, the scope of reported speech, and whether the clause has a target, before or ahead.  They are
composed into one table, whose output at a word is a pattern such as "insult, not negated, not reported, aimed at a target"; each
pattern carries the weight of the word that set it off.  A logistic regression over the weights of the patterns gives the
score, so a negated or reported insult counts what it is worth in the labelled rows, and a word counts only by its clause.

Learned from labelled rows: the insult lexicon (words, and stems that begin words) with its weights, and the weights
of the patterns.  It is fitted on a bounded sample, ``SAMPLE`` labelled rows of smallest hash, none of them held out.  Of near
copies in the sample one stays (a row must be the smallest of each of eight min-hash keys), so a text that is copied
a thousand times teaches its words once.  Closed-class words and a few common insults are given.

Scale: the sample of labels is bounded and sent to all tasks; texts are never shuffled for it, and scoring is a map over
all whole texts with a model of bounded size.  Of a long text one byte a word is held, so clauses of any length are read whole.

Defined results.  Null or empty texts, and texts without patterns: the score of the intercept.  No labels at
all: the given lexicon with prior weights.  Null ids: hashed as the empty text, not held out.  Repeated rows: equal scores.
Labels of null are left out; an id labelled twice counts by its largest label.
An id that several documents share: all of them are training rows of its label.  Only doc_id and text of the documents are read."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import U64, chunks, distinct_sorted, lean, mixed, shingles
from leafmill.llm.common import remainder, saved, ship, table
from leafmill.llm.logistic import fit, sigmoid

SAMPLE = 30_000
THRESHOLD = 0.3
FOLDS, HELD = 4, 2

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# Chosen word lists: closed-class words and common insults in four languages.
TARGETS = "you your yours u they them he she him her these those people du dich dir ihr euch sie ihn tu te toi vous vos ton ta ils elles tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nor n't isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco ni".split()
REPORTS = "said says saying called calls wrote writes quoted quote claimed reported according sagte sagt nannte schrieb zitierte disait dit écrit appelé selon dijo dice llamó escribió según".split()
THREATS = "kill murder hurt destroy shoot stab beat strangle töte töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron stupid loser scum pathetic trash worthless disgusting clown imbecile dumb dummkopf trottel abschaum crétin imbécile ordure idiota estúpido basura escoria".split()
GIVEN = 3.0

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")
STEM = (4, 5, 6, 7)
PART = 1 << 16  # tokens of a long text that are held at a time
LONG = 1 << 20  # characters of a text from which on its tokens are not held all at once


@dataclass(frozen=True)
class Transducer:
    """States and outputs by input: step[state][input] -> (state, output)."""

    step: tuple[tuple[tuple[int, int], ...], ...]

    @classmethod
    def of(cls, states: int, inputs: int, rule: Callable[[int, int], tuple[int, int]]) -> Transducer:
        return cls(tuple(tuple(rule(s, x) for x in range(inputs)) for s in range(states)))

    def compose(self, other: Transducer, width: int) -> Transducer:
        """Both at once: the state is a pair, the output self's * width + other's."""
        m = len(other.step)
        return Transducer(tuple(tuple((x[0] * m + y[0], x[1] * width + y[1]) for x, y in zip(a, b)) for a in self.step for b in other.step))

    def run(self, inputs: Iterable[int]) -> list[int]:
        state, out, step = 0, [], self.step
        for x in inputs:
            state, said = step[state][x]
            out.append(said)
        return out


CLASSES = 7
SCOPE = 3  # words after a negation that it reaches


def ahead() -> Transducer:
    """Read backwards; output: class * 2 + whether a target of the clause follows."""
    return Transducer.of(2, CLASSES, lambda s, c: (0 if c == END else 1 if c == TARGET else s, 2 * c + (s and c != END)))


def grammar() -> Transducer:
    """Read forwards, over the output of ``ahead``; output = kind * 8 + negated * 4 + reported * 2 + aimed at a target.  Kind 0 says nothing, 1
    insult, 2 threat."""

    def machine(states: int, rule: Callable[[int, int, int], tuple[int, int]]) -> Transducer:
        return Transducer.of(states, 2 * CLASSES, lambda s, x: rule(s, x >> 1, x & 1))

    kind = machine(1, lambda s, c, follows: (0, 1 if c == INSULT else 2 if c == THREAT else 0))
    negated = machine(SCOPE + 1, lambda s, c, follows: (0 if c == END else SCOPE if c == NEGATION else max(0, s - 1), int(s > 0)))
    reported = machine(2, lambda s, c, follows: (0 if c == END else 1 if c == REPORT else s, s))
    target = machine(2, lambda s, c, follows: (0 if c == END else 1 if c == TARGET else s, s | follows))
    return kind.compose(negated, 2).compose(reported, 2).compose(target, 2)


#: Patterns: (insult, threat) x negated x reported x target in the clause; then the length.
PATTERNS = 16
FEATURES = PATTERNS + 1
PRIOR = np.array([kind * n * r * t for kind in (1.5, 0.5) for n in (1.0, 0.4) for r in (1.0, 0.6) for t in (1.0, 1.3)] + [0.0, -3.5])


@dataclass
class Lexicon:
    """Weights of insults: whole words, and stems that begin a word."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, GIVEN))
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) if len(word) >= n + 2 else 0.0 for n in STEM))


class Reader:
    """Texts to pattern features, with a bounded cache of word classes."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.backwards, self.forwards, self.kept = lexicon, ahead(), grammar(), {}
        self.closed = dict.fromkeys(THREATS, THREAT) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(ENDS, END)

    def read(self, word: str) -> tuple[int, float]:
        found = self.kept.get(word)
        if found is None:
            kind, weight = self.closed.get(word, OTHER), 1.0
            if kind in (OTHER, TARGET, THREAT) and (w := self.lexicon.weight(word)) > 0:
                kind, weight = INSULT, w
            if len(self.kept) >= 150_000:
                self.kept.clear()
            found = self.kept[word] = (kind, weight)
        return found

    def features(self, text: str) -> np.ndarray:
        out, known, read = np.zeros(FEATURES), self.kept, self.read
        kinds, weights = bytearray(), array("d")  # the class of every word; the weight of every insult and threat, in order
        for part in _tokens(text):
            seen = [known.get(t) or read(t) for t in part]
            own = bytes([kind for kind, _ in seen])
            kinds += own
            if INSULT in own or THREAT in own:
                weights.extend(w for kind, w in seen if kind in (INSULT, THREAT))
        at = 0
        if weights:
            for clause in kinds.split(bytes([END])):
                if INSULT in clause or THREAT in clause:
                    marked = self.backwards.run(reversed(clause))[::-1]
                    for said in self.forwards.run(marked):
                        if said >= 8:
                            out[said - 8] += weights[at]
                            at += 1
        out[:PATTERNS] = np.log1p(out[:PATTERNS])
        out[-1] = math.log1p(len(kinds)) / 10
        return out


def _tokens(text: str) -> Iterator[list[str]]:
    """The tokens of a text in lists; a token is never cut."""
    if len(text) <= LONG:
        yield TOKEN.findall(text.lower())
        return
    found = (m.group() for m in TOKEN.finditer(text.lower()))
    while part := list(islice(found, PART)):
        yield part


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, sample: int, folds: int | None, held: int | None) -> DataFrame:
    """Rows doc_id, text, label of at most ``sample`` labelled documents that aren't held out, those of smallest hash."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    if folds:
        known = known.where(remainder(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most ``sample`` rows of two numbers
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")


def copy_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, label) with eight min-hash keys each, for leaving out near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column(1)):
                sets, begin = distinct_sorted(*shingles(piece, 4), len(piece))
                keys = []
                for a, b in zip(begin[:-1], begin[1:]):
                    own = sets[a:b]
                    keys.append([int(mixed(own ^ U64(0x9E3779B9 * (i + 1))).min() >> U64(4)) * 8 + i - (1 << 62) for i in range(8)] if b > a else [])
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text", "label", "keys"])

    return rows.select("doc_id", "text", "label").mapInArrow(lean(run), "doc_id long, text string, label int, keys array<long>")


def without_copies(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` without those that share a min-hash key with a row of smaller id and the same label."""
    keyed = saved(spark, copy_keys(rows), "copies")
    long = keyed.select("doc_id", "label", F.explode("keys").alias("key"))
    least = long.groupBy("key", "label").agg(F.min("doc_id").alias("least"))
    copies = long.join(least, ["key", "label"]).where("least < doc_id").select("doc_id").distinct()
    return keyed.join(copies, "doc_id", "left_anti").drop("keys")


def _units(text: str) -> set[str]:
    """Words, and stems marked by a star."""
    words = {t for t in TOKEN.findall(text.lower()) if t not in ENDS}
    return words | {w[:n] + "*" for w in words for n in STEM if len(w) >= n + 2}


def _unit_counts(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """In how many rows each unit stands, as partial counts: unit, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["unit", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                units = _units(text or "")
                counts.update(units if among is None else units & among)
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return rows.select("text").mapInArrow(lean(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Units that stand in toxic rows far more often than chance allows.

    Only units of at least 3 toxic rows and of one in 1000 of them are looked at, so their number is bounded
    by the length of the texts, not by their number; a unit counts if its share of toxic rows can't be a
    coincidence even among all units looked at."""
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    found = Lexicon()
    if not ones or not zeros:
        return found
    least = max(3, ones // 1000)
    pos = {r["unit"]: r["n"] for r in _unit_counts(train.where("label = 1")).where(F.col("n") >= least).toLocalIterator()}
    neg = {r["unit"]: r["n"] for r in _unit_counts(train.where("label = 0"), frozenset(pos)).toLocalIterator()}
    base = ones / (ones + zeros)
    for unit, p in pos.items():
        n = neg.get(unit, 0)
        share = p / (p + n)
        odds = math.log((p + 0.5) / (ones + 1)) - math.log((n + 0.5) / (zeros + 1))
        evidence = (p + n) * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)) if share > base else 0
        if odds > 2.0 and evidence > math.log(len(pos)) + 3:
            (found.stems if unit[-1] == "*" else found.words)[unit.rstrip("*")] = odds
    return found


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int | None = FOLDS, held: int | None = HELD) -> Model:
    ship(spark)
    rows = saved(spark, without_copies(spark, labelled(spark, docs, labels, "toxic", sample, folds, held)), "toxic-train")
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            made = [reader.features(t or "").tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["label", "x"])

    # a few numbers for each row of the sample, equal rows as one with their count; in an order that no partitioning changes
    got = rows.select("text", "label").mapInArrow(lean(run), "label int, x array<double>").groupBy("label", "x").agg(F.count("*").alias("n")).toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), FEATURES)
    y, n = got["label"].to_numpy(float), got["n"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return Model(lexicon, fit(x[order], y[order], PRIOR, weight=n[order]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, score, predicted."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in batches:
            for piece in chunks(batch.column(1)):
                x = np.array([reader.features(piece.text(i).decode("utf-8", "replace")) for i in range(len(piece))])
                score = sigmoid(x @ model.weights[:-1] + model.weights[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(spark, docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in batches:
            for piece in chunks(batch.column(at)):
                x = np.array([reader.features(piece.text(i).decode("utf-8", "replace")) for i in range(len(piece))])
                score = sigmoid(x @ model.weights[:-1] + model.weights[-1])
                yield batch.slice(piece.first, len(piece)).filter(pa.array(score < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
