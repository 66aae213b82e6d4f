"""Quality: base rules, and a logistic regression over hashed word and character n-grams.

The classifier reads words, word pairs and runs of 3 and 5 characters, each family hashed into 2 ** 16 weights and averaged over the text, so
long texts do not outweigh short ones.  It is trained on the labelled quality rows, at most ``SAMPLE`` of each label (those
of smallest hash) and at most ``ENTRIES`` different n-grams of texts in all, of which every fifth is held back for calibration: a slope and an intercept turn its sum into a
probability under the true shares of the labels among all labelled rows.  Texts are scored in Arrow batches by a few array
operations on all their bytes, and kept if the base rules pass and the probability reaches ``KEEP``.

Scale: one map over the documents; the sample, its n-grams and the weights (1 MB) have fixed bounds.  Base counts come from hashes of
words, windows and lines of a whole piece at once.

Defined results.  Null or empty text: no words, all counts 0, base_failed, not kept.  Labels of one kind only, or none: the
classifier (or a sample of which no text fits) has no verdict and every text that passes the base rules is kept.  Null labels are left out; an id labelled twice
counts by its larger label.  Rows are judged one by one, so repeated rows and ids do no harm.  Empty table: no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import SPACE, U64, Piece, chunks, lean, mixed, slice_hashes, window_hashes, words
from leafmill.llm.common import saved, scratch, ship, table
from leafmill.llm.logistic import fit, sigmoid

SAMPLE = 1_500
ENTRIES = 12_000_000  # n-grams of the sample, about 200 MB where it is fitted; texts in order of hash as long as they fit
KEEP = 0.35
BITS = 16
GRAMS = (3, 5)
FAMILIES = 2 + len(GRAMS)
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MIX = U64(0x9E3779B97F4A7C15)


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each (document, hash) stands more than once."""
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def base_counts(piece: Piece) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    docs, data = len(piece), piece.data
    starts, ends, doc = words(piece)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

    hashes = slice_hashes(data, starts, ends)
    windows = window_hashes(hashes, WINDOW)
    inside = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    hits = inside[_repeats(windows[inside], doc[inside])]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0

    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([piece.offsets, breaks + 1]))
    begin = edges[:-1]
    end = edges[1:].copy()
    end[np.isin(end - 1, breaks)] -= 1  # without the line's end
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = solid[end] > solid[begin]
    begin, end = begin[full], end[full]
    line_doc = np.searchsorted(piece.offsets[1:], begin, side="right")
    lines = slice_hashes(data, begin, end)
    order = np.lexsort((lines, line_doc))
    again = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    return {
        "n_words": np.bincount(doc, minlength=docs),
        "word_chars": per_doc(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_doc(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_doc[order[1:][again]], minlength=docs),
        "n_repeat_words": np.bincount(doc[covered], minlength=docs),
    }


def families(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: bucket of every n-gram, in order, and where each document's begin."""
    docs, data = len(piece), piece.data
    starts, ends, doc = words(piece)
    hashes = slice_hashes(data, starts, ends)
    shift = U64(64 - BITS)
    yield (hashes >> shift).astype(np.int32), np.searchsorted(doc, np.arange(docs + 1))
    pairs = window_hashes(hashes, 2)
    inside = doc[: len(pairs)] == doc[1:] if len(pairs) else np.zeros(0, bool)
    yield (pairs[inside] >> shift).astype(np.int32), np.searchsorted(doc[: len(pairs)][inside], np.arange(docs + 1))
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U64)
    if len(points) != len(leads):  # not UTF-8: byte by byte
        leads, points = np.arange(len(data)), data.astype(U64)
    texts = np.searchsorted(leads, piece.offsets)
    for n in GRAMS:
        m = max(0, len(points) - n + 1)
        packed = np.full(m, n, U64)
        for i in range(n):
            packed = (packed ^ points[i : i + m]) * _MIX
        good = np.ones(len(points), bool)
        for k in range(1, n):
            at = texts[1:] - k
            good[at[at >= texts[:-1]]] = False
        good = np.flatnonzero(good[:m])
        yield (mixed(packed[good]) >> shift).astype(np.int32), np.searchsorted(good, texts)


@dataclass
class Model:
    weights: np.ndarray  # families x buckets
    slope: float
    intercept: float

    def probability(self, piece: Piece) -> np.ndarray:
        """Probability of good quality of each text."""
        z = np.zeros(len(piece))
        for own, (bucket, begin) in zip(self.weights, families(piece)):
            sums = np.concatenate([[0.0], np.cumsum(own[bucket], dtype=np.float64)])
            z += (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(1, np.diff(begin))
        return sigmoid(self.slope * z + self.intercept)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Rows place, y, at, value, n of the sample: distinct buckets of all families with their share in the text, and how many."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample) for y in (0, 1)]
    # at most two samples of two numbers a row
    chosen = F.broadcast(parts[0].union(parts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column(1)):
                at, value = [[] for _ in range(len(piece))], [[] for _ in range(len(piece))]
                for f, (bucket, begin) in enumerate(families(piece)):
                    for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
                        u, n = np.unique(bucket[a:b], return_counts=True)
                        at[i].append((u + (f << BITS)).astype(np.int32))
                        value[i].append((n / max(1, b - a)).astype(np.float32))
                made = [pa.array([np.concatenate(x).tobytes() for x in xs], pa.binary()) for xs in (at, value)]
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *made, pa.array([sum(map(len, x)) for x in at], pa.int64())], ["place", "y", "at", "value", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id").select(F.xxhash64("doc_id", F.lit(5)).alias("place"), "text", "y")
    return rows.mapInArrow(lean(run), "place long, y int, at binary, value binary, n long")


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 60) -> Model | None:
    shares = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        laid_out = saved(docs.sparkSession, training_rows(docs, labels, sample), "quality-sample")
        # a few numbers for each row of the sample: which of them fit, both labels alike
        sizes = laid_out.select("place", "n").toPandas().groupby("place", sort=True)["n"].sum()
        fit_in = sizes[sizes.cumsum() <= ENTRIES]
        rows = laid_out.where(F.col("place") <= int(fit_in.index.max()) if len(fit_in) else F.lit(False)).select("y", "at", "value").toPandas()
    y = rows["y"].to_numpy(float)
    if len(rows) < 10 or y.min() == y.max():
        return None
    order = rows["at"].map(zlib.crc32).argsort(kind="stable").to_numpy()  # the same in every run
    y, at, value = y[order], rows["at"].to_numpy()[order], rows["value"].to_numpy()[order]
    held = np.arange(len(y)) % 5 == 4

    def laid(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [np.frombuffer(x, np.int32) for x in at[which]]
        return np.concatenate(own), np.concatenate([np.frombuffer(x, np.float32) for x in value[which]]), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])

    def sums(parts: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(parts[2], weights=w[parts[0]] * parts[1], minlength=n)

    train, target = laid(~held), y[~held]
    weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
    w, bias = np.zeros(FAMILIES << BITS, np.float32), 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):  # Adam over the whole sample
        off = (sigmoid(sums(train, w, len(target)) + bias) - target) * weight
        slope = np.bincount(train[0], weights=train[1] * off[train[2]], minlength=len(w)).astype(np.float32) + 1e-7 * w
        bias -= 2.0 * off.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w -= 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    z, known = sums(laid(held), w, int(held.sum())), y[held]
    # every label counts by its share among all labelled rows
    true = {k: shares.get(k, 0) / max(1, shares.get(0, 0) + shares.get(1, 0)) for k in (0, 1)}
    times = np.maximum(1, np.round(50 * np.where(known == 1, true[1] / max(1e-9, (known == 1).mean()), true[0] / max(1e-9, (known == 0).mean())))).astype(int)
    slope, intercept = fit(np.repeat(z, times)[:, None] if len(z) else np.zeros((0, 1)), np.repeat(known, times), np.array([1.0, bias]), 0.1)
    return Model(w.reshape(FAMILIES, -1), float(slope), float(intercept))


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""
    ship(docs.sparkSession)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column(1)):
                counts = base_counts(piece)
                n = counts["n_words"]
                failed = (n < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * n)
                p = model.probability(piece) if model else np.ones(len(piece))
                columns = [batch.column(0).slice(piece.first, len(piece)), *(pa.array(counts[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (p >= KEEP)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", "probability"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, probability double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train_model(docs, table(spark, sf_dir, "labels")))
