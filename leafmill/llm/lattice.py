"""Subword lattice likelihood: log10 probability of a document, summed over all segmentations.

The pieces are those of an existing subword vocabulary, whatever their length; a word is a blank and its bytes, and every single
byte is a piece, so each word has at least one segmentation.  (Pieces with a blank behind their first byte can't stand in a word.)
The vocabulary's scores weight the segmentations: they are a prior worth ``PRIOR`` occurrences, to which four rounds add the
expected counts of pieces over all segmentations of the training documents.  Forward recursion in log space then gives the
marginal probability of each word; a document is the product over its words and one end.

The recursion is done once for every distinct word, not for every word of every text:

1. ``blocks``: one pass over the texts turns blocks of documents of some megabytes into the block's distinct words
   and, for each document, the numbers of its words with their counts.
2. Counts of words over all training documents; expected counts of pieces over all distinct training words.
3. Each block's words meet the word table on the word, and the block's documents on the block.

Scale: what is shuffled are distinct words of blocks, not words of texts; frequent words cost a row for each block.  Piece
probabilities (as many as the vocabulary has pieces) are the only thing that every task gets, and the only thing the driver
collects.  Blocks have a bounded size, and partitions grow in number with them; words of any length take time in proportion to it.

Defined results.  Null or empty text: the end alone.  Null id: hashed as the empty text, not held out.  Rows with equal ids
are scored one by one.  No training documents: counts are 0 and the vocabulary's own order decides.  Empty table: no rows."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import BASE, KEEP, U64, chunks, eights, lean, mixed
from leafmill.llm.common import remainder, saved, ship, table

FOLDS, HELD = 7, 2
ROUNDS = 4
BLOCK = 16 << 20  # bytes of text
WIDE = 256  # bytes of a word; longer ones are rare and go one by one
PRIOR = 32_000  # occurrences that the vocabulary's own scores are worth
LANES = 1 << 14  # most partitions that blocks are dealt to
_LN10 = math.log(10)


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, best score first; blanks as blanks, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored = []
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            scored.append((-model.get_score(i), piece))
    known = dict.fromkeys(p for _, p in sorted(scored))
    return [*known, *(bytes([b]) for b in range(256) if bytes([b]) not in known)]


class Pieces:
    """Piece look-up by hash for many words at once.  The end of a document is the number after the last piece."""

    SLOTS = 19  # bits

    def __init__(self, pieces: list[bytes]) -> None:
        self.count = len(pieces)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.sizes = sorted({len(p) for p in pieces})
        keys = np.zeros(len(pieces), U64)
        for size in self.sizes:
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(len(own), size)
            keys[own] = Keys(data).of(0, size)
        slot = (keys >> U64(64 - self.SLOTS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        first = np.searchsorted(slot[order], slot[order])
        depth = np.arange(len(order)) - first  # pieces of one slot lie in layers
        self.layers = []
        for level in range(int(depth.max(initial=0)) + 1):
            own = order[depth == level]
            held, number = np.zeros(1 << self.SLOTS, U64), np.full(1 << self.SLOTS, -1, np.int32)
            held[slot[own]], number[slot[own]] = keys[own], own
            self.layers.append((held, number))

    def find(self, keys: Keys, i: int, j: int) -> np.ndarray:
        """For each word, the number of the piece at bytes i:j, or -1."""
        key = keys.of(i, j)
        slot = (key >> U64(64 - self.SLOTS)).astype(np.int64)
        held, number = self.layers[0]
        found = np.where(held[slot] == key, number[slot], -1)
        for held, number in self.layers[1:]:
            more = np.flatnonzero(held[slot])
            found[more] = np.where(held[slot[more]] == key[more], number[slot[more]], found[more])
        return found

    def start(self) -> np.ndarray:
        """Log probabilities by the vocabulary's order, the end included."""
        weight = 1.0 / (np.arange(self.count + 1) + 10.0)
        weight[-1] = weight[:100].sum() / 50
        return np.log(weight / weight.sum())


class Keys:
    """64-bit keys of bytes i:j of many words of one size (rows of ``data``), eight bytes a step; slices of up to eight bytes and of
    one size have equal keys only if they are equal."""

    def __init__(self, data: np.ndarray) -> None:
        self.rows, self.width = data.shape
        self.wide = eights(data.ravel())
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def _before(self, i: int, steps: int) -> np.ndarray:
        """What the first ``steps`` times eight bytes from i on come to."""
        if not steps:
            return np.zeros(self.rows, U64)
        found = self.known.get((i, steps))
        if found is None:
            at = i + 8 * (steps - 1)
            found = self.known[i, steps] = mixed((self._before(i, steps - 1) ^ self.wide[at :: self.width][: self.rows]) * BASE)
        return found

    def of(self, i: int, j: int) -> np.ndarray:
        steps = (j - i - 1) // 8
        at = i + 8 * steps
        return mixed((self._before(i, steps) ^ self.wide[at :: self.width][: self.rows] & KEEP[j - at]) * BASE + U64(j - i))


@lru_cache(maxsize=2)
def _pieces(pieces: tuple[bytes, ...]) -> Pieces:
    return Pieces(list(pieces))


def lattice(words: list[bytes], known: Pieces, logp: np.ndarray, weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each word over all its segmentations.

    With ``weights`` and ``expected``: adds each piece's expected count, by forward and backward recursion.  Words of
    equal length advance together."""
    out = np.zeros(len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for r in np.flatnonzero(sizes > WIDE):
        out[r] = _long(b" " + words[r], known, logp, 0.0 if weights is None else float(weights[r]), expected)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] <= WIDE]
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        width = int(sizes[group[0]]) if len(group) else 0
        step = max(1, (1 << 18) // max(1, width))
        for rows in (group[a : a + step] for a in range(0, len(group), step)):
            data = np.frombuffer(b"".join(b" " + words[r] for r in rows), np.uint8).reshape(len(rows), width)
            keys = Keys(data)
            ahead = np.full((width + 1, len(rows)), -np.inf)
            ahead[0] = 0.0
            arcs = []
            for j in range(1, width + 1):
                for size in known.sizes:
                    if (i := j - size) < 0:
                        break
                    number = known.find(keys, i, j)
                    on = np.flatnonzero(number >= 0)
                    if len(on):
                        score = logp[number[on]]
                        ahead[j, on] = np.logaddexp(ahead[j, on], ahead[i, on] + score)
                        if expected is not None:
                            arcs.append((i, j, on, number[on], score))
            out[rows] = ahead[width]
            if expected is None:
                continue
            back = np.full((width + 1, len(rows)), -np.inf)
            back[width] = 0.0
            for i, j, on, _, score in reversed(arcs):  # by falling end: what ends at j is complete before j is used
                back[i, on] = np.logaddexp(back[i, on], score + back[j, on])
            weight = weights[rows]
            for i, j, on, number, score in arcs:
                share = np.exp(ahead[i, on] + score + back[j, on] - ahead[width, on]) * weight[on]
                np.add.at(expected, number, share)
    return out


def _long(word: bytes, known: Pieces, logp: np.ndarray, weight: float, expected: np.ndarray | None) -> float:
    """The same recursions for one long word, in time and memory in proportion to its length."""
    n, get, score, sizes = len(word), known.index.get, logp.tolist(), known.sizes

    def summed(terms: list[float]) -> float:
        most = max(terms)
        return most + math.log(sum(math.exp(t - most) for t in terms))

    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = summed([ahead[j - m] + score[k] for m in sizes if m <= j and (k := get(word[j - m : j])) is not None])
    if expected is not None:
        back = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            arcs = [(i + m, k) for m in sizes if i + m <= n and (k := get(word[i : i + m])) is not None]
            back[i] = summed([score[k] + back[j] for j, k in arcs])
            for j, k in arcs:
                expected[k] += weight * math.exp(ahead[i] + score[k] + back[j] - ahead[n])
    return ahead[n]


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (block, word, train, number) for a block's distinct words, with how often they stand in training
    texts, and (block, doc_id, held, numbers, counts) for its documents."""
    fields = [("block", pa.int64()), ("word", pa.binary()), ("train", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("numbers", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    shape = pa.schema(fields)
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    class Block:
        def __init__(self, number: int) -> None:
            self.number, self.size = number, 0
            self.numbers: dict[bytes, int] = {}
            self.train = array("q")
            self.ids, self.helds, self.own, self.counts, self.ends = [], [], array("i"), array("i"), [0]

        def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
            counted: dict[bytes, int] = {}
            for word in text.translate(lower).split():  # bytes are split at ASCII white space
                counted[word] = counted.get(word, 0) + 1
            numbers, train, own = self.numbers, self.train, self.own
            for word, n in counted.items():
                k = numbers.get(word)
                if k is None:
                    k = numbers[word] = len(train)
                    train.append(0)
                if not held:
                    train[k] += n
                own.append(k)
            self.counts.extend(counted.values())
            self.ids.append(doc_id), self.helds.append(held), self.ends.append(len(own))
            self.size += len(text) + 64

        def made(self) -> Iterator[pa.RecordBatch]:
            n, d = len(self.numbers), len(self.ids)
            yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.array(list(self.numbers), pa.binary()), pa.array(np.array(self.train, np.int64)), pa.array(np.arange(n, dtype=np.int32)), *(pa.nulls(n, t) for _, t in fields[4:])], schema=shape)
            ends = pa.array(self.ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(x, np.int32))) for x in (self.own, self.counts)]
            yield pa.RecordBatch.from_arrays([pa.array([self.number] * d, pa.int64()), *(pa.nulls(d, t) for _, t in fields[1:4]), pa.array(self.ids, pa.int64()), pa.array(self.helds, pa.bool_()), *lists], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, helds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in chunks(batch.column(2)):
                for i in range(len(piece)):
                    block.add(ids[piece.first + i], helds[piece.first + i], piece.text(i))
                if block.size >= BLOCK:
                    yield from block.made()
                    block = Block(block.number + 1)
        if block.ids:
            yield from block.made()

    held = remainder(F.col("doc_id"), FOLDS) == HELD
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "block long, word binary, train long, number int, doc_id long, held boolean, numbers array<int>, counts array<int>")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of small batches in batches of about ``rows``: words of equal length advance together, so many are wanted at once."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_scores(words: DataFrame, pieces: tuple[bytes, ...], logp: np.ndarray) -> DataFrame:
    """``words`` (word, train) with logp, the natural logarithm of the word's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(pieces)
        for batch in gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice(batch.column(0).to_pylist(), known, logp))], ["word", "train", "logp"])

    return words.select("word", "train").mapInArrow(lean(run), "word binary, train long, logp double")


def expected_counts(words: DataFrame, pieces: tuple[bytes, ...], logp: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all words, weighted by how often they stand in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(pieces)
        total = np.zeros(known.count + 1)
        for batch in gathered(batches):
            lattice(batch.column(0).to_pylist(), known, logp, batch.column(1).to_numpy(zero_copy_only=False).astype(float), total)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["piece", "n"])

    rows = words.where("train > 0").select("word", "train").mapInArrow(lean(run), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(pieces) + 1)
    out[rows["piece"].to_numpy(np.int64)] = rows["n"]
    return out


def likelihood(spark: SparkSession, docs: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> DataFrame:
    """Rows doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``rounds`` 0: the vocabulary's scores alone."""
    ship(spark)
    laid = saved(spark, blocks(docs), "lm-blocks")
    terms = laid.where("word is not null").select("block", "word", "train", "number")
    words = saved(spark, terms.groupBy("word").agg(F.sum("train").alias("train")), "lm-words")
    fixed = tuple(pieces)
    lanes = laid.where("word is null").agg(F.count_distinct("block")).first()[0]
    lanes = max(1, min(LANES, lanes))
    row = words.agg(F.sum("train"), F.sum((F.col("train") > 0).cast("long"))).first()
    ends = laid.where("word is null and not held").count()
    total, distinct = (row[0] or 0) + ends, (row[1] or 0) + int(ends > 0)
    logp = start = _pieces(fixed).start()
    for _ in range(rounds if total else 0):
        got = expected_counts(words, fixed, logp)
        got[-1] = ends
        got += PRIOR * np.exp(start)
        logp = np.log(got / got.sum())
    scored = word_scores(words, fixed, logp)
    # partitions grow in number with the blocks, so that what a task reads does not grow with the corpus
    met = terms.repartition(lanes, "word").join(scored.withColumnRenamed("train", "c").repartition(lanes, "word"), "word").select(F.col("block").alias("of"), "number", "c", "logp")
    own = laid.where("word is null").select(F.col("block").alias("at"), "doc_id", "held", "numbers", "counts")
    end_log, end_known, spread = float(logp[-1]) / _LN10, int(ends > 0), math.log10(total + distinct + 1)
    end_base = math.log10(ends + 1)

    def score(docs: pa.Table, terms: pa.Table) -> pa.Table:
        at = terms.column("number").to_numpy()
        c, lp = np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at], lp[at] = terms.column("c").to_numpy(), terms.column("logp").to_numpy()
        lists = docs.column("numbers").combine_chunks()
        numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = docs.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))

        def summed(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=counts * x, minlength=len(lists))

        n = summed(np.ones(len(numbers))).astype(np.int64) + 1
        base = summed(np.log10(c[numbers] + 1.0)) + end_base - n * spread
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": n, "n_known": summed(c[numbers] > 0).astype(np.int64) + end_known, "train_tokens": np.full(len(lists), total, np.int64), "base_score": base, "score": summed(lp[numbers]) / _LN10 + end_log})

    own, met = own.repartition(lanes, "at"), met.repartition(lanes, "of")
    return own.groupBy("at").cogroup(met.groupBy("of")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return likelihood(spark, table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
