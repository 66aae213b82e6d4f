"""Token counts with a whole-token shortcut, for a BPE vocabulary with word ends.

Before any text is read, every vocabulary string with a word end is merged by the rules; the strings that come out as
one token are known to count 1 wherever they stand as a pre-token.  Pre-tokens of a piece of many documents are found by
``pretokens``, made distinct by array operations, and only those that are not such strings are merged (cached).

Normalisation as the vocabulary file asks for: NFC, white space dropped, lower case of each character.  The added special
tokens of the file are found in the raw text first, as the library does by default, and count 1 each; what stands between
them is normalised by itself.

Scale: documents are independent; no shuffle; the vocabulary file (about 2 MB, its size is fixed) goes to the workers once.

Defined results.  Null or empty text: n_bytes 0, n_tokens 0, over_limit false.  Equal texts: equal values.  Empty table:
no rows.  Only doc_id and text are read.  Very long texts and very long words: counted whole; merging takes n log n steps."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import chunks, lean, unique_slices
from leafmill.llm.common import ship, table
from leafmill.llm.pairs import Cached, Merges
from leafmill.llm.pretokens import bounds

LIMIT = 2048
#: Bytes that stand for themselves in byte-level vocabularies; the others take code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte."""
    plain, out, more = set(_PLAIN), [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class WordVocabulary:
    """The counts that a tokenizer file of this kind leads to."""

    def __init__(self, raw: bytes) -> None:
        file = json.loads(raw)
        model = file["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary = model["vocab"]
        self.numbers, self.known = dict(self.vocabulary), frozenset(self.vocabulary.values())
        self.merges = Merges()
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.add(self._number(left), self._number(right), rank, self._number(left + right))
        self.letters = byte_letters()
        added = file.get("added_tokens", [])
        if any(t.get(way) for t in added for way in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space, whole words or normal text are not supported")
        special = [t["content"] for t in added]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hints = {t[:2] for t in special}  # what a text must hold for the search to be worth it
        self.whole = self.prove_whole()
        self.cached = Cached(self._find)

    def _number(self, token: str) -> int:
        """The number of a token; one beyond the vocabulary for a token that isn't in it."""
        return self.numbers.setdefault(token, len(self.numbers) + 1000)

    def _merge(self, letters: str) -> list[int]:
        """Numbers of the tokens of one pre-token, given in letters."""
        return self.merges.merge([self._number(x) for x in letters[:-1]] + [self._number(letters[-1] + self.end)])

    def prove_whole(self) -> frozenset[str]:
        """The pre-tokens, in letters, that come out as one token of the vocabulary."""
        ends = (token[: len(token) - len(self.end)] for token in self.vocabulary if token.endswith(self.end))
        return frozenset(word for word in ends if word and len(self._merge(word)) == 1)

    def _find(self, piece: bytes) -> int:
        letters = "".join([self.letters[b] for b in piece])
        if letters in self.whole:
            return 1
        return sum(1 for part in self._merge(letters) if part in self.known)

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma: letter by letter

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if any(hint in text for hint in self.hints):
                pieces = self.special.split(text)
                out[i] += len(pieces) - 1
            parts += map(self._normal, pieces)
            owner += [i] * len(pieces)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
        edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts, ends = bounds(points, begins[begins < len(points)], blanks=False, digits=True)
        if not len(starts):
            return out
        part = np.searchsorted(begins + sizes, starts, side="right")
        first, inverse = unique_slices(data, edges[starts], edges[ends])
        raw = data.tobytes()
        found = [self.cached(raw[a:b]) for a, b in zip(edges[starts[first]].tolist(), edges[ends[first]].tolist())]
        each = np.array(found, np.int64)[inverse]
        return out + np.bincount(np.asarray(owner)[part], weights=each, minlength=len(texts)).astype(np.int64)


_known: dict[int, WordVocabulary] = {}


def _vocabulary(raw: bytes) -> WordVocabulary:
    key = hash(raw)
    if key not in _known:
        _known.clear()
        _known[key] = WordVocabulary(raw)
    return _known[key]


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens."""
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(sent.value)
        for batch in batches:
            for piece in chunks(batch.column(1)):
                texts = [piece.text(i).decode("utf-8", "replace") for i in range(len(piece))]
                columns = [batch.column(0).slice(piece.first, len(piece)), pa.array(np.diff(piece.offsets)), pa.array(known.count(texts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocabulary = f.read()
    return token_counts(spark, table(spark, sf_dir, "documents"), vocabulary).withColumn("over_limit", F.col("n_tokens") > LIMIT)
