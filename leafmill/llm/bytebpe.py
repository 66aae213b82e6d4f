"""Byte-level BPE, encoding and decoding of whole columns.

Pre-tokens of a piece of many documents are found at once (``pretokens``), their byte slices made distinct with
array operations, and only distinct slices go to the cached pair merging; ids are then laid out for all
documents by gathers.  Each id keeps the offset at which its bytes end in the text, and decoding places the
bytes of the vocabulary by these offsets, without joining strings.

Scale: documents are independent; there is no shuffle.  The vocabulary (its file has a fixed size, about 1 MB)
is sent to the workers once.  Memory is bounded by the largest document or piece.

Defined results.  Null or empty text: no ids, empty decoded bytes.  Special tokens are ordinary text.  Repeated
rows: equal results.  Empty table: no rows.  Other columns than doc_id and text are not read, so clashing names
do no harm."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import Piece, chunks, gathered, lean, unique_slices
from leafmill.llm.common import ship, table
from leafmill.llm.pairs import Cached, Merges
from leafmill.llm.pretokens import bounds


class ByteVocabulary:
    """Tokens by rank, from the text of a file with a base64 token and its rank on each line."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        count = max(self.ranks.values(), default=-1) + 1
        self.lengths = np.zeros(count, np.int64)
        tokens = [b""] * count
        for token, i in self.ranks.items():
            tokens[i], self.lengths[i] = token, len(token)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.merges = Merges()
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges.add(left, right, i, i)
        self.cached = Cached(self._find)

    def _find(self, piece: bytes) -> bytes:
        """The ids of a pre-token, 4 bytes each."""
        whole = self.ranks.get(piece)
        single = self.single
        return array("I", [whole] if whole is not None else self.merges.merge([single[b] for b in piece])).tobytes()

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, where in the piece each id's bytes end, and where each text's ids begin."""
        data = piece.data
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(points) != len(leads):  # not UTF-8: byte by byte
            leads, points = np.arange(len(data)), data.astype(np.uint32)
        texts = piece.offsets[:-1]
        texts = texts[texts < len(data)]
        starts, ends = bounds(points, np.searchsorted(leads, texts), blanks=True, digits=False)
        edges = np.append(leads, len(data))
        starts, ends = edges[starts], edges[ends]
        first, inverse = unique_slices(data, starts, ends)
        raw = data.tobytes()
        found = [self.cached(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        ids = flat[gathered((np.cumsum(sizes) - sizes)[inverse], sizes[inverse])]
        begins = np.concatenate([[0], np.cumsum(sizes[inverse])])[np.searchsorted(starts, piece.offsets)]
        return ids, np.cumsum(self.lengths[ids]), begins

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, each placed to end at its offset."""
        sizes = self.lengths[ids]
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[gathered(ends - sizes, sizes)] = self.blob[gathered(self.begins[ids], sizes)]
        return out


_known: dict[int, ByteVocabulary] = {}


def _vocabulary(raw: bytes) -> ByteVocabulary:
    """The worker's vocabulary; kept between the tasks of a worker."""
    key = hash(raw)
    if key not in _known:
        _known.clear()
        _known[key] = ByteVocabulary(raw)
    return _known[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(known: ByteVocabulary, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in chunks(batch.column(1)):
        ids, ends, begins = known.encode(piece)
        at = pa.array(begins.astype(np.int32))
        ends = ends - np.repeat(piece.offsets[:-1], np.diff(begins))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids.astype(np.int32), ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), *lists], ["doc_id", "ids", "ends"])


def _decoded(known: ByteVocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(1)
    ids, ends = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    begins = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    texts = [known.decode(ids[a:b], ends[a:b]).tobytes() for a, b in zip(begins[:-1], begins[1:])]
    return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(spark: SparkSession, docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Rows doc_id, ids (array of int), ends (byte offset in the text at which each id's bytes end)."""
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(sent.value)
        for batch in batches:
            yield from _encoded(known, batch)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, ids array<int>, ends array<long>")


def decode(spark: SparkSession, encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """Rows doc_id, ids, decoded (binary), from what ``encode`` has made."""
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(sent.value)
        for batch in batches:
            yield _decoded(known, batch)

    return encoded.select("doc_id", "ids", "ends").mapInArrow(lean(run), "doc_id long, ids array<int>, decoded binary")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """``decode`` of ``encode`` in one pass: the ids of a piece are decoded before the next piece is read, so
    neither ids nor offsets go through the JVM in between."""
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(sent.value)
        for batch in batches:
            for made in _encoded(known, batch):
                yield _decoded(known, made)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, ids: bool = False) -> DataFrame:
    """Number of ids and digests of ids and decoded bytes of each row; with ``ids`` the ids too."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", *(["ids"] if ids else []), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(round_trip(spark, table(spark, sf_dir, "documents"), vocabulary))
