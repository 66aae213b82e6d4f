"""A corpus from raw documents to token ids, in five stages; each is written as Parquet before the next begins.

1. toxicity: documents that the grammar rejects go.
2. near_duplicates: one document of each group of near copies stays (shingles of five words, similarity 0.8).
3. secrets: what looks like a live secret is replaced by a mark.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. tokens: byte-level BPE ids of each document, with digests of the ids and of the decoded text.

The first four return the columns of documents.

Defined results of every stage.  Null or empty texts are empty texts: never toxic, linked with nothing, without secrets, of size 0 (so
they are taken by their source's rate), without ids.  Null ids and repeated rows count by themselves, but rows that repeat both id and text
are one document to the second stage.  Extra columns, whatever their names, pass the first four stages as they are; n_chars is set anew where
a secret is replaced.  Empty tables: no rows.  Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bytebpe, mixing, near, secrets, toxicity
from leafmill.llm.common import discard, kept, saved, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold; without labels the given word lists decide."""
    model = toxicity.train_model(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id; documents without words or without an id stay."""
    return near.without_duplicates(spark, docs, k=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark instead of what looks like a live secret."""
    return secrets.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate and its draw say; a null source is a source of its own."""
    return mixing.emit(mixing.mix(spark, docs, keep_all=True)).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    vocabulary = bytebpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    trip = bytebpe.round_trip(spark, docs, vocabulary)
    return bytebpe.digests(trip, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Toxicity, near duplicates and BPE can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage has read and what it wrote on its way goes when its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            made = kept(saved(spark, stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if i:
            discard(spark, docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
