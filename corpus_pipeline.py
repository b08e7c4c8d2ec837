"""A corpus pipeline in five stages; each takes all rows its predecessor kept, and what it decides takes effect.

toxicity: documents predicted toxic go. exact_dedup: of equal texts (A-Z folded) the largest id stays.
near_dedup: of texts linked by a SimHash similarity of 0.8 or more on 5-word shingles the smallest id stays.
mixing: documents are repeated or left out to meet the sources' target weights, in training order. bpe: every
row is encoded and decoded; the last stage returns doc_id, n_tokens, ids_sha256 and decoded_sha256, one row
for each copy that the mix takes.

Defined results: a null text is an empty one, never toxic by itself, equal to other empty ones, of size 0 and of no
tokens; of equal texts the largest id stays (null ids lose), of near copies the smallest; rows that repeat an id and
a text leave one row by the second stage; ties in the order of training fall to a digest of the row; other columns
are carried to the end of the fourth stage, whatever their names; an empty table gives no rows. Without usable
labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import exact_dedup, lexicon_bpe, mixing, simhash_similar, toxicity
from chronolith.llm.common import materialise, table

#: Vocabulary file of the last stage, by its public name.
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_similar.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return lexicon_bpe.round_trip_digests(docs, path(TOKENIZER), lexicon_bpe.build_lexicon(docs, path(TOKENIZER)))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("bpe", encode)]

#: SQL can express neither the scan for segments nor the tokenizer; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", (docs,))  # the former stage's table is done with
    return STAGES[-1][1](spark, docs, sf_dir)
