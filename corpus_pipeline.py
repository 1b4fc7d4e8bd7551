"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

1. quality: documents that the classifier scores under its threshold go.
2. near_duplicates: of each group of near copies one document stays, that with
   the smallest doc_id.
3. decontamination: documents that hold an item of ``benchmark`` go.
4. mixing: sources are taken up to their targets; a document that the mix
   takes twice is two rows, the one at a source's edge has its first words.
5. tokens: the ids of all texts are written as Huffman-coded shards and read
   back: doc_id, start, n_tokens and ids_crc32 of every row.

Rules for unusual rows: a null or empty text is scored, deduplicated and written
like an empty one, holds no item, and has no words to mix, so the fourth stage
leaves it out.  Rows with the same doc_id and text are one from the second stage
on; rows that share only the doc_id are judged apart.  A null doc_id counts as
larger than all others in the second stage and comes first in the last one.
Columns besides doc_id, text and source are carried along, whatever their names;
n_chars is set anew where a text is cut.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, mixing, quality, simhash, token_output
from foliant.llm._tables import load, settle

TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.write_and_read(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: No SQL: a trained classifier and a tokenizer are among the stages. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
