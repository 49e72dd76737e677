"""A corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before it has kept, and its result is written as Parquet and read
again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colsieve.llm.exact_dedup import distinct_rows
from colsieve.llm.mixing import mix
from colsieve.llm.near_dedup import near_duplicates
from colsieve.llm.packing import pack
from colsieve.llm.quality import N_GRADES, accepted, grades_of, train
from colsieve.llm.skew import without
from colsieve.sources.scratch import discard, read_table, written

#: Stages on word shingles take five words and this similarity.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejects documents whose grade is likelier toxic or low than good.

    Null and empty texts get what the model says of texts without words; equal rows stay or go together, and very long
    texts are read whole. Without documents there is nothing to fit on, and nothing to reject."""
    model = train(docs, grades_of(read_table(spark, sf_dir, "labels")), N_GRADES)
    return accepted(docs, model, N_GRADES - 1)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the row with the largest id stays; null is equal to empty. Of repeated rows one stays, and
    an id that isn't null stays before one that is. Texts of any length are compared whole."""
    return distinct_rows(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates the smallest id stays; rows without an id stay, and so do texts
    without words, null ones too. Rows that share an id stay or go together."""
    found = near_duplicates(docs, percent=NEAR_PERCENT)
    dropped = written(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id"), "near-dropped")
    return without(docs, dropped, "doc_id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document once at least, smaller sources more often, none more than twice. A null source is a
    source, a null text is empty, and rows that share an id are repeated together."""
    return mix(docs, max_epochs=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of sequences of 2048 tokens. A null or empty text is its end alone; a text of any length is
    cut into windows; every row is a document, repeated ones too."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # a stage's table, once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
