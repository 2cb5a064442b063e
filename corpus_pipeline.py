"""From raw documents to packed training sequences: toxicity, line de-duplication, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns of documents.

Nulls and edge cases, stage by stage. A text without words (null, empty) isn't toxic unless most labels are, has no line to lose,
is a copy of all other such texts, holds no test window, and is packed as its end token. A row without a doc_id stays in all
stages unless it is toxic or contaminated itself; in line de-duplication such rows are one document. Repeated rows of a doc_id
are each judged by their own text: near-duplicates stay or go with their text, lines and test windows are those of the row. Extra
columns pass through, whatever their names, and have no say. Empty tables, labels or benchmarks give no rows, no toxic and no
contaminated documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import decontam, line_dedup, near_copies, packing, toxicity
from tickforge.llm.common import save, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("simhash_near_dedup", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer aren't SQL; tests/llm/test_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
