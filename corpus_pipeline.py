"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (session, documents, folder of the tables) and is
written to Parquet and read again before the next one starts, so a lost
executor or driver repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import decontamination, near_copies, quality_rules, sentence_pieces, simhash, toxicity
from riskgrid.llm.common import frozen, read, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted text is that labelled as good."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels").where(F.col("quality") == 1))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash tries find them, five-word shingles of Jaccard similarity 0.8 or more settle it."""
    return simhash.one_of_each(docs, near_copies.near_copies(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the text they decode to."""
    return sentence_pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("toxicity", not_toxic),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("sentence pieces", tokenize),
]

#: The stages train classifiers and merge byte pairs, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
