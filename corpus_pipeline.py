"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents:

1. quality rules: rejected documents go, failing lines of the others go;
2. line dedup: lines that repeat an earlier one, up to one edit, go;
3. near-dedup: of documents joined by a similarity of 0.8 or more over five-word shingles, one stays;
4. benchmark decontamination: documents with a benchmark window go;
5. packing: the ids of what is left in sequences of 1024, a row for each piece.

The third stage links by SimHash fingerprints with the near-duplicate operator's parts and thresholds (`simhash`), each link verified on
whole sets of shingles. 64 bits can't reach all pairs at that similarity (see the README), so MinHash keys (`similar`) then join what is still apart.

Defined for every stage: a null text has no words, so stage 1 rejects it, as it does blank and very short ones; what later stages get
has text. Null ids stay null and are told apart by their rows; repeated rows are equal documents, of which stage 3 keeps one. Very
long texts are judged whole. Columns beyond those of documents pass through, whatever their names. An empty table gives empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, lines, packing, quality, shared, similar

TOKENIZER = "byte_bpe_50k.json"


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(quality.filter_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(lines.remove(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Fingerprints, quality rules and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
