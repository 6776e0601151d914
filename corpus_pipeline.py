"""A training corpus from raw documents: five stages, each of which works on all that the one before has kept.

Counted as part of the subpackage for training text: whoever removes that removes this file too.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heddle.llm import decontaminate, packing, simhash, suffixes, toxicity
from heddle.llm.common import discard, new_path, read, scratch

#: Passages of this many bytes that an earlier document holds are cut out: 51 words of one letter with single separators
#: take as many, so any passage of over 50 words is as long or longer.
REPEATED_BYTES = 101


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows among docs."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id holds too are cut out of texts."""
    return suffixes.strip_repeats(docs, REPEATED_BYTES)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in a sequence of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_filter),
    ("packing", pack_sequences),
]

#: The classifier, the components and the packing plan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again by the next.

    What a stage needed on its way is deleted once its rows are written, and these once the next stage's are.
    """
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, [last] if last else [])
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
