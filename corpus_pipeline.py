"""From documents to packed sequences: toxic documents go, then copies, near copies and benchmark passages; the rest is packed.

Every stage reads what its predecessor wrote and works on all of it. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import tokenizer_path, written
from panelyard.llm.decontam import drop_leaks
from panelyard.llm.exactdedup import drop_copies
from panelyard.llm.minhash import drop_near_copies
from panelyard.llm.packing import cut_pieces, place_pieces
from panelyard.llm.toxicity import drop_toxic, fit

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share four fifths of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(docs, _table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, SHINGLE_WORDS, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    light = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return place_pieces(light).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores, signatures and merges have no SQL; the tests hold the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
