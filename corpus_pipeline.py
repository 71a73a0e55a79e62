"""Filter, deduplicate, mix and encode a corpus: stages of the operators in `riskframe.llm`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import encoding, mixing, near_text, pieces, quality, repetition
from riskframe.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repeats."""
    return repetition.judge(docs.select(*COLUMNS), prefix="__").where("__kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be good, by the model that operator 4 learns from `labels`."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return docs.select(*COLUMNS).where(quality.score(F.col("text"), model) >= quality.KEPT_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and similar texts: the one of smallest doc_id."""
    return near_text.one_of_each(docs.select(*COLUMNS), near_text.near_texts(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none more than three times."""
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the check that they decode to the text."""
    encoded = encoding.round_trip(docs.select("doc_id", "source", "text"), pieces.load())
    return encoded.select("doc_id", "source", "ids", "n_pieces", "decoded_crc32", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# Suffix arrays, a learned model, similarity classes and piece ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
