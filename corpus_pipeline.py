"""A training corpus from raw documents, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it
as Parquet and rereads it as the next stage's documents.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, neardup, pieces, quality, repeats
from lodestone.llm.limits import bound_batches
from lodestone.session import apply_runtime_conf, ship_package, work_path
from queries.common import Query

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def _prepare(spark: SparkSession) -> None:
    apply_runtime_conf(spark)
    bound_batches(spark)
    ship_package(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their host's rate reject."""
    _prepare(spark)
    return _columns(quality.passing_documents(docs), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8)."""
    _prepare(spark)
    return _columns(neardup.first_of_each_group(docs, neardup.NearDupConfig(shingle=5, percent=80)), docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that occur earlier."""
    _prepare(spark)
    return _columns(repeats.without_repeats(docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    _prepare(spark)
    return _columns(decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text; ``round_trip`` says that they decode to it."""
    _prepare(spark)
    vocabulary = pieces.load_vocabulary(PIECE_MODEL)
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, checked="round_trip")
    n_pieces = F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces")
    return encoded.select("doc_id", "lang", "source", "ids", n_pieces, "round_trip")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_array_dedup", repeated_string_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_codec", encoding_stage),
]

# Removal of repeated strings, connected components and piece ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
