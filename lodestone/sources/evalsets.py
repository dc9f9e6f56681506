"""Readers of two public evaluation data set layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import slugify_ascii


def read_beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``corpus.jsonl``, ``queries.jsonl`` and ``qrels/<split>.tsv`` of one folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    judged = (
        spark.read.schema("query_id string, doc_id string, relevance int")
        .option("sep", "\t")
        .option("header", True)
        .csv(f"{path}/qrels/{split}.tsv")
    )
    return (
        corpus.select(
            F.col("_id").alias("doc_id"),
            F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("content"),
        ),
        queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query_text")),
        judged,
    )


SQUAD = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, "
    "qas:array<struct<question:string, is_impossible:boolean, answers:array<struct<text:string>>>>>>>>"
)


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    """Answerable questions with the key and text of their paragraph."""
    articles = spark.read.schema(SQUAD).option("multiLine", True).json(path).select(F.explode("data").alias("a"))
    paragraphs = articles.select("a.title", F.posexplode("a.paragraphs").alias("n", "p"))
    asked = paragraphs.select("title", "n", "p.context", F.explode("p.qas").alias("q"))
    answerable = ~F.coalesce("q.is_impossible", F.lit(False)) & (F.size("q.answers") > 0)
    return asked.where(answerable).select(
        F.concat_ws("_", slugify_ascii(F.col("title")), "n").alias("para_key"),
        "context",
        F.col("q.question").alias("question"),
        F.col("q.answers")[0]["text"].alias("answer"),
    )
