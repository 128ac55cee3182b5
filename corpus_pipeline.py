"""From documents to token ids: quality, near duplicates, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the
last keep the columns of ``docs`` as they are. A stage handles null ids and
texts, empty texts and tables, and repeated rows as its operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm.bpe import decode_ids, encode_texts
from wavetable.llm.jaccard import Rule, keep_one
from wavetable.llm.mixture import sample
from wavetable.llm.nbsvm import keep_quality
from wavetable.llm.suffixes import cut_repeats
from wavetable.session import stable

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
NEAR = Rule(width=5, num=80, den=100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 50-byte strings of earlier documents; a text of nothing else becomes empty."""
    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target weights."""
    return sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document; ids are little-endian 32-bit integers."""
    return decode_ids(encode_texts(docs)).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: A classifier's fit and near duplicates are beyond SQL; tests compare the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are checkpointed for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
