"""From documents to training sequences, in five stages; each is written as Parquet and read again as the next one's input.

Defined results, of each stage: null text is empty; a null doc_id, repeated rows and ties are as in the stage's operator (see its module); an empty
table gives an empty result; other columns, whatever their names, are left alone by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import exact_dedup, mixing, packing, resemblance, subword
from leadlake.llm._common import cut, tidy
from leadlake.session import ship


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return subword.survivors(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    ship(spark)
    return exact_dedup.survivors(docs)


@tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle sets of similarity 0.8 or more one stays: SimHash links, checked, then all others."""
    ship(spark)
    return resemblance.survivors(docs)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its budget of words, in more than one epoch if it must."""
    ship(spark)
    return mixing.materialise(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: SQL can express neither the classifier nor the resemblance; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
