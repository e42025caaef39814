"""The thin queries over the operators: opN_<name> and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from leadlake.llm import exact_dedup, hilbert, imatch, line_dedup, mixing, packing, pii, runs, simhash, subword, wavelet, weak_rules, whitening
from leadlake.llm._common import tidy
from leadlake.session import ship


def _over_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @tidy
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    return query


@tidy
def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return subword.op3(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def _whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whitening.op12(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wavelet_matrix": _over_documents(wavelet.op1),
        "op2_pii_bootstrap": _over_documents(pii.op2),
        "op3_subword_classifier": _classified,
        "op4_hilbert_shards": _over_documents(hilbert.op4),
        "op5_exact_dedup": _over_documents(exact_dedup.op5),
        "op6_harmonic_packing": _over_documents(packing.op6),
        "op7_weak_supervision": _over_documents(weak_rules.op7),
        "op8_line_dedup": _over_documents(line_dedup.op8),
        "op9_simhash_pigeonhole": _over_documents(simhash.op9),
        "op10_mixing": _over_documents(mixing.op10),
        "op11_imatch": _over_documents(imatch.op11),
        "op12_svd_whitening": _whitened,
        "op13_periodic_runs": _over_documents(runs.op13),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op10_mixing": mixing.SQL}
