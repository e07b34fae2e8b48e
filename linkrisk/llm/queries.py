"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkrisk.llm import bpe, clustering, decontamination, html_text, jaccard, licences, mixing, quality, secrets, sharding, topk, toxicity, whitening
from linkrisk.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontamination": lambda spark, sf_dir: decontamination.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_licences": lambda spark, sf_dir: licences.digest(spark, table(spark, sf_dir, "documents")),
    "op3_topk": lambda spark, sf_dir: topk.digest(spark, table(spark, sf_dir, "embeddings")),
    "op10_jaccard": lambda spark, sf_dir: jaccard.digest(spark, table(spark, sf_dir, "documents")),
    "op4_html": lambda spark, sf_dir: html_text.digest(spark, table(spark, sf_dir, "pages")),
    "op5_quality": lambda spark, sf_dir: quality.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_toxicity": lambda spark, sf_dir: toxicity.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_bpe": lambda spark, sf_dir: bpe.digest(spark, table(spark, sf_dir, "documents")),
    "op8_shards": lambda spark, sf_dir: sharding.digest(spark, table(spark, sf_dir, "documents")),
    "op9_secrets": lambda spark, sf_dir: secrets.digest(spark, table(spark, sf_dir, "documents")),
    "op11_clusters": lambda spark, sf_dir: clustering.digest(spark, table(spark, sf_dir, "embeddings")),
    "op12_whitening": lambda spark, sf_dir: whitening.digest(spark, table(spark, sf_dir, "embeddings")),
    "op13_mixing": lambda spark, sf_dir: mixing.digest(spark, table(spark, sf_dir, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_licences": licences.oracle(),
    "op3_topk": topk.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
    "op11_clusters": clustering.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
