"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import near_dup, packing, quality, secrets, sentencepiece, token_files, topk, toxicity, url_filter, warc
from .common import ready

Query = Callable[[SparkSession, str], DataFrame]

_OPS: list[Query] = [packing.op1_best_fit_packing, near_dup.op2_near_duplicates, warc.op3_warc_derivatives, sentencepiece.op4_sentencepiece, token_files.op5_token_files, secrets.op6_secrets, quality.op7_quality, toxicity.op8_toxicity, topk.op9_top_k, url_filter.op10_url_filter]
_MODULES = [quality, topk, url_filter]


def _query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {f.__name__: _query(f) for f in _OPS} | {"pipeline": _query(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
