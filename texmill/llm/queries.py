"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from texmill.llm.decontaminate import op4_benchmark_decontamination
from texmill.llm.html_extract import op10_html_extraction
from texmill.llm.language_id import op5_language_id
from texmill.llm.near_dedup import op2_minhash_near_dedup
from texmill.llm.oracles import SQL
from texmill.llm.packing import op6_best_fit_packing
from texmill.llm.resampling import op3_importance_resampling
from texmill.llm.secrets import op8_secret_scan
from texmill.llm.substring_dedup import op1_substring_dedup
from texmill.llm.token_counts import op9_token_counts
from texmill.llm.vector_search import op7_exact_top_k


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_importance_resampling, op4_benchmark_decontamination, op5_language_id, op6_best_fit_packing, op7_exact_top_k, op8_secret_scan, op9_token_counts, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
