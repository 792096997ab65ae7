"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe_encode_decode
from .ctw import op3_lm_scoring
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .media import op9_media_columns
from .mixing import OP7_SQL, op7_mixing
from .quality import op4_quality_classifier
from .secrets import OP2_SQL, op2_secret_scans
from .simhash import op1_simhash_near_dedup
from .substrings import op8_suffix_array_dedup
from .urls import OP10_SQL, op10_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_secret_scans,
        op3_lm_scoring,
        op4_quality_classifier,
        op5_exact_dedup,
        op6_bpe_encode_decode,
        op7_mixing,
        op8_suffix_array_dedup,
        op9_media_columns,
        op10_url_filters,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op10_url_filters": OP10_SQL}
