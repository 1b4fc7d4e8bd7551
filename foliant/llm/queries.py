"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import OP1_SQL, op1_ann_search
from .decontaminate import op2_decontaminate
from .lines import op8_line_dedup
from .mixing import OP7_SQL, op7_mix_sources
from .pii import op3_pii_sanitise
from .quality import op9_quality_classifier
from .simhash import op6_simhash_dedup
from .substring import OP5_SQL, op5_substring_dedup
from .token_counts import op10_token_counts
from .token_output import op4_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_search": op1_ann_search,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii_sanitise": op3_pii_sanitise,
    "op4_token_output": op4_token_output,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
}
ORACLE: dict[str, str] = {"op1_ann_search": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op7_mix_sources": OP7_SQL}
