"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op2_chat_format
from .line_duplicates import op7_segment_edit_join
from .mixing import op10_weighted_mix
from .near_duplicates import op3_order_min_hash
from .oracles import oracle_sql
from .packing import op4_best_fit_packing
from .quality import op6_quality_rules
from .sharding import op8_prefix_sum_shards
from .topk import op5_pivot_top_k
from .toxicity import op1_noisy_channel_toxicity
from .warc import op9_chunked_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
        "op2_chat_format": op2_chat_format,
        "op3_order_min_hash": op3_order_min_hash,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_pivot_top_k": op5_pivot_top_k,
        "op6_quality_rules": op6_quality_rules,
        "op7_segment_edit_join": op7_segment_edit_join,
        "op8_prefix_sum_shards": op8_prefix_sum_shards,
        "op9_chunked_warc": op9_chunked_warc,
        "op10_weighted_mix": op10_weighted_mix,
    }



__all__ = ["oracle_sql", "queries"]
