"""Queries and oracle SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import neardup, topk
from .htmltext import op10_html_text
from .langid import op7_language_id
from .mixing import op2_source_mixing
from .neardup import op6_minhash_neardup
from .packing import op1_bestfit_packing
from .pii import op3_pii
from .quality import op4_quality_rules
from .sharding import op5_sharding
from .topk import op8_exact_topk
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bestfit_packing": op1_bestfit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_language_id": op7_language_id,
    "op8_exact_topk": op8_exact_topk,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
}
ORACLE: dict[str, str] = {
    "op6_minhash_neardup": neardup.ORACLE_SQL,
    "op8_exact_topk": topk.ORACLE_SQL,
}
