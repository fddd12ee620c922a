"""Registers the operators, with SQL where it can express them."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_formatting
from .fp_search import OP13_SQL, op13_ranked_search
from .media import op1_media_columns
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op6_source_mixing
from .near_dedup import op5_minhash_near_dedup
from .packing import op7_retrieval_packing
from .quality import op10_quality_classifier
from .secret_scan import op2_secret_scans
from .sharding import op8_sharding
from .substring_dedup import op3_substring_dedup
from .topk import OP4_SQL, op4_exact_topk
from .url_filter import op11_url_filters

QUERIES = (
    op1_media_columns,
    op2_secret_scans,
    op3_substring_dedup,
    op4_exact_topk,
    op5_minhash_near_dedup,
    op6_source_mixing,
    op7_retrieval_packing,
    op8_sharding,
    op9_chat_formatting,
    op10_quality_classifier,
    op11_url_filters,
    op12_merkle_manifest,
    op13_ranked_search,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": OP4_SQL, "op9_chat_formatting": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_ranked_search": OP13_SQL}
