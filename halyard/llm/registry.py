"""Queries of the corpus operators, by contract name, and their DuckDB equivalents."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .common import clean_up
from .html import op4_html_extraction
from .jaccard import OP7_SQL, op7_jaccard_join
from .packing import op9_packing
from .quality import OP8_SQL, op8_quality_rules
from .secrets import op10_secret_scans
from .sharding import op6_sharding
from .suffixes import op2_suffix_dedup
from .topk import OP1_SQL, op1_topk_search
from .urls import OP5_SQL, op5_url_filters


__all__ = ["clean_up", "oracle_sql", "queries"]


def queries() -> dict:
    return {"op1_topk_search": op1_topk_search, "op2_suffix_dedup": op2_suffix_dedup, "op3_byte_bpe": op3_byte_bpe, "op4_html_extraction": op4_html_extraction, "op5_url_filters": op5_url_filters, "op6_sharding": op6_sharding, "op7_jaccard_join": op7_jaccard_join, "op8_quality_rules": op8_quality_rules, "op9_packing": op9_packing, "op10_secret_scans": op10_secret_scans}


def oracle_sql() -> dict:
    return {"op1_topk_search": OP1_SQL, "op5_url_filters": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_quality_rules": OP8_SQL}
