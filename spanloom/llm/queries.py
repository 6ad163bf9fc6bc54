"""The queries of this folder and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.op01_huffman import op1_huffman_ids
from spanloom.llm.op02_html import op2_html_main_text
from spanloom.llm.op03_perplexity import op3_quality_perplexity
from spanloom.llm import op04_topk, op09_licenses, op12_repair
from spanloom.llm.op05_pii import op5_pii_skip_chain
from spanloom.llm.op06_simhash import op6_simhash_near_dedup
from spanloom.llm.op07_mixing import op7_pivotal_mixing
from spanloom.llm.op08_language import op8_language_cross_parse
from spanloom.llm.op10_packing import op10_packing
from spanloom.llm.op11_alignment import op11_token_alignment
from spanloom.llm.op13_prefix_counts import op13_prefix_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_html_main_text": op2_html_main_text,
    "op3_quality_perplexity": op3_quality_perplexity,
    "op4_threshold_top_k": op04_topk.op4_threshold_top_k,
    "op5_pii_skip_chain": op5_pii_skip_chain,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_pivotal_mixing": op7_pivotal_mixing,
    "op8_language_cross_parse": op8_language_cross_parse,
    "op9_license_diagonals": op09_licenses.op9_license_diagonals,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_repair.op12_conversation_repair,
    "op13_prefix_counts": op13_prefix_counts,
}

ORACLES: dict[str, str] = {
    "op4_threshold_top_k": op04_topk.ORACLE,
    "op9_license_diagonals": op09_licenses.ORACLE,
    "op12_conversation_repair": op12_repair.ORACLE,
}
