"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_byte_bpe
from .clustered_layout import OP12_SQL, op12_clustered_layout
from .conversation_repair import OP11_SQL, op11_conversation_repair
from .hamming_search import OP2_SQL, op2_hamming_top_k
from .html_main import op9_html_main
from .near_dup import op8_near_dup
from .order_minhash import op5_order_minhash
from .packing import op4_best_fit
from .quality import op6_quality
from .sentence_pieces import op13_sentence_pieces
from .sentence_spans import op7_sentence_spans
from .substring_dedup import op1_suffix_dedup
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit": op4_best_fit,
    "op5_order_minhash": op5_order_minhash,
    "op6_quality": op6_quality,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_near_dup": op8_near_dup,
    "op9_html_main": op9_html_main,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_clustered_layout": op12_clustered_layout,
    "op13_sentence_pieces": op13_sentence_pieces,
}

ORACLE_SQL: dict[str, str] = {"op2_hamming_top_k": OP2_SQL, "op11_conversation_repair": OP11_SQL, "op12_clustered_layout": OP12_SQL}
