"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karst.llm import op1_lm, op3_exact, op5_minhash, op7_warc, op8_decontaminate, op11_audit, op13_phrases
from karst.llm.op2_toxicity import op2_toxicity
from karst.llm.op4_langid import op4_language_id
from karst.llm.op6_pieces import op6_sentencepiece
from karst.llm.op9_html import op9_html_main_text
from karst.llm.op10_tokens import op10_token_binary
from karst.llm.op12_lines import op12_line_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm.op1_lm_score,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact.op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_minhash.op5_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_arc_to_warc": op7_warc.op7_arc_to_warc,
    "op8_decontamination": op8_decontaminate.op8_decontamination,
    "op9_html_main_text": op9_html_main_text,
    "op10_token_binary": op10_token_binary,
    "op11_filter_audit": op11_audit.op11_filter_audit,
    "op12_line_quality": op12_line_quality,
    "op13_phrases": op13_phrases.op13_phrases,
}

ORACLES: dict[str, str] = {
    "op1_lm_score": op1_lm.ORACLE_SQL,
    "op3_exact_dedup": op3_exact.ORACLE_SQL,
    "op5_near_dedup": op5_minhash.ORACLE_SQL,
    "op7_arc_to_warc": op7_warc.ORACLE_SQL,
    "op8_decontamination": op8_decontaminate.ORACLE_SQL,
    "op11_filter_audit": op11_audit.ORACLE_SQL,
    "op13_phrases": op13_phrases.ORACLE_SQL,
}
