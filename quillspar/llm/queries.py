"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, html, language, neighbours, packing, pitman_yor, simhash, substring, tokens, toxicity

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_language": language.op2_language,
    "op3_main_text": html.op3_main_text,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_output": tokens.op5_token_output,
    "op6_nearest": neighbours.op6_nearest,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_packing": packing.op9_packing,
    "op10_lm_score": pitman_yor.op10_lm_score,
}
ORACLE_SQL = {"op8_decontamination": decontamination.OP8_SQL}
