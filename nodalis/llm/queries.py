"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from nodalis.llm.cotrain import op9_quality
from nodalis.llm.decontaminate import op8_decontamination
from nodalis.llm.html_text import op2_html_text
from nodalis.llm.permutation import op1_permutation
from nodalis.llm.pieces import op3_sentencepiece
from nodalis.llm.pii import op6_pii
from nodalis.llm.ppm import op7_language
from nodalis.llm.simhash import op10_simhash
from nodalis.llm.toxicity import op4_toxicity
from nodalis.llm.training_order import op5_training_order

QUERIES = {
    "op1_permutation": op1_permutation,
    "op2_html_text": op2_html_text,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_training_order": op5_training_order,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE: dict[str, str] = {}
