"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from kindred.llm.bpe import op4_bpe
from kindred.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from kindred.llm.language_id import op2_language_id
from kindred.llm.language_model import op6_lm_score
from kindred.llm.line_dedup import OP1_SQL, op1_line_dedup
from kindred.llm.near_dedup import op5_near_dedup
from kindred.llm.packing import op9_packing
from kindred.llm.quality_classifier import op10_quality_classifier
from kindred.llm.quality_rules import OP3_SQL, op3_quality_rules
from kindred.llm.toxicity import op8_toxicity


def queries():
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_quality_rules": op3_quality_rules,
        "op4_bpe": op4_bpe,
        "op5_near_dedup": op5_near_dedup,
        "op6_lm_score": op6_lm_score,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql():
    return {"op1_line_dedup": OP1_SQL, "op3_quality_rules": OP3_SQL, "op7_exact_dedup": OP7_SQL}
