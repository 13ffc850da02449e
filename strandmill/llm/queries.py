"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandmill.llm import alignment, decontamination, importance, language, mixing, near_dups, passages, quality, secrets, sharding, top_k, toxicity, url_filter


def queries() -> dict:
    ops = [
        near_dups.op1_near_dups, quality.op2_quality_rules, language.op3_language_id, toxicity.op4_toxicity, decontamination.op5_decontamination,
        mixing.op6_mixing, url_filter.op7_url_filter, sharding.op8_sharding, secrets.op9_secrets, passages.op10_passages,
        top_k.op11_exact_topk, importance.op12_importance, alignment.op13_alignment,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.ORACLE, "op7_url_filter": url_filter.ORACLE, "op11_exact_topk": top_k.ORACLE, "op12_importance": importance.ORACLE}
