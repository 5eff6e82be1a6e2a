"""Queries of this subpackage and the SQL equivalents of those that SQL can express."""

from __future__ import annotations

from corpusx.llm import audit, bpe, dedup, fim, jaccard, langid, lmscore, mixing, pii, secrets, tokens, topk, toxicity


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_mixing": mixing.op2_mixing,
        "op3_bpe": bpe.op3_bpe,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pii": pii.op5_pii,
        "op6_langid": langid.op6_langid,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_exact_dedup": dedup.op8_exact_dedup,
        "op9_secrets": secrets.op9_secrets,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
        "op11_fim": fim.op11_fim,
        "op12_lm_scores": lmscore.op12_lm_scores,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op1_topk": topk.ORACLE, "op2_mixing": mixing.ORACLE, "op8_exact_dedup": dedup.ORACLE, "op11_fim": fim.ORACLE, "op13_filter_audit": audit.ORACLE}
