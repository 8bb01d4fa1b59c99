"""The corpus operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pixelfurrow.llm import byte_bpe, decontaminate, langid, lm_score, ngram_join, quality, suffix_dedup, topk, toxicity, wavelet

QUERIES = {
    "op1_topk_search": topk.op1,
    "op2_toxicity": toxicity.op2,
    "op3_lm_score": lm_score.op3,
    "op4_language_id": langid.op4,
    "op5_quality": quality.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_wavelet_ids": wavelet.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_decontamination": decontaminate.op10,
}

ORACLE_SQL: dict[str, str] = {"op1_topk_search": topk.ORACLE}
