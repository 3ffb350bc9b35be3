"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, lang_id, lm_score, near_dup, secret_scan, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_lm_score": lm_score.op3,
    "op4_bpe": bpe.op4,
    "op5_near_dup": near_dup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_topk": topk.op8,
    "op9_chat": chat.op9,
    "op10_lang_id": lang_id.op10,
}
ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_lm_score": lm_score.OP3_SQL,
    "op5_near_dup": near_dup.OP5_SQL,
    "op8_topk": topk.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
}
