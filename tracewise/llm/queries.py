"""The corpus operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tracewise.llm import bpe, chat, exact_dedup, fim, langid, line_dedup, mixing, packing, pii, resample, secret_ledger, simhash, topk

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_bpe": bpe.query,
    "op3_mixing": mixing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_secrets": secret_ledger.query,
    "op6_pii": pii.query,
    "op7_chat": chat.query,
    "op8_simhash": simhash.query,
    "op9_topk": topk.query,
    "op10_language_id": langid.query,
    "op11_resample": resample.query,
    "op12_fill_in_middle": fim.query,
    "op13_packing": packing.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_secrets": secret_ledger.ORACLE,
    "op7_chat": chat.ORACLE,
    "op9_topk": topk.ORACLE,
    "op11_resample": resample.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
