"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import codebooks, exact_dedup, hardneg, jaccard, langid, lm, mixing, orc_tokens, packing, secrets, topk, toxicity, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_warc": warc.query,
    "op3_toxicity": toxicity.query,
    "op4_language_model": lm.query,
    "op5_secret_ledger": secrets.query,
    "op6_exact_topk": topk.query,
    "op7_jaccard_join": jaccard.query,
    "op8_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_language_id": langid.query,
    "op11_codebooks": codebooks.query,
    "op12_orc_tokens": orc_tokens.query,
    "op13_hard_negatives": hardneg.query,
}
ORACLE_SQL = {"op2_warc": warc.ORACLE, "op6_exact_topk": topk.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_codebooks": codebooks.ORACLE, "op13_hard_negatives": hardneg.ORACLE}
