"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tessera.llm import bpe, extraction, fingerprints, maxent, mixing, simhash, suffixes, toolcalls, topk, toxicity

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_toolcalls": toolcalls.op4_toolcalls,
    "op5_maxent": maxent.op5_maxent,
    "op6_extraction": extraction.op6_extraction,
    "op7_topk": topk.op7_topk,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE = {
    "op4_toolcalls": toolcalls.ORACLE,
    "op7_topk": topk.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
