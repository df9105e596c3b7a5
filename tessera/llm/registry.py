"""Queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from . import avi, bpe, divergence, mixing, packing, periodic, ppm, recompression, records, setsketch, spotsigs, suffix, toxicity

QUERIES = {
    "op1_token_records": records.op1_token_records,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_spotsigs": spotsigs.op3_spotsigs,
    "op4_bpe": bpe.op4_bpe,
    "op5_avi": avi.op5_avi,
    "op6_word_dedup": recompression.op6_word_dedup,
    "op7_ppm": ppm.op7_ppm,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_near_dedup": setsketch.op10_near_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_packing": packing.op13_packing,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {"op12_source_divergence": divergence.SQL}
