"""Queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from sonoloom.llm import decontaminate, hamming, negatives, packing, quality, secrets, sharding, simhash, spelling, substring, suffixes, toxicity, warc

QUERIES = {
    "op1_warc_segments": warc.query,
    "op2_toxicity_mil": toxicity.query,
    "op3_hamming_topk": hamming.query,
    "op4_lpt_shards": sharding.query,
    "op5_secret_battery": secrets.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality_ftrl": quality.query,
    "op8_linear_grouping_pack": packing.query,
    "op9_doubling_dedup": substring.query,
    "op10_simhash_covering": simhash.query,
    "op11_suffix_cover": suffixes.query,
    "op12_trie_pairs": spelling.query,
    "op13_lemp_negatives": negatives.query,
}

ORACLES: dict[str, str] = {
    "op1_warc_segments": warc.SQL,
    "op3_hamming_topk": hamming.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op13_lemp_negatives": negatives.SQL,
}
