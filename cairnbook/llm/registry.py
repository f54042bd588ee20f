"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from cairnbook.llm import byte_bpe, credentials, html_layout, huffman, media, mixing, near_dedup, negatives, periodic, pii, quality, sharding, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_wav_fingerprints": media.op3_wav_fingerprints,
    "op4_minhash_dedup": near_dedup.op4_minhash_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_extendible_shards": sharding.op6_extendible_shards,
    "op7_html_layout": html_layout.op7_html_layout,
    "op8_pii_boosting": pii.op8_pii_boosting,
    "op9_warc_segments": warc.op9_warc_segments,
    "op10_huffman_ids": huffman.op10_huffman_ids,
    "op11_credential_linking": credentials.op11_credential_linking,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op6_extendible_shards": sharding.OP6_SQL,
    "op9_warc_segments": warc.OP9_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
