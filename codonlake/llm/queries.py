"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codonlake.llm import bpe, decontamination, jaccard_join, language_id, license_scan, merkle_manifest, minhash_dedup, prefix_trie, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_language_id": language_id.op8_language_id,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op7_jaccard_join": minhash_dedup.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_minhash_dedup": minhash_dedup.OP12_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
