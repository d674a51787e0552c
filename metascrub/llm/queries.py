"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from metascrub.llm import chat, decontam, jaccard, langid, mixing, pii, quality, repair, secret_scan, substring_dedup, suffix_dedup, trie, warc

QUERIES = {
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_mixing_sources": mixing.op10_mixing_sources,
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_language_id": langid.op6_language_id,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_pii": pii.op13_pii,
}

ORACLES: dict[str, str] = {
    "op10_mixing_sources": mixing.ORACLE,
    "op11_structure_repair": repair.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op2_warc": warc.ORACLE,
}
