"""The queries of this package and their SQL, as the entry file registers them."""

from __future__ import annotations

from sieveline.llm import bpe, chat_format, lm_scoring, media, packing, prefix_trie, quality_model, quality_rules, records, simhash, toxicity, turn_reassembly, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_packing": packing.op4_packing,
    "op5_media_columns": media.op5_media_columns,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality_model": quality_model.op10_quality_model,
    "op11_records": records.op11_records,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_turn_reassembly": turn_reassembly.op13_turn_reassembly,
}

#: Where SQL can't express a query it is tested against a brute-force version in tests/llm.
SQL = {
    "op1_chat_format": chat_format.SQL,
    "op3_quality_rules": quality_rules.sql(),
    "op9_url_filter": url_filter.sql(),
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_turn_reassembly": turn_reassembly.SQL,
}
