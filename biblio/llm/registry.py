"""Queries of this folder, and the SQL that must give the same rows."""

from __future__ import annotations

from . import chat, fingerprint, jaccard, language, mixing, packing, pages, pii, quality, ranked, sharding, suffix_tree, trie

QUERIES = {f.__name__: f for f in (language.op1_language_id, mixing.op2_mix_sources, suffix_tree.op3_suffix_tree_score, fingerprint.op4_fingerprints, pages.op5_main_text, quality.op6_quality_rules, jaccard.op8_jaccard_join, packing.op9_retrieval_packing, chat.op7_chat_format, sharding.op10_external_shuffle, ranked.op11_ranked_search, trie.op12_prefix_trie, pii.op13_personal_data)}
#: The rows of the others are held against brute force in the tests.
ORACLE: dict[str, str] = {"op2_mix_sources": mixing.OP2_SQL, "op7_chat_format": chat.OP7_SQL, "op8_jaccard_join": jaccard.OP8_SQL, "op11_ranked_search": ranked.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL}
