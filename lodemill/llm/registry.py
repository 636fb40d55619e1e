"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodemill.llm import bpe, conversation_trie, fingerprint, mixing, neardup, periodic_runs, quality_model, quality_rules, secrets, sharding, substring_dedup, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": bpe.op1_bpe_roundtrip,
    "op2_merkle_fingerprints": fingerprint.op2_merkle_fingerprints,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_grades": quality_model.op8_quality_grades,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_shard_bytes": sharding.op13_shard_bytes,
}
ORACLES: dict[str, str] = {
    "op3_minhash_neardup": neardup.OP3_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_conversation_trie": conversation_trie.OP11_SQL,
}
