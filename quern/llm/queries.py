"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontamination, embedding_dedup, lexical_search, license_scan, minhash_dedup, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_sharding": sharding.op4_sharding,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_packing": packing.op8_packing,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
        "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL, "op2_minhash_dedup": minhash_dedup.SQL, "op3_quality_rules": quality_rules.SQL, "op4_sharding": sharding.SQL, "op5_suffix_dedup": suffix_dedup.SQL,
        "op11_lexical_search": lexical_search.SQL, "op12_embedding_dedup": embedding_dedup.SQL, "op13_conversation_trie": conversation_trie.SQL,
    }
