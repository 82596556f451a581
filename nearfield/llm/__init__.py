"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import divergence, filter_audit, mixing, topk
from nearfield.llm.divergence import op13_run_lengths
from nearfield.llm.filter_audit import op12_packed_counters
from nearfield.llm.jaccard import op10_adaptive_prefixes
from nearfield.llm.lines import op4_deletion_neighbourhood
from nearfield.llm.lm import op6_elias_fano_trie
from nearfield.llm.mixing import op8_hash_thresholds
from nearfield.llm.packing import op3_best_two_fit
from nearfield.llm.pii import op2_weak_supervision
from nearfield.llm.quality import op1_byte_network
from nearfield.llm.rules import op9_repetition_rules
from nearfield.llm.suffixes import op11_suffix_families
from nearfield.llm.token_counts import op5_offset_attribution
from nearfield.llm.topk import op7_dual_cover_tree

QUERIES = (
    op1_byte_network, op2_weak_supervision, op3_best_two_fit, op4_deletion_neighbourhood, op5_offset_attribution, op6_elias_fano_trie,
    op7_dual_cover_tree, op8_hash_thresholds, op9_repetition_rules, op10_adaptive_prefixes, op11_suffix_families, op12_packed_counters, op13_run_lengths,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return mixing.SQL | topk.SQL | filter_audit.SQL | divergence.SQL
