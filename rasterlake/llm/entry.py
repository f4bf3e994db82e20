"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rasterlake.llm import encoding, fim, jaccard, langid, license, linerules, packing, quality, rans, resync, spelling, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_combination_join": jaccard.op1_token_combination_join,
    "op2_rans_token_files": rans.op2_rans_token_files,
    "op3_sentence_rule_licenses": license.op3_sentence_rule_licenses,
    "op4_revisit_resolution": warc.op4_revisit_resolution,
    "op5_bitmask_language_id": langid.op5_bitmask_language_id,
    "op6_pairwise_additive_quality": quality.op6_pairwise_additive_quality,
    "op7_line_first_rules": linerules.op7_line_first_rules,
    "op8_term_at_a_time_topk": topk.op8_term_at_a_time_topk,
    "op9_speculative_bpe": encoding.op9_speculative_bpe,
    "op10_sum_of_squares_packing": packing.op10_sum_of_squares_packing,
    "op11_overlap_token_counts": resync.op11_overlap_token_counts,
    "op12_automaton_fill_in_middle": fim.op12_automaton_fill_in_middle,
    "op13_parity_band_spelling": spelling.op13_parity_band_spelling,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_token_combination_join": jaccard.ORACLE, "op3_sentence_rule_licenses": license.ORACLE, "op4_revisit_resolution": warc.ORACLE, "op7_line_first_rules": linerules.ORACLE, "op8_term_at_a_time_topk": topk.ORACLE, "op12_automaton_fill_in_middle": fim.ORACLE, "op13_parity_band_spelling": spelling.ORACLE}
