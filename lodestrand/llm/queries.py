"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import context_tree, decontamination, differencing, exact_dedup, fill_middle, fixity, near_dedup, packing, rollups, sharding, spelling, tool_calls, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_tool_calls": tool_calls.op2_tool_calls,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": rollups.op6_token_counts,
    "op7_fixity": fixity.op7_fixity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_lm_scores": context_tree.op9_lm_scores,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_differencing": differencing.op13_differencing,
}

ORACLE_SQL = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_tool_calls": tool_calls.ORACLE, "op7_fixity": fixity.ORACLE, "op12_fill_middle": fill_middle.ORACLE}
