"""Queries of the training-data operators and the SQL of those that SQL can express."""

from . import ann, bpe_tree, conversation_repair, exact_dedup, lm_scoring, manifest, minhash, mixing, quality_fm, repair, sharding, tool_calls, url_reputation

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_token_files": repair.op2_token_files,
    "op3_url_filter": url_reputation.op3_url_filter,
    "op4_quality": quality_fm.op4_quality,
    "op5_tool_calls": tool_calls.op5_tool_calls,
    "op6_bpe": bpe_tree.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_nearest": ann.op8_nearest,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dedup": minhash.op10_near_dedup,
    "op11_conversations": conversation_repair.op11_conversations,
    "op12_sharding": sharding.op12_sharding,
    "op13_manifest": manifest.op13_manifest,
}
ORACLES = {"op3_url_filter": url_reputation.ORACLE, "op5_tool_calls": tool_calls.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_conversations": conversation_repair.ORACLE, "op13_manifest": manifest.ORACLE}
