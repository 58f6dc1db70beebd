"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import alignment, decontaminate, exact_dedup, jaccard_join, packing, periodic_runs, quality, secrets, sharding, substring_dedup, suffix_tree, toxicity, training_order

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_quality": quality.op3_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op4_secrets": secrets.op4_secrets,
    "op5_pack": packing.op5_pack,
    "op7_suffix_tree": suffix_tree.op7_suffix_tree,
    "op8_training_order": training_order.op8_training_order,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_alignment": alignment.op12_alignment,
    "op13_minimax_shards": sharding.op13_minimax_shards,
}
SQL = {
    "op2_jaccard_join": jaccard_join.SQL,
    "op1_decontaminate": decontaminate.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
