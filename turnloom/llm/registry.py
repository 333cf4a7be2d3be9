"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, chaining, exact_dedup, jaccard_join, kneser_ney, line_dedup, mixing, pivots, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_substring_dedup": chaining.op2_substring_dedup,
    "op3_warc": warc.op3_warc,
    "op4_quality": kneser_ney.op4_quality,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_pivot_index": pivots.op8_pivot_index,
    "op9_mixing": mixing.op9_mixing,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE = {"op3_warc": warc.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
