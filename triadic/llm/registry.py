"""Queries of the training-data operators by name, and their SQL where SQL can express them."""

from triadic.llm import exact_dedup, jaccard_join, language_id, line_dedup, mixing, nearest, packing, sampled_pieces, secrets, substring_dedup

QUERIES = {
    "op1_suffix_array_dedup": substring_dedup.op1_suffix_array_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_nearest_neighbours": nearest.op3_nearest_neighbours,
    "op4_language_id": language_id.op4_language_id,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_token_packing": packing.op9_token_packing,
    "op10_sentencepiece": sampled_pieces.op10_sentencepiece,
    "mix_targets": mixing.mix_targets,
    "base_secret_spans": secrets.base_secret_spans,
}
ORACLES = {
    "op1_suffix_array_dedup": substring_dedup.OP1_SQL,
    "op3_nearest_neighbours": nearest.OP3_SQL,
    "op5_ngram_jaccard_join": jaccard_join.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "mix_targets": mixing.TARGETS_SQL,
    "base_secret_spans": secrets.BASE_SQL,
}
