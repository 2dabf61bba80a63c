"""The operators' queries by name, and their SQL where SQL can express them."""

from . import fill_in_middle, fingerprints, jaccard_join, packing, pii, quality, ranked_search, sentencepiece_codec, sharding, substring_dedup, topk, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_warc": warc.op6_warc,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_pii": pii.op8_pii,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLE_SQL = {"op6_warc": warc.OP6_SQL, "op7_exact_topk": topk.OP7_SQL, "op11_fill_in_middle": fill_in_middle.OP11_SQL, "op12_quality_rules": quality.OP12_SQL, "op13_ranked_search": ranked_search.OP13_SQL}
