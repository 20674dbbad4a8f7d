"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import anchors, audio, decontam, dualtree, exact, jaccard, mixing, pii, sharding, substring, tokens, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_query,
    "op2_repeated_passages": substring.op2_query,
    "op3_benchmark_decontamination": decontam.op3_query,
    "op4_toxicity": toxicity.op4_query,
    "op5_warc_revisits": warc.op5_query,
    "op6_token_attribution": tokens.op6_query,
    "op7_mpeg_audio": audio.op7_query,
    "op8_source_mixing": mixing.op8_query,
    "op9_size_tiered_sharding": sharding.op9_query,
    "op10_personal_data": pii.op10_query,
    "op11_vector_codes": anchors.op11_query,
    "op12_exact_dedup": exact.op12_query,
    "op13_ranked_search": dualtree.op13_query,
}
ORACLES = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op5_warc_revisits": warc.OP5_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_vector_codes": anchors.OP11_SQL,
    "op12_exact_dedup": exact.OP12_SQL,
    "op13_ranked_search": dualtree.OP13_SQL,
}
