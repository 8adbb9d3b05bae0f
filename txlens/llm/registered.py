"""The corpus queries and their oracles."""

from txlens.llm import op1_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query, op10_query, op11_query, op12_query, op13_query

QUERIES = {
    "op1_byte_spans": op1_query.op1_byte_spans,
    "op2_neighbours": op2_query.op2_neighbours,
    "op3_bpe": op3_query.op3_bpe,
    "op4_toxicity": op4_query.op4_toxicity,
    "op5_token_counts": op5_query.op5_token_counts,
    "op6_decontamination": op6_query.op6_decontamination,
    "op7_language": op7_query.op7_language,
    "op8_word_spans": op8_query.op8_word_spans,
    "op9_shards": op9_query.op9_shards,
    "op10_simhash": op10_query.op10_simhash,
    "op11_source_audit": op11_query.op11_source_audit,
    "op12_collocations": op12_query.op12_collocations,
    "op13_embedding_copies": op13_query.op13_embedding_copies,
}
ORACLES = {
    "op8_word_spans": op8_query.SQL,
    "op9_shards": op9_query.SQL,
    "op11_source_audit": op11_query.SQL,
    "op12_collocations": op12_query.SQL,
}
