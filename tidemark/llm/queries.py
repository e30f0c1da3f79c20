"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from tidemark.llm import chat, decontamination, divergence, embedding_dedup, licenses, mixing, ngram_lm, quality, simhash, spelling, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_ngram_lm": ngram_lm.op8_ngram_lm,
    "op9_chat": chat.op9_chat,
    "op10_quality": quality.op10_quality,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_divergence": divergence.op12_divergence,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op4_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op5_licenses": licenses.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
