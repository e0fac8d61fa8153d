"""Queries and oracle texts of this package."""

from logspark.llm import chat, decontaminate, hard_negatives, langid, minhash, mixing, ngrams, passages, pseudonyms, rules, similar_lines, token_files, vector_codes

QUERIES = {
    "op1_quality": ngrams.op1_quality,
    "op2_pseudonyms": pseudonyms.op2_pseudonyms,
    "op3_chat_format": chat.op3_chat_format,
    "op4_language_id": langid.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_line_dedup": similar_lines.op7_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_minhash": minhash.op9_minhash,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_token_files": token_files.op11_token_files,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op10_quality_rules": rules.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
