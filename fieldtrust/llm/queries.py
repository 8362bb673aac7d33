"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from fieldtrust.llm import decontamination, language_id, lm, quality, repeats, resharding, simhash, sp_encoding, surrogates, token_counts, vector_codes, vectors, yinyang

QUERIES = {
    "op1_surrogates": surrogates.query,
    "op2_decontamination": decontamination.query,
    "op3_sentencepiece": sp_encoding.query,
    "op4_quality": quality.query,
    "op5_embedding_dedup": vectors.query,
    "op6_simhash": simhash.query,
    "op7_resharding": resharding.query,
    "op8_suffix_repeats": repeats.query,
    "op9_interpolation": lm.query,
    "op10_token_counts": token_counts.query,
    "op11_vector_codes": vector_codes.query,
    "op12_language_id": language_id.query,
    "op13_yinyang": yinyang.query,
}

ORACLE: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_yinyang": yinyang.ORACLE_SQL,
}
