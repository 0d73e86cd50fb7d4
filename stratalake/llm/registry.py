"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stratalake.llm import bpe, decontaminate, html_text, language_id, language_model, near_dedup, point_in_time, quality, quotes, sharding, substring_dedup, vector_codes, warc

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_language_model": language_model.query,
    "op3_warc": warc.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_near_dedup": near_dedup.query,
    "op6_quality": quality.query,
    "op7_bpe": bpe.query,
    "op8_quotes": quotes.query,
    "op9_decontaminate": decontaminate.query,
    "op10_html_text": html_text.query,
    "op11_vector_codes": vector_codes.query,
    "op12_point_in_time": point_in_time.query,
    "op13_sharding": sharding.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op8_quotes": quotes.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_point_in_time": point_in_time.SQL,
}
