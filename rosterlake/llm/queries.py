"""The queries that the operators add to the registry, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, decontam, html_content, langid, lm, media, mixing, neardup, quality, repair, secrets, spelling, urlfilter

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_main_text": html_content.op2_main_text,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_language_id": langid.op4_language_id,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_media_columns": media.op6_media_columns,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_nearest_neighbours": ann.op12_nearest_neighbours,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_main_text": html_content.OP2_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op5_near_duplicates": neardup.OP5_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
    "op10_decontaminate": decontam.OP10_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
