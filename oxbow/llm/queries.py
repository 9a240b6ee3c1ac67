"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html, licenses, mix, pii, quality, simhash, toxicity, url_filter

QUERIES = {
    "op1_html_text": html.query,
    "op2_mix": mix.query,
    "op3_url_filter": url_filter.query,
    "op4_quality": quality.query,
    "op5_licenses": licenses.query,
    "op6_decontaminate": decontaminate.query,
    "op7_pii": pii.query,
    "op8_chat": chat.query,
    "op9_simhash": simhash.query,
    "op10_toxicity": toxicity.query,
}
ORACLE_SQL = {
    "op2_mix": mix.SQL,
    "op3_url_filter": url_filter.SQL,
    "op4_quality": quality.SQL,
    "op5_licenses": licenses.SQL,
    "op8_chat": chat.SQL,
}
