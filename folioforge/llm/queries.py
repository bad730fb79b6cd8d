"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fill_in_middle, html_text, langid, linededup, pieces, pii, prefix_trie, quality, secrets, simhash, substrings, warc

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_sentencepiece": pieces.op2,
    "op3_line_dedup": linededup.op3,
    "op4_html_text": html_text.op4,
    "op5_simhash": simhash.op5,
    "op6_warc": warc.op6,
    "op7_secret_scan": secrets.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_language_id": langid.op9,
    "op10_pii": pii.op10,
    "op11_fill_in_middle": fill_in_middle.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_substring_dedup": substrings.op13,
    "line_dedup_incremental": linededup.incremental,
    "language_id_of_pages": langid.pages_language,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "line_dedup_incremental": linededup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_substring_dedup": substrings.OP13_SQL,
}
