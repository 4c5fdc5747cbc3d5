"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, divergence, hard_negatives, html, licenses, lines, neighbours, packing, repetition, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_html_text": html.op2_html_text,
    "op3_licenses": licenses.op3_licenses,
    "op4_packing": packing.op4_packing,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_repetition": repetition.op11_repetition,
    "op12_divergence": divergence.op12_divergence,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op5_line_dedup": lines.OP5_SQL,
    "op7_warc_revisits": warc.OP7_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_repetition": repetition.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
