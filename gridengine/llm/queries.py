"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import chat, cotrain, fmindex, html, mixing, pii, repetition, simhash, substring, tokens

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_suffix_repetition": repetition.op2_suffix_repetition,
    "op3_cotraining": cotrain.op3_cotraining,
    "op4_systematic_mix": mixing.op4_systematic_mix,
    "op5_site_templates": html.op5_site_templates,
    "op6_suffix_automata": substring.op6_suffix_automata,
    "op7_chat_windows": chat.op7_chat_windows,
    "op8_edit_counts": tokens.op8_edit_counts,
    "op9_fm_decontamination": fmindex.op9_fm_decontamination,
    "op10_private_spans": pii.op10_private_spans,
}

ORACLE_SQL = {
    "op2_suffix_repetition": repetition.OP2_SQL,
    "op4_systematic_mix": mixing.OP4_SQL,
    "op6_suffix_automata": substring.OP6_SQL,
    "op9_fm_decontamination": fmindex.OP9_SQL,
}
