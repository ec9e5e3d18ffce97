"""The subpackage's queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import language, lines, mixing, repetition, secrets, shards, simhash, surrogates, templates, wordpieces

QUERIES = {
    "op1_suffix_repetition": repetition.op1_suffix_repetition,
    "op2_ownership_frequency": secrets.op2_ownership_frequency,
    "op3_string_kernel": language.op3_string_kernel,
    "op4_line_windows": lines.op4_line_windows,
    "op5_minimax_shards": shards.op5_minimax_shards,
    "op6_wordpiece_counts": wordpieces.op6_wordpiece_counts,
    "op7_poisson_mix": mixing.op7_poisson_mix,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_template_decontam": templates.op9_template_decontam,
    "op10_ball_simhash": simhash.op10_ball_simhash,
}

ORACLE_SQL = {
    "op1_suffix_repetition": repetition.OP1_SQL,
    "op4_line_windows": lines.OP4_SQL,
    "op7_poisson_mix": mixing.OP7_SQL,
}
