"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from proofloom.llm import ctw, decontam, html_text, impact_index, lempel_ziv, lines, mixing, ogg, quality, resampling, sharding, simhash, suffix


def queries() -> dict:
    return {
        "op1_context_tree": ctw.op1_context_tree,
        "op2_hilbert_sharding": sharding.op2_hilbert_sharding,
        "op3_induced_sorting": suffix.op3_induced_sorting,
        "op4_simhash_pigeonhole": simhash.op4_simhash_pigeonhole,
        "op5_spaced_seeds": decontam.op5_spaced_seeds,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_poisson_mixing": mixing.op7_poisson_mixing,
        "op8_bradley_terry": quality.op8_bradley_terry,
        "op9_html_line_blocks": html_text.op9_html_line_blocks,
        "op10_ogg_media": ogg.op10_ogg_media,
        "op11_relative_lempel_ziv": lempel_ziv.op11_relative_lempel_ziv,
        "op12_overlap_chunking": resampling.op12_overlap_chunking,
        "op13_impact_search": impact_index.op13_impact_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": lines.OP6_SQL,
        "op7_poisson_mixing": mixing.OP7_SQL,
        "op11_relative_lempel_ziv": lempel_ziv.OP11_SQL,
        "op12_overlap_chunking": resampling.OP12_SQL,
        "op13_impact_search": impact_index.OP13_SQL,
    }
