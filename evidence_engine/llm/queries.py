"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ctw, html, infill, jaccard, licences, mixing, mtree, quality, repeats, runs, tokens, toxicity, winnow

QUERIES = {
    "op4_winnowing": winnow.op4,
    "op8_jaccard_rtree": jaccard.op8,
    "op2_rule_ensemble": quality.op2,
    "op5_token_ids": tokens.op5,
    "op10_block_mixing": mixing.op10,
    "op7_license_digest": licences.op7,
    "op6_mtree": mtree.op6,
    "op9_block_lstm": html.op9,
    "op1_bigru": toxicity.op1,
    "op3_context_tree": ctw.op3,
    "op11_induced_suffixes": repeats.op11,
    "op12_tandem_runs": runs.op12,
    "op13_infill_split": infill.op13,
}

ORACLES = {
    "op4_winnowing": winnow.OP4_SQL,
    "op8_jaccard_rtree": jaccard.OP8_SQL,
    "op7_license_digest": licences.OP7_SQL,
    "op6_mtree": mtree.OP6_SQL,
    "op11_induced_suffixes": repeats.OP11_SQL,
    "op13_infill_split": infill.OP13_SQL,
}
