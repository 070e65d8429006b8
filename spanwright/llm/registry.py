"""Queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from spanwright.llm import oracles, queries

QUERIES = {
    "pipeline": queries.pipeline,
    "op1_ann": queries.op1_ann,
    "op2_license_scan": queries.op2_license_scan,
    "op3_warc": queries.op3_warc,
    "op4_decontaminate": queries.op4_decontaminate,
    "op5_simhash": queries.op5_simhash,
    "op6_url_filter": queries.op6_url_filter,
    "op7_language_id": queries.op7_language_id,
    "op8_mixing": queries.op8_mixing,
    "op9_line_dedup": queries.op9_line_dedup,
    "op10_suffix_dedup": queries.op10_suffix_dedup,
    "op11_whitening": queries.op11_whitening,
    "op12_token_counts": queries.op12_token_counts,
    "op13_collocations": queries.op13_collocations,
}

ORACLES = {
    "op2_license_scan": oracles.OP2,
    "op3_warc": oracles.OP3,
    "op6_url_filter": oracles.OP6,
    "op9_line_dedup": oracles.OP9,
    "op13_collocations": oracles.OP13,
}
