"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import leaks, lines, lm, mixing, near, passages, pii, quality, rules, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_passages": passages.op2_passages,
    "op3_rules": rules.op3_rules,
    "op4_lm": lm.op4_lm,
    "op5_mixing": mixing.op5_mixing,
    "op6_leaks": leaks.op6_leaks,
    "op7_lines": lines.op7_lines,
    "op8_near": near.op8_near,
    "op9_urls": urls.op9_urls,
    "op10_quality": quality.op10_quality,
}

SQL = {
    "op2_passages": passages.SQL,
    "op5_mixing": mixing.SQL,
    "op6_leaks": leaks.SQL,
    "op7_lines": lines.SQL,
    "op8_near": near.SQL,
    "op9_urls": urls.SQL,
}
