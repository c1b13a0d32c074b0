"""Queries of this subpackage for the driver's registry, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, htmltext, langid, lmscore, packing, pii, quality, rules, simhash, suffixdedup

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_lmscore": lmscore.op2_lmscore,
    "op3_packing": packing.op3_packing,
    "op4_suffix": suffixdedup.op4_suffix,
    "op5_quality": quality.op5_quality,
    "op6_rules": rules.op6_rules,
    "op7_langid": langid.op7_langid,
    "op8_decontam": decontam.op8_decontam,
    "op9_pii": pii.op9_pii,
    "op10_html": htmltext.op10_html,
}

ORACLES: dict[str, str] = {
    "op6_rules": rules.ORACLE,
    "op8_decontam": decontam.ORACLE,
}
