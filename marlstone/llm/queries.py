"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontaminate, htmltext, merkle, neighbours, packing, pii, quality, rules, secrets, simhash, substrings, toxicity, whitening

QUERIES = {
    "op1_htmltext": htmltext.op1_htmltext,
    "op2_resampling": quality.op2_resampling,
    "op3_secrets": secrets.op3_secrets,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_packing": packing.op6_packing,
    "op7_substrings": substrings.op7_substrings,
    "op8_pii": pii.op8_pii,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_whitening": whitening.op11_whitening,
    "op12_merkle": merkle.op12_merkle,
    "op13_rules": rules.op13_rules,
}

ORACLES: dict[str, str] = {
    "op3_secrets": secrets.SQL,
    "op12_merkle": merkle.SQL,
    "op13_rules": rules.SQL,
}
