"""Queries of the corpus operators, and the SQL that has to agree where SQL can express them."""

from __future__ import annotations

from . import decontaminate, langid, langmodel, linededup, mixing, neardup, quality, secrets, tokenbin, toxicity


def queries():
    return {
        "op1_secret_scan": secrets.op1,
        "op2_line_dedup": linededup.op2,
        "op3_mix": mixing.op3,
        "op4_lm_score": langmodel.op4,
        "op5_token_shards": tokenbin.op5,
        "op6_quality_rules": quality.op6,
        "op7_near_duplicates": neardup.op7,
        "op8_language_id": langid.op8,
        "op9_toxicity": toxicity.op9,
        "op10_decontaminate": decontaminate.op10,
    }


def oracle_sql():
    """The models, draws and token ids of the others are beyond SQL; tests/llm holds them against brute force."""
    return {
        "op1_secret_scan": secrets.SQL,
        "op2_line_dedup": linededup.SQL,
        "op6_quality_rules": quality.SQL,
        "op10_decontaminate": decontaminate.SQL,
    }
