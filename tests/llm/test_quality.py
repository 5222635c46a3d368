"""Boilerplate lines: every phrase, in any case, in the judged lines and in what the pipeline keeps."""

import pytest

from weft.llm import quality

PHRASES = [
    "all rights reserved", "licensed under", "released under", "copyright", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "subscribe to", "sign up", "log in", "click here", "enable javascript", "lorem ipsum",
]
GOOD = "a plain sentence of words that stays in the text, whatever else happens to it"


@pytest.mark.parametrize("style", [str.lower, str.capitalize, str.title, str.upper])
def test_every_phrase_in_any_case(spark, style):
    docs = spark.createDataFrame([(k, f"{GOOD}\nread: {style(p)} now\n{style(p)}") for k, p in enumerate(PHRASES)], "doc_id long, text string")
    rows = quality.quality_rules(docs).collect()
    assert {PHRASES[r["doc_id"]]: (r["n_lines_removed"], r["clean_text"]) for r in rows} == {p: (2, GOOD) for p in PHRASES}


def test_documents_of_boilerplate_are_rejected(spark):
    bad = "Click here to sign up\nLog in\nTerms of use\nPrivacy Policy\nPlease enable JavaScript\nCOPYRIGHT 2024\nSome Rights reserved\n(c)opyright of the owner"
    docs = spark.createDataFrame([(1, bad), (2, GOOD)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality.clean(docs).collect()] == [2]
