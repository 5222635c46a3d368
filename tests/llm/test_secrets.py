"""The automaton against Python's regular expressions, on generated texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import secrets
from weft.llm.automaton import Dfa

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
PIECES = st.sampled_from(
    ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "abc", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOPQRST", "é", "漢",
     "\n", "-", "==", "deadbeefdeadbeefdeadbeef", "x", "ghp_", "a" * 40, "xoxb-", "AIza", "eyJ", ".", "-----BEGIN PRIVATE KEY-----", "_"])


def expected(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


SCANNER = secrets.Scanner()


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_spans(text):
    found = secrets.scan(text.encode(), SCANNER)
    assert [s for s in found if s[0] in ("assign", "access", "hex")] == expected(text)


def test_more_rules_add_spans():
    text = "key ghp_" + "A1" * 20 + " and xoxb-1234567890-abc and AIza" + "b" * 35 + " -----BEGIN RSA PRIVATE KEY-----"
    assert {k for k, *_ in secrets.scan(text.encode(), SCANNER)} >= {"github", "slack", "google", "private"}


def test_minimal_automaton_accepts_what_the_expression_does():
    dfa = Dfa({"a": "(ab|ac)*d{2,3}"}, anywhere=False)
    for text in ("dd", "abacdd", "ddd", "d", "abd", "acacddd", "dddd", ""):
        got = dfa.longest(text.encode().translate(dfa.classes), 0, len(text))
        m = re.match(r"(ab|ac)*d{2,3}", text)
        assert got == (m.end() if m else -1)


def test_long_text_is_scanned_whole():
    text = "a" * 300_000 + " token=abcdef" + "1" * 100_000
    assert any(k == "assign" and b == len(text) for k, _, b in secrets.scan(text.encode(), SCANNER))
