"""Secret scans: every rule's trigger in one minimal byte automaton, one pass over each whole text.

The combined automaton finds, for each rule, the first byte at which a match is certain. A
reversed automaton of the trigger then gives the leftmost start not before the rule's last
match, and a forward one the furthest end: together the leftmost, longest, non-overlapping
match. A match that fails its rule's length test is dropped, yet the scan goes on behind it.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive;
rows that repeat are scanned alike and all returned; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Dfa
from .common import raw, slices, table

_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_B64 = "[A-Za-z0-9_-]"


@dataclass(frozen=True)
class Rule:
    """trigger: shortest text that settles a match; tail: bytes that carry it on; least: bytes it must have,
    counted from its start or, if `value`, from the trigger's last byte."""

    kind: str
    trigger: str
    tail: str
    least: int
    value: bool = False


BASE = (
    Rule("assign", _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]", 24),
)
MORE = (
    Rule("github", "gh[opsu]_[A-Za-z0-9]", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9]", "[A-Za-z0-9-]", 15),
    Rule("google", f"AIza{_B64}", _B64, 39),
    Rule("jwt", f"eyJ{_B64}+\\.eyJ{_B64}+\\.{_B64}", _B64, 40),
    Rule("private", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "-", 0),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = {r.kind: (n, r) for n, r in enumerate(rules)}
        self.all = Dfa({r.kind: r.trigger for r in rules}, anywhere=True)
        self.back = {r.kind: Dfa({r.kind: r.trigger}, anywhere=False, reverse=True) for r in rules}
        self.on = {r.kind: Dfa({r.kind: f"({r.tail})*"}, anywhere=False) for r in rules}

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start."""
        found, seen = [], {}
        table, accepting, state = self.all.table, self.all.accepting, self.all.start
        for at, code in enumerate(text.translate(self.all.classes)):
            state = table[state + code]
            if state >= accepting:
                for kind in self.all.labels[state]:
                    after = seen.get(kind, 0)
                    if at < after:
                        continue
                    back = self.back[kind]
                    left = text[after : at + 1].translate(back.classes)
                    length = back.longest(left, len(left) - 1, -1, -1)
                    if length < 0:
                        continue
                    start, (n, rule) = at + 1 - length, self.rules[kind]
                    on, end = self.on[kind], at + 1
                    chunk = 4096
                    while end < len(text):
                        part = text[end : end + chunk].translate(on.classes)
                        more = max(0, on.longest(part, 0, len(part)))
                        end += more
                        if more < len(part):
                            break
                    seen[kind] = end
                    if end - (at if rule.value else start) >= rule.least:
                        found.append((start, n, end))
        found.sort()
        return found


def scan(text: bytes, scanner: Scanner) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the rules' order."""
    kinds = list(scanner.rules)
    out, at, points = [], 0, 0
    for start, n, end in scanner.spans(text):
        points += len(text[at:start].decode("utf-8", "replace"))
        at = start
        out.append((kinds[n], points, points + len(text[start:end].decode("utf-8", "replace"))))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_scanner: Scanner | None = None


def _rows(batches):
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    base = [r.kind for r in BASE]
    for batch in batches:
        for part in slices(batch):
            data, ptr = raw(part.column(1))
            body, out = data.tobytes(), []
            for a, b in zip(ptr[:-1], ptr[1:], strict=True):
                spans = scan(body[a:b], _scanner)
                kept = [s for s in spans if s[0] in base]
                out.append((*[sum(s[0] == k for s in kept) for k in base], hashlib.sha256(joined(kept).encode()).hexdigest(), joined(spans), len(spans) - len(kept)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:5]], pa.array(cols[5], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of their spans, and every span as kind:start:end."""
    return docs.select("doc_id", "text").mapInArrow(
        _rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long")


def op1(spark, sf_dir) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    shapes = {r.kind: (r.trigger + f"{r.tail}*", r) for r in RULES}
    shapes["hex"] = ("[0-9a-f]+", BASE[2])
    parts = []
    for n, (kind, (pattern, rule)) in enumerate(shapes.items()):
        p = pattern.replace("'", "''")
        least = f"length(regexp_extract(m, '^{_KEY}[\"'']?\\x20*[:=]\\x20*[\"'']?(.*)$', 2))" if rule.value else "length(m)"
        if kind == "private":
            p = rule.trigger + "-*"
        parts.append(f"""SELECT rn, {n} AS n, '{kind}' AS kind, s AS a, s + length(m) AS b FROM (
  SELECT rn, m, sum(length(p)) OVER (PARTITION BY rn ORDER BY i) + sum(length(m)) OVER (PARTITION BY rn ORDER BY i) - length(m) AS s FROM (
    SELECT rn, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
      SELECT rn, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d) WHERE len(ms) > 0)) WHERE {least} >= {rule.least}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rn, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
  count(*) FILTER (n > 2) AS n_more,
  coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, n) FILTER (n < 3), '') AS base,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, n) AS spans FROM s GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_more, 0) AS n_more
FROM d LEFT JOIN g USING (rn)"""


SQL = _sql()
