"""Quality rules (native): judge each line first, drop the lines that fail, then reject
documents that lost too much of their text.

Everything is one projection of built-in functions: no shuffle, no Python, one row in and one
row out, so a hot source or a large group of copies costs no more than any other rows.

Defined results: a null or empty text has no words, fails the base rule and is not kept; rows
that repeat are judged alike and all returned; columns other than those named are ignored
(score) or passed through untouched (clean).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (  # in small letters, found in any case; "rights reserved" also without "all", "opyright" also in "(c)opyright"
    "rights reserved", "licensed under", "released under", "opyright", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "subscribe to", "sign up", "log in", "click here", "enable javascript", "lorem ipsum",
)
SHOUT = "([A-Z]+[^a-zA-Z]+){6}"  # six runs of capitals with no small letter between them
MIN_WORDS = 10
REPEAT_PERCENT = 20
LOST_PERCENT = 50  # a document that loses more of its characters than this is rejected
NAV_PIPES = 3
SYMBOL_PERCENT = 8
NAV_CHARS = 40  # a pipe for every so many characters
LONG_LINE = 200


def let(value: Column, body) -> Column:
    """Bind a computed value to a lambda variable, so that it is worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_symbols(text: Column) -> Column:
    return F.size(F.split(text, "[#*$%&|<>]")) - 1


def words_in(text: Column) -> Column:
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS + "+"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 5-word window that the text holds at least twice."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        hashed = lambda a, b: F.xxhash64(a, b)
        two = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, F.lit(2), n - 1), hashed)
        four = let(two, lambda p: F.zip_with(F.slice(p, 1, n - 3), F.slice(p, F.lit(3), n - 3), hashed))
        five = F.zip_with(F.slice(four, 1, n - 4), F.slice(w, F.lit(5), n - 4), hashed)
        return F.when(n >= 6, five)

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            hit = F.transform(s, lambda e, k: F.when(
                (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]), e["i"]))
            return F.sort_array(F.filter(hit, lambda v: v.isNotNull()))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda v, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1), v + 5) - v))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, v: a + v)

        return let(let(ranked, twice), total)

    none = F.lit(0).cast("long")
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda g: F.when(
        g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), none).otherwise(covered(g)))


def boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def line_fails(line: Column, suspect: Column) -> Column:
    """Symbol noise, navigation, missing punctuation, shouting or boilerplate; suspect: the text has a boilerplate phrase somewhere."""
    n = F.length(line)
    pipes = F.size(F.split(line, "[|]")) - 1
    fails = (count_symbols(line) * 100 > n * SYMBOL_PERCENT) | ((pipes >= NAV_PIPES) & (pipes * NAV_CHARS >= n))
    fails = fails | ((n >= LONG_LINE) & ~line.rlike("[.,;:!?]"))
    return fails | line.rlike(SHOUT) | (suspect & boilerplate(line))


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source and the like stay; adds struct column `_weft_quality` with every measure."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def lines_of(lines: Column) -> Column:
        return let(F.filter(lines, has_word), lambda full: F.struct(
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            let(boilerplate(text), lambda bad: F.filter(full, lambda x: ~line_fails(x, bad))).alias("good"),
            full.alias("full")))

    def measures(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    chars = lambda ls: F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    parts = docs.withColumn("_weft_quality", F.struct(
        let(words_in(text), measures).alias("w"),
        let(F.split(text, "\n"), lines_of).alias("l"),
        count_symbols(text).cast("long").alias("n_symbols")))
    q = F.col("_weft_quality")
    total, left = chars(q["l"]["full"]), chars(q["l"]["good"])
    failed = (q["w"]["n_words"] < MIN_WORDS) | (q["w"]["n_repeat_words"] * 100 > q["w"]["n_words"] * REPEAT_PERCENT)
    return parts.withColumn("_weft_quality", F.struct(
        q["w"]["n_words"].alias("n_words"), q["w"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["l"]["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ((total - left) * 100 <= total * LOST_PERCENT)).alias("kept"),
        (F.size(q["l"]["full"]) - F.size(q["l"]["good"])).cast("long").alias("n_lines_removed"),
        (total - left).alias("chars_removed"),
        F.array_join(q["l"]["good"], "\n").alias("clean_text")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept and clean_text."""
    return assess(docs.select("doc_id", "text")).select("doc_id", "_weft_quality.*")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines taken out; columns as given, n_chars brought up to date."""
    # a generator works the measures out once, where a filter would work them out again
    out = assess(docs).withColumn("_weft_quality", F.explode(F.filter(F.array("_weft_quality"), lambda q: q["kept"])))
    columns = [F.col("_weft_quality.clean_text").alias("text") if c == "text"
               else F.length("_weft_quality.clean_text").cast("long").alias(c) if c == "n_chars"
               else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def op6(spark, sf_dir) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text")).drop("clean_text")


def _cut(expr: str, chars: str) -> str:
    for c in chars:
        expr = f"replace({expr}, '{c}', '')"
    return expr


_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT rn, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rn, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS gram,
        lead(x, 4) OVER o AS fifth FROM u WINDOW o AS (PARTITION BY rn ORDER BY i)),
h AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS c FROM g WHERE fifth IS NOT NULL),
p AS (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nx FROM h WHERE c > 1),
r AS (SELECT rn, sum(least(5, coalesce(nx - i, 5))) AS n FROM p GROUP BY rn),
l AS (SELECT rn, list_filter(ls, lambda x: NOT (
        (length(x) - length(replace(x, '|', '')) >= {NAV_PIPES} AND (length(x) - length(replace(x, '|', ''))) * {NAV_CHARS} >= length(x))
        OR (length(x) - length({_cut('x', SYMBOLS)})) * 100 > length(x) * {SYMBOL_PERCENT}
        OR (length(x) >= {LONG_LINE} AND NOT regexp_matches(x, '[.,;:!?]'))
        OR regexp_matches(x, '{SHOUT}') OR {_PHRASES})) AS good FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length({_cut('t', SYMBOLS)}) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) - len(good) AS BIGINT) AS n_lines_removed,
        CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS total,
        CAST(coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS BIGINT) AS good_chars
      FROM w JOIN l USING (rn) LEFT JOIN r USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
    AND (total - good_chars) * 100 <= total * {LOST_PERCENT} AS kept,
  n_lines_removed, total - good_chars AS chars_removed
FROM m
"""
