"""Text of source files and names, as Columns over built-in functions.

Defined results: a null text gives null, or false for predicates; an empty one gives empty text,
no tokens and false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import directory, file_name

FILE_CHARS, SNIPPET_CHARS, AROUND = 10_000, 5_000, 2
CUT = "\n... [truncated]"
BINARY_NOTE = "[Binary file - content not stored]"
TEXT_BYTES = r"\x07-\x0A\x0C\x0D\x1B\x20-\x7E"

# Words that carry no meaning in a code search.
STOP_WORDS = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while", "class", "new", "this", "import", "export", "from", "default",
    "async", "await", "try", "catch", "throw", "typeof", "instanceof", "true", "false", "null", "undefined",
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "of", "it", "be", "as", "by", "that", "are", "was", "were",
)
# Words that make a graph query a writing one.
WRITE_WORDS = ("CREATE", "DELETE", "SET", "MERGE", "REMOVE", "DROP", "ALTER", "COPY", "DETACH")
# Evaluation modes at the end of a run's name, old and new.
RUN_MODES = ("baseline", "mcp", "augment", "full", "native", "native_augment")
# Folders too general to name a community.
GENERIC_FOLDERS = ("src", "lib", "core", "utils", "common", "shared", "helpers")


def sanitize(text: Column) -> Column:
    """Line ends as \\n, without control characters and non-characters."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFE\uFFFF]", "")


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(sanitize(F.coalesce(value.cast("string"), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_number(value: Column, default: float = -1) -> Column:
    return F.coalesce(value.cast("string"), F.lit(str(default)))


def is_binary_text(text: Column) -> Column:
    """A tenth or more of the first 1000 characters cannot be printed."""
    head = F.substring(text, 1, 1000)
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.coalesce((F.length(head) > 0) & (odd * 10 >= F.length(head)), F.lit(False))


def is_binary_bytes(content: Column) -> Column:
    """A zero byte, or over three tenths of bytes that are not text, among the first 8192."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, f"[{TEXT_BYTES}]", ""))
    return F.coalesce(F.contains(head, F.lit("\0")) | (odd * 10 > F.length(head) * 3), F.lit(False))


def snippet(content: Column, label: Column, start_line: Column, end_line: Column) -> Column:
    """What the index keeps of a node: the head of a file, or a symbol's lines with two around them."""
    lines = F.split(content, "\n", -1)
    lo = F.greatest(F.lit(0), start_line.cast("int") - AROUND)
    hi = F.least(F.size(lines) - 1, end_line.cast("int") + AROUND)
    body = F.array_join(F.slice(lines, lo + 1, F.greatest(F.lit(0), hi - lo + 1)), "\n")

    def cut(text: Column, most: int) -> Column:
        return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(CUT)))

    return (F.when(content.isNull() | (content == "") | (label == "Folder"), "").when(is_binary_text(content), BINARY_NOTE)
            .when(label == "File", cut(content, FILE_CHARS)).when(start_line.isNull() | end_line.isNull(), "").otherwise(cut(body, SNIPPET_CHARS)))


def name_tokens(name: Column) -> Column:
    """Parts of a camel-case or snake-case name, lower case, of three characters and more."""
    parts = F.regexp_extract_all(F.translate(name, "_-", "  "), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"), 0)
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 3)


def search_tokens(text: Column, camel: bool = False) -> Column:
    """Words for file search. camel: names in camel case also give their parts (the plain form keeps them whole)."""
    own = F.split(F.lower(text), r"[\s\-_./\\(){}\[\]<>:;,!?'\"]+")
    if camel:
        apart = F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), r"[\s\-_./\\(){}\[\]<>:;,!?'\"]+")
        own = F.concat(own, F.array_except(apart, own))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(own, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores: the terms of full-text search."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def common_prefix(names: Column) -> Column:
    """Longest common start of an array of strings."""
    lo, hi = F.array_min(names), F.array_max(names)
    ends = F.filter(F.sequence(F.lit(0), F.length(lo)), lambda k: F.substring(lo, F.lit(1), k) == F.substring(hi, F.lit(1), k))
    return F.coalesce(F.substring(lo, F.lit(1), F.array_max(ends)), F.lit(""))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def sanitize_id(text: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), 1, 20))


def slugify(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_words(text: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis, cut at the last blank if that is in the last fifth."""
    head = F.substring(text, 1, most)
    blank = F.length(head) - F.locate(" ", F.reverse(head))  # counted from 0
    at_blank = (F.locate(" ", F.reverse(head)) > 0) & (blank > most * 0.8)
    return F.when(F.length(text) <= most, text).when(at_blank, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def clean_content(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, no blanks at line ends or around the text."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)[^\S\n]+$", ""), r"^\s+|\s+$", "")


def embedding_text(label: Column, name: Column, path: Column, content: Column | None = None, most: int = 500) -> Column:
    """What an embedder reads of a node: name, file, directory and the start of its cleaned content."""
    folder = directory(path)
    head = F.concat_ws("\n", F.concat(label, F.lit(": "), name), F.concat(F.lit("File: "), file_name(path)),
                       F.when(folder != "", F.concat(F.lit("Directory: "), folder)))
    if content is None:
        return head
    return F.when(F.coalesce(content, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n\n"), truncate_words(clean_content(content), most)))


def plain_embedding_text(label: Column, name: Column, path: Column) -> Column:
    return F.concat_ws(" ", label, name, path)


def node_id(label: Column, key: Column) -> Column:
    """Deterministic id: label and the start of the key's SHA-256."""
    return F.concat(F.lower(label), F.lit("_"), F.substring(F.sha2(key, 256), 1, 16))


def search_pattern(command: Column) -> Column:
    """What a shell command searches for with grep, rg or ag: the quoted pattern, else the first plain word; never a path or a flag."""
    def fit(p: Column) -> Column:
        return F.when((p != "") & ~p.rlike(r"^[/.\-]"), p)

    flags = r"(?:grep|rg|ag)\s+(?:-[a-zA-Z]*\s+)*"
    return F.coalesce(fit(F.regexp_extract(command, flags + r"[\"']([^\"']+)[\"']", 1)), fit(F.regexp_extract(command, flags + r"(\S+)", 1)))


def parse_run(run: Column, modes=RUN_MODES) -> Column:
    """struct(model, mode) of a run's name; an unknown mode leaves the name whole."""
    tail = "|".join(sorted((re.escape(m) for m in modes), key=len, reverse=True))
    mode = F.regexp_extract(run, rf"^.*?_({tail})$", 1)
    return F.when(mode == "", F.struct(run.alias("model"), F.lit("unknown").alias("mode"))).otherwise(
        F.struct(F.substring(run, F.lit(1), F.length(run) - F.length(mode) - 1).alias("model"), mode.alias("mode")))


def is_write_query(query: str) -> bool:
    return re.search(rf"\b({'|'.join(WRITE_WORDS)})\b", query, re.IGNORECASE) is not None


def stem(word: str) -> str:
    """Porter's stemmer (1980) for a lower-case English word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    shape = lambda w: "".join("v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w))
    measure = lambda w: len(re.findall("vc", re.sub("(.)\\1+", "\\1", shape(w))))
    vowel = lambda w: "v" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"
    closed = lambda w: len(w) > 2 and shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def swap(w: str, rules, least: int) -> str:
        for old, new in rules:
            if w.endswith(old):
                base = w[: len(w) - len(old)]
                return base + new if measure(base) > least else w
        return w

    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and closed(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
                 ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
                 ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("ement", "ment", "ent", "ance", "ence", "able", "ible", "ant", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or measure(base) == 1 and not closed(base):
            w = base
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w
