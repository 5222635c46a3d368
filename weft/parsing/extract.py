"""Files to definitions, imports, calls, inheritance and routes: one pass over the file table.

Each file is read by itself, so the work splits by files and a broken one costs only its own rows. Files of
over 512 KB, binary ones and languages without rules give nothing but their File node.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths
from weft.functions.text import node_id

from .languages import CALL, LANGUAGES, WORDS

MAX_CHARS = 512 * 1024
FACTS = "kind string, path string, name string, label string, start_line int, end_line int, exported boolean, other string, extra string, text string, items array<string>, ord long"
_ARROW = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("name", pa.string()), ("label", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()),
    ("other", pa.string()), ("extra", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("ord", pa.int64())])
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "options", "any", "match")
RESOURCE = {"resource": ("index", "create", "store", "show", "edit", "update", "destroy"), "apiResource": ("index", "store", "show", "update", "destroy")}
# Model properties and relations that describe a table.
MODEL_LISTS = ("fillable", "guarded", "casts", "hidden", "appends", "with", "dates")
RELATIONS = ("hasMany", "hasOne", "belongsTo", "belongsToMany", "morphTo", "morphMany", "morphOne", "morphToMany", "hasManyThrough", "hasOneThrough")


def make_id(label: str, key: str) -> str:
    return f"{label.lower()}_{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def blank(text: str, lifetimes: bool = False, hashes: bool = False, strings: bool = True) -> str:
    """Comments (and strings) as blanks, every line break and position kept."""
    quote = r"'(?:\\.|[^'\\\n])'" if lifetimes else r"'(?:\\.|[^'\\\n])*'"
    shape = r"//[^\n]*|/\*[\s\S]*?\*/" + (r"|#(?!\[)[^\n]*" if hashes else "") + rf"|(?P<s>\"(?:\\.|[^\"\\\n])*\"|{quote}|`(?:\\.|[^`\\])*`)"

    def wipe(m):
        if m["s"] and not strings:
            return m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return re.sub(shape, wipe, text)


def _end(clean: str, at: int) -> int:
    """Where the block that opens after `at` ends; `at` if none opens before a semicolon or blank line."""
    i = at
    while i < len(clean) and clean[i] not in "{;":
        if clean.startswith("\n\n", i):
            return at
        i += 1
    if i >= len(clean) or clean[i] == ";":
        return at
    depth = 0
    for m in re.finditer(r"[{}]", clean[i:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return i + m.start()
    return len(clean) - 1


def _names(listed: str) -> list[str]:
    """Parent names of a list such as `public Base, IFoo<T>`."""
    out = []
    for part in re.sub(r"<[^<>]*>|\([^()]*\)", "", listed).split(","):
        words = [w for w in re.findall(r"[\w$\\.:]+", part) if w not in ("public", "private", "protected", "virtual", "where", "by", "implements")]
        if words:
            out.append(re.split(r"[.:\\]+", words[0] if len(words) == 1 else words[-1])[-1])
    return out


def _by_rules(path: str, text: str, language: str):
    rules = LANGUAGES[language]
    clean = blank(text, rules.lifetimes, rules.hashes)
    strings = blank(text, rules.lifetimes, rules.hashes, strings=False)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    defs, taken = [], set()
    for label, shape in rules.definitions:
        for m in shape.finditer(clean):
            name = m["n"]
            if name in WORDS and not (label == "Constructor" or name == "constructor") or (m.start("n"), "d") in taken:
                continue
            taken.add((m.start("n"), "d"))
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            own = label
            stop = _end(clean, m.end() - 1 if m[0].endswith("{") else m.end())
            head = clean[clean.rfind("\n", 0, m.start("n")) + 1 : m.start("n")]
            defs.append([own, name, line(begin), line(max(stop, begin)), head, text[begin : begin + 300]])
    defs.sort(key=lambda d: (d[2], -d[3]))
    shown = []
    for d in defs:
        head, name, own = d[4], d[1], False
        if language in ("javascript", "typescript"):
            own = bool(re.search(r"\bexport\b", head)) or any(s and e[2] < d[2] and e[3] >= d[3] for e, s in zip(defs, shown, strict=False))
        elif language == "go":
            own = name[:1].isupper()
        elif language == "kotlin":
            own = not re.search(r"\b(private|internal|protected)\b", head)
        elif language == "php":
            own = "public" in head if d[0] in ("Method", "Property") else True
        elif rules.public:
            own = bool(re.search(rf"\b({rules.public})\b", head))
        shown.append(own)
    for d, own in zip(defs, shown, strict=True):
        yield {"kind": "def", "name": d[1], "label": d[0], "start_line": d[2], "end_line": d[3], "exported": own, "text": d[5], "other": _described(d, text, breaks) if language == "php" else None}
    for shape in rules.imports:
        for m in shape.finditer(strings):
            yield {"kind": "import", "name": m["i"], "start_line": line(m.start())}
    if "grouped" in rules.extra:
        for m in rules.extra["grouped"].finditer(strings):
            for i in re.finditer(r"\"([^\"\n]+)\"", m["b"]):
                yield {"kind": "import", "name": i[1], "start_line": line(m.start("b") + i.start())}
    for kind, shape in rules.heritage:
        for m in shape.finditer(clean):
            for parent in _names(m["p"]):
                yield {"kind": "heritage", "name": m["c"], "other": parent, "extra": kind, "start_line": line(m.start())}
    if language == "php":
        for m in re.finditer(r"^[ \t]+use\s+([\w\\]+(?:\s*,\s*[\w\\]+)*)\s*;", clean, re.MULTILINE):
            at = line(m.start())
            inside = [d for d in defs if d[0] in ("Class", "Trait") and d[2] <= at <= d[3]]
            for parent in _names(m[1]) if inside else ():
                yield {"kind": "heritage", "name": inside[-1][1], "other": parent, "extra": "trait", "start_line": at}
    functions = [d for d in defs if d[0] in rules.functions]
    at_name = {(d[2], d[1]) for d in defs}
    for m in CALL.finditer(clean):
        name, at = m[1], line(m.start())
        if name in WORDS or (at, name) in at_name:
            continue
        yield {"kind": "call", "name": name, "start_line": at, **_inside(path, functions, at)}
    if language == "php":
        yield from _routes(blank(text, hashes=True, strings=False), line)


def _inside(path: str, functions, at: int) -> dict:
    """The innermost function around a line, as its id; else the file."""
    around = [d for d in functions if d[2] <= at <= d[3]]
    if not around:
        return {"other": make_id("File", path)}
    d = max(around, key=lambda d: (d[2], -d[3]))
    return {"other": make_id(d[0], f"{path}:{d[1]}:{d[2]}")}


def _described(d, text: str, breaks) -> str | None:
    """What a model's list or relation says."""
    lo = breaks[d[2] - 2] + 1 if d[2] > 1 else 0
    hi = breaks[d[3] - 1] if d[3] - 1 < len(breaks) else len(text)
    if d[0] == "Property" and d[1] in MODEL_LISTS:
        m = re.search(r"\[(.*?)\]", text[lo:], re.DOTALL)
        items = []
        for part in m[1].split(",") if m else ():
            words = re.findall(r"['\"]([^'\"]+)['\"]", part)
            if "=>" in part and len(words) > 1:
                items.append(f"{words[0]}:{words[1]}")
            elif words:
                items.append(words[0])
        return ", ".join(items) or None
    if d[0] == "Method":
        m = re.search(rf"\$this->({'|'.join(RELATIONS)})\(\s*(?:([\w\\]+)::class)?", text[lo:hi])
        if m:
            return f"{m[1]}({m[2].rsplit(chr(92), 1)[-1]})" if m[2] else m[1]
    return None


def _close(text: str, at: int) -> int:
    """The bracket that closes the one at `at`, strings skipped."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "'\"":
            i = text.find(c, i + 1)
            if i < 0:
                return len(text)
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(text)


def _strings(args: str) -> list[str]:
    return re.findall(r"['\"]([^'\"\n]*)['\"]", args)


def _routes(text: str, line, stack=(), lo: int = 0, hi: int | None = None):
    """Route:: calls, groups within groups; attributes of a chain and of the groups around it add up."""
    hi = len(text) if hi is None else hi
    at = lo
    while True:
        m = re.compile(r"\bRoute::").search(text, at, hi)
        if not m:
            return
        pos, attrs, done = m.end(), [], None
        while True:
            w = re.compile(r"\s*(?:->)?\s*(\w+)\s*\(").match(text, pos, hi)
            if not w:
                break
            close = _close(text, w.end() - 1)
            args = text[w.end() : close]
            if done is None and (w[1] == "group" or w[1] in ROUTE_VERBS or w[1] in RESOURCE):
                done = (w[1], args, w.end(), close)
            else:
                attrs.append((w[1], args))
            pos = close + 1
            if not re.compile(r"\s*->").match(text, pos, hi):
                break
        at = max(pos, m.end())
        if done is None:
            continue
        verb, args, start, close = done
        own = {"middleware": [], "prefix": None, "controller": None}
        for name, a in attrs:
            if name == "middleware":
                own["middleware"] += _strings(a)
            elif name == "prefix" and _strings(a):
                own["prefix"] = _strings(a)[0]
            elif name == "controller" and (c := re.search(r"([\w\\]+)::class", a)):
                own["controller"] = c[1].rsplit("\\", 1)[-1]
        if verb == "group":
            if args.lstrip().startswith("["):
                listed = args[: _close(args, args.index("[")) + 1]
                if p := re.search(r"['\"]prefix['\"]\s*=>\s*['\"]([^'\"]+)", listed):
                    own["prefix"] = p[1]
                if p := re.search(r"['\"]middleware['\"]\s*=>\s*(\[[^\]]*\]|['\"][^'\"]+['\"])", listed):
                    own["middleware"] += _strings(p[1])
            yield from _routes(text, line, (*stack, own), start, close)
            continue
        prefix = re.sub("/+", "/", "/".join(x["prefix"] for x in (*stack, own) if x["prefix"])) or None
        middleware = [y for x in (*stack, own) for y in x["middleware"]]
        controller = next((x["controller"] for x in reversed((*stack, own)) if x["controller"]), None)
        target, method = re.search(r"([\w\\]+)::class", args), None
        texts = _strings(args)
        if target:
            controller = target[1].rsplit("\\", 1)[-1]
            method = next(iter(_strings(args[target.end() :])), None)
        elif len(texts) > 1 and "@" in texts[1]:
            controller, method = texts[1].split("@", 1)
        elif len(texts) > 1 and controller:
            method = texts[1]
        for action in RESOURCE.get(verb, (method,)):
            yield {"kind": "route", "name": controller, "label": verb, "other": action, "extra": prefix, "text": texts[0] if texts else None, "start_line": line(m.start()), "items": middleware}


def _python(path: str, text: str):
    tree = ast.parse(text)
    functions = []

    def walk(node, inner):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                label = "Class" if isinstance(child, ast.ClassDef) else "Function"
                begin = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                d = [label, child.name, child.lineno, child.end_lineno or child.lineno]
                head = "\n".join(text.split("\n")[begin - 1 : child.lineno])[:300]
                yield {"kind": "def", "name": child.name, "label": label, "start_line": d[2], "end_line": d[3], "exported": not child.name.startswith("_"), "text": head}
                if label == "Function":
                    functions.append(d)
                for base in child.bases if label == "Class" else ():
                    if isinstance(base, ast.Name):
                        yield {"kind": "heritage", "name": child.name, "other": base.id, "extra": "extends", "start_line": child.lineno}
                    elif isinstance(base, ast.Attribute):
                        yield {"kind": "heritage", "name": child.name, "other": base.attr, "extra": "extends", "start_line": child.lineno}
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield {"kind": "import", "name": a.name, "start_line": child.lineno}
            elif isinstance(child, ast.ImportFrom):
                name = "." * child.level + (child.module or "")
                yield {"kind": "import", "name": _dotted(child.level, child.module) if child.level else name, "start_line": child.lineno}
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    calls.append((name, child.lineno))
            yield from walk(child, inner)

    calls: list = []
    yield from walk(tree, None)
    for name, at in sorted(calls, key=lambda c: c[1]):
        yield {"kind": "call", "name": name, "start_line": at, **_inside(path, functions, at)}


def _dotted(level: int, module: str | None) -> str:
    """A relative Python import as a relative path."""
    up = "./" if level == 1 else "../" * (level - 1)
    return up + (module or "").replace(".", "/")


def facts_of(path: str, text: str | None, language: str | None):
    """All facts of one file, as dictionaries."""
    if not text or language is None or len(text) > MAX_CHARS:
        return []
    try:
        if language == "python":
            return list(_python(path, text))
        return list(_by_rules(path, text, language)) if language in LANGUAGES else []
    except (SyntaxError, ValueError, RecursionError):
        return []  # a file that does not parse has no facts


def extract(files: DataFrame) -> DataFrame:
    """files: path, content and perhaps language. One row a fact: see FACTS."""
    if "language" not in files.columns:
        files = files.withColumn("language", paths.language(F.col("path")))

    def rows(batches):
        for batch in batches:
            for path, text, language in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                found = facts_of(path, text, language)
                if found:
                    yield pa.RecordBatch.from_pylist([{**f, "path": path, "ord": k} for k, f in enumerate(found)], _ARROW)

    return files.select("path", "content", "language").mapInArrow(rows, FACTS)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """nodes, symbols, imports, calls, heritage, routes from facts."""
    key = F.concat_ws(":", "path", "name", "start_line")
    defs = facts.where("kind = 'def'").withColumn("language", paths.language(F.col("path")))
    mark = paths.framework_of_definition(F.col("language"), F.col("text"))
    nodes = defs.select(
        node_id(F.col("label"), key).alias("id"), "label", "name", F.col("path").alias("file_path"), "start_line", "end_line", "language", F.col("exported").alias("is_exported"),
        F.col("other").alias("description"), mark["multiplier"].alias("ast_fw_multiplier"), mark["reason"].alias("ast_fw_reason"), "ord").dropDuplicates(["id"])
    return {
        "nodes": nodes,
        "symbols": defs.select(F.col("path").alias("file_path"), "name", node_id(F.col("label"), key).alias("node_id"), F.col("label").alias("type"), F.struct("path", "ord").alias("ord")),
        "imports": facts.where("kind = 'import'").select(F.col("path").alias("file_path"), F.col("name").alias("raw_import_path"), paths.language(F.col("path")).alias("language"), "ord"),
        "calls": facts.where("kind = 'call'").select(F.col("path").alias("file_path"), F.col("name").alias("called_name"), F.col("other").alias("source_id"), "ord"),
        "heritage": facts.where("kind = 'heritage'").select(F.col("path").alias("file_path"), F.col("name").alias("class_name"), F.col("other").alias("parent_name"),
                                                            F.when(F.col("extra") == "trait", "implements").otherwise(F.col("extra")).alias("kind"), "ord"),
        "routes": facts.where("kind = 'route'").select(F.col("path").alias("file_path"), F.col("label").alias("http_method"), F.col("text").alias("route_path"), F.col("name").alias("controller_name"),
                                                       F.col("other").alias("method_name"), F.col("items").alias("middleware"), F.col("extra").alias("prefix"), F.col("start_line").alias("line")),
    }
