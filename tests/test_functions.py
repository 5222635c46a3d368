"""Row-level functions: paths, texts, vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import paths, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def each(spark, function, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r["x"] for r in df.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_language(spark):
    got = each(spark, paths.language, ["a/b.py", "x.TSX", "Dockerfile", "a/Makefile", "noext", ".py", "a.d/b", "k.kts", None])
    assert got == ["python", "typescript", "dockerfile", "makefile", None, None, None, "kotlin", None]


def test_ignored(spark):
    got = each(spark, paths.is_ignored, ["src/a.ts", "node_modules/x/a.ts", "a/yarn.lock", "a.min.js", "a.test.js", "x.chunk.y.js", "t.d.ts", "img/a.PNG", "a\\dist\\b.js", None, "LICENSE"])
    assert got == [False, True, True, True, False, True, True, True, True, False, True]


def test_ignore_patterns(spark):
    lines = ["*.log", "/root.txt", "docs/", "a/**/z.py", "!keep.log", "x[0-9].c", "# note", ""]
    got = each(spark, lambda c: paths.not_ignored(c, lines), ["a.log", "d/b.log", "root.txt", "d/root.txt", "docs/x.md", "docs", "a/z.py", "a/b/c/z.py", "d/keep.log", "x1.c", "xy.c"])
    assert got == [False, False, False, True, False, True, False, False, True, False, True]
    assert each(spark, paths.not_ignored, ["a/__pycache__/b.py", "venv/x", "src/env.py"]) == [False, False, True]


def test_test_files(spark):
    names = ["a.test.ts", "src/tests/x.py", "a_test.go", "src/TestsUITests/x.swift", "src/main.py", "conftest.py", "a/fixtures/x", "Foo\\tests\\a.cs", None]
    assert each(spark, paths.is_test_file, names) == [True, True, True, True, False, False, False, True, False]
    assert each(spark, paths.is_test_for_impact, names)[4:7] == [False, False, True]


@pytest.mark.parametrize("path,want", [
    ("src/pages/index.tsx", ("nextjs-pages", 3.0)), ("src/pages/_app.tsx", None), ("pages/api/user.ts", ("nextjs-api", 3.0)), ("src/app/page.tsx", ("nextjs-app", 3.0)),
    ("src/app/layout.tsx", ("nextjs-app", 2.0)), ("app/api/x/route.ts", ("nextjs-api", 3.0)), ("routes/a.js", ("express", 2.5)), ("proj/views.py", ("django", 3.0)),
    ("proj/urls.py", ("django", 2.0)), ("api/__init__.py", ("api", 1.8)), ("api/x.py", ("python-api", 2.0)), ("src/UserController.java", ("spring", 3.0)),
    ("src/service/X.java", ("java-service", 1.8)), ("cmd/tool/x.go", ("go", 3.0)), ("src/main.rs", ("rust", 3.0)), ("src/app.cpp", ("c-cpp", 2.5)), ("main.c", ("c-cpp", 3.0)),
    ("app/Http/Controllers/A.php", ("laravel", 3.0)), ("App/AppDelegate.swift", ("ios", 3.0)), ("Sources/MyApp.swift", ("swiftui", 3.0)), ("ui/HomeViewController.swift", ("uikit", 2.5)),
    ("api/index.ts", ("api", 1.8)), ("src/components/Button.tsx", ("react", 1.5)), ("src/components/button.tsx", None), ("lib/util.py", None), (None, None),
])
def test_framework_of_path(spark, path, want):
    got = each(spark, paths.framework_of_path, [path])[0]
    assert (got and (got["framework"], got["multiplier"])) == want


def test_framework_of_definition(spark):
    df = spark.createDataFrame([("python", "@app.route('/x')"), ("Python", "@APP.GET('/')"), ("java", "@GET x"), ("kotlin", "class A : Fragment("), ("go", "http.Handler"), (None, "x")], "l string, t string")
    got = [r["x"] and r["x"]["framework"] for r in df.select(paths.framework_of_definition(F.col("l"), F.col("t")).alias("x")).collect()]
    assert got == ["flask", "fastapi", "jaxrs", "android-kotlin", None, None]


def test_sanitize_escape_binary(spark):
    assert each(spark, text.sanitize, ["a\r\nb\rc\x00\x07d\x7f", None]) == ["a\nb\ncd", None]
    assert each(spark, text.csv_field, ['say "hi"', None]) == ['"say ""hi"""', '""']
    assert each(spark, text.is_binary_text, ["a" * 9 + "\x01", "a" * 10 + "\x01", "", None, "plain"]) == [True, False, False, False, False]
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"a\0b"),), (bytearray(range(128, 180)),), (bytearray(b""),)], "b binary")
    assert [r[0] for r in df.select(text.is_binary_bytes(F.col("b"))).collect()] == [False, True, True, False]


def test_snippet(spark):
    body = "\n".join(f"line {k}" for k in range(20))
    df = spark.createDataFrame([("Function", 5, 6), ("Function", 0, 0), ("Function", 18, 19), ("File", None, None), ("Folder", None, None), ("Class", None, 3)], "l string, a int, b int").withColumn("c", F.lit(body))
    got = [r[0] for r in df.select(text.snippet(F.col("c"), F.col("l"), F.col("a"), F.col("b"))).collect()]
    want = lambda lo, hi: "\n".join(f"line {k}" for k in range(lo, hi + 1))
    assert got == [want(3, 8), want(0, 2), want(16, 19), body, "", ""]
    assert each(spark, lambda c: text.snippet(c, F.lit("File"), F.lit(None).cast("int"), F.lit(None).cast("int")), ["x" * 10_001])[0] == "x" * 10_000 + "\n... [truncated]"


def test_names(spark):
    assert each(spark, text.name_tokens, ["getUserById", "HTTPServer2000", "parse_xml-file", "a"]) == [["get", "user"], ["http", "server", "2000"], ["parse", "xml", "file"], []]
    assert each(spark, lambda c: text.common_prefix(F.split(c, ",")), ["userGet,userSet,userX", "a,b", "x"]) == ["user", "", "x"]
    assert each(spark, text.sanitize_id, ["Handle-Login!é"]) == ["handle_login__"]
    assert each(spark, text.slugify, ["My  Module — Core!"]) == ["my-module-core"]
    assert each(spark, text.capitalize, ["abc", ""]) == ["Abc", ""]
    assert each(spark, paths.short_path, ["a/b/c/d", "a"]) == ["b/c/d", "a"]
    assert each(spark, text.estimate_tokens, ["abcde", ""]) == [2, 0]
    assert each(spark, text.search_tokens, ["getUser the src/app.ts"]) == [["getuser", "src", "app", "ts"]]
    assert set(each(spark, lambda c: text.search_tokens(c, camel=True), ["getUser"])[0]) == {"getuser", "get", "user"}


def test_embedding_text(spark):
    got = one(spark, text.embedding_text(F.lit("Function"), F.col("n"), F.col("p"), F.col("c")), n="run", p="src/a.ts", c="x  \r\n\n\n\ny ")
    assert got == "Function: run\nFile: a.ts\nDirectory: src\n\nx\n\ny"
    assert each(spark, lambda c: text.truncate_words(c, 10), ["short", "aaaa bbbb cccc", "aaaaaaaaaaaaaa", "aaaaaaaaa bbb"]) == ["short", "aaaa bbbb...", "aaaaaaaaaa...", "aaaaaaaaa..."]


def test_search_pattern_and_runs(spark):
    got = each(spark, text.search_pattern, ["grep -rn 'foo bar' src", "rg foo", "rg -i /etc", "ls", 'ag "x"', "grep .hidden"])
    assert got == ["foo bar", "foo", None, None, "x", None]
    assert [tuple(r) for r in each(spark, text.parse_run, ["gpt_native_augment", "m-2.5_full", "m_x", "baseline"])] == [("gpt", "native_augment"), ("m-2.5", "full"), ("m_x", "unknown"), ("baseline", "unknown")]


def test_write_guard():
    for word in ("CREATE", "DELETE", "SET", "MERGE", "REMOVE", "DROP", "ALTER", "COPY", "DETACH"):
        assert text.is_write_query(f"match (n) {word.lower()} n")
    assert not text.is_write_query("MATCH (n) RETURN n.settings")


@pytest.mark.parametrize("word,want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("formative", "form"), ("goodness", "good"),
    ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("generalization", "gener"), ("oscillators", "oscil")])
def test_porter(word, want):
    assert text.stem(word) == want


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in v[k]]) for k in range(500)] + [(900, None), (901, []), (902, [1.0])]
    df = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    q = v[3] * 2
    got = vectors.nearest(df, q, 7).collect()
    want = sorted(((-float(v[k] @ v[3]), k) for k in range(500)))[:7]
    assert [r["node_id"] for r in got] == [k for _, k in want]
    assert np.allclose([r["score"] for r in got], [-s for s, _ in want])
    same = vectors.within(vectors.nearest(df, q, 7), 0.3).count()
    assert same == sum(1 + s < 0.3 for s, _ in want)
    assert one(spark, vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), a=1) == 0.0
    assert one(spark, vectors.normalise(F.array(F.lit(0.0), F.lit(0.0))), a=1) == [0.0, 0.0]


def test_node_id(spark):
    import hashlib

    assert each(spark, lambda c: text.node_id(F.lit("Function"), c), ["a.py:f:1"]) == ["function_" + hashlib.sha256(b"a.py:f:1").hexdigest()[:16]]
