"""From source files to a graph, and what is asked of it; sources, store, command line and the stream."""

import json
import zipfile

import pytest

from weft.analyze import analyze
from weft.cypher import CypherError, compile_query
from weft.graph import CANNED, KnowledgeGraph, as_text, hashed_embedding, yaml
from weft.parsing.extract import facts_of
from weft.sources import files as source_files
from weft.sources import project, runs
from weft.sources.registry import Registry, Status
from weft.sources.store import Store, load_edges, markdown

SOURCES = {
    "src/api/handler.ts": "import { validate } from '../lib/check'\nimport { save } from '../lib/db'\nexport function handleRequest(x) {\n  validate(x)\n  save(x)\n}\n",
    "src/lib/check.ts": "import { fmt } from './fmt'\nexport function validate(x) {\n  return fmt(x)\n}\n",
    "src/lib/db.ts": "import { fmt } from './fmt'\nexport class Base {}\nexport class Db extends Base {\n  save(x) {\n    return fmt(x)\n  }\n}\nexport const save = (x) => new Db().save(x)\n",
    "src/lib/fmt.ts": "export function fmt(x) {\n  return String(x)\n}\n",
    "src/lib/fmt.test.ts": "import { fmt } from './fmt'\nfunction testFmt() {\n  fmt(1)\n}\n",
    "py/tool.py": "import os\nfrom .util import helper\n\nclass A(B):\n    def run(self):\n        return helper()\n\ndef _hidden():\n    pass\n",
    "py/util.py": "class B:\n    pass\n\ndef helper():\n    return 1\n",
    "README.md": "# fmt and validate\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(sorted(SOURCES.items()), "path string, content string")


@pytest.fixture(scope="module")
def graph(spark, files):
    t = analyze(files)
    g = KnowledgeGraph(t["nodes"].cache(), t["edges"].cache(), t["communities"], t["processes"], files)
    g.embeddings = g.embed().cache()
    return g


def edges(graph, kind):
    names = {r["id"]: r["name"] for r in graph.nodes.collect()}
    return {(names.get(r["src"]), names.get(r["dst"])) for r in graph.typed(kind).collect()}


def test_structure_and_symbols(graph):
    stats = graph.stats()["by_label"]
    assert stats["File"] == 8 and stats["Folder"] == 4 and stats["Class"] == 4
    assert ("lib", "fmt.ts") in edges(graph, "CONTAINS") and ("src", "lib") in edges(graph, "CONTAINS")
    assert ("fmt.ts", "fmt") in edges(graph, "DEFINES")
    shown = {r["name"]: r["is_exported"] for r in graph.nodes.where("label in ('Function', 'Method', 'Class')").collect()}
    assert shown["_hidden"] is False and shown["helper"] and shown["fmt"] and shown["testFmt"] is False


def test_resolved_edges(graph):
    assert {("handler.ts", "check.ts"), ("handler.ts", "db.ts"), ("check.ts", "fmt.ts"), ("tool.py", "util.py")} <= edges(graph, "IMPORTS")
    assert {("handleRequest", "validate"), ("handleRequest", "save"), ("validate", "fmt"), ("run", "helper")} <= edges(graph, "CALLS")
    assert edges(graph, "EXTENDS") == {("Db", "Base"), ("A", "B")}
    assert graph.typed("MEMBER_OF").count() == graph.nodes.where("label not in ('File', 'Folder', 'Community', 'Process')").count()


def test_context_and_impact(graph):
    c = graph.context("fmt")
    assert c["status"] == "found" and {r["name"] for r in c["incoming"]["calls"]} >= {"validate", "save"}
    assert graph.context("save")["status"] == "ambiguous" and "Several" in as_text(graph.context("save"))
    assert graph.context("save", file_path="nowhere")["error"]
    assert graph.context(uid=c["symbol"]["uid"], include_content=True)["symbol"]["content"].startswith("export function fmt")
    with pytest.raises(ValueError):
        graph.context()
    i = graph.impact("fmt")
    names = {r["name"] for r in i["members"].collect()}
    assert {"validate", "handleRequest"} <= names and "testFmt" not in names
    assert "testFmt" in {r["name"] for r in graph.impact("fmt", tests=True)["members"].collect()}
    assert graph.impact("fmt", min_confidence=0.99, relations=["CALLS"])["impacted_count"] == 0
    assert graph.impact("nothing")["error"] and i["risk"] in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    assert {r["name"] for r in graph.impact("handleRequest", "downstream")["members"].collect()} >= {"validate", "save", "fmt"}


def test_search(graph):
    assert graph.bm25("validating").first()["id"].startswith(("function_", "file_"))  # stems
    assert graph.bm25_files("fmt").count() > 0 and graph.semantic(" ").count() == 0
    found = graph.query("validate request")
    assert found["processes"] and {s["name"] for s in found["process_symbols"]} & {"validate", "handleRequest"}
    assert graph.hybrid("fmt", 3).count() == 3
    assert "fmt" in graph.augment("fmt") and graph.augment("zz") == "" and graph.augment("qqqqqq") == ""
    with pytest.raises(ValueError):
        graph.query(" ")
    v = hashed_embedding(["a b", "", "a b"])
    assert (v[0] == v[2]).all() and not v[1].any()


def test_changes_rename_and_views(graph):
    d = graph.detect_changes(["src/lib/fmt.ts"])
    assert d["summary"]["changed_files"] == 1 and "fmt" in {s["name"] for s in d["changed_symbols"]}
    r = graph.rename("render", "fmt")
    assert {e["path"] for e in r["changes"] if e["source"] == "graph"} >= {"src/lib/fmt.ts", "src/lib/check.ts"} and "README.md" in {e["path"] for e in r["changes"] if e["source"] == "text_search"}
    assert not r["applied"] and graph.rename("x", "save")["status"] == "ambiguous"
    o = graph.overview()
    assert o["stats"]["files"] == 8 and o["processes"]
    p = graph.process(o["processes"][0]["id"])
    assert p["steps"] and graph.mermaid(o["processes"][0]["id"]).startswith("flowchart TD") and graph.process("none")["error"]
    name = graph.all_nodes.where("label = 'Community'").first()["title"]
    assert graph.cluster(name)["members"] and graph.explore("cluster", name)["cluster"] and graph.cluster("none")["error"]
    assert "processes:" in graph.resource("processes") and "nodes:" in graph.resource("schema") and graph.resource("context").startswith("stats:")
    assert graph.codebase()["folders"] and graph.flows_through(["src/api/handler.ts"]).count() > 0


def test_sql_and_cypher(graph):
    assert graph.sql("SELECT count(*) AS n FROM calls WHERE confidence >= :c", c=0.5).first()["n"] > 0
    with pytest.raises(ValueError):
        graph.sql("DROP TABLE x")
    for q in CANNED.values():
        graph.cypher(q).collect()
    rows = graph.cypher("MATCH (a:Function)-[r:CodeRelation {type: 'CALLS'}]->(b {name: $n}) WHERE r.confidence >= 0.5 AND NOT a.filePath CONTAINS '.test.' RETURN DISTINCT a.name AS name ORDER BY name", n="fmt").collect()
    assert [r["name"] for r in rows] == ["validate"]
    rows = graph.cypher("MATCH (n:Function) WHERE n.name IN ['fmt', 'testFmt'] OPTIONAL MATCH (m)-[r:CALLS]->(n) RETURN n.name AS name, COUNT(DISTINCT m.id) AS callers, collect(DISTINCT {name: m.name, type: labels(m)[0]}) AS who ORDER BY callers DESC").collect()
    assert [(r["name"], r["callers"] > 0) for r in rows] == [("fmt", True), ("testFmt", False)]
    rows = graph.cypher("MATCH (n:Function)-[r]-(m) WHERE n.name = 'fmt' WITH n, COUNT(r) AS c WHERE c > 1 RETURN n.name AS name, c SKIP 0 LIMIT 5").collect()
    assert len(rows) == 1 and rows[0]["c"] > 2
    two = graph.cypher("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) MATCH (c)-[:MEMBER_OF]->(g:Community) RETURN a.name AS a, c.name AS c, g.symbolCount AS n, CASE WHEN g.cohesion > 0.5 THEN 'tight' ELSE 'loose' END AS kind").collect()
    assert ("handleRequest", "fmt") in {(r["a"], r["c"]) for r in two}
    assert graph.cypher("MATCH (n) WHERE n.name STARTS WITH 'hand' AND n.name ENDS WITH 'Request' AND n.startLine IS NOT NULL RETURN n").first()["n"]["name"] == "handleRequest"


@pytest.mark.parametrize("query", ["MATCH (n) DELETE n", "MATCH (n)", "MATCH (a), (b) RETURN a", "RETURN", "MATCH (a)-[:X*1..3]->(b) RETURN a", "MATCH (a) RETURN a ???", "OPTIONAL MATCH (a) RETURN a"])
def test_cypher_errors(query):
    with pytest.raises(CypherError):
        compile_query(query)


@pytest.mark.parametrize("language,code,names,calls,parents", [
    ("java", "package x;\nimport a.b.C;\npublic class A extends B implements C, D {\n  public A() { go(); }\n  private int size(int n) { return count(n); }\n}\n", {"A": "Class", "size": "Method"}, {"go", "count"}, {"B", "C", "D"}),
    ("go", "package x\nimport (\n  \"fmt\"\n  \"a/b\"\n)\ntype T struct {\n}\nfunc (t *T) Run() {\n  helper()\n}\nfunc helper() {}\n", {"T": "Struct", "Run": "Method", "helper": "Function"}, {"helper"}, set()),
    ("rust", "use crate::a::b;\npub struct S {}\nimpl Shape for S {\n  fn area(&self) -> f64 { compute(1) }\n}\nfn other<'a>(x: &'a str) {}\n", {"S": "Struct", "area": "Function", "other": "Function"}, {"compute"}, {"Shape"}),
    ("csharp", "using System.Text;\nnamespace N {\n  public class A : B, IC {\n    public int X { get; set; }\n    public void Run() { Go(); }\n  }\n}\n", {"A": "Class", "X": "Property", "Run": "Method", "N": "Namespace"}, {"Go"}, {"B", "IC"}),
    ("kotlin", "import a.b.*\nclass A(val x: Int) : B(), C {\n  fun run() { go() }\n}\n", {"A": "Class", "run": "Function"}, {"go"}, {"B", "C"}),
    ("swift", "import UIKit\nclass A: B, P {\n  func run() { go() }\n  init() {}\n}\nprotocol P {}\n", {"A": "Class", "run": "Function", "init": "Constructor", "P": "Interface"}, {"go"}, {"B", "P"}),
    ("c", "#include <stdio.h>\n#define MAX 3\nstruct point { int x; };\nint add(int a, int b) {\n  return plus(a, b);\n}\n", {"add": "Function", "point": "Struct", "MAX": "Macro"}, {"plus"}, set()),
    ("cpp", "#include \"a.h\"\nnamespace n {\nclass A : public B {\n};\n}\nint A::run(int x) {\n  return go(x);\n}\n", {"A": "Class", "run": "Function", "n": "Namespace"}, {"go"}, {"B"}),
    ("php", "<?php\nuse App\\X;\nclass A extends B implements C {\n  use T;\n  public function run() { go(); }\n}\n", {"A": "Class", "run": "Method"}, {"go"}, {"B", "C", "T"}),
    ("javascript", "const a = require('x')\n// function no() {}\nclass A extends B {\n  run() { go('function not() {') }\n}\n", {"A": "Class", "run": "Method"}, {"go"}, {"B"}),
])
def test_languages(language, code, names, calls, parents):
    facts = facts_of("f", code, language)
    got = {(f["name"], f["label"]) for f in facts if f["kind"] == "def"}
    assert set(names.items()) <= got and not {"no", "not"} & {n for n, _ in got}
    assert calls <= {f["name"] for f in facts if f["kind"] == "call"}
    assert {f["other"] for f in facts if f["kind"] == "heritage"} == parents


def test_broken_and_odd_files():
    for text in (None, "", "def (", "class", "\x00", "((((", "{" * 5000):
        for language in ("python", "typescript", "php", "java", None, "unknown"):
            facts_of("f", text, language)
    assert facts_of("f", "x" * 600_000, "python") == []


def test_laravel_routes():
    code = "<?php\nRoute::prefix('api')->middleware(['auth', 'log'])->group(function () {\n  Route::get('/u', [UserController::class, 'index']);\n  Route::group(['prefix' => 'v1', 'middleware' => 'x'], function () {\n    Route::apiResource('posts', PostController::class);\n  });\n});\nRoute::post('/old', 'OldController@store');\nRoute::controller(C::class)->group(function () { Route::get('/a', 'show'); });\n"
    got = [(r["label"], r["text"], r["name"], r["other"], r["extra"], r["items"]) for r in facts_of("routes/api.php", code, "php") if r["kind"] == "route"]
    assert got[0] == ("get", "/u", "UserController", "index", "api", ["auth", "log"])
    assert [g[3] for g in got[1:6]] == ["index", "store", "show", "update", "destroy"] and got[1][4] == "api/v1" and got[1][5] == ["auth", "log", "x"]
    assert got[6][:4] == ("post", "/old", "OldController", "store") and got[7][2:4] == ("C", "show")


def test_sources(spark, tmp_path):
    for path, text in {**SOURCES, "node_modules/x/a.ts": "x", ".git/config": "x", "big.py": "x" * 600_000, "skip/me.py": "x", "pic.png": "x", "notes.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    (tmp_path / ".gitignore").write_text("skip/\n# no\n")
    found = source_files.scan(spark, tmp_path.as_uri(), project.ignore_lines(tmp_path))
    assert {r["path"] for r in found.collect()} == {*SOURCES, "bin.py"}
    assert {r["language"]: r["files"] for r in source_files.count_by_language(found).collect()}["typescript"] == 5
    assert source_files.scan(spark, tmp_path.as_uri(), languages=["markdown"]).count() == 1
    assert [r["language"] for r in source_files.skipped_by_language(found).collect()] == ["markdown"]
    texts = {r["path"]: r for r in source_files.contents(spark, tmp_path.as_uri(), found).collect()}
    assert texts["py/util.py"]["content"] == SOURCES["py/util.py"] and texts["bin.py"]["is_binary"] and texts["bin.py"]["content"] is None
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("repo-main/src/a.py", "x = 1")
        z.writestr("repo-main/b.bin", b"\0")
    assert {r["path"]: r["content"] for r in source_files.from_zip(spark, str(tmp_path / "a.zip")).collect()} == {"src/a.py": "x = 1", "b.bin": None}


def test_project_files(tmp_path):
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": ".", /* x */ "paths": {"@/*": ["src/*"]} // y\n}}')
    (tmp_path / "go.mod").write_text("module github.com/u/r\n\ngo 1.21\n")
    (tmp_path / "composer.json").write_text(json.dumps({"autoload": {"psr-4": {"App\\": "app/"}}, "autoload-dev": {"psr-4": {"Tests\\": "tests/"}}}))
    (tmp_path / "Sources/Core").mkdir(parents=True)
    (tmp_path / "weft.toml").write_text("[analysis]\nskip_embeddings = true\n")
    c = project.config(tmp_path)
    assert c.aliases == (("@/", "src/"),) and c.go_module == "github.com/u/r" and c.psr4 == (("App", "app"), ("Tests", "tests")) and c.swift_targets == (("Core", "Sources/Core"),)
    assert project.settings(tmp_path) == {"skip_embeddings": True} and project.settings(tmp_path / "none") == {}
    assert project.inside(tmp_path, "a/b").name == "b"
    with pytest.raises(ValueError):
        project.inside(tmp_path, "../x")


def test_git(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert project.git_head(tmp_path) is None
    run("init", "-q")
    (tmp_path / "a.py").write_text("1")
    run("add", "-A")
    run("commit", "-qm", "one")
    first = project.git_head(tmp_path)
    (tmp_path / "a.py").write_text("2")
    assert project.changed_files(tmp_path) == ["a.py"] and project.changed_files(tmp_path, "staged") == []
    run("commit", "-qam", "two")
    assert project.changed_files(tmp_path, "compare", first) == ["a.py"] and project.commits_behind(tmp_path, first) == 1 and project.commits_behind(tmp_path, "nope") == 0
    with pytest.raises(ValueError):
        project.changed_files(tmp_path, "compare")


def test_registry_and_status(tmp_path):
    for n in ("alpha", "beta"):
        (tmp_path / n / "sub").mkdir(parents=True)
    r = Registry(tmp_path / "r.json")
    with pytest.raises(LookupError):
        r.find()
    r.register("Alpha", tmp_path / "alpha", str(tmp_path / "alpha"), "c1", {})
    assert r.find()["name"] == "Alpha"
    r.register("beta", tmp_path / "beta", str(tmp_path / "beta"), "c2", {})
    assert r.find("alpha")["last_commit"] == "c1" and r.find("bet")["name"] == "beta" and r.for_folder(tmp_path / "beta" / "sub")["name"] == "beta"
    with pytest.raises(LookupError):
        r.find()
    r.register("gone", tmp_path / "gone", str(tmp_path / "gone"), None, {})
    assert len(r.rows()) == 2
    r.unregister(tmp_path / "beta")
    assert [x["name"] for x in r.rows()] == ["Alpha"]
    s = Status(tmp_path / "s.json")
    assert s.read() is None
    s.write("r1", "parse", 40)
    assert s.read()["percent"] == 40


def test_store(spark, graph, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    assert s.read("nodes").count() == 0
    s.write(meta={"last_commit": "c"}, nodes=graph.nodes, edges=graph.edges, embeddings=graph.embeddings)
    assert s.counts() == {"nodes": graph.nodes.count(), "edges": graph.edges.count()} and s.state()["meta"]["last_commit"] == "c"
    before = s.read("embeddings").count()
    gone = spark.createDataFrame([("py/util.py",)], "path string")
    ids = {r["id"] for r in graph.nodes.where("file_path = 'py/util.py'").collect()}
    s.delete_files(gone)
    assert not ids & {r["id"] for r in s.read("nodes").collect()} and not ids & {x for r in s.read("edges").collect() for x in (r["src"], r["dst"])}
    assert s.read("embeddings").count() < before
    s.restore_embeddings(graph.embeddings)
    assert s.read("embeddings").count() < before
    new = spark.createDataFrame([("n1", "x", "Function"), (None, "y", "Function")], "id string, name string, label string")
    assert s.upsert("nodes", new) == {"inserted": 1, "failed": 1} and s.read("nodes").where("id = 'n1'").count() == 1
    kept, counts = load_edges(spark.createDataFrame([("n1", "n1", "CALLS"), ("n1", "zz", "CALLS")], "src string, dst string, type string"), new.where("id is not null"))
    assert kept.count() == 1 and tuple(counts.first()) == (1, 1)
    assert markdown([{"a": None, "b": [1], "c": "x|y" * 40}], ["a", "b", "c"]).count("\n") == 2


def test_runs(spark, tmp_path):
    run = tmp_path / "m_native" / "i1"
    run.mkdir(parents=True)
    (tmp_path / "m_native" / "preds.json").write_text(json.dumps({"i1": {"model_patch": "diff"}, "i2": {"model_patch": ""}}))
    (run / "i1.traj.json").write_text(json.dumps({"instance_id": "i1", "info": {"model_stats": {"instance_cost": 0.5, "api_calls": 3}, "metrics": {"total_tool_calls": 2}}}))
    got = {r["instance_id"]: r for r in runs.load(spark, str(tmp_path)).collect()}
    assert got["i1"]["cost"] == 0.5 and got["i1"]["tool_calls"] == 2 and got["i2"]["cost"] is None and got["i1"]["run_id"] == "m_native"


def test_stream(spark, tmp_path):
    from weft.streaming import incremental as inc

    source, index = tmp_path / "in", f"file://{tmp_path}/index"
    schema = "path string, content string, ord long"
    step = 0
    for rows in ([("a", "one two two", 1), ("b", "two", 1)], [("a", "three", 2), ("c", "one", 2)], [("b", None, 3), ("c", "x", 3), ("c", "four", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = inc.index_stream(spark.readStream.schema(schema).parquet(str(source)), index, f"{tmp_path}/cp")
        q.awaitTermination(120)
        step += 1
    got = {(r["path"], r["term"], r["tf"]) for r in inc.read_index(spark, index).collect()}
    assert got == {("a", "three", 1), ("c", "four", 1)}
    inc.apply_batch(spark, index, spark.createDataFrame([("b", None), ("c", "four")], "path string, content string"), 2)  # a batch that runs again
    assert {(r["path"], r["term"], r["tf"]) for r in inc.read_index(spark, index).collect()} == got


def test_yaml():
    assert yaml({"a": [1, {"b": None}], "c": {}, "d": "x: y"}) == 'a:\n  - 1\n  - b: null\nc: {}\nd: "x: y"'
