"""Joins, graph algorithms, search and aggregations against small models."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import changes, community, flows, graph, resolve, search

SYMBOLS = "file_path string, name string, node_id string, ord long"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- resolution ------------------------------------------------------------------------------------


def model_resolve(refs, symbols, imports, same):
    out = []
    for f, n in refs:
        own = [s for s in symbols if s[0] == f and s[1] == n]
        every = [s for s in symbols if s[1] == n]
        near = [s for s in every if (f, s[0]) in imports]
        if own:
            out.append((f, n, own[-1][2], same, "same-file"))
        elif near:
            out.append((f, n, near[0][2], 0.9, "import-resolved"))
        elif every:
            out.append((f, n, every[0][2], 0.5 if len(every) == 1 else 0.3, "fuzzy-global"))
        else:
            out.append((f, n, None, None, None))
    return sorted(out, key=repr)


def test_call_tiers(spark):
    symbols = [("a.py", "f", "a1", 0), ("a.py", "f", "a2", 1), ("b.py", "g", "b1", 2), ("c.py", "g", "c1", 3), ("d.py", "h", "d1", 4), ("b.py", "k", "b2", 5), ("c.py", "k", "c2", 6)]
    refs = [("a.py", "f"), ("a.py", "g"), ("a.py", "h"), ("a.py", "k"), ("a.py", "none"), ("b.py", "g"), ("z.py", "g")]
    imports = [("a.py", "c.py"), ("a.py", "b.py")]
    s = spark.createDataFrame(symbols, SYMBOLS)
    got = resolve.resolve(spark.createDataFrame(refs, "file_path string, name string"), s, spark.createDataFrame(imports, "file_path string, imported_path string"))
    assert rows_of(got) == model_resolve(refs, symbols, set(imports), 0.85)
    calls = spark.createDataFrame([(f, n, "src", 0) for f, n in refs], "file_path string, called_name string, source_id string, ord long")
    noise = spark.createDataFrame([("h",)], "name string")
    edges, counts = resolve.call_edges(calls, s, spark.createDataFrame(imports, "file_path string, imported_path string"), noise)
    assert tuple(counts.first()) == (5, 1, 1) and edges.count() == 5


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), min_size=1, max_size=12), st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=5))
def test_resolution_model(spark, pairs, imports):
    symbols = [(f, n, f"{f}{n}{k}", k) for k, (f, n) in enumerate(pairs)]
    refs = list(itertools.product("abc", "xyzw"))
    got = resolve.resolve(spark.createDataFrame(refs, "file_path string, name string"), spark.createDataFrame(symbols, SYMBOLS),
                          spark.createDataFrame(sorted(imports), "file_path string, imported_path string"), 0.95)
    assert rows_of(got) == model_resolve(refs, symbols, imports, 0.95)


def imports_of(spark, raws, files, **config):
    rows = spark.createDataFrame(raws, "file_path string, raw_import_path string, language string")
    got = resolve.resolve_imports(rows, spark.createDataFrame([(f,) for f in files], "path string"), resolve.Config(**config))
    return {tuple(r) for r in got.collect()}


def test_imports_relative_and_suffix(spark):
    files = ["src/a.ts", "src/util.ts", "src/lib/index.ts", "src/Comp.tsx", "pkg/mod.py", "pkg/sub/__init__.py", "other/util.ts"]
    raws = [("src/a.ts", "./util", "typescript"), ("src/a.ts", "./lib", "typescript"), ("src/lib/index.ts", "../Comp", "typescript"), ("src/a.ts", "./missing", "typescript"),
            ("pkg/mod.py", "pkg.sub", "python"), ("src/a.ts", "deep/other/util", "typescript"), ("src/a.ts", "COMP", "typescript"), ("src/a.ts", "react", "typescript")]
    assert imports_of(spark, raws, files) == {
        ("src/a.ts", "src/util.ts"), ("src/a.ts", "src/lib/index.ts"), ("src/lib/index.ts", "src/Comp.tsx"), ("pkg/mod.py", "pkg/sub/__init__.py"), ("src/a.ts", "other/util.ts"), ("src/a.ts", "src/Comp.tsx")}


def test_imports_by_language(spark):
    files = ["src/main/java/com/x/A.java", "src/main/java/com/x/B.java", "src/main/java/com/x/sub/C.java", "k/com/y/D.kt", "repo/internal/auth/a.go", "repo/internal/auth/a_test.go", "repo/internal/auth/b.go",
             "app/Models/User.php", "Sources/Core/X.swift", "Sources/Core/in/Y.swift", "src/foo/bar.rs", "src/foo/mod.rs", "src/lib.rs", "web/src/comp/Btn.ts"]
    raws = [("m.java", "com.x.*", "java"), ("n.java", "com.x.A.helper", "java"), ("o.kt", "com.y.*", "kotlin"), ("p.kt", "com.x.*", "kotlin"), ("q.go", "github.com/u/r/internal/auth", "go"),
            ("r.php", "App\\Models\\User", "php"), ("s.swift", "Core", "swift"), ("t.swift", "Foundation", "swift"), ("src/lib.rs", "crate::foo::bar", "rust"), ("src/foo/bar.rs", "super::foo::Thing", "rust"),
            ("w.ts", "@/comp/Btn", "typescript"), ("src/foo/x.rs", "self::bar", "rust")]
    got = imports_of(spark, raws, files, go_module="github.com/u/r", psr4=(("App", "app"),), swift_targets=(("Core", "Sources/Core"),), aliases=(("@/", "web/src/"),))
    assert got == {
        ("m.java", "src/main/java/com/x/A.java"), ("m.java", "src/main/java/com/x/B.java"), ("n.java", "src/main/java/com/x/A.java"), ("o.kt", "k/com/y/D.kt"),
        ("p.kt", "src/main/java/com/x/A.java"), ("p.kt", "src/main/java/com/x/B.java"), ("q.go", "repo/internal/auth/a.go"), ("q.go", "repo/internal/auth/b.go"), ("r.php", "app/Models/User.php"),
        ("s.swift", "Sources/Core/X.swift"), ("s.swift", "Sources/Core/in/Y.swift"), ("src/lib.rs", "src/foo/bar.rs"), ("src/foo/bar.rs", "src/foo/mod.rs"), ("w.ts", "web/src/comp/Btn.ts"), ("src/foo/x.rs", "src/foo/bar.rs")}


def test_routes_and_open_heritage(spark):
    symbols = spark.createDataFrame([("c1.php", "UserController", "C1", 0), ("c2.php", "UserController", "C2", 1), ("c2.php", "index", "M2", 2), ("p.php", "Base", "B", 3)], SYMBOLS)
    imports = spark.createDataFrame([("r.php", "c2.php")], "file_path string, imported_path string")
    routes = spark.createDataFrame([("r.php", "UserController", "index"), ("x.php", "UserController", "show"), ("r.php", None, "a"), ("r.php", "Nope", "a")], "file_path string, controller_name string, method_name string")
    got = {(r["src"], r["dst"], round(r["confidence"], 4)) for r in resolve.route_edges(routes, symbols, imports).collect()}
    assert got == {("File:r.php", "M2", 0.9), ("File:x.php", "Method:c1.php:show", 0.4)}
    heritage = spark.createDataFrame([("p.php", "Base", "Base", "extends"), ("q.php", "Kid", "Base", "extends"), ("q.php", "Kid", "Jsonable", "implements")], "file_path string, class_name string, parent_name string, kind string")
    assert {(r["src"], r["dst"], r["type"]) for r in resolve.heritage_edges_open(heritage, symbols).collect()} == {("Class:q.php:Kid", "B", "EXTENDS"), ("Class:q.php:Kid", "Interface:Jsonable", "IMPLEMENTS")}


# --- graph -----------------------------------------------------------------------------------------

EDGES = "src string, dst string, confidence double, type string"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=14), st.sampled_from(["upstream", "downstream", "both"]))
def test_reach_model(spark, pairs, way):
    e = spark.createDataFrame([(a, b, 0.9, "CALLS") for a, b in sorted(pairs)], EDGES)
    got = dict(map(tuple, graph.reach(e, spark.createDataFrame([("a",)], "node string"), 3, way).collect()))
    seen, front, want = {"a"}, {"a"}, {}
    for d in range(1, 4):
        step = {x for s, t in pairs for x in ([s] if way != "downstream" and t in front else []) + ([t] if way != "upstream" and s in front else [])} - seen
        want |= dict.fromkeys(step, d)
        seen |= step
        front = step
    assert got == want


def test_blocked_nodes_stop_reach(spark):
    e = spark.createDataFrame([("b", "a", 0.9, "CALLS"), ("c", "b", 0.2, "CALLS"), ("d", "b", None, "CALLS"), ("e", "d", 0.9, "CALLS")], EDGES)
    start, blocked = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("d",)], "node string")
    assert rows_of(graph.reach(e, start, 3, "upstream", 0.5)) == [("b", 1), ("d", 2), ("e", 3)]
    assert rows_of(graph.reach(e, start, 3, "upstream", 0.5, blocked)) == [("b", 1)]


@pytest.mark.parametrize("numbers,want", [((30, 0, 0, 30), "CRITICAL"), ((0, 5, 0, 1), "CRITICAL"), ((15, 0, 0, 15), "HIGH"), ((1, 0, 3, 1), "HIGH"), ((5, 0, 0, 5), "MEDIUM"), ((1, 0, 0, 30), "MEDIUM"), ((1, 1, 1, 1), "LOW")])
def test_risk(spark, numbers, want):
    assert spark.range(1).select(graph.risk(*[F.lit(n) for n in numbers])).first()[0] == want


# --- entry points, flows, traces -------------------------------------------------------------------


@pytest.mark.parametrize("name,language,callers,callees,exported,path,want", [
    ("handleLogin", "typescript", 1, 3, True, "src/pages/index.tsx", 13.5), ("getUser", "typescript", 0, 2, True, "src/api/users.ts", 1.2), ("handleLogin", "typescript", 3, 0, True, "src/pages/index.tsx", 0),
    ("handleLogin", "typescript", 0, 1, True, "src/app/page.tsx", 9.0), ("app", "python", 0, 1, False, "", 1.5), ("run", "python", 1, 4, None, None, 3.0)])
def test_entry_scores(spark, name, language, callers, callees, exported, path, want):
    df = spark.createDataFrame([(name, language, callers, callees, exported, path)], "n string, l string, a long, b long, e boolean, p string")
    got = df.select(flows.entry_score(*[F.col(c) for c in "nlabep"]).alias("s")).first()["s"]
    assert got["score"] == pytest.approx(want)
    assert got["reasons"][0] == ("no-outgoing-calls" if callees == 0 else f"base:{callees / (callers + 1):.2f}")


def test_flows(spark):
    calls = spark.createDataFrame([("main", "work", 0.9, "CALLS"), ("work", "save", 0.9, "CALLS"), ("save", "main", 0.9, "CALLS"), ("main", "zed", 0.9, "CALLS")], EDGES)
    got = flows.bfs_flows(spark.createDataFrame([("main",)], "id string"), calls)
    assert [(r["node"], r["step"]) for r in got.orderBy("ord").collect()] == [("main", 0), ("work", 1), ("zed", 1), ("save", 2)]
    s = flows.flow_summary(got, spark.createDataFrame([("main", "c1"), ("save", "c2")], "node string, community string")).first()
    assert (s["terminal"], s["step_count"], s["nodes"], s["communities"]) == ("save", 3, 4, ["c1", "c2"])


def counted(spark, frame):
    """The frame, and an accumulator of how often its first row was worked out."""
    seen = spark.sparkContext.accumulator(0)
    first = frame.first()[0]

    def look(batches):
        for b in batches:
            seen.add(int((b.iloc[:, 0] == first).any()))
            yield b

    return frame.coalesce(1).mapInPandas(look, frame.schema), seen


def test_flows_of_many_entries(spark):
    """Levels have a row a node, block of entries and step, however many entries meet there; calls are worked out once."""
    ids = [f"n{k:03}" for k in range(300)]
    pairs = [(a, b, 0.9, "CALLS") for k, a in enumerate(ids) for b in (ids[(k + 1) % 300], ids[(k * 7 + 3) % 300])]
    calls, seen = counted(spark, spark.createDataFrame(pairs, EDGES))
    entries, groups = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame([(x, x[-1]) for x in ids if x != "n007"], "node string, community string")
    levels, _ = flows.bfs_levels(entries, calls)
    assert seen.value == 1 and levels.groupBy("block", "node", "step").count().where("count > 1").isEmpty()
    assert levels.count() <= 2 * 300 * (1 + levels.agg(F.max("step")).first()[0])
    want = flows.bfs_flows(entries, calls)
    assert seen.value == 2 and want.count() == 300 * 300
    assert rows_of(flows.bfs_steps(entries, calls)) == rows_of(want.select("entry", "node", "step"))
    columns = ["entry", "terminal", "step_count", "nodes", "communities"]
    assert rows_of(flows.level_summary(entries, calls, groups).select(columns)) == rows_of(flows.flow_summary(want, groups).select(columns))
    assert flows.bfs_steps(entries.limit(0), calls).isEmpty()


def model_traces(entry, out, depth=10, branches=4, most=12, least=3):
    queue, found = [[entry]], []
    while queue and len(found) < most:
        path = queue.pop(0)
        nexts = out.get(path[-1], [])
        if not nexts or len(path) >= depth:
            if len(path) >= least:
                found.append(path)
            continue
        grown = [[*path, n] for n in nexts[:branches] if n not in path]
        queue += grown
        if not grown and len(path) >= least:
            found.append(path)
    return found


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=18))
def test_traces_model(spark, pairs):
    out = {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    calls = spark.createDataFrame([(a, b, 0.9, "CALLS") for a, b in sorted(pairs)], "src long, dst long, confidence double, type string")
    got = flows.traces(spark.createDataFrame([(0,), (3,)], "id long"), calls, depth=5, most=6).orderBy("entry", "ord").collect()
    assert [(r["entry"], r["path"]) for r in got] == [(e, p) for e in (0, 3) for p in model_traces(e, out, 5, 4, 6)]


def test_trace_clean_up(spark):
    paths = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["b", "c"]), (4, ["a", "c"]), (5, ["a", "b", "c"]), (6, ["a", "x", "y", "c"]), (7, ["ab", "c"])], "key int, path array<string>")
    left = flows.drop_contained(paths)
    assert sorted(r["key"] for r in left.collect()) == [1, 4, 6, 7]
    assert sorted(r["key"] for r in flows.longest_per_ends(left).collect()) == [6, 7]
    assert [flows.process_limit(n) for n in (5, 500, 10_000)] == [20, 50, 300]
    names = spark.createDataFrame([("a", "alpha"), ("c", "Gamma!")], "id string, name string")
    groups = spark.createDataFrame([("a", "k1"), ("x", "k2")], "node string, community string")
    rows, steps = flows.processes(flows.longest(flows.longest_per_ends(left), 5), names, groups)
    first = rows.orderBy("id").first()
    assert (first["id"], first["label"], first["process_type"], first["step_count"]) == ("proc_0_alpha", "Alpha → Gamma!", "cross_community", 4)
    assert steps.where("process = 'proc_0_alpha'").orderBy("step").first()["step"] == 1


# --- communities -----------------------------------------------------------------------------------


def model_in_turn(near):
    label = {n: n for n in near}
    for _ in range(12):
        changed = False
        for n in sorted(near):
            votes = {}
            for o in near[n]:
                votes[label[o]] = votes.get(label[o], 0) + 1
            if not votes:
                continue
            best, weight = max(votes.items(), key=lambda i: (i[1], i[0] == label[n], i[0]))
            if weight > votes.get(label[n], 0) and best != label[n]:
                label[n], changed = best, True
        if not changed:
            break
    return label


def test_communities(spark):
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("f", "g"), ("e", "g"), ("g", "h"), ("h", "i"), ("i", "j"), ("h", "j")]
    nodes = spark.createDataFrame([(x, "Function", f"do_{x}Thing", f"src/part{x}/f.py") for x in "abcdefghijk"], "id string, label string, name string, file_path string")
    edges = spark.createDataFrame([(a, b, 0.9, "CALLS") for a, b in pairs], EDGES)
    adj = community.adjacency(nodes, edges)
    near = {x: set() for x in "abcdefghijk"}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    members = community.communities(adj, nodes.select(F.col("id").alias("node")))
    assert dict(map(tuple, members.collect())) == model_in_turn(near)
    whole = community.communities(adj, nodes.select(F.col("id").alias("node")), exact_nodes=1)
    assert whole.count() == 11
    d = community.describe(members, adj, nodes).orderBy("name").collect()
    assert d[0]["members"] == ["a", "b"] and d[0]["cohesion"] == 1.0 and d[0]["description"] == "Cluster of 2 related symbols" and "thing" in d[0]["keywords"]
    assert community.member_edges(community.describe(members, adj, nodes)).count() == 11
    share = {r["label"]: r["cohesion"] for r in community.inner_share(members, adj).collect()}
    assert all(0 <= v <= 1 for v in share.values())


def modularity(pairs, group):
    m2 = 2 * len(pairs)
    k = {v: sum(v in p for p in pairs) for v in group}
    same = sum(2 for a, b in pairs if group[a] == group[b]) / m2
    return same - sum(sum(k[v] for v in group if group[v] == g) ** 2 for g in set(group.values())) / m2**2


def every_partition(items):
    if not items:
        yield []
        return
    for rest in every_partition(items[1:]):
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]
        yield [[items[0]], *rest]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda p: p[0] < p[1]), min_size=3, max_size=14))
def test_leiden_comes_near_the_best_modularity(pairs):
    from weft.operators.leiden import leiden

    nodes = sorted({v for p in pairs for v in p})
    at = {v: k for k, v in enumerate(nodes)}
    near = [{} for _ in nodes]
    for a, b in pairs:
        near[at[a]][at[b]] = near[at[b]][at[a]] = 1.0
    got = leiden(near)
    group = {v: got[at[v]] for v in nodes}
    best = max(modularity(pairs, {v: k for k, part in enumerate(p) for v in part}) for p in every_partition(nodes))
    assert modularity(pairs, group) >= best - 0.12  # a local optimum
    for g in set(got):  # groups hang together
        own = {k for k, x in enumerate(got) if x == g}
        seen, todo = set(), [min(own)]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [u for u in near[k] if u in own]
        assert seen == own
    assert leiden(near) == got


def test_neighbours_are_worked_out_once(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)]
    rows = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "node long, other long")
    nodes = rows.select("node").distinct()
    for work in (community.propagate, community.components, lambda a, n: community.communities(a, n, exact_nodes=10), lambda a, n: community.communities(a, n, method="leiden")):
        adj, seen = counted(spark, rows)
        assert work(adj, nodes).count() == 44
        assert seen.value == 1


def test_leiden_on_tables(spark):
    ring = [(f"n{c}{i}", f"n{c}{j}") for c in range(4) for i in range(5) for j in range(i)] + [("n00", "n10"), ("n11", "n20"), ("n21", "n30")]
    rows = spark.createDataFrame([*ring, *[(b, a) for a, b in ring]], "node string, other string")
    nodes = rows.select("node").distinct().union(spark.createDataFrame([("alone",)], "node string"))
    got = {r["node"]: r["label"] for r in community.communities(rows, nodes, method="leiden").collect()}
    assert {n: f"n{n[1]}0" for n in got if n != "alone"} == {n: g for n, g in got.items() if n != "alone"} and got["alone"] == "alone"


def test_folder_labels(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2), ("f", 3)], "node string, label int")
    info = spark.createDataFrame([("a", "src/auth/x.py", "x"), ("b", "src/auth/y.py", "y"), ("c", "src/x.py", "userGet"), ("d", "lib/y.py", "userSet"), ("e", "z.py", "userX"), ("f", "f.py", "f")], "id string, file_path string, name string")
    assert {r["label"]: r["heuristic_label"] for r in community.folder_label(members, info).collect()} == {1: "Auth", 2: "User", 3: "Cluster_2"}


def test_aggregate_and_enrich(spark):
    rows = spark.createDataFrame([("c1", "Auth", 0.5, 4), ("c2", "Auth", 1.0, 6), ("c3", "Db", 0.2, 3)], "id string, label string, cohesion double, symbol_count int")
    r = community.aggregate_by_name(rows).collect()
    assert [(x["label"], x["id"], x["symbol_count"], x["sub_communities"]) for x in r] == [("Auth", "c2", 10, 2)] and r[0]["cohesion"] == pytest.approx(0.8)
    d = spark.createDataFrame([("c1", ["a", "b"], "Auth")], "id string, members array<string>, heuristic_label string")
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    assert community.enrich(d, names, lambda own: "+".join(own)).first()["enriched_label"] == "x+y"


# --- search ----------------------------------------------------------------------------------------


def test_scores_do_not_depend_on_the_order_of_their_parts(spark):
    """Copies of a text tie to the last bit and are ordered by id, however the parts of a sum arrive."""
    rows = [(k, v) for k in range(60) for v in ((0.3, 0.2, 0.1) if k % 2 == 0 else (0.1, 0.2, 0.3))]  # 0.6 and 0.6000000000000001 as doubles
    files = spark.createDataFrame(rows, "file_path long, score double").coalesce(1)
    got = search.merge_tables(files, 60).orderBy("rank").collect()
    assert [r["file_path"] for r in got] == list(range(60)) and len({r["score"] for r in got}) == 1
    text = "lytic lytion lytia lytin lytio lytiq thatt thats that"
    docs = spark.createDataFrame([(k, text) for k in range(40)] + [(99, "other words here")], "id long, text string").repartition(7)
    found = search.field_search({"text": (search.Bm25.build(docs), 1.0)}, "lyti thatt", 40).orderBy("rank").collect()
    assert [r["id"] for r in found] == list(range(40)) and len({r["score"] for r in found}) == 1



def test_rrf_goldens(spark):
    bm = spark.createDataFrame([("A", 9.0, 1), ("B", 8.0, 2)], "id string, score double, rank int")
    se = spark.createDataFrame([("B", 0.9, 1), ("C", 0.8, 2)], "id string, score double, rank int")
    got = search.rrf({"bm25": (bm, 0.4), "semantic": (se, 0.6)}).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["B", "C", "A"]
    assert [r["score"] for r in got] == pytest.approx([0.4 / 62 + 0.6 / 61, 0.6 / 62, 0.4 / 61])
    assert got[0]["sources"] == "bm25,semantic" and got[1]["bm25_rank"] is None and got[1]["bm25_score"] == 0.0
    tie = search.rrf({"a": (spark.createDataFrame([("z", 1.0, 1)], "id string, score double, rank int"), 0.5), "b": (spark.createDataFrame([("y", 1.0, 1)], "id string, score double, rank int"), 0.5)}, k=0)
    assert [(r["id"], r["score"]) for r in tie.orderBy("rank").collect()] == [("y", 0.5), ("z", 0.5)]


def test_bm25(spark):
    import math

    docs = {1: "the cat sat", 2: "the cat cat", 3: "dogs running", 4: None}
    index = search.Bm25.build(spark.createDataFrame(list(docs.items()), "id long, text string"))
    assert index.size == (4, 2.0)
    got = {r["id"]: r["score"] for r in index.search("cat sat").collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert got == pytest.approx({1: idf(2) * part(1, 3) + idf(1) * part(1, 3), 2: idf(2) * part(2, 3)})
    assert [r["id"] for r in index.search("cat sat", conjunctive=True).collect()] == [1]
    assert index.search("  ").count() == 0 and index.search("cat", 0).count() == 0
    stems = search.Bm25.build(spark.createDataFrame(list(docs.items()), "id long, text string"), porter=True)
    assert [r["id"] for r in stems.search("dog runs").collect()] == [3]
    assert {r["term"] for r in index.expand("ca dogz", 0.25).collect()} == {"cat", "dogs"}


def test_grep_read_rename(spark):
    files = spark.createDataFrame([("src/a.py", "def foo():\n  foo_bar()\n  foo()"), ("src/b.py", "x = Foo()\nfoo(1); foo(2)"), ("lib/c.txt", "food"), ("d.py", None)], "path string, content string")
    assert rows_of(search.grep(files, r"foo\(")) == [("src/a.py", 1, "def foo():"), ("src/a.py", 3, "foo()"), ("src/b.py", 1, "x = Foo()"), ("src/b.py", 2, "foo(1); foo(2)")]
    assert search.grep(files, "foo", "LIB/", limit=1).first()["path"] == "lib/c.txt"
    assert search.read_file(files, "b.py").first()["path"] == "src/b.py" and search.read_file(files, "zzz").count() == 0
    plan = search.rename_plan(files, "foo", "b$r", ("src/a.py", 1), spark.createDataFrame([("src/b.py",)], "path string"))
    assert rows_of(plan) == [("src/a.py", 1, "def foo():", "def b$r():", "graph"), ("src/b.py", 2, "foo(1); foo(2)", "b$r(1); b$r(2)", "graph")]
    assert {r["content"] for r in search.apply_rename(files, plan, "foo", "bar").collect()} == {"def bar():\n  foo_bar()\n  bar()", "x = Foo()\nbar(1); bar(2)"}


def test_process_groups(spark):
    hits = spark.createDataFrame([("a", 0.03), ("b", 0.02), ("c", 0.01)], "id string, score double")
    steps = spark.createDataFrame([("a", "p1", 1), ("b", "p1", 2), ("a", "p2", 1)], "id string, process string, step int")
    groups = spark.createDataFrame([("a", 0.5)], "id string, cohesion double")
    p, s, d = search.process_groups(hits, steps, groups)
    assert rows_of(p) == [("p1", 0.1, 2), ("p2", 0.08, 1)]
    assert rows_of(s) == [("p1", "a", 0.03, 1), ("p1", "b", 0.02, 2)] and rows_of(d) == [("c", 0.01)]


# --- changes ---------------------------------------------------------------------------------------


def test_changes(spark):
    nodes = spark.createDataFrame([("n1", "f", "Function", "repo/src/a.ts"), ("n2", "g", "Function", "src/a.ts"), ("n3", "h", "Function", "src/xa.ts")], "id string, name string, label string, file_path string")
    files = spark.createDataFrame([("src\\a.ts",)], "path string")
    assert sorted(r["id"] for r in changes.changed_symbols(nodes, files).collect()) == ["n1", "n2"]
    steps = spark.createDataFrame([("n1", "p", 1), ("n2", "q", 1)], "id string, process string, step int")
    assert tuple(changes.change_summary(nodes, files, steps).first()) == (2, 2, 1, "medium")
    assert changes.change_summary(nodes, files.limit(0), steps).first()["risk_level"] == "none"


def test_upsert_delete_and_budget(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert rows_of(changes.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string"))) == [(1, "x"), (2, "z"), (3, "w")]
    f = spark.createDataFrame([("r", k, s) for k, s in enumerate([5, 5, 20, 1, 9, 1])], "repo string, ord long, size long")
    assert [r["chunk"] for r in changes.chunk_by_budget(f, 10).orderBy("ord").collect()] == [0, 0, 1, 2, 2, 3]


def test_budget_of_a_large_repository(spark):
    """The time of a fold grows with its rows, not with their square; odd sizes and repositories as in a small one."""
    import time

    f = spark.range(60_000).select(F.lit("r").alias("repo"), (59_999 - F.col("id")).alias("ord"), (F.col("id") % 50 + 1).alias("size"))
    begin = time.monotonic()
    got = [r["chunk"] for r in changes.chunk_by_budget(f, 200).orderBy("ord").collect()]
    assert time.monotonic() - begin < 20
    chunk, filled, want = 0, 0, []
    for size in ((59_999 - k) % 50 + 1 for k in range(60_000)):
        chunk, filled = (chunk + 1, size) if filled > 0 and filled + size > 200 else (chunk, filled + size)
        want.append(chunk)
    assert got == want
    odd = spark.createDataFrame([(None, 1, 7), (None, 2, 7), ("a", 1, 7), ("a", 2, None), ("a", 3, 20), ("b", None, 7), ("b", 1, 7)], "repo string, ord long, size long")
    assert rows_of(changes.chunk_by_budget(odd, 10)) == sorted([(None, 1, 0), (None, 2, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("b", None, 1), ("b", 1, 0)], key=repr)


def test_run_metrics(spark):
    rows = spark.createDataFrame([("m_baseline", "i1", "diff", 1.0, 10, None, None, None), ("m_baseline", "i2", " ", None, None, None, None, None), ("m_native", "i1", "d", 3.0, 4, 2, 1, 2)],
                                 "run_id string, instance_id string, patch string, cost double, api_calls long, tool_calls long, augment_hits long, augment_calls long")
    m = changes.run_metrics(rows)
    got = {r["run_id"]: r for r in m.collect()}
    assert got["m_baseline"]["patch_rate"] == 0.5 and got["m_baseline"]["avg_cost"] == 0.5 and got["m_native"]["augment_hit_rate"] == 0.5
    d = {r["mode"]: r for r in changes.mode_deltas(m).collect()}
    assert d["native"]["patch_rate_delta"] == 0.5 and d["native"]["cost_delta_pct"] == 500.0
    assert tuple(changes.mode_table(m, ("baseline", "native")).first()) == ("m", 0.5, 1.0)


def test_relations_both_ways_read_the_edges_once(spark):
    """Either direction of a relation comes from one reading of the edges; a self loop counts once."""
    from weft.cypher import compile_query

    sql = compile_query("MATCH (n)-[r:CALLS]-(m) WITH n, COUNT(r) AS c RETURN n.id AS id, c")
    assert sql.count("gedges") == 1
    spark.createDataFrame([("a",), ("b",), ("c",)], "id string").createOrReplaceTempView("gnodes")
    edges = [("a", "b", "CALLS"), ("b", "b", "CALLS"), ("c", "a", "CALLS"), ("a", "gone", "CALLS"), (None, "a", "CALLS"), ("a", "c", "IMPORTS")]
    spark.createDataFrame(edges, "src string, dst string, type string").createOrReplaceTempView("gedges")
    assert rows_of(spark.sql(sql)) == [("a", 2), ("b", 2), ("c", 1)]
