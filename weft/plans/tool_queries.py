"""Catalogue: graph queries in MATCH form and composed tools over the analogue graph as nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.graph import KnowledgeGraph
from weft.operators import changes, community, flows, graph, search

from .analogue import CALLS, SYMBOLS, calls, folders, steps, symbols, t

FILES = ("Brand#1/ECONOMY", "Brand#2/PROMO")


def knowledge(s, d) -> KnowledgeGraph:
    """Parts as symbols, brands as communities, users as processes whose steps are parts."""
    sy, st = symbols(s, d), _steps(s, d)
    part = lambda c: F.concat(F.lit("P"), c.cast("string"))
    nodes = sy.select(part(F.col("id")).alias("id"), "label", "name", "file_path", "is_exported", F.col("ord").cast("int").alias("start_line"))
    brands = sy.groupBy("community").agg(F.count("*").cast("int").alias("symbol_count"))
    users = st.groupBy("process").agg(F.count("*").cast("int").alias("step_count"))
    nodes = nodes.unionByName(brands.select(F.col("community").alias("id"), F.lit("Community").alias("label"), F.col("community").alias("name")), allowMissingColumns=True)
    nodes = nodes.unionByName(users.select(F.concat(F.lit("U"), "process").alias("id"), F.lit("Process").alias("label"), F.concat(F.lit("user "), "process").alias("name")), allowMissingColumns=True)
    e = calls(s, d).select(part(F.col("src")).alias("src"), part(F.col("dst")).alias("dst"), F.lit("CALLS").alias("type"), "confidence")
    e = e.unionByName(sy.select(part(F.col("id")).alias("src"), F.col("community").alias("dst"), F.lit("MEMBER_OF").alias("type"), F.lit(0.95).alias("confidence")), allowMissingColumns=True)
    e = e.unionByName(st.select(part(F.col("node")).alias("src"), F.concat(F.lit("U"), "process").alias("dst"), F.lit("STEP_IN_PROCESS").alias("type"), F.lit(1.0).alias("confidence"), F.col("step").cast("int").alias("step")), allowMissingColumns=True)
    groups = brands.select(F.col("community").alias("id"), F.col("community").alias("name"), F.col("community").alias("heuristic_label"), (F.col("symbol_count") % 10 / 10).alias("cohesion"), "symbol_count", F.array().cast("array<string>").alias("keywords"))
    runs = users.select(F.concat(F.lit("U"), "process").alias("id"), F.concat(F.lit("user "), "process").alias("label"), F.lit("trace").alias("process_type"), "step_count", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("terminal"))
    return KnowledgeGraph(nodes, e, groups, runs)


def _steps(s, d):
    """A user's events as steps through parts: the part with the event's number, around the table."""
    n = t(s, d, "part").agg(F.count("*").alias("_n"))
    return steps(s, d).crossJoin(n).select("process", (F.col("event_id") % F.col("_n")).alias("node"), "step")  # a one-row aggregate


_ST = "sp AS (SELECT user_id AS process, event_id % (SELECT count(*) FROM part) AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"
_NE = "ne AS (SELECT id, other FROM (SELECT src AS id, dst AS other FROM ce UNION ALL SELECT dst, src FROM ce))"


def _cypher(query, **args):
    return lambda s, d: knowledge(s, d).cypher(query, **args)


def _split(s, d):
    g = knowledge(s, d)
    a = g.nodes.select(F.col("id").alias("src"), F.col("label").alias("from_label"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("to_label"))
    return g.edges.join(a, "src").join(b, "dst").groupBy("from_label", "to_label", "type").agg(F.count("*").alias("n"))


def _folder_list(s, d):
    return graph.folder_tree(folders(s, d)).select("folder").orderBy("folder").limit(50)


def _hops(s, d):
    """First, second and third callers of a part, with at most 300, 200 and 100 rows, and how sure they are."""
    e = calls(s, d).where("confidence >= 0.5")
    near = lambda front, most: e.join(front.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("confidence").alias("confidence")).orderBy("id").limit(most)
    one = near(s.createDataFrame([(7,)], "id long"), 300)
    two = near(one, 200)
    three = near(two, 100)
    rows = one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2))).unionByName(three.withColumn("depth", F.lit(3)))
    return rows.groupBy("depth").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("sure"), F.count_if((F.col("confidence") >= 0.8) & (F.col("confidence") < 0.9)).alias("likely"))


_HOP = "SELECT src AS id, max(confidence) AS confidence FROM ce WHERE confidence >= 0.5 AND dst IN (SELECT id FROM {f}) GROUP BY src ORDER BY src LIMIT {n}"


def _connections(s, d):
    hits = symbols(s, d).where("name = 'red bolt' or name = 'small ring'").select("id")
    return search.neighbours_of(calls(s, d), symbols(s, d).select("id", "name"), hits).na.fill("", ["callers", "callees"])


def _side(a, b, out):
    return f"{out} AS (SELECT {a} AS id, string_agg(name, ', ' ORDER BY name) AS {out} FROM (SELECT {a}, name FROM ce JOIN sy ON sy.id = {b} WHERE {a} IN (SELECT id FROM h) QUALIFY row_number() OVER (PARTITION BY {a} ORDER BY name, {b}) <= 3) GROUP BY 1)"


def _through(s, d):
    out = knowledge(s, d).flows_through(list(FILES), 5)
    return out.select("process", "step_count", F.size("trace").cast("long").alias("steps"), F.transform("trace", lambda x: x["name"])[0].alias("first"))


def _affected(s, d):
    hit = graph.reach(calls(s, d), s.createDataFrame([(7,)], "node long"), depth=2)
    rows = hit.join(_steps(s, d), "node").groupBy("process").agg(F.countDistinct("node").alias("hits"), F.min("step").alias("broken_at_step"))
    return rows.orderBy(F.desc("hits"), "process").limit(20)


def _clusters(s, d):
    return knowledge(s, d).clusters(10).select("id", "label", "symbol_count", F.round("cohesion", 6).alias("cohesion"), "sub_communities")


def _stats(s, d):
    kind = _steps(s, d).join(symbols(s, d).select(F.col("id").alias("node"), "community"), "node").groupBy("process").agg(F.countDistinct("community").alias("c"), F.count("*").alias("step_count"))
    return flows.process_stats(kind.withColumn("process_type", F.when(F.col("c") > 1, "cross_community").otherwise("intra_community")))


def _pruned(s, d):
    return community.prune_large(calls(s, d), 10_001).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("callers"))


def _file_changes(s, d):
    nodes = symbols(s, d)
    return changes.changed_symbols(nodes, s.createDataFrame([(f,) for f in FILES], "path string")).select("path", "id", "name")


QUERIES = {
    "cypher_calls_of_functions": (_cypher("MATCH (a:Function)-[r:CodeRelation {type: 'CALLS'}]->(b:Class) WHERE r.confidence >= $least AND b.isExported = true RETURN a.id AS caller, b.id AS callee, b.name AS name", least=0.9),
        f"WITH {CALLS}, {SYMBOLS} SELECT 'P' || a.id AS caller, 'P' || b.id AS callee, b.name AS name FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.label = 'Function' AND b.label = 'Class' AND confidence >= 0.9 AND b.is_exported"),
    "cypher_hotspots": (_cypher("MATCH (n)-[r:CodeRelation]-(m) WHERE r.type = 'CALLS' WITH n, COUNT(r) AS connections ORDER BY connections DESC, n.id LIMIT 8 RETURN n.id AS id, n.name AS name, labels(n)[0] AS type, connections"),
        f"WITH {CALLS}, {SYMBOLS}, {_NE} SELECT 'P' || ne.id AS id, name, label AS type, count(*) AS connections FROM ne JOIN sy USING (id) GROUP BY ne.id, name, label ORDER BY connections DESC, 'P' || ne.id LIMIT 8"),
    "cypher_optional_match": (_cypher("MATCH (n:Class) OPTIONAL MATCH (m:Method)-[r:CALLS]->(n) WHERE r.confidence >= 0.5 RETURN n.id AS id, COUNT(DISTINCT m.id) AS methods, MIN(m.name) AS first"),
        f"WITH {CALLS}, {SYMBOLS} SELECT 'P' || n.id AS id, count(DISTINCT m.id) AS methods, min(m.name) AS first FROM sy n LEFT JOIN (SELECT sy.id, name, dst FROM ce JOIN sy ON sy.id = src WHERE label = 'Method' AND confidence >= 0.5) m ON m.dst = n.id WHERE n.label = 'Class' GROUP BY n.id"),
    "cypher_two_hops": (_cypher("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) WHERE a.id = 'P7' AND a.id <> c.id AND NOT c.name IN ['red bolt', 'small ring'] RETURN DISTINCT c.id AS id, c.name AS name"),
        f"WITH {CALLS}, {SYMBOLS} SELECT DISTINCT 'P' || c.id AS id, c.name FROM ce x JOIN ce y ON x.dst = y.src JOIN sy c ON c.id = y.dst WHERE x.src = 7 AND y.dst <> 7 AND c.name NOT IN ('red bolt', 'small ring')"),
    "cypher_cluster_dependencies": (_cypher("MATCH (a)-[:CALLS]->(b), (a)-[:MEMBER_OF]->(c1:Community), (b)-[:MEMBER_OF]->(c2:Community) WHERE c1.id <> c2.id RETURN c1.label AS source, c2.label AS target, COUNT(*) AS calls ORDER BY calls DESC, source, target LIMIT 15"),
        f"WITH {CALLS}, {SYMBOLS} SELECT a.community AS source, b.community AS target, count(*) AS calls FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL ORDER BY calls DESC, source, target LIMIT 15"),
    "cypher_process_hits": (_cypher("MATCH (s)-[r:CodeRelation {type: 'STEP_IN_PROCESS'}]->(p:Process) WHERE s.name CONTAINS 'red' RETURN p.heuristicLabel AS name, COUNT(DISTINCT s.id) AS hits, MIN(r.step) AS minStep, p.stepCount AS stepCount ORDER BY hits DESC, name LIMIT 20"),
        f"WITH {SYMBOLS}, {_ST}, z AS (SELECT process, CAST(count(*) AS INTEGER) AS n FROM sp GROUP BY 1) SELECT 'user ' || process AS name, count(DISTINCT node) AS hits, CAST(min(step) AS INTEGER) AS minStep, any_value(n) AS stepCount FROM sp JOIN sy ON sy.id = node JOIN z USING (process) WHERE contains(name, 'red') GROUP BY process ORDER BY hits DESC, 'user ' || process LIMIT 20"),
    "relation_split_counts": (_split, f"""WITH {CALLS}, {SYMBOLS}, {_ST} SELECT a.label AS from_label, b.label AS to_label, 'CALLS' AS type, count(*) AS n FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst GROUP BY ALL
UNION ALL SELECT label, 'Community', 'MEMBER_OF', count(*) FROM sy GROUP BY label UNION ALL SELECT label, 'Process', 'STEP_IN_PROCESS', count(*) FROM sp JOIN sy ON sy.id = node GROUP BY label"""),
    "folder_list_top50": (_folder_list, "SELECT DISTINCT unnest([r_name, r_name || '/' || n_name]) AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY folder LIMIT 50"),
    "impact_hops_by_confidence": (_hops, f"""WITH {CALLS}, z AS (SELECT 7 AS id), a AS ({_HOP.format(f='z', n=300)}), b AS ({_HOP.format(f='a', n=200)}), c AS ({_HOP.format(f='b', n=100)}),
r AS (SELECT 1 AS depth, confidence FROM a UNION ALL SELECT 2, confidence FROM b UNION ALL SELECT 3, confidence FROM c) SELECT depth, count(*) AS n, count(*) FILTER (confidence >= 0.9) AS sure, count(*) FILTER (confidence >= 0.8 AND confidence < 0.9) AS likely FROM r GROUP BY depth"""),
    "search_connections": (_connections, f"WITH {CALLS}, {SYMBOLS}, h AS (SELECT id FROM sy WHERE name IN ('red bolt', 'small ring')), {_side('dst', 'src', 'callers')}, {_side('src', 'dst', 'callees')} SELECT id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM h LEFT JOIN callers USING (id) LEFT JOIN callees USING (id)"),
    "processes_through_files": (_through, f"""WITH {SYMBOLS}, {_ST}, z AS (SELECT process, count(*) AS n FROM sp GROUP BY 1), k AS (SELECT DISTINCT process FROM sp JOIN sy ON sy.id = node WHERE file_path IN {FILES})
SELECT 'U' || process AS process, CAST(n AS INTEGER) AS step_count, n AS steps, (SELECT name FROM sp JOIN sy ON sy.id = node WHERE sp.process = k.process AND step = 1) AS first FROM k JOIN z USING (process) ORDER BY n DESC, 'U' || process LIMIT 5"""),
    "affected_processes_top20": (_affected, f"""WITH {CALLS}, {_ST}, a AS (SELECT DISTINCT src AS node FROM ce WHERE dst = 7), b AS (SELECT node FROM a UNION SELECT src FROM ce JOIN a ON ce.dst = a.node)
SELECT process, count(DISTINCT node) AS hits, min(step) AS broken_at_step FROM sp JOIN (SELECT node FROM b WHERE node <> 7) USING (node) GROUP BY process ORDER BY hits DESC, process LIMIT 20"""),
    "cluster_list": (_clusters, f"WITH {SYMBOLS} SELECT community AS id, community AS label, count(*) AS symbol_count, round((count(*) % 10) / 10, 6) AS cohesion, CAST(1 AS BIGINT) AS sub_communities FROM sy GROUP BY community HAVING count(*) >= 5 ORDER BY symbol_count DESC, label LIMIT 10"),
    "process_stats": (_stats, f"WITH {SYMBOLS}, {_ST}, p AS (SELECT process, count(*) AS n, count(DISTINCT community) AS c FROM sp JOIN sy ON sy.id = node GROUP BY 1) SELECT count(*) AS processes, count(*) FILTER (c > 1) AS cross_community, round(avg(n), 1) AS avg_steps FROM p"),
    "large_graph_pruning": (_pruned, f"WITH {CALLS}, k AS (SELECT * FROM ce WHERE confidence >= 0.5), g AS (SELECT node FROM (SELECT src AS node FROM k UNION ALL SELECT dst FROM k) GROUP BY node HAVING count(*) >= 2) SELECT count(*) AS edges, count(DISTINCT src) AS callers FROM k WHERE src IN (SELECT node FROM g) AND dst IN (SELECT node FROM g)"),
    "changed_symbols": (_file_changes, f"WITH {SYMBOLS} SELECT file_path AS path, id, name FROM sy WHERE file_path IN {FILES} QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY id) <= 20"),
}
