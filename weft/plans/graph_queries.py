"""Catalogue: traversal, structure and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph as g

from .analogue import CALLS, FOLDERS, STEPS, SYMBOLS, calls, folders, steps, symbols, t

TARGET = 7


def _start(spark):
    return spark.createDataFrame([(TARGET,)], "node long")


def _group(s, d):
    return symbols(s, d).select(F.col("id").alias("node"), F.col("community").alias("grp"))


def _impact(s, d, **kw):
    return g.reach(calls(s, d), _start(s), depth=3, **kw)


def _typed(s, d):
    """All relations of the analogue with their types: order -> part CALLS, part -> supplier IMPORTS, customer -> order DEFINES."""
    li, o = t(s, d, "lineitem"), t(s, d, "orders")
    return (li.select(F.concat(F.lit("Order:"), "l_orderkey").alias("src"), F.concat(F.lit("Part:"), "l_partkey").alias("dst"), F.lit("CALLS").alias("type")).distinct()
            .union(li.select(F.concat(F.lit("Part:"), "l_partkey"), F.concat(F.lit("Supplier:"), "l_suppkey"), F.lit("IMPORTS")).distinct())
            .union(o.select(F.concat(F.lit("Customer:"), "o_custkey"), F.concat(F.lit("Order:"), "o_orderkey"), F.lit("DEFINES")).distinct()))


TYPED = """te AS (SELECT DISTINCT 'Order:' || l_orderkey AS src, 'Part:' || l_partkey AS dst, 'CALLS' AS type FROM lineitem
  UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'Supplier:' || l_suppkey, 'IMPORTS' FROM lineitem
  UNION ALL SELECT DISTINCT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'DEFINES' FROM orders)"""


def _nodes(s, d):
    rows = [("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"),
            ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey")]
    out = None
    for label, name, key in rows:
        one = t(s, d, name).select(F.concat(F.lit(f"{label}:"), F.col(key)).alias("id"), F.lit(label).alias("label"))
        out = one if out is None else out.union(one)
    return out


def _prefixed(edge):
    return f"""up(node, depth) AS (SELECT CAST({TARGET} AS BIGINT), 0 UNION
  SELECT {edge}, up.depth + 1 FROM up JOIN ce ON {"ce.dst" if edge == "ce.src" else "ce.src"} = up.node WHERE up.depth < 3)"""


_UP = f"WITH RECURSIVE {CALLS}, {_prefixed('ce.src')}, im AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node HAVING min(depth) > 0)"
_DOWN = f"WITH RECURSIVE {CALLS}, {_prefixed('ce.dst')}, im AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node HAVING min(depth) > 0)"
_UND = "un AS (SELECT DISTINCT src AS node, dst AS other FROM (SELECT src, dst FROM ce UNION ALL SELECT dst, src FROM ce) WHERE src <> dst)"


def _risk(s, d):
    hit = _impact(s, d)
    procs = steps(s, d).select((F.col("event_id") % 997).alias("node"), "process")
    return g.impact_summary(hit, _group(s, d).withColumnRenamed("grp", "community"), procs)


def _confident(s, d):
    return _impact(s, d, min_confidence=0.9, direction="downstream", blocked=symbols(s, d).where("name like '%bolt%'").select(F.col("id").alias("node")))


def _optional(s, d):
    c = calls(s, d)
    i = c.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.max("confidence").alias("best_in"))
    o = c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return symbols(s, d).select("id", "label").join(i, "id", "left").join(o, "id", "left").select(
        "id", "label", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), "best_in")


def _cluster(s, d):
    b = g.between(calls(s, d), _group(s, d)).where("g_src = g_dst").groupBy(F.col("g_src").alias("name")).agg(F.count("*").alias("inner"))
    sub = symbols(s, d).groupBy(F.col("community").alias("name"), "file_path").agg(F.count("*").alias("symbols"), F.avg(F.length("name")).alias("cohesion"))
    agg = sub.groupBy("name").agg(F.sum("symbols").alias("symbols"), (F.sum(F.col("cohesion") * F.col("symbols")) / F.sum("symbols")).alias("cohesion"),
                                  F.max_by("file_path", F.struct("symbols", "file_path")).alias("largest"), F.count("*").alias("parts"))
    return agg.where("symbols >= 5").join(b, "name", "left").select(
        "name", "symbols", F.round("cohesion", 6).alias("cohesion"), "largest", "parts", F.coalesce("inner", F.lit(0)).alias("inner_calls"))


QUERIES = {
    "node_counts_by_label": (lambda s, d: _nodes(s, d).groupBy("label").agg(F.count("*").alias("n")),
        " UNION ALL ".join(f"SELECT '{a}' AS label, count(*) AS n FROM {b}" for a, b in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders")))),
    "edge_counts_by_type": (lambda s, d: _typed(s, d).groupBy("type").agg(F.count("*").alias("n")), f"WITH {TYPED} SELECT type, count(*) AS n FROM te GROUP BY type"),
    "graph_totals": (lambda s, d: _nodes(s, d).agg(F.count("*").alias("nodes")).crossJoin(_typed(s, d).agg(F.count("*").alias("edges"))),
        f"WITH {TYPED} SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM te) AS edges"),
    "structure_contains": (lambda s, d: g.structure(folders(s, d))[1],
        f"WITH {FOLDERS} SELECT DISTINCT split_part(path, '/', 1) AS src, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dst FROM fo UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path FROM fo"),
    "structure_nodes": (lambda s, d: g.structure(folders(s, d))[0].groupBy("label").agg(F.count("*").alias("n")),
        f"WITH {FOLDERS}, n AS (SELECT path, 'File' AS label FROM fo UNION SELECT split_part(path, '/', 1), 'Folder' FROM fo UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'Folder' FROM fo) SELECT label, count(*) AS n FROM n GROUP BY label"),
    "folder_tree": (lambda s, d: g.folder_tree(folders(s, d)),
        f"WITH {FOLDERS}, p AS (SELECT split_part(path, '/', 1) AS folder FROM fo UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM fo) SELECT folder, count(*) AS files FROM p GROUP BY folder"),
    "callers_of": (lambda s, d: g.callers(calls(s, d), TARGET), f"WITH {CALLS} SELECT src AS id, confidence FROM ce WHERE dst = {TARGET}"),
    "callees_of": (lambda s, d: g.callees(calls(s, d), TARGET), f"WITH {CALLS} SELECT dst AS id, confidence FROM ce WHERE src = {TARGET}"),
    "undirected_neighbors": (lambda s, d: g.undirected(calls(s, d)).groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("least")),
        f"WITH {CALLS}, {_UND} SELECT node, count(*) AS n, min(other) AS least FROM un GROUP BY node"),
    "optional_neighbourhood_counts": (_optional,
        f"WITH {CALLS}, {SYMBOLS}, i AS (SELECT dst AS id, count(*) AS n_in, max(confidence) AS best_in FROM ce GROUP BY dst), o AS (SELECT src AS id, count(*) AS n_out FROM ce GROUP BY src) SELECT id, label, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, best_in FROM sy LEFT JOIN i USING (id) LEFT JOIN o USING (id)"),
    "two_hop_distinct": (lambda s, d: g.hops(calls(s, d), TARGET, 2), f"WITH {CALLS} SELECT DISTINCT b.dst AS node FROM ce a JOIN ce b ON a.dst = b.src WHERE a.src = {TARGET}"),
    "three_hop_distinct": (lambda s, d: g.hops(calls(s, d), TARGET, 3),
        f"WITH {CALLS}, h AS (SELECT DISTINCT b.dst AS node FROM ce a JOIN ce b ON a.dst = b.src WHERE a.src = {TARGET}) SELECT DISTINCT dst AS node FROM ce JOIN h ON ce.src = h.node"),
    "impact_by_depth": (lambda s, d: _impact(s, d).groupBy("depth").agg(F.count("*").alias("n")), f"{_UP} SELECT depth, count(*) AS n FROM im GROUP BY depth"),
    "impact_members": (lambda s, d: _impact(s, d), f"{_UP} SELECT node, depth FROM im"),
    "impact_downstream_confident": (_confident,
        f"WITH RECURSIVE {CALLS}, {SYMBOLS}, ok AS (SELECT src, dst FROM ce JOIN sy ON sy.id = ce.dst WHERE confidence >= 0.9 AND name NOT LIKE '%bolt%'), up(node, depth) AS (SELECT CAST({TARGET} AS BIGINT), 0 UNION SELECT ok.dst, up.depth + 1 FROM up JOIN ok ON ok.src = up.node WHERE up.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node HAVING min(depth) > 0"),
    "impact_risk": (_risk,
        f"{_UP}, {SYMBOLS}, {STEPS}, r AS (SELECT (SELECT count(*) FROM im WHERE depth = 1) AS direct, (SELECT count(*) FROM im) AS total, (SELECT count(DISTINCT community) FROM im JOIN sy ON sy.id = im.node) AS modules, (SELECT count(DISTINCT process) FROM im JOIN st ON st.event_id % 997 = im.node) AS processes) SELECT *, CASE WHEN direct >= 30 OR processes >= 5 OR modules >= 5 OR total >= 200 THEN 'CRITICAL' WHEN direct >= 15 OR processes >= 3 OR modules >= 3 OR total >= 100 THEN 'HIGH' WHEN direct >= 5 OR total >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r"),
    "impact_modules": (lambda s, d: _impact(s, d).join(_group(s, d), "node").groupBy("grp").agg(F.count("*").alias("hits"), F.min("depth").alias("nearest"), (F.min("depth") == 1).alias("is_direct")).orderBy(F.desc("hits"), "grp").limit(20),
        f"{_UP}, {SYMBOLS} SELECT community AS grp, count(*) AS hits, min(depth) AS nearest, min(depth) = 1 AS is_direct FROM im JOIN sy ON sy.id = im.node GROUP BY community ORDER BY hits DESC, grp LIMIT 20"),
    "n_hop_neighbourhood": (lambda s, d: g.reach(calls(s, d), _start(s), depth=2, direction="both"),
        f"WITH RECURSIVE {CALLS}, {_UND}, up(node, depth) AS (SELECT CAST({TARGET} AS BIGINT), 0 UNION SELECT un.other, up.depth + 1 FROM up JOIN un ON un.node = up.node WHERE up.depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node HAVING min(depth) > 0"),
    "hotspots_top8": (lambda s, d: g.hotspots(calls(s, d)), f"WITH {CALLS} SELECT node, count(*) AS connections FROM (SELECT src AS node FROM ce UNION ALL SELECT dst FROM ce) GROUP BY node ORDER BY connections DESC, node LIMIT 8"),
    "caller_callee_counts": (lambda s, d: g.degree(calls(s, d)),
        f"WITH {CALLS} SELECT coalesce(i.node, o.node) AS node, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM (SELECT dst AS node, count(*) AS callers FROM ce GROUP BY dst) i FULL JOIN (SELECT src AS node, count(*) AS callees FROM ce GROUP BY src) o ON i.node = o.node"),
    "cluster_dependencies_top15": (lambda s, d: g.dependencies(calls(s, d), _group(s, d), 15),
        f"WITH {CALLS}, {SYMBOLS} SELECT a.community AS g_src, b.community AS g_dst, count(*) AS calls FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL ORDER BY calls DESC, g_src, g_dst LIMIT 15"),
    "module_edge_counts": (lambda s, d: g.dependencies(calls(s, d), _group(s, d)),
        f"WITH {CALLS}, {SYMBOLS} SELECT a.community AS g_src, b.community AS g_dst, count(*) AS calls FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL"),
    "intra_module_edges": (lambda s, d: g.between(calls(s, d), _group(s, d)).where("g_src = g_dst").select("src", "dst", F.col("g_src").alias("grp")),
        f"WITH {CALLS}, {SYMBOLS} SELECT src, dst, a.community AS grp FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community = b.community"),
    "inter_module_edges_top30": (lambda s, d: g.between(calls(s, d), _group(s, d)).where("g_src = 'Brand#1' and g_dst != 'Brand#1'").orderBy("src", "dst").limit(30).select("src", "dst", "g_dst"),
        f"WITH {CALLS}, {SYMBOLS} SELECT src, dst, b.community AS g_dst FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community = 'Brand#1' AND b.community <> 'Brand#1' ORDER BY src, dst LIMIT 30"),
    "inter_file_calls": (lambda s, d: g.between(calls(s, d), symbols(s, d).select(F.col("id").alias("node"), F.col("file_path").alias("grp"))).where("g_src != g_dst").select("g_src", "g_dst").distinct(),
        f"WITH {CALLS}, {SYMBOLS} SELECT DISTINCT a.file_path AS g_src, b.file_path AS g_dst FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.file_path <> b.file_path"),
    "cluster_aggregate_weighted": (_cluster,
        f"WITH {CALLS}, {SYMBOLS}, sub AS (SELECT community AS name, file_path, count(*) AS symbols, avg(length(name)) AS cohesion FROM sy GROUP BY ALL), i AS (SELECT a.community AS name, count(*) AS n FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst WHERE a.community = b.community GROUP BY ALL), a AS (SELECT name, CAST(sum(symbols) AS BIGINT) AS symbols, round(sum(cohesion * symbols) / sum(symbols), 6) AS cohesion, arg_max(file_path, (symbols, file_path)) AS largest, count(*) AS parts FROM sub GROUP BY name) SELECT a.*, coalesce(n, 0) AS inner_calls FROM a LEFT JOIN i USING (name) WHERE symbols >= 5"),
    "exported_symbols_per_file": (lambda s, d: symbols(s, d).where("is_exported").groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names")),
        f"WITH {SYMBOLS} SELECT file_path, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM sy WHERE is_exported GROUP BY file_path"),
    "context_refs_by_type": (lambda s, d: g.refs_by_type(_typed(s, d), f"Part:{TARGET}"),
        f"WITH {TYPED} SELECT 'incoming' AS direction, lower(type) AS type, count(DISTINCT src) AS n FROM te WHERE dst = 'Part:{TARGET}' GROUP BY type UNION ALL SELECT 'outgoing', lower(type), count(DISTINCT dst) FROM te WHERE src = 'Part:{TARGET}' GROUP BY type"),
    "symbol_name_search": (lambda s, d: symbols(s, d).where(F.lower("name").contains("red")).orderBy("name", "id").limit(10).select("id", "name", "label"),
        f"WITH {SYMBOLS} SELECT id, name, label FROM sy WHERE contains(lower(name), 'red') ORDER BY name, id LIMIT 10"),
    "symbols_per_file_top3": (lambda s, d: g.top_per_group(symbols(s, d), "file_path", ["name", "id"], 3).select("file_path", "id", "name"),
        f"WITH {SYMBOLS} SELECT file_path, id, name FROM sy QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY name, id) <= 3"),
}
