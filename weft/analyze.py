"""From a file table to a whole graph: structure, symbols, imports, calls, inheritance, communities and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths
from weft.functions.text import node_id, snippet
from weft.operators import community, flows, graph, resolve
from weft.operators.resolve import Config
from weft.parsing.extract import extract, tables
from weft.parsing.languages import noise
from weft.schema import conform
from weft.session import materialise


def _edges(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        one = f.select(node_id(F.col("type"), F.concat_ws("->", "src", "dst", *(["step"] if "step" in f.columns else []))).alias("id"), "src", "dst", "type", "confidence", "reason",
                       (F.col("step") if "step" in f.columns else F.lit(None)).cast("int").alias("step"))
        out = one if out is None else out.unionByName(one)
    return out


def analyze(files: DataFrame, config: Config = Config(), with_flows: bool = True) -> dict[str, DataFrame]:
    """files: path, content. Returns nodes, edges, communities, processes, import_map, each checkpointed where it is used again."""
    if "language" not in files.columns:
        files = files.withColumn("language", paths.language(F.col("path")))
    t = tables(materialise(extract(files)))
    where, below = graph.structure(files.select("path"))
    file_key = lambda label, path: node_id(label, path)
    holders = where.select(file_key(F.col("label"), F.col("path")).alias("id"), "label", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"))
    labels = where.select(F.col("path").alias("_p"), F.col("label").alias("_l"))
    contains = below.join(labels, below.src == F.col("_p")).select(file_key(F.col("_l"), F.col("src")).alias("src"), F.col("dst").alias("_dst"))
    contains = contains.join(labels, F.col("_dst") == F.col("_p")).select("src", file_key(F.col("_l"), F.col("_dst")).alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
    symbols = materialise(t["symbols"])
    defines = t["nodes"].select(node_id(F.lit("File"), F.col("file_path")).alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type"), F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
    import_map = materialise(resolve.resolve_imports(t["imports"], files.select("path"), config))
    skip = files.sparkSession.createDataFrame([(n,) for n in sorted(noise(config.noise))], "name string")
    calls, counts = resolve.call_edges(t["calls"], symbols, import_map, F.broadcast(skip))
    parents = resolve.heritage_edges(t["heritage"], symbols, import_map)
    routes = resolve.route_edges(t["routes"], symbols, import_map).withColumn("src", node_id(F.lit("File"), F.substring("src", 6, 1 << 20)))
    code = t["nodes"].join(files.select(F.col("path").alias("file_path"), F.col("content").alias("_c")), "file_path", "left")
    code = code.withColumn("content", snippet(F.col("_c"), F.col("label"), F.col("start_line") - 1, F.col("end_line") - 1)).drop("_c")
    plain = holders.join(files.select(F.col("path").alias("file_path"), F.col("content").alias("_c"), "language"), "file_path", "left")
    plain = plain.withColumn("content", snippet(F.col("_c"), F.col("label"), F.lit(None).cast("int"), F.lit(None).cast("int"))).drop("_c")
    nodes = materialise(conform(code, "nodes").unionByName(conform(plain, "nodes")))
    edges = materialise(_edges(contains, defines, resolve.import_edges(import_map), calls.drop("id"), parents.drop("heritage_kind"), routes).dropDuplicates(["id"]))
    out = {"nodes": nodes, "edges": edges, "import_map": import_map, "call_counts": counts}
    if not with_flows:
        return out
    adj = materialise(community.adjacency(nodes, edges))
    members = materialise(community.communities(adj, nodes.where(~F.col("label").isin(*community.NOT_SYMBOLS)).select(F.col("id").alias("node")), method="leiden"))
    groups = materialise(community.describe(members, adj, nodes.select("id", "name"), community.LEIDEN))
    scored = flows.score_entries(nodes, edges.where("type = 'CALLS'"))
    scored = materialise(scored)
    reach = materialise(flows.bfs_flows(scored, edges.where("type = 'CALLS'")))
    membership = groups.select(F.explode("members").alias("node"), F.col("id").alias("community"))
    summary = materialise(flows.flow_summary(reach, membership))
    more = _edges(community.member_edges(groups), flows.step_edges(reach, summary))
    scores = scored.select("id", F.col("score").alias("entry_point_score"), F.col("reasons").alias("entry_point_reason"))
    nodes = conform(nodes.drop("entry_point_score", "entry_point_reason").join(scores, "id", "left"), "nodes")
    own = groups.select("id", F.lit("Community").alias("label"), F.col("heuristic_label").alias("name"), "description")
    runs = summary.select("id", F.lit("Process").alias("label"), F.concat(F.lit("process-"), F.substring("entry", 1, 12)).alias("name"))
    nodes = nodes.unionByName(conform(own, "nodes")).unionByName(conform(runs, "nodes"))
    processes = summary.select("id", F.concat(F.lit("process-"), F.substring("entry", 1, 12)).alias("label"), F.lit("entrypoint-bfs").alias("process_type"), "step_count", "communities", "entry", "terminal")
    return {**out, "nodes": nodes, "edges": edges.unionByName(more), "communities": groups, "processes": processes}
