"""Traversal and structure of a code graph held as nodes and edges DataFrames.

Edges are (src, dst, confidence[, type]); a filter or a relation type is a predicate on them. Each
hop is one join on the frontier, which Spark broadcasts while it is small and shuffles when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialise


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs (node, other), both ways, without self loops."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    return both.where("node != other").distinct()


def callers(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.col("dst") == target).select(F.col("src").alias("id"), "confidence").distinct()


def callees(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.col("src") == target).select(F.col("dst").alias("id"), "confidence").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """node, callers, callees: distinct counts, one pass over the edges."""
    ends = edges.select("src", "dst").distinct()
    rows = ends.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(ends.select("src", F.lit(0), F.lit(1)))
    return rows.groupBy("node").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def hotspots(edges: DataFrame, k: int = 8) -> DataFrame:
    """The k nodes with most edges in either direction."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "node").limit(k)


def reach(edges: DataFrame, start: DataFrame, depth: int = 3, direction: str = "upstream", min_confidence: float = 0.0,
          blocked: DataFrame | None = None) -> DataFrame:
    """Breadth-first reach from start(node): (node, depth), first depth seen, start left out.

    direction: upstream (callers), downstream (callees) or both. A null confidence passes. Blocked
    nodes (tests, say) are neither reported nor expanded.
    """
    step = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    up, down = step.select(F.col("dst").alias("at"), F.col("src").alias("to")), step.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    step = up.union(down) if direction == "both" else up if direction == "upstream" else down
    step = materialise(step) if depth > 1 else step  # the edges are worked out once, not at each level
    seen = start.select("node", F.lit(0).alias("depth"))
    front = start.select("node")
    for d in range(1, depth + 1):
        front = step.join(front, step.at == front.node).select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        if blocked is not None:
            front = front.join(blocked.select("node"), "node", "left_anti")
        front = materialise(front) if d < depth else front
        seen = seen.union(front.select("node", F.lit(d)))
    return seen.where("depth > 0")


def risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    """Risk grade of a change from how much it reaches."""
    rule = lambda d, p, m, n: (direct >= d) | (processes >= p) | (modules >= m) | (total >= n)
    return F.when(rule(30, 5, 5, 200), "CRITICAL").when(rule(15, 3, 3, 100), "HIGH").when((direct >= 5) | (total >= 30), "MEDIUM").otherwise("LOW")


def impact_summary(hit: DataFrame, membership: DataFrame, processes: DataFrame) -> DataFrame:
    """One row: direct, total, processes, modules, risk. membership: (node, community); processes: (node, process)."""
    n = hit.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"))
    m = hit.join(membership, "node").agg(F.countDistinct("community").alias("modules"))
    p = hit.join(processes, "node").agg(F.countDistinct("process").alias("processes"))
    out = n.crossJoin(m).crossJoin(p)  # three one-row aggregates
    return out.withColumn("risk", risk(F.col("direct"), F.col("processes"), F.col("modules"), F.col("total")))


def hops(edges: DataFrame, target, n: int) -> DataFrame:
    """Distinct nodes at the end of some path of exactly n calls from target."""
    at = edges.where(F.col("src") == target).select(F.col("dst").alias("node")).distinct()
    for _ in range(n - 1):
        at = edges.join(at, edges.src == at.node).select(F.col("dst").alias("node")).distinct()
    return at


def structure(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder and File nodes of every path prefix, and CONTAINS edges parent -> child."""
    parts = F.split("path", "/")
    prefix = paths.select(F.size(parts).alias("n"), parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    rows = prefix.select(
        F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path"), F.when(F.col("k") == F.col("n"), "File").otherwise("Folder").alias("label"),
        F.when(F.col("k") > 1, F.array_join(F.slice("p", 1, F.col("k") - 1), "/")).alias("parent")).distinct()
    return rows.select("path", "label"), rows.where("parent is not null").select(F.col("parent").alias("src"), F.col("path").alias("dst"))


def folder_tree(paths: DataFrame) -> DataFrame:
    """folder, files: how many files lie below each folder."""
    parts = F.split("path", "/")
    prefix = paths.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    return prefix.groupBy(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("folder")).agg(F.count("*").alias("files"))


def between(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Edges with the groups of both ends: src, dst, g_src, g_dst. group: (node, grp)."""
    a = group.select(F.col("node").alias("src"), F.col("grp").alias("g_src"))
    b = group.select(F.col("node").alias("dst"), F.col("grp").alias("g_dst"))
    return edges.join(a, "src").join(b, "dst")


def dependencies(edges: DataFrame, group: DataFrame, k: int | None = None) -> DataFrame:
    """Calls between different groups: g_src, g_dst, calls, by calls falling (top k if given)."""
    out = between(edges, group).where("g_src != g_dst").groupBy("g_src", "g_dst").agg(F.count("*").alias("calls"))
    return out.orderBy(F.desc("calls"), "g_src", "g_dst").limit(k) if k else out


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def refs_by_type(edges: DataFrame, node) -> DataFrame:
    """direction, type, n of the relations a node has: the table behind a symbol's context."""
    kind = F.lower("type").alias("type")
    into = edges.where(F.col("dst") == node).select(F.lit("incoming").alias("direction"), kind, F.col("src").alias("other"))
    out = edges.where(F.col("src") == node).select(F.lit("outgoing").alias("direction"), kind, F.col("dst").alias("other"))
    return into.union(out).groupBy("direction", "type").agg(F.countDistinct("other").alias("n"))
