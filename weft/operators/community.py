"""Communities of a symbol graph: adjacency, label propagation, names, keywords and cohesion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import GENERIC_FOLDERS, capitalize, common_prefix, name_tokens
from weft.session import materialise

from .leiden import in_component

ROUNDS = 12
EDGE_TYPES = ("CALLS", "INHERITS", "EXTENDS", "IMPLEMENTS", "IMPORTS")
NOT_SYMBOLS = ("File", "Folder", "Community", "Process")
LARGE, LARGE_CONFIDENCE = 10_000, 0.5
EXACT_NODES = 20_000
PROPAGATION, LEIDEN = "fallback-deterministic", "leiden"


def adjacency(nodes: DataFrame, edges: DataFrame, types=EDGE_TYPES) -> DataFrame:
    """node, other: distinct neighbours both ways between symbols; self loops are kept once."""
    own = nodes.where(~F.col("label").isin(*NOT_SYMBOLS)).select("id")
    some = edges.where(F.col("type").isin(*types)) if "type" in edges.columns else edges
    some = some.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return some.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(some.select("dst", "src")).distinct()


def prune_large(adj_edges: DataFrame, symbols: int) -> DataFrame:
    """Of a large graph only edges of some confidence and nodes of two neighbours or more; others are left as they are."""
    if symbols <= LARGE:
        return adj_edges
    sure = adj_edges.where(F.col("confidence").isNull() | (F.col("confidence") >= LARGE_CONFIDENCE))
    ends = sure.select(F.col("src").alias("node")).union(sure.select("dst"))
    some = ends.groupBy("node").count().where("count >= 2").select("node")
    return sure.join(some.withColumnRenamed("node", "src"), "src", "left_semi").join(some.withColumnRenamed("node", "dst"), "dst", "left_semi")


def propagate(adj: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Label propagation, all nodes at once each round: (node, label).

    A node takes the label that most neighbours bear if that beats its own label's count; ties go to the larger
    label. The neighbours are worked out once; a round moves each neighbour's label to its node once and counts there.
    """
    return _propagate(materialise(adj.select("node", "other")), nodes, rounds)


def _propagate(adj: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    labels = materialise(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        said = adj.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label").repartition("node")
        votes = said.groupBy("node", "label").agg(F.count("*").alias("n"))  # all of a node are together: nothing else moves
        mine = labels.select("node", F.col("label").alias("_mine"))
        best = votes.join(mine, "node").groupBy("node").agg(F.max(F.struct("n", "label")).alias("best"), F.max(F.when(F.col("label") == F.col("_mine"), F.col("n"))).alias("own"))
        step = labels.join(best, "node", "left")
        better = F.col("best.n") > F.coalesce("own", F.lit(0))
        after = materialise(step.select("node", F.col("label").alias("old"), F.when(better, F.col("best.label")).otherwise(F.col("label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            break
    return labels


def components(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): connected components by smallest node, with pointer jumping."""
    return _components(materialise(adj.select("node", "other")), nodes)


def _components(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    labels = materialise(nodes.select("node", F.col("node").alias("comp")))
    while True:
        near = adj.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        after = materialise(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")))
        labels = after.select("node", "comp")
        if after.where("old != comp").isEmpty():
            return labels


def _in_turn(table: pa.Table) -> pa.Table:
    """Label propagation of one component, node by node in order, each seeing the labels changed before it."""
    near: dict = {}
    for node, other in zip(table.column("node").to_pylist(), table.column("other").to_pylist(), strict=True):
        near.setdefault(node, []).append(other)
    label = {node: node for node in near}
    for _ in range(ROUNDS):
        changed = False
        for node in sorted(near):
            votes: dict = {}
            for other in near[node]:
                votes[label[other]] = votes.get(label[other], 0) + 1
            mine = label[node]
            best = max(votes, key=lambda x: (votes[x], x == mine, x))
            if votes[best] > votes.get(mine, 0):
                label[node], changed = best, True
        if not changed:
            break
    return pa.table({"node": pa.array(list(label), table.schema.field("node").type), "label": pa.array(list(label.values()), table.schema.field("node").type)})


def communities(adj: DataFrame, nodes: DataFrame, exact_nodes: int = EXACT_NODES, method: str = "propagation", resolution: float = 1.0, iterations: int = 2) -> DataFrame:
    """(node, label), one task a component of up to exact_nodes nodes: `leiden` by modularity, or `propagation` node by node.

    Larger components go by propagation, all nodes at once, so no task holds more than exact_nodes nodes and their edges.
    """
    adj = materialise(adj.select("node", "other"))
    comp = _components(adj, nodes)
    sized = materialise(comp.join(comp.groupBy("comp").agg(F.count("*").alias("n")), "comp"))
    small, large = sized.where(f"n <= {exact_nodes} and n > 1"), sized.where(f"n > {exact_nodes}")
    kind = dict(adj.dtypes)["node"]
    one = _in_turn_of_group
    if method == "leiden":
        total = float(adj.where("node != other").count())  # both ways: twice the number of edges

        def one(table: pa.Table) -> pa.Table:
            return in_component(table.select(["node", "other"]), total, resolution, iterations)

    turn = adj.join(small.select("node", "comp"), "node").groupBy("comp").applyInArrow(one, f"node {kind}, label {kind}")
    out = turn.union(sized.where("n = 1").select("node", F.col("node").alias("label")))
    if not large.isEmpty():
        out = out.union(propagate(adj.join(large.select("node"), "node", "left_semi"), large.select("node")))
    return out


def _in_turn_of_group(table: pa.Table) -> pa.Table:
    return _in_turn(table.select(["node", "other"]))


def describe(members: DataFrame, adj: DataFrame, names: DataFrame, found_by: str = PROPAGATION) -> DataFrame:
    """members: node, label. One row a community: id, name, heuristic_label, keywords, cohesion, symbol_count, description, members."""
    grouped = members.groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("members"))
    order = Window.orderBy(F.col("members")[0])  # one row a community
    named = grouped.withColumn("name", F.concat(F.lit("community-"), F.row_number().over(order)))
    words = members.join(names.select(F.col("id").alias("node"), F.col("name").alias("_n")), "node").select(
        "label", F.explode(name_tokens(F.col("_n"))).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    top = words.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "token"))).where("_k <= 5")
    keys = top.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "token"))), lambda s: s["token"]).alias("keywords"))
    out = named.join(keys, "label", "left").join(density(members, adj), "label", "left")
    out = out.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return out.select(
        F.concat(F.lit("community_"), F.substring(F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), "|"), 256), 1, 16)).alias("id"),
        "label", "name", F.coalesce(F.get("keywords", F.lit(0)), "name").alias("heuristic_label"), "keywords", "cohesion",
        F.size("members").alias("symbol_count"), F.concat(F.lit("Cluster of "), F.size("members"), F.lit(" related symbols")).alias("description"),
        F.lit(found_by).alias("enriched_by"), "members")


def member_edges(described: DataFrame) -> DataFrame:
    return described.select(F.explode("members").alias("src"), F.col("id").alias("dst"), F.lit("MEMBER_OF").alias("type"), F.lit(0.95).alias("confidence"), F.col("enriched_by").alias("reason"))


def inner_edges(members: DataFrame, adj: DataFrame) -> DataFrame:
    """label, node, other: neighbour pairs inside one community."""
    a = members.select("node", "label")
    b = members.select(F.col("node").alias("other"), F.col("label").alias("_l"))
    return adj.join(a, "node").join(b, "other").where("label = _l").select("label", "node", "other")


def density(members: DataFrame, adj: DataFrame) -> DataFrame:
    """label, cohesion: inner edges over possible ones, to four places; 1 for a community of one."""
    size = members.groupBy("label").agg(F.count("*").alias("n"))
    inner = inner_edges(members, adj).where("node < other").groupBy("label").agg(F.count("*").alias("m"))
    full = F.col("n") * (F.col("n") - 1) / 2
    return size.join(inner, "label", "left").select(
        "label", F.when(F.col("n") <= 1, 1.0).otherwise(F.round(F.coalesce("m", F.lit(0)) / full, 4)).alias("cohesion"))


def inner_share(members: DataFrame, adj: DataFrame, sample: int | None = 50) -> DataFrame:
    """label, cohesion: share of the members' neighbours that belong to the community, over its first members (all if sample is None)."""
    some = members
    if sample:
        some = members.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("node"))).where(F.col("_k") <= sample).drop("_k")
    near = some.select("label", "node").join(adj, "node").join(members.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other", "left")
    ratio = near.groupBy("label").agg((F.count_if(F.col("_l") == F.col("label")) / F.count("*")).alias("r"))
    size = members.groupBy("label").agg(F.count("*").alias("n"))
    return size.join(ratio, "label", "left").select("label", F.when(F.col("n") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("r", F.lit(1.0)))).alias("cohesion"))


def folder_label(members: DataFrame, paths: DataFrame) -> DataFrame:
    """label, heuristic_label: the commonest parent folder that is not too general, else a common start of the names, else Cluster_n.

    paths: id, file_path, name. Ties of folders go to the first by name.
    """
    rows = members.join(paths.select(F.col("id").alias("node"), "file_path", "name"), "node", "left")
    parts = F.filter(F.split("file_path", "/"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    seen = rows.select("label", folder.alias("folder")).where(F.col("folder").isNotNull() & ~F.lower("folder").isin(*GENERIC_FOLDERS))
    best = seen.groupBy("label", "folder").agg(F.count("*").alias("n")).groupBy("label").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("folder"))
    ends = rows.groupBy("label").agg(F.array(F.min("name"), F.max("name")).alias("ends"), F.count("name").alias("n"))
    prefix = common_prefix(F.col("ends"))
    numbered = members.groupBy("label").agg(F.min("node").alias("first")).withColumn("k", F.row_number().over(Window.orderBy("first")) - 1)  # one row a community
    out = numbered.join(best, "label", "left").join(ends, "label", "left")
    return out.select("label", F.when(F.col("folder").isNotNull(), capitalize(F.col("folder"))).when((F.col("n") > 2) & (F.length(prefix) > 2), capitalize(prefix))
                      .otherwise(F.concat(F.lit("Cluster_"), "k")).alias("heuristic_label"))


def aggregate_by_name(clusters: DataFrame, least: int = 5) -> DataFrame:
    """clusters: id, label, cohesion, symbol_count. Clusters of one name as one: id of the largest, symbols, weighted cohesion, parts."""
    s, c = F.coalesce("symbol_count", F.lit(0)), F.coalesce("cohesion", F.lit(0.0))
    out = clusters.groupBy("label").agg(
        F.min_by("id", F.struct(-s, "id")).alias("id"), F.sum(s).alias("symbol_count"),
        F.when(F.sum(s) > 0, F.sum(c * s) / F.sum(s)).otherwise(0.0).alias("cohesion"), F.count("*").alias("sub_communities"))
    return out.where(F.col("symbol_count") >= least)


def enrich(described: DataFrame, names: DataFrame, label_with=None, most: int = 15) -> DataFrame:
    """Adds name and description given by a callable over a community's first member names; without one the heuristic label stays."""
    if label_with is None:
        return described.withColumn("enriched_label", F.col("heuristic_label"))
    rows = described.select("id", F.explode(F.slice("members", 1, most)).alias("node")).join(names.select(F.col("id").alias("node"), "name"), "node")
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("names"))

    @F.pandas_udf("string")
    def labelled(batch):
        return batch.map(lambda own: label_with(list(own)))

    return described.join(lists, "id", "left").withColumn("enriched_label", F.coalesce(labelled("names"), "heuristic_label")).drop("names")
