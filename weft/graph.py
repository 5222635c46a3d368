"""A code graph and the questions asked of it.

Tables stay DataFrames; a tool returns plain Python only for what its limits keep small.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.cypher import compile_query
from weft.functions import paths, vectors
from weft.functions.text import embedding_text, is_write_query
from weft.operators import changes, community, flows, graph, search
from weft.schema import IMPACT_RELATIONS, LABELS, RELATIONS, conform

DIMENSIONS = 384
EMBEDDABLE = ("File", "Function", "Class", "Method", "Interface")
NEAR = 0.6
# Queries offered to a user who does not write their own.
CANNED = {
    "all functions": "MATCH (n:Function) RETURN n.id AS id, n.name AS name, n.filePath AS path LIMIT 50",
    "all classes": "MATCH (n:Class) RETURN n.id AS id, n.name AS name, n.filePath AS path LIMIT 50",
    "all interfaces": "MATCH (n:Interface) RETURN n.id AS id, n.name AS name, n.filePath AS path LIMIT 50",
    "calls": "MATCH (a)-[r:CodeRelation {type: 'CALLS'}]->(b) RETURN a.id AS id, a.name AS caller, b.name AS callee LIMIT 50",
    "imports": "MATCH (a:File)-[r:CodeRelation {type: 'IMPORTS'}]->(b:File) RETURN a.id AS id, a.name AS source, b.name AS imports LIMIT 50",
}


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors from hashed words: the embedder used when no model is given."""
    import re
    import zlib

    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[row, h % dimensions] += 1.0 if h & 0x80000000 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


@dataclass
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    processes: DataFrame | None = None
    files: DataFrame | None = None  # path, content
    embeddings: DataFrame | None = None
    embedder: object = field(default=hashed_embedding)  # list of texts -> matrix

    def __post_init__(self) -> None:
        self.nodes, self.edges = conform(self.nodes, "nodes"), conform(self.edges, "edges")
        self.spark: SparkSession = self.nodes.sparkSession

    # --- tables ----------------------------------------------------------------------------------

    @cached_property
    def all_nodes(self) -> DataFrame:
        """The nodes with what is known of communities and processes."""
        out = self.nodes
        if self.communities is not None:
            c = self.communities.select("id", F.col("name").alias("_ct"), F.col("heuristic_label").alias("_ch"), "cohesion", "symbol_count", "keywords")
            out = out.join(c, "id", "left")
        else:
            out = out.withColumns({"_ct": F.lit(None).cast("string"), "_ch": F.lit(None).cast("string"), "cohesion": F.lit(None).cast("double"), "symbol_count": F.lit(None).cast("int"), "keywords": F.lit(None).cast("array<string>")})
        if self.processes is not None:
            p = self.processes.select("id", F.col("label").alias("_pt"), "process_type", "step_count", F.col("entry").alias("entry_point_id"), F.col("terminal").alias("terminal_id"))
            out = out.join(p, "id", "left")
        else:
            out = out.withColumns({"_pt": F.lit(None).cast("string"), "process_type": F.lit(None).cast("string"), "step_count": F.lit(None).cast("int"), "entry_point_id": F.lit(None).cast("string"), "terminal_id": F.lit(None).cast("string")})
        return out.withColumn("title", F.coalesce("_ct", "_pt", "name")).withColumn("heuristic_label", F.coalesce("_ch", "_pt")).drop("_ct", "_ch", "_pt")

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    @property
    def steps(self) -> DataFrame:
        return self.typed("STEP_IN_PROCESS").select(F.col("src").alias("id"), F.col("dst").alias("process"), "step")

    @property
    def membership(self) -> DataFrame:
        own = self.typed("MEMBER_OF").select(F.col("src").alias("id"), F.col("dst").alias("community"))
        if self.communities is None:
            return own.withColumns({"cohesion": F.lit(0.0), "module": F.col("community")})
        return own.join(self.communities.select(F.col("id").alias("community"), "cohesion", F.col("heuristic_label").alias("module")), "community")

    def register(self) -> None:
        """Views: gnodes, gedges, one for each label and one for each relation type in small letters."""
        self.all_nodes.createOrReplaceTempView("gnodes")
        self.edges.createOrReplaceTempView("gedges")
        for label in LABELS:
            self.all_nodes.where(F.col("label") == label).createOrReplaceTempView(label if label.lower() not in ("function", "macro") else f"{label}s")
        for kind in RELATIONS:
            self.typed(kind).createOrReplaceTempView(kind.lower())

    def sql(self, query: str, **args) -> DataFrame:
        if is_write_query(query):
            raise ValueError("write operations are not allowed")
        self.register()
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def cypher(self, query: str, **args) -> DataFrame:
        text = compile_query(query)
        self.register()
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    # --- search ----------------------------------------------------------------------------------

    @cached_property
    def indexes(self) -> dict[str, search.Bm25]:
        """A full-text index for each kind of node that is searched, over name and content."""
        text = F.concat_ws(" ", "name", "content")
        return {label: search.Bm25.build(self.nodes.where(F.col("label") == label).select("id", text.alias("text")), porter=True) for label in EMBEDDABLE}

    def bm25(self, text: str, limit: int = 20, conjunctive: bool = False) -> DataFrame:
        """id, score, rank over all searched kinds."""
        out = None
        for index in self.indexes.values():
            one = index.search(text, limit, conjunctive).select("id", "score")
            out = one if out is None else out.union(one)
        return search.ranked(out, limit)

    def bm25_files(self, text: str, limit: int = 20) -> DataFrame:
        hits = self.bm25(text, 10 * limit).join(self.nodes.select("id", "file_path"), "id")
        return search.merge_tables(hits, limit)

    def embed(self, batch: int = 32) -> DataFrame:
        """node_id, embedding of every node that can have one and has none yet."""
        own = self.nodes.where(F.col("label").isin(*EMBEDDABLE))
        if self.embeddings is not None:
            own = own.join(self.embeddings.select(F.col("node_id").alias("id")), "id", "left_anti")
        texts = own.select("id", embedding_text(F.col("label"), F.col("name"), F.col("file_path"), F.col("content")).alias("text"))
        embedder = self.embedder

        def rows(batches):
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    v = np.asarray(embedder(part.column(1).to_pylist()), np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["node_id", "embedding"])

        return texts.mapInArrow(rows, "node_id string, embedding array<float>")

    def semantic(self, text: str, limit: int = 20, distance: float | None = None) -> DataFrame:
        """id, score, rank of the nearest vectors; nothing without vectors or for a blank text."""
        if self.embeddings is None or not text.strip() or limit <= 0:
            return self.spark.createDataFrame([], "id string, score double, rank int")
        query = np.asarray(self.embedder([text]))[0]
        found = vectors.nearest(self.embeddings.withColumnRenamed("node_id", "id"), query, limit, "id", "embedding")
        if distance is not None:
            found = vectors.within(found, distance).drop("distance")
        return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def hybrid(self, text: str, limit: int = 20, k: int = search.RRF_K, bm25_weight: float = 0.4, semantic_weight: float = 0.6, conjunctive: bool = False) -> DataFrame:
        found = search.rrf({"bm25": (self.bm25(text, limit, conjunctive), bm25_weight), "semantic": (self.semantic(text, limit), semantic_weight)}, k=k, limit=limit)
        return found.join(self.nodes.select("id", "name", "file_path"), "id", "left").orderBy("rank")

    def query(self, text: str, limit: int = 5, max_symbols: int = 10, include_content: bool = False) -> dict:
        """Processes that a search touches, their symbols, and hits outside any process."""
        if not text.strip():
            raise ValueError("an empty query")
        wide = limit * max_symbols
        hits = search.rrf({"bm25": (self.bm25(text, wide), 1.0), "semantic": (self.semantic(text, wide, NEAR), 1.0)}, first_rank=0, limit=wide).select("id", "score")
        a, b, c = search.process_groups(hits, self.steps, self.membership.select("id", "cohesion"), limit, max_symbols)
        columns = ["id", "name", "label", "file_path", "start_line", "end_line"] + (["content"] if include_content else [])
        known = self.nodes.select(*columns)
        module = self.membership.groupBy("id").agg(F.min("module").alias("module"))
        detail = self.all_nodes.where("label = 'Process'").select(F.col("id").alias("process"), F.col("title").alias("summary"), "process_type", "step_count")
        return {
            "processes": _rows(a.join(detail, "process", "left").orderBy(F.desc("priority"), "process")),
            "process_symbols": _rows(b.join(known, "id").join(module, "id", "left").orderBy("process", F.desc("score"), "id")),
            "definitions": _rows(c.join(known, "id").join(module, "id", "left").orderBy(F.desc("score"), "id"))}

    def augment(self, pattern: str) -> str:
        """What is known of the symbols a search pattern may mean, as text; empty if nothing."""
        files = self.files if self.files is not None else self.nodes.where("label = 'File'").select(F.col("file_path").alias("path"), "content")
        index = search.Bm25.build(files.select(F.col("path").alias("id"), F.col("content").alias("text")), porter=True)
        found = search.augment(index, self.nodes.where(~F.col("label").isin("File", "Folder", "Community", "Process")), self.typed("CALLS"), self.steps, self.membership.select("id", "cohesion"), pattern).collect()
        if not found:
            return ""
        out = [f"{len(found)} related symbols found:", ""]
        for r in found:
            out.append(f"{r['name']} ({r['file_path']})")
            out += [f"  {title}: {r[c]}" for title, c in (("Called by", "callers"), ("Calls", "callees"), ("Flows", "processes")) if r[c]] + [""]
        return "\n".join(out).strip()

    # --- symbols ---------------------------------------------------------------------------------

    def find(self, name: str | None = None, uid: str | None = None, file_path: str | None = None, limit: int = 10) -> list[dict]:
        if not name and not uid:
            raise ValueError("a name or an id is needed")
        if uid:
            some = self.nodes.where(F.col("id") == uid)
        else:
            some = self.nodes.where(~F.col("label").isin("Community", "Process")).where((F.col("name") == name) | ((F.col("id") == name) if "/" in name or ":" in name else F.lit(False)))
            if file_path:
                some = some.where(F.contains("file_path", F.lit(file_path)))
        return _rows(some.orderBy("id").limit(limit))

    def refs(self, uid: str, limit: int = 30) -> tuple[dict, dict]:
        """Incoming and outgoing relations by type, at most `limit` each."""
        out = []
        for a, b in (("src", "dst"), ("dst", "src")):
            near = self.typed(*IMPACT_RELATIONS).where(F.col(b) == uid).select(F.col(a).alias("id"), "type").distinct()
            groups: dict[str, list] = {}
            for r in near.join(self.nodes.select("id", "name", "file_path", "label"), "id").orderBy("type", "id").limit(limit).collect():
                groups.setdefault(r["type"].lower(), []).append({"uid": r["id"], "name": r["name"], "file_path": r["file_path"], "kind": r["label"]})
            out.append(groups)
        return out[0], out[1]

    def context(self, name: str | None = None, uid: str | None = None, file_path: str | None = None, include_content: bool = False) -> dict:
        found = self.find(name, uid, file_path)
        if not found:
            return {"error": f"Symbol '{name or uid}' not found"}
        if len(found) > 1:
            return {"status": "ambiguous", "candidates": [{"uid": s["id"], "name": s["name"], "kind": s["label"], "file_path": s["file_path"], "line": s["start_line"]} for s in found]}
        s = found[0]
        incoming, outgoing = self.refs(s["id"])
        part = self.steps.where(F.col("id") == s["id"]).join(self.all_nodes.select(F.col("id").alias("process"), "title", "step_count"), "process", "left").orderBy("process", "step")
        symbol = {"uid": s["id"], "name": s["name"], "kind": s["label"], "file_path": s["file_path"], "start_line": s["start_line"], "end_line": s["end_line"]}
        if include_content and s["content"]:
            symbol["content"] = s["content"]
        return {"status": "found", "symbol": symbol, "incoming": incoming, "outgoing": outgoing,
                "processes": [{"id": r["process"], "name": r["title"], "step_index": r["step"], "step_count": r["step_count"]} for r in part.collect()]}

    def impact(self, target: str, direction: str = "upstream", depth: int = 3, relations=(), tests: bool = False, min_confidence: float = 0.0) -> dict:
        """What a change of the target reaches, by depth, with the processes and modules it touches and a risk grade."""
        own = self.nodes.where(~F.col("label").isin("Community", "Process")).where((F.col("name") == target) | (F.col("id") == target)).orderBy("id").limit(1).collect()
        if not own:
            return {"error": f"Target '{target}' not found"}
        types = [r for r in relations if r in IMPACT_RELATIONS] or list(IMPACT_RELATIONS)
        start = self.spark.createDataFrame([(own[0]["id"],)], "node string")
        blocked = None if tests else self.nodes.where(paths.is_test_for_impact(F.col("file_path"))).select(F.col("id").alias("node"))
        hit = graph.reach(self.typed(*types), start, depth, direction, min_confidence, blocked)
        from weft.session import materialise

        hit = materialise(hit)
        named = hit.join(self.nodes.select(F.col("id").alias("node"), "name", "label", "file_path"), "node", "left")
        processes = hit.join(self.steps.withColumnRenamed("id", "node"), "node").groupBy("process").agg(F.countDistinct("node").alias("hits"), F.min("step").alias("broken_at_step")).orderBy(F.desc("hits"), "process").limit(20).collect()
        modules = hit.join(self.membership.select(F.col("id").alias("node"), "module"), "node").groupBy("module").agg(
            F.countDistinct("node").alias("hits"), F.when(F.min("depth") == 1, "direct").otherwise("indirect").alias("impact")).orderBy(F.desc("hits"), "module").limit(20).collect()
        counts = {r["depth"]: r["n"] for r in hit.groupBy("depth").agg(F.count("*").alias("n")).collect()}
        direct, total = counts.get(1, 0), sum(counts.values())
        row = self.spark.range(1).select(graph.risk(F.lit(direct), F.lit(len(processes)), F.lit(len(modules)), F.lit(total)).alias("risk")).first()
        return {"target": {k: own[0][k] for k in ("id", "name", "label", "file_path")}, "direction": direction, "impacted_count": total, "risk": row["risk"],
                "summary": {"direct": direct, "processes_affected": len(processes), "modules_affected": len(modules)},
                "affected_processes": [r.asDict() for r in processes], "affected_modules": [r.asDict() for r in modules], "by_depth": counts, "members": named}

    def detect_changes(self, changed: list[str]) -> dict:
        files = self.spark.createDataFrame([(c,) for c in changed], "path string")
        summary = changes.change_summary(self.nodes, files, self.steps).first().asDict()
        return {"summary": summary, "changed_symbols": _rows(changes.changed_symbols(self.nodes, files).orderBy("path", "id")),
                "affected_processes": _rows(changes.affected_processes(self.nodes, files, self.steps).orderBy("process"))}

    def rename(self, new: str, name: str | None = None, uid: str | None = None, file_path: str | None = None) -> dict:
        """The edits of a rename; nothing is written. `apply_rename` of the search operators gives the new contents."""
        found = self.context(name, uid, file_path)
        if found.get("status") != "found":
            return found
        s = found["symbol"]
        if s["name"] == new:
            raise ValueError("the new name is the old one")
        incoming = [r["file_path"] for group in found["incoming"].values() for r in group if r["file_path"]]
        refs = self.spark.createDataFrame([(p,) for p in incoming], "path string")
        plan = search.rename_plan(self.files, s["name"], new, (s["file_path"], s["start_line"] or 0), refs)
        edits = _rows(plan.orderBy("path", "line"))
        return {"status": "success", "old_name": s["name"], "new_name": new, "files_affected": len({e["path"] for e in edits}), "total_edits": len(edits),
                "graph_edits": sum(e["source"] == "graph" for e in edits), "text_search_edits": sum(e["source"] == "text_search" for e in edits), "changes": edits, "applied": False}

    # --- overviews -------------------------------------------------------------------------------

    def stats(self) -> dict:
        by = {r["label"]: r["n"] for r in self.nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
        return {"files": by.get("File", 0), "nodes": sum(by.values()), "edges": self.edges.count(), "communities": by.get("Community", 0), "processes": by.get("Process", 0), "by_label": by}

    def clusters(self, limit: int = 100) -> DataFrame:
        """Communities of one name as one, largest first."""
        raw = self.all_nodes.where("label = 'Community'").select("id", F.coalesce("heuristic_label", "title").alias("label"), "cohesion", "symbol_count")
        top = raw.orderBy(F.desc("symbol_count"), "id").limit(max(5 * limit, 200))
        return community.aggregate_by_name(top).orderBy(F.desc("symbol_count"), "label").limit(limit)

    def process_list(self, limit: int = 50) -> DataFrame:
        return self.all_nodes.where("label = 'Process'").select("id", F.col("title").alias("label"), "process_type", "step_count").orderBy(F.desc("step_count"), "id").limit(limit)

    def cluster(self, name: str) -> dict:
        own = self.all_nodes.where((F.col("label") == "Community") & ((F.col("title") == name) | (F.col("heuristic_label") == name)))
        rows = _rows(own.select("id", "title", "heuristic_label", "cohesion", "symbol_count").orderBy(F.desc("symbol_count"), "id"))
        if not rows:
            return {"error": f"Cluster '{name}' not found"}
        total = sum(r["symbol_count"] or 0 for r in rows)
        members = self.typed("MEMBER_OF").join(own.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).join(self.nodes, "id").select("name", "label", "file_path").distinct()
        weighted = sum((r["cohesion"] or 0) * (r["symbol_count"] or 0) for r in rows)
        return {"cluster": {"id": rows[0]["id"], "label": rows[0]["heuristic_label"] or rows[0]["title"], "symbol_count": total, "cohesion": weighted / total if total else 0, "sub_communities": len(rows)},
                "members": _rows(members.orderBy("name", "file_path").limit(30))}

    def process(self, name: str) -> dict:
        own = _rows(self.all_nodes.where((F.col("label") == "Process") & ((F.col("title") == name) | (F.col("id") == name))).select("id", "title", "process_type", "step_count").orderBy("id").limit(1))
        if not own:
            return {"error": f"Process '{name}' not found"}
        steps = self.steps.where(F.col("process") == own[0]["id"]).join(self.nodes.select("id", "name", "label", "file_path"), "id").orderBy("step", "id")
        return {"process": own[0], "steps": _rows(steps.select("id", "step", "name", "label", "file_path"))}

    def overview(self, limit: int = 20) -> dict:
        return {"stats": self.stats(), "clusters": _rows(self.clusters(limit)), "processes": _rows(self.process_list(limit)),
                "dependencies": _rows(graph.dependencies(self.typed("CALLS"), self.membership.select(F.col("id").alias("node"), F.col("module").alias("grp")), 15))}

    def codebase(self) -> dict:
        """Counts, the most connected nodes and the folder tree."""
        spots = graph.hotspots(self.typed("CALLS")).join(self.nodes.select(F.col("id").alias("node"), "name", "label", "file_path"), "node").orderBy(F.desc("connections"), "node")
        tree = graph.folder_tree(self.nodes.where("label = 'File'").select(F.col("file_path").alias("path"))).orderBy(F.desc("files"), "folder").limit(50)
        return {"stats": self.stats(), "hotspots": _rows(spots), "folders": _rows(tree)}

    def explore(self, kind: str, name: str) -> dict:
        return {"symbol": self.context, "cluster": self.cluster, "process": self.process}[kind](name)

    def flows_through(self, files: list[str], limit: int = 10) -> DataFrame:
        """process, label, step_count, trace: the longest processes that pass through the files."""
        inside = self.nodes.where(F.col("file_path").isin(files)).select("id")
        some = self.steps.join(inside, "id", "left_semi").select("process").distinct().join(self.all_nodes.select(F.col("id").alias("process"), F.col("title").alias("label"), "step_count"), "process")
        top = some.orderBy(F.desc("step_count"), "process").limit(limit)
        trace = self.steps.join(top, "process").join(self.nodes.select("id", "name", "file_path"), "id").groupBy("process", "label", "step_count").agg(
            F.array_sort(F.collect_list(F.struct("step", "name", "file_path"))).alias("trace"))
        return trace.orderBy(F.desc("step_count"), "process")

    def mermaid(self, process: str) -> str:
        """A flow chart of one process; nodes grouped by module."""
        found = self.process(process)
        if "error" in found:
            return found["error"]
        ids = [s["id"] for s in found["steps"]]
        module = {r["id"]: r["module"] for r in self.membership.where(F.col("id").isin(ids)).collect()}
        calls = flows.process_edges(self.steps.where(F.col("process") == found["process"]["id"]).withColumnRenamed("id", "node"), self.typed("CALLS")).collect()
        short = {i: f"n{k}" for k, i in enumerate(dict.fromkeys(ids))}
        out, groups = ["flowchart TD"], {}
        for s in found["steps"]:
            groups.setdefault(module.get(s["id"]), {})[s["id"]] = str(s["name"]).replace('"', "'")
        for g, members in groups.items():
            inner = [f'{short[i]}["{n}"]' for i, n in members.items()]
            out += [f'  subgraph "{g}"', *[f"    {x}" for x in inner], "  end"] if g else [f"  {x}" for x in inner]
        return "\n".join(out + [f"  {short[r['src']]} --> {short[r['dst']]}" for r in sorted(calls, key=lambda r: (ids.index(r["src"]), ids.index(r["dst"])))])

    def resource(self, name: str) -> str:
        """Overview pages as YAML text: context, clusters, processes, schema, cluster/<name>, process/<name>."""
        kind, _, rest = name.partition("/")
        value = {"context": lambda: {"stats": self.stats()}, "clusters": lambda: {"modules": _rows(self.clusters())}, "processes": lambda: {"processes": _rows(self.process_list())},
                 "schema": lambda: {"nodes": list(LABELS), "relations": list(RELATIONS)}, "cluster": lambda: self.cluster(rest), "process": lambda: self.process(rest)}[kind]()
        return yaml(value)


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]  # frames here are bounded by a limit or by one symbol


def yaml(value, indent: int = 0) -> str:
    """Plain YAML of dictionaries, lists and scalars."""
    import json

    pad = "  " * indent
    if isinstance(value, dict):
        return "\n".join(f"{pad}{k}:" + (f"\n{yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v, ensure_ascii=False)}") for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}- " + yaml(v, indent + 1).lstrip() if isinstance(v, (dict, list)) else f"{pad}- {json.dumps(v, ensure_ascii=False)}" for v in value)
    return pad + json.dumps(value, ensure_ascii=False)


def as_text(result: dict) -> str:
    """A tool's result for people: what it is, then its parts."""
    if "error" in result:
        return result["error"]
    if result.get("status") == "ambiguous":
        return "Several symbols fit:\n" + "\n".join(f"  {c['kind']} {c['name']} {c['file_path']}:{c['line']} ({c['uid']})" for c in result["candidates"])
    return yaml({k: v for k, v in result.items() if not isinstance(v, DataFrame)})
