"""python -m weft analyze FOLDER STORE | query|context|impact|augment STORE TEXT | cypher|sql STORE QUERY | overview|clusters|processes STORE"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _graph(spark, store_path: str):
    from weft.graph import KnowledgeGraph
    from weft.sources.store import Store

    s = Store(spark, store_path)
    vectors = s.read("embeddings")
    return KnowledgeGraph(s.read("nodes"), s.read("edges"), s.read("communities"), s.read("processes"), s.read("files").select("path", "content"), None if vectors.isEmpty() else vectors)


def analyze(spark, folder: str, store_path: str, embeddings: bool = False, force: bool = False) -> dict:
    """Scan, analyse and store one source tree; a tree whose commit is stored already is left as it is."""
    from weft.analyze import analyze as run
    from weft.graph import KnowledgeGraph
    from weft.sources import files, project
    from weft.sources.store import Store

    s, head = Store(spark, store_path), project.git_head(folder)
    if head and not force and s.state()["meta"].get("last_commit") == head:
        return {"status": "up to date", **s.state()["meta"]}
    wanted = files.scan(spark, Path(folder).resolve().as_uri(), project.ignore_lines(folder))
    texts = files.contents(spark, Path(folder).resolve().as_uri(), wanted).where("not is_binary").join(wanted.select("path", "language"), "path")
    tables = run(texts, project.config(folder))
    kept = s.read("embeddings")
    s.write(meta={"last_commit": head, "path": str(Path(folder).resolve())}, files=texts, **{k: tables[k] for k in ("nodes", "edges", "communities", "processes", "import_map")})
    if embeddings and not project.settings(folder).get("skip_embeddings"):
        nodes = s.read("nodes")
        old = kept.join(nodes.select(nodes["id"].alias("node_id")), "node_id", "left_semi")
        graph = KnowledgeGraph(nodes, s.read("edges"), embeddings=old)
        s.write(embeddings=old.unionByName(graph.embed()))
    return {"status": "done", **s.counts()}


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="weft", description=__doc__)
    parser.add_argument("command", choices=["analyze", "query", "context", "impact", "augment", "cypher", "sql", "overview", "clusters", "processes", "cluster", "process", "resource"])
    parser.add_argument("target")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--embeddings", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--direction", default="upstream", choices=["upstream", "downstream"])
    args = parser.parse_args(argv)
    from weft.graph import as_text, yaml
    from weft.session import local_session
    from weft.sources.store import markdown

    spark = local_session()
    if args.command == "analyze":
        print(yaml(analyze(spark, args.target, args.text, args.embeddings, args.force)))
        return 0
    g = _graph(spark, args.target)
    if args.command in ("cypher", "sql", "clusters", "processes"):
        frame = {"cypher": lambda: g.cypher(args.text), "sql": lambda: g.sql(args.text), "clusters": g.clusters, "processes": g.process_list}[args.command]()
        print(markdown(frame.limit(50).collect(), frame.columns))
    elif args.command == "augment":
        print(g.augment(args.text))
    elif args.command == "resource":
        print(g.resource(args.text))
    else:
        call = {"query": lambda: g.query(args.text), "context": lambda: g.context(args.text), "impact": lambda: g.impact(args.text, args.direction), "overview": g.overview,
                "cluster": lambda: g.cluster(args.text), "process": lambda: g.process(args.text)}[args.command]
        print(as_text(call()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
