"""A graph on disk: Parquet tables in one folder, written whole, replaced by version, changed by file.

Each change writes new table folders and then moves one small pointer file, so readers see the old or
the new state and a job that dies half-way leaves the old one.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.changes import upsert, without_files
from weft.schema import SCHEMAS, conform

TABLES = tuple(SCHEMAS)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def state(self) -> dict:
        """Table -> folder, and meta."""
        fs, path = self._file("current.json")
        if not fs.exists(path):
            return {"tables": {}, "meta": {}}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, tables: dict, meta: dict) -> None:
        fs, path = self._file("current.json")
        _, draft = self._file(f"current-{uuid4().hex}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"tables": tables, "meta": meta}).encode()))
        out.close()
        old = fs.exists(path) and fs.delete(path, False)  # rename does not replace everywhere
        if not fs.rename(draft, path):
            raise OSError(f"cannot move {draft} to {path} (old state removed: {old})")

    def write(self, meta: dict | None = None, **frames: DataFrame) -> None:
        """Write or replace tables; those not given stay."""
        now = self.state()
        tables = dict(now["tables"])
        for name, frame in frames.items():
            folder = f"{name}-{uuid4().hex}"
            out = conform(frame, name)
            writer = out.write.partitionBy("label") if name == "nodes" else out.write.partitionBy("type") if name == "edges" else out.write
            writer.parquet(f"{self.path}/{folder}")
            tables[name] = folder
        self._commit(tables, {**now["meta"], **(meta or {})})

    def read(self, name: str) -> DataFrame:
        folder = self.state()["tables"].get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return conform(self.spark.read.parquet(f"{self.path}/{folder}"), name)

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> dict:
        """Put rows in by key: counts of inserted and failed (without a key)."""
        good = conform(rows, name).where(F.col(key).isNotNull()).dropDuplicates([key])
        counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("bad")).first()
        self.write(**{name: upsert(self.read(name), good, key)})
        return {"inserted": counts["n"] - counts["bad"], "failed": counts["bad"]}

    def delete_files(self, paths: DataFrame) -> None:
        """Nodes of the files go, with their edges and vectors."""
        nodes = self.read("nodes")
        gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
        edges = self.read("edges").join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        vectors = self.read("embeddings").join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti")
        self.write(nodes=without_files(nodes, paths), edges=edges, embeddings=vectors)

    def put_embeddings(self, rows: DataFrame) -> None:
        """Vectors by node; empty ones are skipped."""
        good = rows.where(F.col("node_id").isNotNull() & (F.size("embedding") > 0)).dropDuplicates(["node_id"])
        self.write(embeddings=upsert(self.read("embeddings"), good, "node_id"))

    def restore_embeddings(self, cached: DataFrame) -> None:
        """Put back vectors of nodes that are still there."""
        self.put_embeddings(cached.join(self.read("nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi"))

    def counts(self) -> dict:
        return {"nodes": self.read("nodes").count(), "edges": self.read("edges").count()}


def load_edges(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends exist (and whose labels may be joined, if pairs (src_label, dst_label) are given), and a row of counts."""
    a = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    known = edges.join(a, "src", "left").join(b, "dst", "left")
    ok = F.col("src_label").isNotNull() & F.col("dst_label").isNotNull()
    if pairs is not None:
        known = known.join(F.broadcast(pairs.distinct().withColumn("_pair", F.lit(True))), ["src_label", "dst_label"], "left")
        ok = ok & F.col("_pair").isNotNull()
    counts = known.agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("skipped"))
    return known.where(ok).select(*edges.columns), counts


def export_csv(frame: DataFrame, path: str) -> None:
    """One table as CSV with every text quoted."""
    frame.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def markdown(rows, columns, most: int = 50, width: int = 60) -> str:
    """Rows as a Markdown table: nulls empty, structures as JSON, long cells cut, | escaped."""
    def cell(v) -> str:
        s = "" if v is None else json.dumps(v, default=str) if isinstance(v, (dict, list, tuple)) else str(v)
        s = s.replace("\n", " ").replace("|", "\\|")
        return s if len(s) <= width else s[: width - 3] + "..."

    head = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows[:most]])


