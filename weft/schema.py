"""The tables of a code graph. One wide table of nodes with a label, one of edges with a type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node labels and relation types.
LABELS = (
    "File", "Folder", "Function", "Class", "Interface", "Method", "CodeElement", "Community", "Process", "Struct", "Enum", "Macro", "Typedef", "Union",
    "Namespace", "Trait", "Impl", "TypeAlias", "Const", "Static", "Property", "Record", "Delegate", "Annotation", "Constructor", "Template", "Module",
)
RELATIONS = ("CONTAINS", "DEFINES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "MEMBER_OF", "STEP_IN_PROCESS")
IMPACT_RELATIONS = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")

SCHEMAS = {
    "files": "path string, language string, size bigint, is_binary boolean, content string",
    "nodes": "id string, name string, file_path string, start_line int, end_line int, language string, is_exported boolean, content string, description string, "
             "ast_fw_multiplier double, ast_fw_reason string, entry_point_score double, entry_point_reason string, ord bigint, label string",
    "edges": "id string, src string, dst string, confidence double, reason string, step int, ord bigint, type string",
    "symbols": "file_path string, name string, node_id string, type string, ord bigint",
    "imports": "file_path string, raw_import_path string, language string, ord bigint",
    "import_map": "file_path string, imported_path string",
    "calls": "file_path string, called_name string, source_id string, ord bigint",
    "heritage": "file_path string, class_name string, parent_name string, kind string, ord bigint",
    "routes": "file_path string, http_method string, route_path string, controller_name string, method_name string, middleware array<string>, prefix string, line int",
    "communities": "id string, label string, name string, heuristic_label string, keywords array<string>, description string, enriched_by string, cohesion double, symbol_count int",
    "processes": "id string, label string, process_type string, step_count int, communities array<string>, entry string, terminal string",
    "embeddings": "node_id string, embedding array<float>",
}

def conform(frame: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others go."""
    out = []
    for part in _columns(SCHEMAS[table]):
        name, kind = part
        out.append(F.col(name).cast(kind).alias(name) if name in frame.columns else F.lit(None).cast(kind).alias(name))
    return frame.select(*out)


def _columns(ddl: str) -> list[tuple[str, str]]:
    parts = [p.strip() for p in ddl.split(", ")]
    return [tuple(p.split(" ", 1)) for p in parts]
