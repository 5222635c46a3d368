"""Changed files and what they touch, groupings of files, upserts and deletes, and evaluation metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.paths import is_ignored
from weft.functions.text import estimate_tokens, parse_run

PER_FILE = 20
MODULE_TOKENS, MODULE_FILES, NEW_FILES = 30_000, 3, 5


def changed_symbols(nodes: DataFrame, changed: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """path, id, name, label, file_path: at most per_file symbols, by id, of files whose path holds a changed one whole.

    A stored path holds a changed one if it is it, ends with it after a slash, or has it as a run of segments, so the
    runs of segments of the stored paths are joined on; partial segments do not count.
    """
    files = nodes.select("file_path").where("file_path is not null").distinct()
    parts = F.split("file_path", "/")
    starts = files.select("file_path", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    runs = starts.select("file_path", "p", "i", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("i") + 1)).alias("m")).select(
        "file_path", F.array_join(F.slice("p", F.col("i"), F.col("m")), "/").alias("path")).distinct()
    hit = changed.select(F.translate("path", "\\", "/").alias("path")).distinct().join(runs, "path").join(nodes, "file_path")
    order = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    return hit.withColumn("_k", order).where(F.col("_k") <= per_file).select("path", "id", "name", "label", "file_path")


def affected_processes(nodes: DataFrame, changed: DataFrame, steps: DataFrame) -> DataFrame:
    """process, changed_steps, symbols: the flows that changed symbols take part in. steps: id, process, step."""
    hit = changed_symbols(nodes, changed).join(steps, "id")
    return hit.groupBy("process").agg(F.count("*").alias("changed_steps"), F.array_sort(F.collect_set("name")).alias("symbols"))


def change_summary(nodes: DataFrame, changed: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: changed_count, affected_count, changed_files, risk_level."""
    a = changed_symbols(nodes, changed).agg(F.count("*").alias("changed_count"))
    b = affected_processes(nodes, changed, steps).agg(F.count("*").alias("affected_count"))
    c = changed.select("path").distinct().agg(F.count("*").alias("changed_files"))
    n = F.col("affected_count")
    risk = F.when(F.col("changed_files") == 0, "none").when(n == 0, "low").when(n <= 5, "medium").when(n <= 15, "high").otherwise("critical")
    return a.crossJoin(b).crossJoin(c).withColumn("risk_level", risk)  # three one-row aggregates


def chunk_by_budget(files: DataFrame, budget: int) -> DataFrame:
    """repo, ord, chunk: files in order, packed until a chunk would pass the budget; a larger file has a chunk alone.

    The fold runs inside each repository, over rows sorted by order (then size, nulls last): it holds a batch of rows and
    the chunk that is being filled. For plain reading the scan's own split size does this without a shuffle.
    """
    kinds = dict(files.dtypes)
    rows = files.select("repo", F.col("ord"), F.col("size")).repartition("repo")
    rows = rows.sortWithinPartitions(F.asc("repo"), F.asc_nulls_last("ord"), F.asc_nulls_last("size"))

    def pack(batches):
        last, chunk, filled = (), 0, 0
        for batch in batches:
            out = []
            for repo, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last != (repo,):
                    last, chunk, filled = (repo,), 0, 0
                if filled is None or size is None:
                    filled = None  # after an unknown size nothing is known to be over the budget
                elif filled > 0 and filled + size > budget:
                    chunk, filled = chunk + 1, size
                else:
                    filled += size
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out, pa.int32())], names=["repo", "ord", "chunk"])

    return rows.mapInArrow(pack, f"repo {kinds['repo']}, ord bigint, chunk int")


def module_tokens(files: DataFrame) -> DataFrame:
    """files: module, path, content. module, files, tokens, split: whether the module is too large for one page."""
    out = files.groupBy("module").agg(F.count("*").alias("files"), F.sum(estimate_tokens(F.coalesce("content", F.lit("")))).alias("tokens"))
    return out.withColumn("split", (F.col("tokens") > MODULE_TOKENS) & (F.col("files") > MODULE_FILES))


def split_modules(files: DataFrame) -> DataFrame:
    """module, part, path: files of too large modules by their first two folders, others by module."""
    large = module_tokens(files).where("split").select("module", F.lit(True).alias("_large"))
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    return files.join(large, "module", "left").select("module", F.when(F.col("_large"), folder).otherwise(F.col("module")).alias("part"), "path")


def by_top_folder(files: DataFrame) -> DataFrame:
    parts = F.split(F.translate("path", "\\", "/"), "/")
    return files.select(F.when(F.size(parts) > 1, parts[0]).otherwise("Root").alias("module"), "path")


def affected_modules(modules: DataFrame, changed: DataFrame) -> DataFrame:
    """module, full_run: modules with changed files; new ones go to Other, and over NEW_FILES of them ask for a full run. modules: module, path."""
    own = modules.groupBy("path").agg(F.min("module").alias("module"))
    known = changed.select("path").distinct().join(own, "path", "left")
    new = known.where(F.col("module").isNull() & ~is_ignored(F.col("path")))
    names = known.where("module is not null").select("module").union(new.select(F.lit("Other"))).distinct()
    return names.crossJoin(new.agg((F.count("*") > NEW_FILES).alias("full_run")))  # a one-row aggregate


def without_files(rows: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows of other files; rows without a file stay."""
    return rows.join(paths.select(F.col("path").alias(column)), column, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows with new ones put in or in place of those with the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def run_metrics(rows: DataFrame) -> DataFrame:
    """rows: run_id, instance_id, patch, cost, api_calls, tool_calls, augment_hits, augment_calls. One row a run; nulls count 0."""
    n = F.greatest(F.count("*"), F.lit(1))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    patched = F.count_if(F.coalesce(F.col("patch"), F.lit("")).rlike(r"\S"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n_instances"), patched.alias("n_with_patch"), (patched / n).alias("patch_rate"), total("cost").alias("total_cost"), (total("cost") / n).alias("avg_cost"),
        total("api_calls").alias("total_api_calls"), (total("api_calls") / n).alias("avg_api_calls"), total("tool_calls").alias("total_tool_calls"),
        (total("tool_calls") / n).alias("avg_tool_calls"), total("augment_hits").alias("total_augment_hits"), total("augment_calls").alias("total_augment_calls"),
        (total("augment_hits") / F.greatest(total("augment_calls"), F.lit(1))).alias("augment_hit_rate"))


def _by_mode(metrics: DataFrame) -> DataFrame:
    run = parse_run(F.col("run_id"))
    return metrics.withColumns({"model": run["model"], "mode": run["mode"]})


def mode_table(metrics: DataFrame, modes, measure: str = "patch_rate") -> DataFrame:
    """model and one column a mode."""
    return _by_mode(metrics).groupBy("model").pivot("mode", list(modes)).agg(F.max(measure))


def mode_deltas(metrics: DataFrame, base: str = "baseline") -> DataFrame:
    """model, mode, patch_rate, patch_rate_delta, cost_delta_pct against the model's base mode."""
    rows = _by_mode(metrics)
    b = rows.where(F.col("mode") == base).select("model", F.col("patch_rate").alias("_r"), F.col("avg_cost").alias("_c"))
    pct = F.when(F.col("_c") > 0, (F.col("avg_cost") - F.col("_c")) / F.col("_c") * 100)
    return rows.join(b, "model", "left").select("model", "mode", "patch_rate", (F.col("patch_rate") - F.col("_r")).alias("patch_rate_delta"), pct.alias("cost_delta_pct"))
