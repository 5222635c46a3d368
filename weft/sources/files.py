"""Source trees as DataFrames: scans that read paths and sizes only, contents on demand, and zip archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths, text

MAX_FILE = 512 * 1024
SCHEMA = "path string, content string, size long, is_binary boolean"


def _below(spark: SparkSession, root: str):
    """The root as the scan will spell it, for cutting it off paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full.rstrip("/") + "/"


def scan(spark: SparkSession, root: str, patterns=(), static: bool = True, languages=None, without=(), max_size: int | None = MAX_FILE, dotfiles: bool = False) -> DataFrame:
    """path (below root), size, language of every file worth reading. Contents are not read.

    patterns: lines of ignore files, on top of the default ones. static: also apply the fixed lists of folders, names and
    endings. Files without a language are left out; languages and without narrow further; larger files are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    base = _below(spark, root)
    out = raw.select(_relative(F.col("path"), base).alias("path"), F.col("length").alias("size"))
    out = out.withColumn("language", paths.language(F.col("path"))).where(paths.not_ignored(F.col("path"), (*paths.DEFAULT_PATTERNS, *patterns)))
    if static:
        out = out.where(~paths.is_ignored(F.col("path")))
    if not dotfiles:
        out = out.where(~F.col("path").rlike(r"(^|/)\."))
    out = out.where("language is not null")
    if languages is not None:
        out = out.where(F.col("language").isin(*languages))
    if without:
        out = out.where(~F.col("language").isin(*without))
    return out.where(F.col("size") <= max_size) if max_size else out


def _relative(path, base: str):
    """Paths of a scan come as scheme:/a or scheme:///a; both lose the root."""
    flat = F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    scheme, _, rest = base.partition(":")
    start = f"{scheme}:/{rest.lstrip('/')}" if rest else base
    return F.when(F.startswith(flat, F.lit(start)), F.substring(flat, len(start) + 1, 1 << 20)).otherwise(path)


def contents(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """path, content, size, is_binary. Files that cannot be read are left out; binary ones have no content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    base = _below(spark, root)
    rows = raw.select(_relative(F.col("path"), base).alias("path"), "content", F.col("length").alias("size"))
    if wanted is not None:
        rows = rows.join(wanted.select("path"), "path", "left_semi")
    odd = text.is_binary_bytes(F.col("content"))
    return rows.select("path", F.when(~odd, F.decode("content", "UTF-8")).alias("content"), "size", odd.alias("is_binary"))


def from_zip(spark: SparkSession, path: str) -> DataFrame:
    """path, content, size, is_binary of the files in one or more archives; a folder shared by all files of an archive is cut off."""
    def unpack(batches):
        for batch in batches:
            for blob in batch["content"]:
                out = []
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    first = {n.split("/", 1)[0] for n in names if "/" in n}
                    cut = len(next(iter(first))) + 1 if len(first) == 1 and all("/" in n for n in names) else 0
                    for n in names:
                        data = z.read(n)
                        odd = b"\0" in data[:8192]
                        out.append((n[cut:], None if odd else data.decode("utf-8", "replace"), len(data), odd))
                yield pd.DataFrame(out, columns=["path", "content", "size", "is_binary"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, SCHEMA)


def count_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def skipped_by_language(files: DataFrame) -> DataFrame:
    """Files that no extractor reads, by language."""
    return count_by_language(files.where(~F.col("language").isin(*paths.PARSEABLE)))
