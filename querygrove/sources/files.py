"""File trees, documents and result folders as DataFrames."""

from __future__ import annotations

import uuid
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.operators.results import upsert_results
from querygrove.prims import rule_table, shared_base

BUNDLED_DOCS = ("planning.md", "security.md", "tuning.md")

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root``; paths relative to it.

    Content is read lazily: a query that does not use ``content`` lists files only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return relative(files, root)


def relative(files: DataFrame, root: str) -> DataFrame:
    prefix = root.rstrip("/") + "/"
    local = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?(?=/)", "")
    return files.select(
        F.substring(local, F.lit(len(prefix) + 1), F.length(local)).alias("path"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.col("length").alias("size"),
        "content",
    )


def bundled_docs(spark: SparkSession) -> DataFrame:
    """The documents shipped with the package."""
    folder = resources.files("querygrove") / "docs"
    rows = [(f"bundled:{name}", (folder / name).read_text(encoding="utf-8")) for name in BUNDLED_DOCS]
    return rule_table(spark, rows, "source string, content string")


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions of a store, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*")) or [])]
    done = [p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS"))]
    return sorted(done)


def write_results(results: DataFrame, folder: str) -> None:
    """Inserts or replaces results by key: nothing else in the store changes.

    Each write is a new version of the store, which readers see once it is
    complete; earlier versions stay until ``drop_old_versions``. One writer at a time.
    """
    spark = results.sparkSession
    versions = _versions(spark, folder)
    stored = read_version(spark, versions[-1]) if versions else results.limit(0)
    number = int(versions[-1].rsplit("=", 1)[1]) + 1 if versions else 1
    merged = upsert_results(stored.select(*results.columns), results)
    merged.write.partitionBy("domain").parquet(f"{folder}/version={number:08d}")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("domain", F.col("domain").cast("string"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """The latest complete version of a store."""
    return read_version(spark, _versions(spark, folder)[-1])


def drop_old_versions(spark: SparkSession, folder: str) -> None:
    """Deletes all versions but the latest."""
    jvm = spark.sparkContext._jvm
    for path in _versions(spark, folder)[:-1]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def subfolders(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths below ``folder`` whose name fits the glob ``pattern``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [found.getPath().toString() for found in (fs.globStatus(path) or [])]


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder within one file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot rename {source}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach: below the one the cluster names."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
