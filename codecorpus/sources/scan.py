"""Reading trees of source files and coverage reports; writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.operators.inventory import IGNORED_FOLDERS
from codecorpus.shipping import ship
from codecorpus.sources.trees import TreeSource

MAX_FILE_BYTES = 50 * 1024 * 1024
COVERAGE = "struct<files:map<string,struct<summary:struct<num_statements:int,covered_lines:int,percent_covered:double>,executed_lines:array<int>,missing_lines:array<int>>>>"


def scan_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, ignored: tuple[str, ...] = IGNORED_FOLDERS, hidden_folders: bool = False, content: bool = True) -> DataFrame:
    """project_id, relative_path, content, size_bytes of every file under root/<project>/..., whatever its name.

    Ignored folders (in any case), folders whose names begin with a dot and files over max_bytes are left out while
    listing; projects may have any name. Files in the root itself have the project "". Links to folders aren't followed; a
    file that can't be read has a null content, as all have without `content`. Filters on project_id prune the listing."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"maxBytes": max_bytes, "ignoredFolders": ",".join(ignored), "hiddenFolders": hidden_folders, "content": content, "partitions": 4 * spark.sparkContext.defaultParallelism}
    return ship(spark).read.format("source_tree").options(**options).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Files (project_id, relative_path, content: text or bytes) as root/<project>/<path>. Rows of one file that follow each other
    in a partition are pieces of it, in their order. Paths that leave their project are an error."""
    spark = files.sparkSession
    spark.dataSource.register(TreeSource)
    ship(spark)
    files.select("project_id", "relative_path", "content").write.format("source_tree").mode("append").save(root)


def write_lines(lines: DataFrame, root: str, name: str, order: list[str], project: str = "project_id") -> None:
    """Each project's lines in order as one file root/<project>/<name>: sorted in the shuffle and streamed to the file, so no
    row or task holds a whole file. Lines are joined by line feeds; there is none at the end."""
    later = F.lag(F.lit(True)).over(Window.partitionBy(project).orderBy(*order)).isNotNull()
    pieces = lines.select(F.col(project).alias("project_id"), F.lit(name).alias("relative_path"), *order, F.concat(F.when(later, "\n").otherwise(""), "line").alias("content"))
    write_tree(pieces.sortWithinPartitions("project_id", *order), root)


def delete_tree(spark: SparkSession, root: str) -> None:
    """Removes a folder and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_coverage_json(reports: DataFrame, body: str = "body") -> DataFrame:
    """One row for each file of a coverage.py report; a malformed or absent report gives none."""
    parsed = reports.withColumn("_c", F.from_json(body, COVERAGE))
    files = parsed.select(*[c for c in reports.columns if c != body], F.explode("_c.files").alias("path", "f"))
    return files.select(*[c for c in files.columns if c != "f"], F.coalesce("f.summary.num_statements", F.lit(0)).alias("statements"), F.coalesce("f.summary.covered_lines", F.lit(0)).alias("covered"), F.col("f.executed_lines").alias("covered_lines"), F.col("f.missing_lines").alias("missing_lines"))


def write_by_project(df: DataFrame, path: str, project: str = "project_id") -> None:
    """Replaces the written projects' records and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(project).parquet(path)


def to_api_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the whole row as one JSON payload."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("payload"))
