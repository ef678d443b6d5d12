"""Imports to dependency edges: candidate paths with priorities meet module paths in equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s

# -- fixed values --------------------------------------------------------------------------------------------------
STANDARD_LIBRARY = (
    "os", "sys", "re", "json", "math", "time", "datetime", "hashlib", "io", "pathlib", "shutil", "subprocess", "logging", "typing", "collections",
    "dataclasses", "unittest", "asyncio", "ast", "tokenize", "uuid", "random", "sqlite3", "urllib", "copy", "inspect", "functools", "itertools", "concurrent",
)
SUFFIXES = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", "/index.mjs", "/index.cjs")
# ------------------------------------------------------------------------------------------------------------------


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def python_candidates(name: Column, source_path: Column) -> Column:
    """Paths that an import may mean, best first; relative names climb from the source's folder; none for the standard library."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(name, r"^\.+", ""), ".", "/")
    up = F.concat(folder(source_path), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    base = F.when(dots > 0, s.normalize_path(F.concat_ws("/", up, rest))).otherwise(rest)
    standard = (dots == 0) & s.base_package(name).isin(*STANDARD_LIBRARY)
    whole = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    return F.when(standard | (name == ""), F.array().cast("array<string>")).otherwise(whole)


def javascript_candidates(name: Column, source_path: Column) -> Column:
    """Paths that a relative specifier may mean, best first."""
    base = s.normalize_path(F.concat_ws("/", folder(source_path), name))
    return F.when(F.startswith(name, F.lit(".")), F.array(*[F.concat(base, F.lit(x)) for x in SUFFIXES])).otherwise(F.array().cast("array<string>"))


def resolve(imports: DataFrame, modules: DataFrame, candidates: Callable[[Column, Column], Column], source_path: str, name: str) -> DataFrame:
    """imports with target_id, the first candidate that is a module of the project, or null.

    What an import means depends on its project, its source's folder and its name, so each such triple is looked up once,
    however many files hold it. Columns of imports may have any other names."""
    near = imports.withColumns({"_project": F.col("project_id"), "_folder": folder(F.col(source_path)), "_name": F.col(name)})
    asked = near.select("_project", "_folder", "_name").distinct()
    somewhere = F.when(F.col("_folder") == "", "_").otherwise(F.concat("_folder", F.lit("/_")))
    spread = asked.select("_project", "_folder", "_name", F.posexplode(candidates(F.col("_name"), somewhere)).alias("_priority", "_candidate"))
    paths = modules.select(F.col("project_id").alias("_project"), F.col("relative_path").alias("_candidate"), F.col("module_id").alias("target_id"))
    hits = spread.join(paths, ["_project", "_candidate"]).groupBy("_project", "_folder", "_name").agg(F.min_by("target_id", "_priority").alias("target_id"))
    return near.join(hits, ["_project", "_folder", "_name"], "left").drop("_project", "_folder", "_name")


def resolve_python_imports(imports: DataFrame, modules: DataFrame, keys: list[str] | None = None, source_path: str = "relative_path", name: str = "module_name") -> DataFrame:
    """See `resolve`; keys isn't needed any more."""
    return resolve(imports, modules, python_candidates, source_path, name)


def resolve_javascript_imports(imports: DataFrame, modules: DataFrame, keys: list[str] | None = None, source_path: str = "relative_path", name: str = "module_name") -> DataFrame:
    """See `resolve`; keys isn't needed any more."""
    return resolve(imports, modules, javascript_candidates, source_path, name)


def build_edges(resolved: DataFrame, kind: str = "import_kind") -> DataFrame:
    """edge_id, source_module_id, target_module_id, type, resolved, source_line. What isn't resolved keeps its name: the
    base package for the standard library, `external` for none."""
    name = F.col("module_name")
    outside = F.when(name == "", "external").when(s.base_package(name).isin(*STANDARD_LIBRARY), s.base_package(name)).otherwise(name)
    target = F.coalesce(F.col("target_id").cast("string"), outside)
    rows = resolved.select(F.col("module_id").alias("source_module_id"), target.alias("target_module_id"), F.col(kind).alias("type"), F.col("target_id").isNotNull().alias("resolved"), "source_line", *[c for c in resolved.columns if c == "project_id"])
    return dedup_edges(rows).withColumn("edge_id", s.edge_id(F.col("source_module_id"), F.col("target_module_id"), F.col("type"), F.col("source_line")))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source_module_id", "target_module_id", "type", "source_line"])


def split_external(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with is_external, and one node `ext:<target>` for each target that is no module."""
    known = modules.select(F.col("module_id").alias("target_module_id"), F.lit(True).alias("_known"))
    marked = edges.join(known, "target_module_id", "left").withColumn("is_external", F.col("_known").isNull()).drop("_known")
    nodes = marked.where("is_external").select(F.concat(F.lit("ext:"), F.col("target_module_id").cast("string")).alias("node_id"), F.col("target_module_id").alias("label")).distinct()
    return marked, nodes
