"""Planned tests, their results and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s


def public_functions(symbols: DataFrame, language: str = "python") -> DataFrame:
    name = F.col("name")
    hidden = F.startswith(name, F.lit("_"))
    return symbols.where(~hidden | F.startswith(name, F.lit("__init__")) if language == "python" else ~hidden)


def testable_modules(modules: DataFrame) -> DataFrame:
    return modules.where((F.col("parse_status") != "failed") & F.col("language").isin("python", "javascript", "typescript"))


# -- fixed values --------------------------------------------------------------------------------------------------
STRATEGIES = ("import_smoke", "callable_existence", "export_existence", "simple_execution", "boundary_value", "class_instantiation")
#: What JavaScript functions are called with, whatever their parameters.
SCRIPT_ARGUMENTS = "10, 'test'"
# ------------------------------------------------------------------------------------------------------------------


def plan_tests(modules: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """module_id, strategy, target, arguments: a smoke test of the import for each module; for each function that it
    exists and runs, and in Python its bounds where one to three parameters are more than the receiver; that each class
    can be instantiated.

    modules: module_id, relative_path, language; functions: module_id, name, parameters (array of names).
    """
    smoke_name, callable_name, export_name, run_name, bound_name, class_name = (F.lit(x).alias("strategy") for x in STRATEGIES)
    empty = F.lit("").alias("arguments")
    smoke = modules.select("module_id", smoke_name, F.col("relative_path").alias("target"), empty)
    script = modules.select("module_id", F.col("language").isin("javascript", "typescript").alias("_script"))
    called = functions.select("module_id", "name", "parameters").join(script, "module_id")
    own = F.filter("parameters", lambda p: ~s.is_receiver(p))
    values = F.when(F.col("_script"), SCRIPT_ARGUMENTS).otherwise(F.array_join(F.transform(own, s.infer_argument), ", "))
    bounds = F.array_join(F.transform(own, s.boundary_argument), ", ")
    exists = called.select("module_id", F.when(F.col("_script"), export_name).otherwise(callable_name).alias("strategy"), F.col("name").alias("target"), empty)
    runs = called.select("module_id", run_name, F.col("name").alias("target"), values.alias("arguments"))
    limits = called.where(~F.col("_script") & (F.size("parameters") <= 3) & (F.size(own) > 0)).select("module_id", bound_name, F.col("name").alias("target"), bounds.alias("arguments"))
    made = classes.select("module_id", class_name, F.col("name").alias("target"), empty)
    return smoke.unionByName(exists).unionByName(runs).unionByName(limits).unionByName(made)


def plan_rollup(plan: DataFrame) -> DataFrame:
    return plan.groupBy("module_id").agg(F.count(F.lit(1)).alias("test_count"), F.array_sort(F.collect_set("strategy")).alias("strategies"))


def test_rollup(test_files: DataFrame, project: str = "project_id") -> DataFrame:
    state = F.col("execution_status")
    return test_files.groupBy(project).agg(
        F.sum("test_count").alias("tests"), F.count_if("syntax_valid").alias("syntax_valid"), F.count_if(state.isin("passed", "failed")).alias("executed"),
        F.count_if(state == "passed").alias("passed"), F.count_if(state == "failed").alias("failed"), F.array_sort(F.collect_set("framework")).alias("frameworks"),
    )


def test_bundle(test_files: DataFrame) -> DataFrame:
    return test_files.where("syntax_valid and download_eligible")


def iteration_log(test_files: DataFrame, project: str = "project_id", enough: float = 60.0) -> DataFrame:
    """Each pass up to the first that covers enough: tests, valid files, mean coverage."""
    log = test_files.groupBy(project, "iteration").agg(F.sum("test_count").alias("tests"), F.count_if("syntax_valid").alias("valid"), F.bround(F.avg("line_coverage"), 1).alias("coverage"))
    stop = log.where(F.col("coverage") >= enough).groupBy(project).agg(F.min("iteration").alias("stop"))
    return log.join(stop, project, "left").where(F.col("stop").isNull() | (F.col("iteration") <= F.col("stop"))).drop("stop")


def match_coverage_paths(coverage: DataFrame, targets: DataFrame, project: str = "project_id", path: str = "path", target: str = "target", order: str = "ord") -> DataFrame:
    """coverage rows with the first target in order that a path is or ends with, after a /. Every suffix of a path is
    looked up, which keeps this an equi-join; rows without one go."""
    clean = lambda c: F.regexp_replace(F.translate(c, "\\", "/"), r"^[./]+", "")
    parts = F.split(clean(F.col(path)), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    spread = coverage.select(project, path, F.explode(suffixes).alias("_suffix")).distinct()
    known = targets.select(project, clean(F.col(target)).alias("_suffix"), F.col(target).alias("target"), F.col(order).alias("_o"))
    first = spread.join(known, [project, "_suffix"]).groupBy(project, path).agg(F.min_by("target", "_o").alias("target"))
    return coverage.join(first, [project, path])


def coverage_rollup(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of lines, one decimal, half to even: 100 for files without statements; 0 for projects without."""
    c, n = F.sum("covered"), F.sum("statements")
    return matched.groupBy(*keys).agg(c.alias("covered"), n.alias("statements"), F.when(n > 0, F.bround(c / n * 100, 1)).otherwise(100.0 if len(keys) > 1 else 0.0).alias("coverage"))
