"""Aggregates of modules, warnings and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s


def module_complexity(modules: DataFrame, symbols: DataFrame, high: int = 10) -> DataFrame:
    """module_id, cyclomatic_complexity (1 without symbols), rating, hotspots_count."""
    per = symbols.groupBy("module_id").agg(F.max("complexity").alias("c"), F.count_if(F.col("complexity") > high).alias("h"))
    joined = modules.select("module_id").join(per, "module_id", "left")
    return joined.select("module_id", F.coalesce("c", F.lit(1)).alias("cyclomatic_complexity"), F.coalesce("h", F.lit(0)).alias("hotspots_count")).withColumn("rating", s.complexity_rating(F.col("cyclomatic_complexity")))


def parse_status_counts(modules: DataFrame, project: str = "project_id") -> DataFrame:
    return modules.groupBy(project).agg(*[F.count_if(F.col("parse_status") == x).alias(x) for x in ("complete", "partial", "failed")])


def project_totals(modules: DataFrame, project: str = "project_id") -> DataFrame:
    known = F.when(F.col("language") != "unknown", F.col("language"))
    return modules.groupBy(project).agg(F.count(F.lit(1)).alias("total_files"), F.sum("line_count").alias("total_lines"), F.array_sort(F.collect_set(known)).alias("languages"), F.array_sort(F.collect_list(F.when(F.col("is_entry_point"), F.col("relative_path")))).alias("entry_points"))


def project_warnings(modules: DataFrame, warnings: DataFrame) -> DataFrame:
    """module_id, code, message, severity: all warnings, and one PARSE_ERROR for each error of a module (parse_errors)."""
    errors = modules.select("module_id", "relative_path", F.explode("parse_errors").alias("e"))
    rows = errors.select("module_id", F.lit("PARSE_ERROR").alias("code"), F.concat("relative_path", F.lit(": "), "e").alias("message"), F.lit("risk").alias("severity"))
    return warnings.select("module_id", "code", "message", "severity").unionByName(rows)


def warning_weight(warnings: DataFrame, keys: list[str]) -> DataFrame:
    return warnings.groupBy(*keys).agg(F.sum(s.severity_weight(F.col("severity"))).alias("warning_weight"), F.count(F.lit(1)).alias("warning_count"))


def node_metrics(modules: DataFrame, symbols: DataFrame, warnings: DataFrame) -> DataFrame:
    n = symbols.groupBy("module_id").agg(F.count(F.lit(1)).alias("symbol_count"))
    w = warnings.groupBy("module_id").agg(F.count(F.lit(1)).alias("warning_count"))
    return modules.join(n, "module_id", "left").join(w, "module_id", "left").fillna(0, ["symbol_count", "warning_count"])


def edge_resolution_counts(edges: DataFrame, project: str = "project_id") -> DataFrame:
    return edges.groupBy(project).agg(F.count_if("resolved").alias("resolved_edges"), F.count_if(~F.col("resolved")).alias("unresolved_edges"))


def module_counts(modules: DataFrame, symbols: DataFrame, warnings: DataFrame) -> DataFrame:
    """module_id, classes, functions, codes (sorted and distinct)."""
    n = symbols.groupBy("module_id").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"))
    w = warnings.groupBy("module_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return modules.select("module_id").join(n, "module_id", "left").join(w, "module_id", "left").fillna(0, ["classes", "functions"]).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def warning_groups(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("module_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", F.struct("ord", "severity")).alias("severity"))


def first_n(df: DataFrame, n: int, keys: list[str], order: list, value: str) -> DataFrame:
    """keys and the first n values in order; where the order leaves it open, the lesser value comes first."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, value))).where(F.col("_r") <= n)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias(value))


def largest_modules(modules: DataFrame, k: int = 3, project: str = "project_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(project).orderBy(F.desc("line_count"), "relative_path"))
    return modules.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_calls_in_order(calls: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """keys and the distinct names in the order of their first use."""
    firsts = calls.groupBy(*keys, name).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", name))), lambda x: x[name]).alias("calls"))


def top_symbol_names(symbols: DataFrame, n: int = 4) -> DataFrame:
    """module_id and its first names, classes before functions."""
    kind = F.when(F.col("kind") == "class", 0).otherwise(1)
    return first_n(symbols.where("kind <> 'variable'").withColumn("_k", kind), n, ["module_id"], ["_k", "ord"], "name")


def hotspot_lines(modules: DataFrame, complexity: DataFrame, n: int = 5) -> DataFrame:
    line = F.concat(F.lit("Module '"), "relative_path", F.lit("' has "), F.col("hotspots_count").cast("string"), F.lit(" high-complexity function(s)."))
    hot = modules.join(complexity.select("module_id", "hotspots_count"), "module_id").where("hotspots_count > 0").withColumn("line", line)
    return first_n(hot, n, ["project_id"], ["relative_path"], "line")


def risk_lines(modules: DataFrame, warnings: DataFrame, n: int = 10) -> DataFrame:
    line = F.concat(F.lit("'"), "relative_path", F.lit("' [Line "), F.coalesce("line", F.lit(1)).cast("string"), F.lit("]: "), "message")
    rows = warnings.where(F.col("severity").isin("risk", "warning")).join(modules.select("module_id", "project_id", "relative_path"), "module_id").withColumn("line", line)
    return first_n(rows, n, ["project_id"], ["relative_path", "ord"], "line")


def parse_limit_lines(modules: DataFrame, n: int = 5) -> DataFrame:
    line = F.concat(F.lit("Module '"), "relative_path", F.lit("' parsed with status '"), "parse_status", F.lit("'."))
    return first_n(modules.where("parse_status <> 'complete'").withColumn("line", line), n, ["project_id"], ["relative_path"], "line")


def union_warnings(*sources: DataFrame) -> DataFrame:
    """Warnings of modules, symbols and the parser as one table; what a source lacks is null."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
