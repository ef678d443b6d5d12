"""Change impact, readiness, priorities and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators import graph, quality

# -- fixed values --------------------------------------------------------------------------------------------------
PHASES = (
    (1, "Build the safety net", 5),
    (2, "Apply low-risk improvements", 8),
    (3, "Untangle shared modules", 8),
    (4, "Modernize entry points", 8),
)
# what impact_reasons says of a module, in this order
AFFECTS, SUGGESTS, RATED, ENTRY, NOTHING = (
    ("Changes can affect ", " downstream file(s)."),
    ("Contains ", " modernization suggestion(s)."),
    ("Complexity is rated ", "."),
    "This is an application entry point.",
    "No major static-analysis risk indicators were found.",
)
CATEGORIES = ("analysis", "complexity", "coupling", "maintainability", "testability")
# ------------------------------------------------------------------------------------------------------------------


def tests_by_target(modules: DataFrame, test_files: DataFrame, project: str = "project_id") -> DataFrame:
    """module_id, suggested_tests: sorted test paths, or one placeholder."""
    found = test_files.groupBy(project, F.col("target_relative_path").alias("relative_path")).agg(F.array_sort(F.collect_list("safe_test_path")).alias("t"))
    placeholder = F.array(F.concat(F.lit("Generate tests for "), "relative_path"))
    return modules.join(found, [project, "relative_path"], "left").select("module_id", F.coalesce("t", placeholder).alias("suggested_tests"))


def impact_reasons(blast: Column, warnings: Column, rating: Column, is_entry: Column) -> Column:
    """Up to four sentences, or one that nothing was found."""
    said = lambda parts, x: F.concat(F.lit(parts[0]), x.cast("string"), F.lit(parts[1]))
    found = F.filter(F.array(F.when(blast > 0, said(AFFECTS, blast)), F.when(warnings > 0, said(SUGGESTS, warnings)), F.when(rating.isin("high", "critical"), said(RATED, rating)), F.when(is_entry, F.lit(ENTRY))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NOTHING)))


def scored_modules(modules: DataFrame, edges: DataFrame, warnings: DataFrame, listed: bool = True) -> DataFrame:
    """modules with warning_weight, warning_count, blast_radius, entry_count, with listed affected_entry_points, rating, raw_risk,
    risk_level. modules hold complexity. See `graph.dependent_facts` on listed."""
    weights = quality.warning_weight(warnings, ["module_id"])
    joined = modules.join(graph.dependent_facts(modules, edges, listed=listed), "module_id").join(weights, "module_id", "left").fillna(0, ["warning_weight", "warning_count"])
    rated = joined.withColumn("rating", s.complexity_rating(F.col("complexity")))
    raw = rated.withColumn("raw_risk", s.raw_risk(F.col("warning_weight"), F.col("rating"), F.col("blast_radius"), F.col("is_entry_point")))
    return raw.withColumn("risk_level", s.risk_level(F.col("raw_risk")))


def change_impact(modules: DataFrame, edges: DataFrame, warnings: DataFrame, test_files: DataFrame, listed: bool = True) -> DataFrame:
    """One row for each module: risk, blast radius, neighbours, entry points (with listed; always their number), tests and reasons."""
    scored = scored_modules(modules, edges, warnings, listed)
    out = scored.withColumn("reasons", impact_reasons(F.col("blast_radius"), F.col("warning_count"), F.col("rating"), F.col("is_entry_point")))
    for more in (graph.direct_neighbours(modules, edges), tests_by_target(modules, test_files)):
        out = out.join(more, "module_id")
    return out


def _order() -> list[Column]:
    return [F.desc(s.risk_rank(F.col("risk_level"))), F.desc("blast_radius"), F.asc("relative_path")]


def rank_impacts(impacts: DataFrame, project: str = "project_id") -> DataFrame:
    return impacts.withColumn("rank", F.row_number().over(Window.partitionBy(project).orderBy(*_order())))


def top_priorities(impacts: DataFrame, k: int = 6, project: str = "project_id") -> DataFrame:
    return rank_impacts(impacts, project).where(F.col("rank") <= k)


def phase_files(impacts: DataFrame, project: str = "project_id") -> DataFrame:
    """project, phase, title, files: paths in rank order. impacts hold warning_count, is_entry_point and entries (any affected entry point)."""
    risk = F.col("risk_level")
    member = {1: F.lit(True), 2: risk.isin("low", "medium") & (F.col("warning_count") > 0), 3: (F.col("blast_radius") > 0) | risk.isin("high", "critical"), 4: F.col("entries") | F.col("is_entry_point")}
    phases = F.filter(F.array(*[F.when(member[p], F.struct(F.lit(p).alias("phase"), F.lit(t).alias("title"), F.lit(n).alias("most"))) for p, t, n in PHASES]), lambda x: x.isNotNull())
    spread = impacts.select(project, "relative_path", "risk_level", "blast_radius", F.explode(phases).alias("p")).select(project, "relative_path", "risk_level", "blast_radius", "p.*")
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy(project, "phase").orderBy(*_order()))).where(F.col("r") <= F.col("most"))
    return ranked.groupBy(project, "phase", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "relative_path"))), lambda x: x["relative_path"]).alias("files"))


def readiness(modules: DataFrame, warnings: DataFrame, edges: DataFrame, cycle_counts: DataFrame, tests: DataFrame, project: str = "project_id") -> DataFrame:
    """project and the scores of the five categories, overall and status.

    modules: parse_status, complexity; edges: internal; cycle_counts: project, cycle_count; tests: project, generated,
    syntax_valid, coverage (null: not measured), job_state (of the latest generation, or null).
    """
    ids = modules.select("module_id", project)
    rated = s.complexity_rating(F.col("complexity")).isin("high", "critical")
    m = modules.groupBy(project).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parse_status") == "complete").alias("complete"), F.count_if(F.col("parse_status") == "partial").alias("partial"), F.count_if(rated).alias("high"))
    w = warnings.join(ids, "module_id").groupBy(project).agg(F.sum(s.severity_weight(F.col("severity"))).alias("weight"))
    e = edges.groupBy(project).agg(F.count(F.lit(1)).alias("edges"))
    joined = m.join(w, project, "left").join(e, project, "left").join(cycle_counts, project, "left").fillna(0, ["weight", "edges", "cycle_count"]).join(tests, project, "left")
    n = F.greatest(F.col("n"), F.lit(1))
    ratio = F.col("syntax_valid") / F.col("generated")
    busy, failed, some = F.col("job_state").isin("queued", "generating"), F.col("job_state") == "failed", F.coalesce("generated", F.lit(0)) > 0
    scores = {
        "analysis": s.bounded_score(100 * (F.col("complete") + F.col("partial") * 0.5) / n),
        "complexity": s.bounded_score(100 - F.col("high") / n * 100),
        "coupling": s.bounded_score(100 - F.least(F.lit(85.0), F.col("edges") / n * 18 + F.col("cycle_count") * 12)),
        "maintainability": s.bounded_score(100 - F.least(F.lit(85.0), F.col("weight") * 3 / n)),
        "testability": F.when(busy | failed | ~some, 35).otherwise(s.bounded_score(F.coalesce("coverage", F.lit(60.0)) * 0.6 + F.when(some, ratio) * 40)),
    }
    scored = joined.withColumns(scores)
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    out = scored.withColumn("overall", s.bounded_score(total * F.lit(2) / F.lit(10)))
    status = F.when(busy, "Calculating").when(failed, "Generation failed").when(~some, "Not calculated").otherwise(s.score_status(F.col("testability")))
    return out.withColumn("testability_status", status).select(project, *CATEGORIES, "testability_status", "overall", s.score_status(F.col("overall")).alias("status"))
