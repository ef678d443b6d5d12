"""Jobs, cached analyses and project lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.operators import search as index
from codecorpus.shipping import dealt

# -- fixed values --------------------------------------------------------------------------------------------------
ACTIVE = ("queued", "extracting", "analyzing", "generating")
INTERRUPTIBLE = ("queued", "extracting", "analyzing")
PROGRESS = {"queued": ("Queued", 25), "extracting": ("Extracting", 50), "analyzing": ("Analyzing", 75), "generating": ("Generating", 75), "completed": ("Completed", 100), "failed": ("Failed", 100)}
# ------------------------------------------------------------------------------------------------------------------
#: Symbols whose names one task collects, about.
SYMBOLS = 1 << 18


def cache_probe(projects: DataFrame, analyses: DataFrame, version: str, forced: bool = False, project: str = "project_id") -> DataFrame:
    """projects with cache: hit if a record of the version has the content hash, else miss; or forced."""
    known = analyses.where(F.col("analyzer_version") == version).select(project, "content_hash", F.lit(True).alias("_hit")).distinct()
    joined = projects.join(known, [project, "content_hash"], "left")
    return joined.withColumn("cache", F.lit("forced") if forced else F.when(F.col("_hit"), "hit").otherwise("miss")).drop("_hit")


def work_list(projects: DataFrame, analyses: DataFrame, version: str, project: str = "project_id") -> DataFrame:
    return projects.join(analyses.where(F.col("analyzer_version") == version), [project, "content_hash"], "left_anti")


def stale_language(modules: DataFrame, files: DataFrame, project: str = "project_id") -> DataFrame:
    """project, stale: whether a module's language differs from its file's."""
    own = files.select(project, "relative_path", F.col("language").alias("_language"))
    return modules.join(own, [project, "relative_path"], "left").groupBy(project).agg(F.coalesce(F.bool_or(F.col("language") != F.col("_language")), F.lit(False)).alias("stale"))


def active_job(requests: DataFrame, jobs: DataFrame, keys: tuple[str, ...] = ("project_id", "source_type")) -> DataFrame:
    """requests with the newest active job of their project and type, or null where a new one is due."""
    busy = jobs.where(F.col("state").isin(*ACTIVE)).groupBy(*keys).agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("reused_job"))
    return requests.join(busy, list(keys), "left")


def latest_job(jobs: DataFrame, keys: tuple[str, ...] = ("project_id", "source_type")) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.max_by(F.struct("job_id", "state"), F.struct("created_at", "job_id")).alias("j")).select(*keys, "j.job_id", "j.state")


def recent(rows: DataFrame, n: int = 12, order: str = "created_at", tie: str = "job_id") -> DataFrame:
    """The newest n, at least 1 and at most 50."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(max(1, min(50, n)))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart cut off fail with INTERRUPTED."""
    cut = F.col("state").isin(*INTERRUPTIBLE)
    return jobs.withColumn("error_code", F.when(cut, "INTERRUPTED")).withColumn("state", F.when(cut, "failed").otherwise(F.col("state")))


def job_progress(jobs: DataFrame) -> DataFrame:
    """Adds stage and progress by state."""
    stage = F.create_map(*[F.lit(x) for k, (t, _) in PROGRESS.items() for x in (k, t)])
    done = F.create_map(*[F.lit(x) for k, (_, p) in PROGRESS.items() for x in (k, p)])
    return jobs.withColumns({"stage": F.try_element_at(stage, F.col("state")), "progress": F.try_element_at(done, F.col("state"))})


def job_error(code) -> object:
    """A message for an error code."""
    return F.when(code.isNotNull(), F.format_string("The job failed with %s.", code))


def file_inventory(files: DataFrame, project: str = "project_id") -> DataFrame:
    """files with file_count, the files of their project: small counts meet the rows, which are never gathered by project."""
    counts = files.groupBy(F.col(project).alias("_project")).agg(F.count(F.lit(1)).alias("file_count"))
    own = files.drop("file_count")
    return own.join(counts, own[project].eqNullSafe(counts["_project"])).drop("_project")


def search(rows: DataFrame, query: str, *columns: str, key: str | None = None, postings: str | None = None) -> DataFrame:
    """Rows of which a column holds the query, whatever its case; an empty query keeps all. Array columns match by element. With
    `postings` (of these columns, by key) only the rows that these name are looked at."""
    if postings:
        return index.search_postings(rows, key, query, columns, postings)
    return rows.where(index.holds(rows, query, columns)) if query.strip() else rows


def module_texts(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """module_id, texts: a module's path and the names of its functions and classes, as `search_modules` looks through them."""
    names = dealt(symbols.select("module_id", "kind", "name"), SYMBOLS, "module_id").where(F.col("kind").isin("function", "class")).groupBy("module_id").agg(F.collect_set("name").alias("_names"))
    own = modules.select("module_id", "relative_path").join(names, "module_id", "left")
    return own.select("module_id", F.concat(F.array("relative_path"), F.coalesce("_names", F.array().cast("array<string>"))).alias("texts"))


def search_modules(modules: DataFrame, symbols: DataFrame, query: str, language: str = "all", postings: str | None = None) -> DataFrame:
    """Modules whose path, or the name of a function or class of which, holds the query; with `postings` (of `module_texts`, by
    module_id) only the modules that these name are read further."""
    own = modules if language == "all" else modules.where(F.col("language") == language)
    found = index.candidates(modules.sparkSession, postings, query) if postings else None
    if found is not None:
        near = found.withColumnRenamed("key", "module_id")
        own, symbols = own.join(near, "module_id", "left_semi"), symbols.join(near, "module_id", "left_semi")
    q = F.lit(query.strip().lower())
    named = symbols.where(F.col("kind").isin("function", "class") & F.contains(F.lower("name"), q)).select("module_id", F.lit(True).alias("_named")).distinct()
    return own.join(named, "module_id", "left").where(F.contains(F.lower("relative_path"), q) | F.col("_named")).drop("_named")


def project_metadata(projects: DataFrame, project_id, hidden: tuple[str, ...] = ("workspace_id",), project: str = "project_id") -> DataFrame:
    """The rows of one project, without the columns that stay inside."""
    return projects.where(F.col(project) == project_id).drop(*hidden)
