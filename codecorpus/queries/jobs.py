"""Jobs, caches, lists and searches."""

import uuid

from pyspark.sql import functions as F

from codecorpus.operators import graph
from codecorpus.operators import jobs as op
from codecorpus.operators import search as index
from codecorpus.queries.register import adder
from codecorpus.shipping import shared_folder
from codecorpus.sources import scan

ALL: dict = {}
add = adder(ALL)


def _projects(j):
    return j.groupBy("project_id").agg(F.max("job_id").alias("content_hash"))


def _analyses(j):
    return _projects(j).where("project_id % 3 <> 0").select("project_id", F.when(F.col("project_id") % 2 == 0, F.col("content_hash")).otherwise(-1).alias("content_hash"), F.when(F.col("project_id") % 5 == 0, "1").otherwise("2").alias("analyzer_version"))


_P = "p AS (SELECT project_id, max(job_id) AS content_hash FROM v_jobs GROUP BY 1)"
add("j5_cache_probe", "v_jobs", lambda j: op.cache_probe(_projects(j), _analyses(j), "2"), f"WITH {_P} SELECT *, CASE WHEN project_id % 3 <> 0 AND project_id % 2 = 0 AND project_id % 5 <> 0 THEN 'hit' ELSE 'miss' END AS cache FROM p")
add("j5_work_list", "v_jobs", lambda j: op.work_list(_projects(j), _analyses(j), "2"), f"WITH {_P} SELECT * FROM p WHERE NOT (project_id % 3 <> 0 AND project_id % 2 = 0 AND project_id % 5 <> 0)")
add("j6_stale_language", "v_modules", lambda m: op.stale_language(m, m.withColumn("language", F.when(F.col("module_id") % 50 == 0, "typescript").otherwise(F.col("language")))), "SELECT project_id, bool_or(module_id % 50 = 0) AS stale FROM v_modules GROUP BY 1")
add("j14_active_job", "v_jobs", lambda j: op.active_job(j.select("project_id", "source_type").distinct(), j), "SELECT project_id, source_type, arg_max(job_id, (created_at, job_id)) FILTER (state IN ('queued', 'analyzing')) AS reused_job FROM v_jobs GROUP BY 1, 2")
add("w10_latest_job", "v_jobs", op.latest_job, "SELECT project_id, source_type, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(state, (created_at, job_id)) AS state FROM v_jobs GROUP BY 1, 2")
add("w9_recent_projects", "v_jobs", lambda j: op.recent(j, 12).select("job_id", "created_at"), "SELECT job_id, created_at FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 12")
add("o4_recover_interrupted", "v_jobs", lambda j: op.recover_interrupted(j).select("job_id", "state", "error_code"), "SELECT job_id, CASE WHEN state IN ('queued', 'analyzing') THEN 'failed' ELSE state END AS state, CASE WHEN state IN ('queued', 'analyzing') THEN 'INTERRUPTED' END AS error_code FROM v_jobs")
add("f22_job_error", "v_jobs", lambda j: op.recover_interrupted(j).select("job_id", op.job_error(F.col("error_code")).alias("error")), "SELECT job_id, CASE WHEN state IN ('queued', 'analyzing') THEN 'The job failed with INTERRUPTED.' END AS error FROM v_jobs")
add("o5_job_progress", "v_jobs", lambda j: op.job_progress(j).select("job_id", "stage", "progress"), "SELECT job_id, CASE state WHEN 'completed' THEN 'Completed' WHEN 'queued' THEN 'Queued' ELSE 'Analyzing' END AS stage, CAST(CASE state WHEN 'completed' THEN 100 WHEN 'queued' THEN 25 ELSE 75 END AS INT) AS progress FROM v_jobs")
add("p1_project_metadata", "v_jobs", lambda j: op.project_metadata(j.withColumn("workspace_id", F.lit("w")), 37), "SELECT * FROM v_jobs WHERE project_id = 37")
add("p2_file_inventory", "v_files", lambda f: op.file_inventory(f).select("doc_id", "project_id", "file_count"), "SELECT doc_id, project_id, count(*) OVER (PARTITION BY project_id) AS file_count FROM v_files")


def _posted(rows, key, columns, find):
    """What find(path) gives with the postings of rows in the shared folder."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    index.write_postings(rows, key, columns, path)
    found = graph.settled(find(path))
    scan.delete_tree(spark, path)
    return found


def _languages(j):
    return j.withColumn("languages", F.array("state"))


add("p4_search_modules", "v_modules v_symbols", lambda m, y: _posted(op.module_texts(m, y), "module_id", ("texts",), lambda path: op.search_modules(m, y, "FN_1", "python", path).select("module_id")), "SELECT module_id FROM v_modules WHERE language = 'python' AND (contains(lower(relative_path), 'fn_1') OR module_id IN (SELECT module_id FROM v_symbols WHERE kind IN ('function', 'class') AND contains(name, 'fn_1')))")
add("p5_search_impacts", "v_modules", lambda m: op.search(m, " Bl ", "relative_path").select("module_id"), "SELECT module_id FROM v_modules WHERE contains(lower(relative_path), 'bl')")
add("p5_search_postings", "v_modules", lambda m: _posted(m, "module_id", ("relative_path",), lambda path: op.search(m, " blue/", "relative_path", key="module_id", postings=path).select("module_id")), "SELECT module_id FROM v_modules WHERE contains(lower(relative_path), 'blue/')")
add("p6_search_projects", "v_jobs", lambda j: _posted(_languages(j), "job_id", ("source_type", "languages"), lambda path: op.search(_languages(j), "queue", "source_type", "languages", key="job_id", postings=path).select("job_id")), "SELECT job_id FROM v_jobs WHERE contains(lower(source_type), 'queue') OR contains(state, 'queue')")
