"""Explanations and Markdown reports."""

import uuid

from pyspark.sql import functions as F

from codecorpus.operators import graph, quality
from codecorpus.plans import migration
from codecorpus.plans import reports as op
from codecorpus.queries.plan import CLOSURE, PHASED, READY, SCORED, STATUS, _scored, _tests, _with_entries
from codecorpus.queries.register import adder
from codecorpus.shipping import shared_folder
from codecorpus.sources import scan

ALL: dict = {}
add = adder(ALL)


def _symbols(y):
    params = F.transform(F.sequence(F.lit(1), F.col("complexity") % 3 + 1), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("name"), F.when(i == 1, "int").alias("annotation"), F.when(i == 2, "0").alias("default")))
    return y.withColumns({"docstring": F.when(F.col("ord") % 3 == 0, "Does it.\nMore."), "parameters": F.when(F.col("ord") % 4 == 0, F.array().cast(y.select(params.alias("p")).schema["p"].dataType)).otherwise(params), "return_annotation": F.when(F.col("ord") % 5 == 0, "str"), "direct_calls": F.when(F.col("ord") % 2 == 0, F.array(*[F.lit(f"c{i}") for i in range(7)])).otherwise(F.array().cast("array<string>"))})


add(
    "f19_symbol_explanation", "v_symbols", lambda y: op.symbol_explanation(_symbols(y)).select("module_id", "ord", "summary", "inputs_summary", "returns_summary", "side_effects"),
    """SELECT module_id, ord, CASE WHEN ord % 3 = 0 THEN concat(upper(left(kind, 1)), substr(kind, 2), ' `', name, '`: Does it.') ELSE concat('This ', CASE WHEN is_async THEN 'asynchronous ' ELSE '' END, kind, ' is named `', name, '`. Its exact purpose is not documented, so the description is based on its name and code structure.') END AS summary,
    CASE WHEN ord % 4 = 0 THEN 'Accepts no parameters.' ELSE concat('Inputs: p1: int', CASE WHEN complexity % 3 >= 1 THEN ', p2 = 0' ELSE '' END, CASE WHEN complexity % 3 >= 2 THEN ', p3' ELSE '' END, '.') END AS inputs_summary,
    CASE WHEN ord % 5 = 0 THEN 'Returns: str.' ELSE 'The return type is not declared in the code.' END AS returns_summary, CASE WHEN ord % 2 = 0 THEN 'It calls: c0, c1, c2, c3, c4.' ELSE 'No direct function calls were detected.' END AS side_effects FROM v_symbols""",
)


def _explained(m, y, w):
    counted = quality.module_counts(m, y, w).join(quality.top_symbol_names(y).withColumnRenamed("name", "names"), "module_id", "left")
    return op.module_explanation(m.join(counted, "module_id").withColumns({"imports": F.col("complexity"), "exports": F.col("complexity") + 1, "warning_count": F.size("codes"), "language": F.col("language")}))


add(
    "f20_module_explanation", "v_modules v_symbols v_warnings", lambda m, y, w: _explained(m, y, w).select("module_id", "responsibility", "classes_functions_summary", "dependencies_summary", "entry_point_indicator", "warnings_summary"),
    """WITH s AS (SELECT module_id, count(*) FILTER (kind = 'class') AS c, count(*) FILTER (kind = 'function') AS f FROM v_symbols GROUP BY 1), n AS (SELECT module_id, string_agg(name, ', ' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY CASE kind WHEN 'class' THEN 0 ELSE 1 END, ord, name) AS r FROM v_symbols WHERE kind <> 'variable') WHERE r <= 4 GROUP BY 1),
    w AS (SELECT module_id, count(DISTINCT code) AS k, string_agg(DISTINCT code, ', ' ORDER BY code) AS codes FROM v_warnings GROUP BY 1)
    SELECT module_id, CASE WHEN is_entry_point THEN concat('`', relative_path, '` is where this part of the program starts.') WHEN contains(relative_path, 'test') THEN concat('`', relative_path, '` contains tests or testing helpers.') WHEN contains(relative_path, 'util') OR contains(relative_path, 'helper') THEN concat('`', relative_path, '` provides reusable helper functions.') WHEN contains(relative_path, 'model') OR contains(relative_path, 'schema') THEN concat('`', relative_path, '` defines the project''s data structures.')
      WHEN contains(relative_path, 'api') OR contains(relative_path, 'route') OR contains(relative_path, 'controller') THEN concat('`', relative_path, '` handles API requests and routes.') WHEN names IS NOT NULL THEN concat('`', relative_path, '` contains the main logic for ', names, '.') ELSE concat('`', relative_path, '` contains ', upper(left(language, 1)), substr(language, 2), ' project logic.') END AS responsibility,
      concat('It contains ', coalesce(c, 0), ' classes and ', coalesce(f, 0), ' functions or methods.') AS classes_functions_summary, concat('It uses ', complexity, ' dependencies and exposes ', complexity + 1, ' items.') AS dependencies_summary,
      CASE WHEN is_entry_point THEN 'Yes — the program can start here.' ELSE 'No — this file is used by other code.' END AS entry_point_indicator, CASE WHEN k > 0 THEN concat('Identified ', k, ' warning(s): ', codes, '.') ELSE 'No legacy or risk warnings detected.' END AS warnings_summary
    FROM v_modules LEFT JOIN s USING (module_id) LEFT JOIN n USING (module_id) LEFT JOIN w USING (module_id)""",
)


def _projects(m, e):
    major = quality.first_n(quality.largest_modules(m), 3, ["project_id"], ["rank"], "relative_path").withColumnRenamed("relative_path", "major")
    return op.project_explanation(quality.project_totals(m).join(major, "project_id").join(quality.edge_resolution_counts(e), "project_id", "left").fillna(0, ["resolved_edges", "unresolved_edges"]))


_PROJECTS = """m AS (SELECT project_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS l, string_agg(DISTINCT language, ',' ORDER BY language) AS langs FROM v_modules GROUP BY 1), en AS (SELECT project_id, string_agg(relative_path, ', ' ORDER BY relative_path) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path) AS r FROM v_modules WHERE is_entry_point) WHERE r <= 3 GROUP BY 1),
    g AS (SELECT project_id, string_agg(relative_path, '; ' ORDER BY r) AS major FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY line_count DESC, relative_path) AS r FROM v_modules) WHERE r <= 3 GROUP BY 1), e AS (SELECT project_id, count(*) FILTER (resolved) AS a, count(*) FILTER (NOT resolved) AS b FROM v_all_edges GROUP BY 1),
    x AS (SELECT m.project_id, concat('This is a ', CASE langs WHEN 'javascript,python' THEN 'JavaScript and Python' WHEN 'python' THEN 'Python' ELSE 'JavaScript' END, ' project with ', n, CASE WHEN n = 1 THEN ' code file and ' ELSE ' code files and ' END, l, ' lines of code.') AS languages_summary,
      coalesce(concat('The program appears to start in ', CASE WHEN entries IS NULL THEN NULL ELSE entries END || '.'), 'x') AS e0, CASE WHEN entries IS NOT NULL THEN concat('The program appears to start in ', entries, '.') ELSE 'No clear starting file was found; this may be a library used by another program.' END AS entry_points_summary, concat('Important files: ', major, '.') AS major_modules_summary,
      concat('The files have ', coalesce(a, 0), ' internal connection(s) and use ', coalesce(b, 0), ' external dependency reference(s).') AS dependencies_summary, CASE langs WHEN 'javascript,python' THEN 'The project combines Python with JavaScript code.' WHEN 'python' THEN 'The project is organized as Python modules that share functions and data.' ELSE 'The project is organized as JavaScript modules that import and export code.' END AS architecture FROM m LEFT JOIN en USING (project_id) JOIN g USING (project_id) LEFT JOIN e USING (project_id))"""
add("f21_project_explanation", "v_modules v_all_edges", lambda m, e: _projects(m, e).select("project_id", "languages_summary", "entry_points_summary", "major_modules_summary", "dependencies_summary", "architecture"), f"WITH {_PROJECTS} SELECT project_id, languages_summary, entry_points_summary, major_modules_summary, dependencies_summary, architecture FROM x")


def _files(lines):
    """The reports as files in the shared folder, read again: all of them, of any size and under any folder's name."""
    spark = lines.sparkSession
    root = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    op.write_reports(lines, root, "report.md")
    found = graph.settled(scan.scan_tree(spark, root, max_bytes=(1 << 63) - 1, ignored=(), hidden_folders=True).select("project_id", F.col("content").cast("string").alias("report")))
    scan.delete_tree(spark, root)
    return found


add("k2_explanation_report", "v_modules v_all_edges", lambda m, e: _files(op.explanation_report(_projects(m, e), m)), f"WITH {_PROJECTS} SELECT project_id, concat('# ', project_id, chr(10), languages_summary, chr(10), entry_points_summary, chr(10), major_modules_summary, chr(10), dependencies_summary, chr(10), (SELECT string_agg(concat('- ', relative_path, ' (', line_count, ' lines)'), chr(10) ORDER BY relative_path) FROM v_modules v WHERE v.project_id = x.project_id)) AS report FROM x")
add(
    "k3_mermaid_report", "v_modules v_edges", lambda m, e: _files(op.mermaid_report(m, e.select("project_id", "source_module_id", "target_module_id", "type"))),
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, module_id) - 1 AS k FROM v_modules), a AS (SELECT e.project_id, x.k AS a, y.k AS b, e.type FROM v_edges e JOIN n x ON x.module_id = e.source_module_id JOIN n y ON y.module_id = e.target_module_id),
    l AS (SELECT project_id, 0 AS s, 0 AS o, 'graph TD' AS line FROM n GROUP BY 1 UNION ALL SELECT project_id, 1, k, concat('  N', k, '["', relative_path, '"]') FROM n UNION ALL SELECT project_id, 2, row_number() OVER (PARTITION BY project_id ORDER BY a, b, type), concat('  N', a, ' -->|', type, '| N', b) FROM a
      UNION ALL SELECT project_id, 3, 0, concat('%% ', count(*), ' nodes, ', (SELECT count(*) FROM a WHERE a.project_id = n.project_id), ' edges') FROM n GROUP BY 1)
    SELECT project_id, string_agg(line, chr(10) ORDER BY s, o) AS report FROM l GROUP BY 1""",
)


def _plan(m, e, w, t):
    scored = graph.settled(_scored(m, e, w))
    return _files(op.plan_report(migration.readiness(m, w, e, graph.cycle_counts(e), _tests(t)), migration.top_priorities(scored), migration.phase_files(_with_entries(scored))))


add(
    "k4_plan_report", "v_modules v_edges v_warnings v_tests", _plan,
    f"""WITH RECURSIVE {CLOSURE}, {SCORED}, {PHASED}, {READY},
    line AS (SELECT project_id, 0 AS part, 0 AS place, concat('# Readiness ', overall, '/100: ', {STATUS.format('overall')}) AS line FROM o
      UNION ALL SELECT project_id, 1, rank, concat(rank, '. ', relative_path, ' (', risk_level, ')') FROM t WHERE rank <= 6
      UNION ALL SELECT project_id, 2, phase, concat('## ', CASE phase WHEN 1 THEN 'Build the safety net' WHEN 2 THEN 'Apply low-risk improvements' WHEN 3 THEN 'Untangle shared modules' ELSE 'Modernize entry points' END, ': ', replace(files, ',', ', ')) FROM ph)
    SELECT project_id, string_agg(line, chr(10) ORDER BY part, place) AS report FROM line GROUP BY 1""",
)
add("k7_to_api_json", "v_modules", lambda m: scan.to_api_json(m.select("module_id", "language", "complexity"), ["module_id"]), "SELECT module_id, concat('{\"module_id\":', module_id, ',\"language\":\"', language, '\",\"complexity\":', complexity, '}') AS payload FROM v_modules")
