"""Aggregates of modules, symbols and warnings."""

from pyspark.sql import functions as F

from codecorpus.operators import facts
from codecorpus.operators import quality as op
from codecorpus.queries.register import adder

ALL: dict = {}
add = adder(ALL)

_RATING = "CASE WHEN c <= 5 THEN 'low' WHEN c <= 10 THEN 'medium' WHEN c <= 20 THEN 'high' ELSE 'critical' END"
add("a1_module_complexity", "v_modules v_symbols", lambda m, y: op.module_complexity(m, y), f"SELECT module_id, c AS cyclomatic_complexity, h AS hotspots_count, {_RATING} AS rating FROM (SELECT m.module_id, coalesce(max(s.complexity), 1) AS c, count(*) FILTER (s.complexity > 10) AS h FROM v_modules m LEFT JOIN v_symbols s ON s.module_id = m.module_id GROUP BY 1)")
add("a2_parse_status_counts", "v_modules", op.parse_status_counts, "SELECT project_id, count(*) FILTER (parse_status = 'complete') AS complete, count(*) FILTER (parse_status = 'partial') AS partial, count(*) FILTER (parse_status = 'failed') AS failed FROM v_modules GROUP BY 1")
add("a3_project_totals", "v_modules", lambda m: op.project_totals(m).select("project_id", "total_files", "total_lines", F.array_join("languages", ",").alias("languages"), F.array_join("entry_points", ",").alias("entry_points")), "SELECT project_id, count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, coalesce(string_agg(CASE WHEN is_entry_point THEN relative_path END, ',' ORDER BY relative_path), '') AS entry_points FROM v_modules GROUP BY 1")
add("a4_project_warnings", "v_modules v_warnings", lambda m, w: op.project_warnings(m.withColumn("parse_errors", F.when(F.col("parse_status") == "failed", F.array(F.lit("bad"), F.lit("worse"))).otherwise(F.array().cast("array<string>"))), w).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("last")), "SELECT code, severity, count(*) AS n, max(message) AS last FROM (SELECT code, severity, message FROM v_warnings UNION ALL SELECT 'PARSE_ERROR', 'risk', concat(relative_path, ': ', unnest(['bad', 'worse'])) FROM v_modules WHERE parse_status = 'failed') GROUP BY ALL")
add("a5_warning_weight", "v_warnings", lambda w: op.warning_weight(w, ["module_id"]), "SELECT module_id, CAST(sum(CASE severity WHEN 'risk' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS BIGINT) AS warning_weight, count(*) AS warning_count FROM v_warnings GROUP BY 1")
add("a6_node_metrics", "v_modules v_symbols v_warnings", lambda m, y, w: op.node_metrics(m, y, w).select("module_id", "symbol_count", "warning_count"), "SELECT m.module_id, (SELECT count(*) FROM v_symbols s WHERE s.module_id = m.module_id) AS symbol_count, (SELECT count(*) FROM v_warnings w WHERE w.module_id = m.module_id) AS warning_count FROM v_modules m")
add("a14_edge_resolution_counts", "v_all_edges", op.edge_resolution_counts, "SELECT project_id, count(*) FILTER (resolved) AS resolved_edges, count(*) FILTER (NOT resolved) AS unresolved_edges FROM v_all_edges GROUP BY 1")
add("a15_module_counts", "v_modules v_symbols v_warnings", lambda m, y, w: op.module_counts(m, y, w).withColumn("codes", F.array_join("codes", ",")), "SELECT m.module_id, coalesce(c, 0) AS classes, coalesce(f, 0) AS functions, coalesce(codes, '') AS codes FROM v_modules m LEFT JOIN (SELECT module_id, count(*) FILTER (kind = 'class') AS c, count(*) FILTER (kind = 'function') AS f FROM v_symbols GROUP BY 1) s USING (module_id) LEFT JOIN (SELECT module_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM v_warnings GROUP BY 1) w USING (module_id)")
add("a17_warning_groups", "v_warnings", op.warning_groups, "SELECT module_id, code, count(*) AS n, arg_min(severity, (ord, severity)) AS severity FROM v_warnings GROUP BY 1, 2")
add("o1_union_warnings", "v_warnings v_symbols", lambda w, y: op.union_warnings(w.select("module_id", "code", "severity", "message"), facts.complexity_warnings(y.withColumn("start_line", F.col("ord")), ["module_id"]).select("module_id", "code", "severity", F.col("line").alias("ord"))).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("count"), F.count("message").alias("messages")), "SELECT code, severity, count(*) AS count, count(message) AS messages FROM (SELECT code, severity, message FROM v_warnings UNION ALL SELECT 'HIGH_COMPLEXITY', 'warning', NULL FROM v_symbols WHERE complexity > 10 AND kind = 'function') GROUP BY ALL")
add("w6_first_n", "v_symbols", lambda y: op.first_n(y, 5, ["module_id"], ["ord"], "name").withColumn("name", F.array_join("name", ",")), "SELECT module_id, string_agg(name, ',' ORDER BY ord) AS name FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY ord) AS r FROM v_symbols) WHERE r <= 5 GROUP BY 1")
add("w7_largest_modules", "v_modules", lambda m: op.largest_modules(m).select("project_id", "module_id", "rank"), "SELECT project_id, module_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY line_count DESC, relative_path) AS rank FROM v_modules) WHERE rank <= 3")
add("w11_distinct_calls", "v_symbols", lambda y: op.distinct_calls_in_order(y, ["module_id"], "name", "ord").withColumn("calls", F.array_join("calls", ",")), "SELECT module_id, string_agg(name, ',' ORDER BY o, name) AS calls FROM (SELECT module_id, name, min(ord) AS o FROM v_symbols GROUP BY 1, 2) GROUP BY 1")
add("w13_top_symbol_names", "v_symbols", lambda y: op.top_symbol_names(y).withColumn("name", F.array_join("name", ",")), "SELECT module_id, string_agg(name, ',' ORDER BY r) AS name FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY CASE kind WHEN 'class' THEN 0 ELSE 1 END, ord) AS r FROM v_symbols WHERE kind <> 'variable') WHERE r <= 4 GROUP BY 1")
add("a13_hotspot_lines", "v_modules v_symbols", lambda m, y: op.hotspot_lines(m, op.module_complexity(m, y)).withColumn("line", F.array_join("line", "|")), "WITH h AS (SELECT module_id, count(*) AS h FROM v_symbols WHERE complexity > 10 GROUP BY 1), r AS (SELECT project_id, relative_path, h, row_number() OVER (PARTITION BY project_id ORDER BY relative_path) AS r FROM v_modules JOIN h USING (module_id)) SELECT project_id, string_agg(concat('Module ''', relative_path, ''' has ', h, ' high-complexity function(s).'), '|' ORDER BY r) AS line FROM r WHERE r <= 5 GROUP BY 1")
add("a13_risk_lines", "v_modules v_warnings", lambda m, w: op.risk_lines(m, w).withColumn("line", F.array_join("line", "|")), "WITH r AS (SELECT project_id, concat('''', relative_path, ''' [Line ', line, ']: ', message) AS line, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, ord) AS r, relative_path, ord FROM v_warnings JOIN v_modules USING (module_id) WHERE severity IN ('risk', 'warning')) SELECT project_id, string_agg(line, '|' ORDER BY r) AS line FROM r WHERE r <= 10 GROUP BY 1")
add("a13_parse_limit_lines", "v_modules", lambda m: op.parse_limit_lines(m).withColumn("line", F.array_join("line", "|")), "WITH r AS (SELECT project_id, concat('Module ''', relative_path, ''' parsed with status ''', parse_status, '''.') AS line, row_number() OVER (PARTITION BY project_id ORDER BY relative_path) AS r FROM v_modules WHERE parse_status <> 'complete') SELECT project_id, string_agg(line, '|' ORDER BY r) AS line FROM r WHERE r <= 5 GROUP BY 1")
