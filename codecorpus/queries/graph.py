"""Degrees, reachability, cycles and views of the modules' graph."""

from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators import graph as op
from codecorpus.queries.register import adder

ALL: dict = {}
add = adder(ALL)

#: Reachability over resolved edges, for the oracle.
CLOSURE = "r AS (SELECT source_module_id AS a, target_module_id AS b FROM v_edges UNION SELECT r.a, e.target_module_id FROM r JOIN v_edges e ON r.b = e.source_module_id)"
DENSE = "d AS (SELECT source_module_id AS a, target_module_id AS b FROM v_dense), r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)"
#: A depth-first walk over each project in id order, a step a row; k has the cycle of each back edge, from its least member.
WALK = """e0 AS (SELECT DISTINCT project_id AS p, source_module_id AS a, target_module_id AS b FROM v_edges WHERE source_module_id <> target_module_id),
    walk AS (SELECT p, CAST([] AS BIGINT[]) AS path, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS x FROM (SELECT DISTINCT p FROM e0)
      UNION ALL SELECT p, CASE WHEN y IS NULL THEN path[:-2] ELSE list_append(path, y) END, CASE WHEN y IS NULL THEN seen ELSE list_append(seen, y) END, y
      FROM (SELECT p, path, seen, CASE WHEN len(path) = 0 THEN (SELECT min(a) FROM e0 WHERE e0.p = walk.p AND NOT list_contains(walk.seen, a)) ELSE (SELECT min(b) FROM e0 WHERE e0.p = walk.p AND e0.a = walk.path[-1] AND NOT list_contains(walk.seen, b)) END AS y FROM walk) s WHERE y IS NOT NULL OR len(path) > 0),
    ring AS (SELECT walk.p, path[list_position(path, b):] AS r FROM walk JOIN e0 ON e0.p = walk.p AND e0.a = walk.x AND list_contains(walk.path, e0.b)),
    k AS (SELECT p, list_concat(r[list_position(r, list_min(r)):], r[:list_position(r, list_min(r)) - 1]) AS r FROM ring)"""


add("a7_degrees", "v_modules v_edges", lambda m, e: op.degrees(m, e).select("module_id", "in_degree", "out_degree"), "SELECT module_id, (SELECT count(*) FROM v_edges WHERE target_module_id = module_id) AS in_degree, (SELECT count(*) FROM v_edges WHERE source_module_id = module_id) AS out_degree FROM v_modules")
add("g5_orphans", "v_modules v_edges", lambda m, e: op.orphans(op.degrees(m, e)).select("project_id", "module_id"), "SELECT project_id, module_id FROM v_modules WHERE module_id NOT IN (SELECT source_module_id FROM v_edges UNION SELECT target_module_id FROM v_edges)")
add("g6_entry_points", "v_modules", lambda m: op.entry_points(m).select("project_id", "module_id"), "SELECT project_id, module_id FROM v_modules WHERE is_entry_point")
add("w3_top_connected", "v_modules v_all_edges", lambda m, e: op.top_connected(op.degrees(m, e)).select("project_id", "module_id", "rank"), "SELECT project_id, module_id, CAST(rank AS INT) AS rank FROM (SELECT m.*, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(n, 0) DESC, relative_path) AS rank FROM v_modules m LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_module_id AS id FROM v_all_edges UNION ALL SELECT target_module_id FROM v_all_edges) GROUP BY 1) d ON d.id = m.module_id) WHERE rank <= 5")
add("g1_transitive_dependents", "v_edges", op.transitive_dependents, f"WITH RECURSIVE {CLOSURE} SELECT b AS module_id, a AS dependent FROM r WHERE a <> b")
add("g2_blast_radius", "v_modules v_edges", lambda m, e: op.blast_radii(m.select("project_id", "module_id"), e).drop("project_id"), f"WITH RECURSIVE {CLOSURE} SELECT module_id, count(a) AS blast_radius FROM v_modules LEFT JOIN r ON r.b = module_id AND r.a <> r.b GROUP BY 1")
#: The cycles that the reference lists, of any length: one for each back edge of its walk (analysis/graph_service.py, `find_directed_cycles`).
add("g3_dependency_cycles", "v_edges", lambda e: op.dfs_cycles(e).select((F.size("path") - 1).alias("length"), F.concat_ws("-", F.col("path").cast("array<string>")).alias("path")), f"WITH RECURSIVE {WALK} SELECT CAST(len(r) AS INT) AS length, concat(array_to_string(r, '-'), '-', r[1]) AS path FROM k")
add("g3_short_cycles", "v_dense", lambda e: op.cycles(e, 3).select("length", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path")), f"WITH RECURSIVE {DENSE} SELECT 2 AS length, concat(x.a, '-', x.b, '-', x.a) AS path FROM d x JOIN d y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b UNION ALL SELECT 3, concat(x.a, '-', y.a, '-', z.a, '-', x.a) FROM d x JOIN d y ON x.b = y.a JOIN d z ON y.b = z.a AND z.b = x.a WHERE x.a < y.a AND x.a < z.a")
add("g4_cyclic_components", "v_dense", op.cyclic_components, f"WITH RECURSIVE {DENSE} SELECT p.a AS module_id, min(p.b) AS component FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY 1")
add("u2_dfs_cycles", "v_edges", lambda e: op.dfs_cycles(e).withColumn("path", F.concat_ws("-", F.col("path").cast("array<string>"))), f"WITH RECURSIVE {WALK} SELECT p AS project_id, concat(array_to_string(r, '-'), '-', r[1]) AS path FROM k")
_SUMMARY = f"""{WALK}, d AS (SELECT DISTINCT source_module_id AS a, target_module_id AS b FROM v_edges),
    n AS (SELECT project_id, count(*) AS internal_nodes, count(*) FILTER (module_id NOT IN (SELECT a FROM d UNION SELECT b FROM d)) AS orphan_count, count(*) FILTER (is_entry_point) AS entry_point_count, count(*) FILTER (complexity > 10) AS high_complexity_count FROM v_modules GROUP BY 1),
    e AS (SELECT project_id, count(*) FILTER (resolved) AS internal_edges, count(*) FILTER (NOT resolved) AS external_edges, count(DISTINCT CASE WHEN NOT resolved THEN target_module_id END) AS external_nodes FROM v_all_edges GROUP BY 1), c AS (SELECT p AS project_id, count(*) AS cycle_count FROM k GROUP BY 1)"""


def _summary(m, e):
    inside = op.graph_edge_filter(e)
    rated = op.degrees(m, inside).withColumn("complexity_rating", s.complexity_rating(F.col("complexity")))
    return op.graph_summary(rated, e, op.cycle_counts(inside))


add("a8_graph_summary", "v_modules v_all_edges", _summary, f"WITH RECURSIVE {_SUMMARY} SELECT n.*, coalesce(internal_edges, 0) AS internal_edges, coalesce(external_edges, 0) AS external_edges, coalesce(external_nodes, 0) AS external_nodes, coalesce(cycle_count, 0) AS cycle_count FROM n LEFT JOIN e USING (project_id) LEFT JOIN c USING (project_id)")


def _graph(m, e, y, w):
    """All parts of the graph as rows of one shape."""
    g = op.module_graph(m, e, y, w, include_external=True)
    row = lambda name, item, n: g[name].select(F.lit(name).alias("part"), "project_id", item.alias("item"), n.cast("long").alias("n"))
    counts = [c for c in g["summary"].columns if c != "project_id"]
    parts = [
        row("nodes", F.concat_ws(" ", "node_id", "label", "kind", "language", "parse_status", "line_count", "complexity_score", "complexity_rating", "warning_count", "symbol_count", F.col("is_entry_point").cast("string"), "in_degree", "out_degree"), F.col("is_external").cast("int")),
        row("edges", F.concat_ws(" ", "id", "source", "target", "type", "source_line"), F.col("resolved").cast("int")),
        row("top_connected", F.col("relative_path"), F.col("rank")),
        row("orphans", F.col("relative_path"), F.lit(0)),
        row("entry_points", F.col("relative_path"), F.lit(0)),
        g["summary"].unpivot("project_id", counts, "item", "n").select(F.lit("summary").alias("part"), "project_id", "item", "n"),
        row("cycles", F.concat_ws("-", F.col("path").cast("array<string>")), F.size("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RATED = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 20 THEN 'high' ELSE 'critical' END"
add(
    "g7_module_graph", "v_modules v_all_edges v_symbols v_warnings", _graph,
    f"""WITH RECURSIVE {WALK}, gi AS (SELECT target_module_id AS id, count(*) AS i FROM v_edges GROUP BY 1), go AS (SELECT source_module_id AS id, count(*) AS o FROM v_all_edges GROUP BY 1),
    sy AS (SELECT module_id, count(*) AS sn FROM v_symbols GROUP BY 1), wa AS (SELECT module_id, count(*) AS wn FROM v_warnings GROUP BY 1),
    m AS (SELECT v.*, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(sn, 0) AS sn, coalesce(wn, 0) AS wn, {_RATED} AS rating FROM v_modules v LEFT JOIN gi ON gi.id = v.module_id LEFT JOIN go ON go.id = v.module_id LEFT JOIN sy USING (module_id) LEFT JOIN wa USING (module_id)),
    x AS (SELECT a.project_id, target_module_id AS t, count(*) AS i, arg_min(language, source_module_id) AS language FROM v_all_edges a JOIN v_modules ON module_id = source_module_id WHERE NOT resolved GROUP BY 1, 2),
    su AS (SELECT project_id, count(*) AS internal_nodes, count(*) FILTER (i + o = 0) AS orphan_count, count(*) FILTER (is_entry_point) AS entry_point_count, count(*) FILTER (complexity > 10) AS high_complexity_count FROM m GROUP BY 1),
    se AS (SELECT project_id, count(*) FILTER (resolved) AS internal_edges, count(*) FILTER (NOT resolved) AS external_edges, count(DISTINCT CASE WHEN NOT resolved THEN target_module_id END) AS external_nodes FROM v_all_edges GROUP BY 1),
    sc AS (SELECT p AS project_id, count(*) AS cycle_count FROM k GROUP BY 1),
    su2 AS (SELECT su.*, coalesce(internal_edges, 0) AS internal_edges, coalesce(external_edges, 0) AS external_edges, coalesce(external_nodes, 0) AS external_nodes, coalesce(cycle_count, 0) AS cycle_count FROM su LEFT JOIN se USING (project_id) LEFT JOIN sc USING (project_id))
    SELECT 'nodes' AS part, project_id, concat_ws(' ', module_id, relative_path, 'module', language, parse_status, line_count, complexity, rating, wn, sn, is_entry_point, i, o) AS item, 0 AS n FROM m
    UNION ALL SELECT 'nodes', project_id, concat_ws(' ', concat('ext:', t), t, 'external', language, 0, 0, false, i, 0), 1 FROM x
    UNION ALL SELECT 'edges', project_id, concat_ws(' ', concat('edge_', left(sha256(concat_ws(':', source_module_id, target_module_id, type, source_line)), 12)), source_module_id, CASE WHEN resolved THEN '' ELSE 'ext:' END || target_module_id, type, source_line), CAST(resolved AS BIGINT) FROM v_all_edges
    UNION ALL SELECT 'top_connected', project_id, relative_path, r FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY i + o DESC, relative_path) AS r FROM m) WHERE r <= 5
    UNION ALL SELECT 'orphans', project_id, relative_path, 0 FROM m WHERE i + o = 0 UNION ALL SELECT 'entry_points', project_id, relative_path, 0 FROM m WHERE is_entry_point
    UNION ALL SELECT 'summary', project_id, item, n FROM (UNPIVOT su2 ON COLUMNS(* EXCLUDE project_id) INTO NAME item VALUE n)
    UNION ALL SELECT 'cycles', p, concat(array_to_string(r, '-'), '-', r[1]), len(r) + 1 FROM k""",
)
add("p3_graph_edge_filter", "v_all_edges", lambda e: op.graph_edge_filter(e, ["require"], False), "SELECT * FROM v_all_edges WHERE type = 'require' AND resolved")
add("p7_graph_view", "v_modules v_edges", lambda m, e: op.graph_view(m, e, " A ", "import")[1].select("source_module_id", "target_module_id"), "SELECT source_module_id, target_module_id FROM v_edges JOIN v_modules x ON x.module_id = source_module_id JOIN v_modules y ON y.module_id = target_module_id WHERE type = 'import' AND contains(lower(x.relative_path), 'a') AND contains(lower(y.relative_path), 'a')")
add("o2_node_set", "v_modules v_all_edges", op.node_set, "SELECT CAST(module_id AS VARCHAR) AS node_id, false AS is_external FROM v_modules UNION SELECT concat('ext:', target_module_id), true FROM v_all_edges WHERE NOT resolved")
add("w12_order_graph", "v_modules v_all_edges", lambda m, e: op.order_graph(op.node_set(m, e).withColumn("label", F.col("node_id")), e)[0].select("node_id"), "SELECT CAST(module_id AS VARCHAR) AS node_id FROM v_modules UNION SELECT concat('ext:', target_module_id) FROM v_all_edges WHERE NOT resolved")
add("j11_direct_neighbours", "v_modules v_edges", lambda m, e: op.direct_neighbours(m, e).select("module_id", F.array_join("direct_dependents", ",").alias("users"), F.array_join("direct_dependencies", ",").alias("used")), "SELECT module_id, coalesce((SELECT string_agg(DISTINCT x.relative_path, ',' ORDER BY x.relative_path) FROM v_edges e JOIN v_modules x ON x.module_id = e.source_module_id WHERE e.target_module_id = m.module_id), '') AS users, coalesce((SELECT string_agg(DISTINCT x.relative_path, ',' ORDER BY x.relative_path) FROM v_edges e JOIN v_modules x ON x.module_id = e.target_module_id WHERE e.source_module_id = m.module_id), '') AS used FROM v_modules m")
add("j12_affected_entry_points", "v_modules v_edges", op.entry_point_texts, f"WITH RECURSIVE {CLOSURE}, o AS (SELECT a, b FROM r UNION SELECT module_id, module_id FROM v_modules) SELECT m.module_id, coalesce(string_agg(DISTINCT x.relative_path, ',' ORDER BY x.relative_path), '') AS affected_entry_points FROM v_modules m LEFT JOIN o ON o.b = m.module_id LEFT JOIN v_modules x ON x.module_id = o.a AND x.is_entry_point GROUP BY 1")
add("o3_closure_and_self", "v_modules v_edges", lambda m, e: op.closure_and_self(m, op.transitive_dependents(e)), f"WITH RECURSIVE {CLOSURE} SELECT b AS module_id, a AS dependent FROM r WHERE a <> b UNION ALL SELECT module_id, module_id FROM v_modules")
add("j13_cycle_edges", "v_dense", lambda e: op.cycle_edges(e).select("source_module_id", "target_module_id"), f"WITH RECURSIVE {DENSE}, c AS (SELECT a FROM r WHERE a = b) SELECT a AS source_module_id, b AS target_module_id FROM d WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)")


def _symbols(y):
    return y.withColumns({"symbol_id": F.concat_ws(":", "module_id", "ord"), "qualified_name": F.when((F.col("kind") == "function") & (F.col("ord") % 2 == 0), F.concat("name", F.lit(".run"))).otherwise(F.col("name"))})


def _calls(y):
    return _symbols(y).select("module_id", "symbol_id", F.concat(F.lit("fn_"), (F.col("ord") % 10 + 1).cast("string")).alias("target"), "ord")


_SYM = "y AS (SELECT *, concat(module_id, ':', ord) AS symbol_id, CASE WHEN kind = 'function' AND ord % 2 = 0 THEN concat(name, '.run') ELSE name END AS qualified_name FROM v_symbols)"
_CALL = f"{_SYM}, k AS (SELECT module_id, t, arg_max(symbol_id, ord) AS target_id FROM (SELECT module_id, name AS t, symbol_id, ord FROM y WHERE kind <> 'variable' UNION SELECT module_id, qualified_name, symbol_id, ord FROM y WHERE kind <> 'variable') GROUP BY 1, 2), c AS (SELECT y.module_id, y.symbol_id, k.target_id, y.ord FROM y JOIN k ON k.module_id = y.module_id AND k.t = concat('fn_', y.ord % 10 + 1) WHERE k.target_id <> y.symbol_id)"
add("j9_link_methods", "v_symbols", lambda y: op.link_methods(_symbols(y)).select("symbol_id", "parent_id"), f"WITH {_SYM}, c AS (SELECT module_id, name, arg_max(symbol_id, ord) AS class_id FROM y WHERE kind = 'class' GROUP BY 1, 2) SELECT y.symbol_id, coalesce(c.class_id, CAST(y.module_id AS VARCHAR)) AS parent_id FROM y LEFT JOIN c ON c.module_id = y.module_id AND contains(y.qualified_name, '.') AND c.name = string_split(y.qualified_name, '.')[1]")
add("j10_resolve_calls", "v_symbols", lambda y: op.resolve_calls(_symbols(y), _calls(y)).select("symbol_id", "target_id"), f"WITH {_CALL} SELECT symbol_id, target_id FROM c")
add("w8_cap_call_edges", "v_symbols", lambda y: op.cap_call_edges(op.resolve_calls(_symbols(y), _calls(y)), 2, order=["ord"]).select("symbol_id", "total"), f"WITH {_CALL} SELECT symbol_id, total FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY ord) AS r, count(*) OVER (PARTITION BY module_id) AS total FROM c) WHERE r <= 2")
add("g8_symbol_graph", "v_modules v_symbols", lambda m, y: op.symbol_graph(m, _symbols(y), _calls(y))[1].groupBy("module_id", "type").count(), f"WITH {_CALL} SELECT module_id, 'contains' AS type, count(*) AS count FROM y WHERE kind <> 'variable' GROUP BY 1 UNION ALL SELECT module_id, 'call', least(50, count(*)) FROM c GROUP BY 1")
