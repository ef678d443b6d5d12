"""Dependency graphs: degrees, reachability, cycles, components, neighbours, views and symbol drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators import quality, walks
from codecorpus.shipping import shared_folder


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "module_id", source: str = "source_module_id", target: str = "target_module_id") -> DataFrame:
    """Adds in_degree and out_degree; parallel edges count each."""
    ends = edges.select(F.col(source).alias(node), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col(target).alias(node), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy(node).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(sums, node, "left").fillna(0, ["in_degree", "out_degree"])


def orphans(with_degrees: DataFrame) -> DataFrame:
    return with_degrees.where("in_degree = 0 and out_degree = 0")


def entry_points(nodes: DataFrame, order: str = "relative_path") -> DataFrame:
    return nodes.where("is_entry_point").orderBy(order)


def top_connected(with_degrees: DataFrame, k: int = 5, project: str = "project_id", label: str = "relative_path") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(project).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), label))
    return with_degrees.withColumn("rank", rank).where(F.col("rank") <= k)


def reachable(edges: DataFrame, source: str = "source_module_id", target: str = "target_module_id") -> DataFrame:
    """(start, reached) over all paths of one edge or more.

    Semi-naive: a round extends only the pairs that the last one found, by one edge, or by all known paths where few rows
    would come of it (long, thin graphs then need a logarithmic number of rounds). Each round's table is checkpointed.
    """
    known = settled(edges.select(F.col(source).alias("start"), F.col(target).alias("reached")).distinct())
    single, fresh, n = known, known, known.count()
    while True:
        ends = fresh.groupBy(F.col("reached").alias("via")).agg(F.count(F.lit(1)).alias("a"))
        more = ends.join(known.groupBy(F.col("start").alias("via")).agg(F.count(F.lit(1)).alias("b")), "via").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]
        if not more:
            return known
        onward = known if more <= 4 * n else single
        step = fresh.withColumnRenamed("reached", "via").join(onward.select(F.col("start").alias("via"), "reached"), "via").select("start", "reached")
        fresh = settled(step.distinct().join(known, ["start", "reached"], "left_anti"))
        found = fresh.count()
        if not found:
            return known
        known, n = settled(known.unionByName(fresh)), n + found


def grouped(edges: DataFrame, project: str, source: str, target: str) -> DataFrame:
    """Different edges with their project; without such a column all are of one."""
    name = F.col(project) if project in edges.columns else F.lit("")
    return edges.select(name.alias("project_id"), source, target).distinct()


def transitive_dependents(edges: DataFrame, source: str = "source_module_id", target: str = "target_module_id", project: str = "project_id") -> DataFrame:
    """(module_id, dependent): who reaches a module over resolved edges; never itself. Edges stay within a project.

    Each project is walked in a task of its own; those of more than `walks.LIMIT` edges by rounds of joins."""
    small, large = walks.split_by_size(settled(grouped(edges, project, source, target)), "project_id")
    pairs = walks.dependent_pairs(small, "project_id", source, target).select("module_id", "dependent")
    if large is None:
        return pairs
    return pairs.unionByName(reachable(large, source, target).where("start <> reached").select(F.col("reached").alias("module_id"), F.col("start").alias("dependent")))


def dependent_facts(modules: DataFrame, edges: DataFrame, project: str = "project_id", listed: bool = True) -> DataFrame:
    """module_id, blast_radius (how many others reach it), entry_count (of the paths of entry points among its dependents and
    itself) and, with listed, affected_entry_points (these paths, sorted) of each module.

    modules: project, module_id, relative_path, is_entry_point. Edges stay within a project. All come from bit sets over
    the components of a project in a task of its own, no pairs are made and lists go out as they come; only in projects of
    more than `walks.LIMIT` edges are dependents counted from all pairs and entry points spread by joins. Lists may be as
    long as a project has entry points for each of its modules, so who needs their number alone asks without listed."""
    source, target = "source_module_id", "target_module_id"
    different = settled(edges.select(project, source, target).distinct())
    small, large = walks.split_by_size(different, project)
    nodes = modules.select(project, "module_id", F.when(F.col("is_entry_point"), F.col("relative_path")).alias("label"))
    own = nodes.where(F.col(project).isNotNull()) if large is None else nodes.join(large.select(project).distinct(), project, "left_anti").where(F.col(project).isNotNull())
    counted = ["module_id", F.col("dependents").alias("blast_radius"), "entry_count"]
    none = F.array().cast("array<string>")
    facts = walks.dependent_facts(small, own, project, source, target, listed=listed).select(*counted, *([F.col("entries").alias("affected_entry_points")] if listed else []))
    nowhere = modules.where(F.col(project).isNull()).select("module_id", F.lit(0).cast("long").alias("blast_radius"), F.lit(0).cast("long").alias("entry_count"), *([none.alias("affected_entry_points")] if listed else []))
    facts = facts.unionByName(nowhere)
    if large is None:
        return facts
    there = settled(modules.join(large.select(project).distinct(), project, "left_semi"))
    reached = settled(reachable(large).where("start <> reached").groupBy(F.col("reached").alias("module_id")).agg(F.count(F.lit(1)).alias("blast_radius")))
    paths = there.where("is_entry_point").select(F.col("module_id").alias("entry"), "relative_path")
    spread = _spread_entries(there, large).select("module_id", F.explode("entries").alias("entry")).join(paths, "entry")
    named = spread.groupBy("module_id").agg(F.count_distinct("relative_path").alias("entry_count"), *([F.array_sort(F.collect_set("relative_path")).alias("affected_entry_points")] if listed else []))
    joined = there.select("module_id").join(reached, "module_id", "left").join(named, "module_id", "left").fillna(0, ["blast_radius", "entry_count"])
    return facts.unionByName(joined.withColumn("affected_entry_points", F.coalesce("affected_entry_points", none)) if listed else joined)


def blast_radii(modules: DataFrame, edges: DataFrame, project: str = "project_id") -> DataFrame:
    """modules with blast_radius, by `dependent_facts` without entry points."""
    counts = dependent_facts(modules.select(project, "module_id", F.lit("").alias("relative_path"), F.lit(False).alias("is_entry_point")), edges, project, listed=False)
    return modules.join(counts.select("module_id", "blast_radius"), "module_id")


def blast_radius(modules: DataFrame, dependents: DataFrame, node: str = "module_id") -> DataFrame:
    counts = dependents.groupBy("module_id").agg(F.count(F.lit(1)).alias("blast_radius")).withColumnRenamed("module_id", node)
    return modules.join(counts, node, "left").fillna(0, ["blast_radius"])


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, l): the least label that reaches each node along edges (a, b), its own included. One narrow join a round."""
    while True:
        near = edges.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("l").alias("m"))
        new = settled(labels.join(near, "v", "left").select("v", F.least("l", "m").alias("l"), (F.col("m") < F.col("l")).alias("moved")))
        labels = new.select("v", "l")
        if new.where("moved").isEmpty():
            return labels


def cyclic_components(edges: DataFrame, source: str = "source_module_id", target: str = "target_module_id", project: str = "project_id") -> DataFrame:
    """(module_id, component) of the modules on a cycle; a component's id is its least member. Edges stay within a project.

    Each project is walked in a task of its own; those of more than `walks.LIMIT` edges are coloured by rounds of joins."""
    small, large = walks.split_by_size(settled(grouped(edges, project, source, target)), "project_id")
    members = walks.cyclic_members(small, "project_id", source, target).select("module_id", "component")
    return members if large is None else members.unionByName(coloured_components(large, source, target))


def coloured_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """What `cyclic_components` gives, of one graph of any size.

    Nodes without a way in or out are trimmed, the least id that reaches a node is its colour, and what reaches that id
    back within the colour is its component; these nodes leave and the rest goes on. No pairs of nodes are ever made.
    """
    left = settled(edges.where(F.col(source) != F.col(target)).select(F.col(source).alias("a"), F.col(target).alias("b")).distinct())
    kind = left.schema["a"].dataType.simpleString()
    found = left.sparkSession.createDataFrame([], f"module_id {kind}, component {kind}")
    n = left.count()
    while n:
        while True:
            kept = settled(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            left, n, before = kept, kept.count(), n
            if n == before:
                break
        if not n:
            break
        colours = _spread(left.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v")), left)
        inside = settled(left.join(colours.select(F.col("v").alias("a"), F.col("l").alias("ca")), "a").join(colours.select(F.col("v").alias("b"), F.col("l").alias("cb")), "b").where("ca = cb").select("a", "b"))
        # backwards from each colour's own node: 0 spreads to what reaches it
        marks = _spread(colours.select("v", F.when(F.col("v") == F.col("l"), 0).otherwise(1).alias("l")), inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        members = settled(marks.where("l = 0").select("v").join(colours, "v"))
        found = settled(found.unionByName(members.select(F.col("v").alias("module_id"), F.col("l").alias("component"))))
        gone = members.select("v")
        left = settled(left.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
        n = left.count()
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes, "component", "left_semi").select("module_id", "component")


def cycles(edges: DataFrame, max_length: int, source: str = "source_module_id", target: str = "target_module_id", project: str = "project_id") -> DataFrame:
    """length, path: all elementary cycles of up to max_length nodes, each once, from its least member and closed with it.

    Inside a component only. A path grows through larger nodes than its first, and only to nodes from which the rest of
    max_length leads back to the first: distances back, of bounded length, come first. Both take a join a step. The
    number of elementary cycles grows fast with the length; `dfs_cycles` gives one for each back edge."""
    own = settled(cyclic_components(edges, source, target, project))
    ends = [own.select(F.col("module_id").alias(end), F.col("component").alias(f"_{end}")) for end in ("a", "b")]
    pairs = edges.where(F.col(source) != F.col(target)).select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()
    inner = settled(pairs.join(ends[0], "a").join(ends[1], "b").where("_a = _b").select("a", "b"))
    back = fresh = settled(inner.where("a > b").select(F.col("b").alias("first"), F.col("a").alias("node"), F.lit(1).alias("steps")))
    for steps in range(2, max_length):
        onward = fresh.join(inner.select("a", F.col("b").alias("node")), "node").where("a > first").select("first", F.col("a").alias("node")).distinct()
        fresh = settled(onward.join(back, ["first", "node"], "left_anti").withColumn("steps", F.lit(steps)))
        if fresh.isEmpty():
            break
        back = settled(back.unionByName(fresh))
    kind = inner.schema["a"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([], f"length int, path array<{kind}>")
    step = inner.select(F.col("a").alias("last"), F.col("b").alias("node"))
    paths = inner.where("b > a").select(F.col("a").alias("first"), F.col("b").alias("node"), F.array("a", "b").alias("path"))
    for length in range(2, max_length + 1):
        paths = settled(paths.join(back, ["first", "node"]).where(F.col("steps") <= max_length - length + 1))
        if paths.isEmpty():
            break
        found = found.unionByName(paths.where("steps = 1").select(F.lit(length).alias("length"), F.concat("path", F.array("first")).alias("path")))
        onward = paths.select("first", F.col("node").alias("last"), "path").join(step, "last").where(F.expr("node > first and not array_contains(path, node)"))
        paths = onward.select("first", "node", F.concat("path", F.array("node")).alias("path"))
    return found


def cycle_counts(edges: DataFrame, project: str = "project_id") -> DataFrame:
    """project, cycle_count: the back edges of a depth-first walk, one cycle each (see `dfs_cycles`)."""
    return walks.cycle_counts(edges.select(project, "source_module_id", "target_module_id"), project, "source_module_id", "target_module_id")


def cycle_edges(edges: DataFrame, source: str = "source_module_id", target: str = "target_module_id") -> DataFrame:
    """Edges whose both ends are on cycles, of any length."""
    members = settled(cyclic_components(edges, source, target).select("module_id"))
    return edges.join(members.withColumnRenamed("module_id", source), source, "left_semi").join(members.withColumnRenamed("module_id", target), target, "left_semi")


def dfs_cycles(edges: DataFrame, project: str = "project_id") -> DataFrame:
    """project, path: one cycle for each back edge of a depth-first walk over the whole project in id order, from its least
    member and closed with it.

    Which edges are back edges depends on the order of the one walk, so a project is one task's work, in memory linear in
    its edges; projects are walked side by side. The walk keeps its own stack, so long chains are no problem."""
    return walks.cycle_paths(edges.select(project, "source_module_id", "target_module_id"), project, "source_module_id", "target_module_id")


def graph_edge_filter(edges: DataFrame, types: list[str] | None = None, include_external: bool = False) -> DataFrame:
    """edges with resolved; an empty list of types means all."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    return kept if include_external else kept.where("resolved")


def graph_view(nodes: DataFrame, edges: DataFrame, query: str = "", kind: str = "all", node: str = "module_id", label: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """Nodes whose label holds the query, and the edges of a type with both ends among them."""
    shown = nodes.where(F.contains(F.lower(label), F.lit(query.strip().lower()))) if query.strip() else nodes
    ids = shown.select(node)
    kept = edges.join(ids.withColumnRenamed(node, "source_module_id"), "source_module_id", "left_semi").join(ids.withColumnRenamed(node, "target_module_id"), "target_module_id", "left_semi")
    return shown, kept if kind == "all" else kept.where(F.col("type") == kind)


def order_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.orderBy("is_external", "label", "node_id"), edges.orderBy("source_module_id", "target_module_id", "type", "source_line")


def node_set(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules and what edges lead to outside them: one row for each id (as text)."""
    inside = modules.select(F.col("module_id").cast("string").alias("node_id"), F.lit(False).alias("is_external"))
    outside = edges.where("not resolved").select(F.concat(F.lit("ext:"), F.col("target_module_id").cast("string")).alias("node_id"), F.lit(True).alias("is_external"))
    return inside.unionByName(outside).dropDuplicates(["node_id"])


def direct_neighbours(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module_id, direct_dependents, direct_dependencies: sorted paths over resolved edges."""
    path = modules.select("module_id", "relative_path")
    near = edges.select("source_module_id", "target_module_id").distinct()
    users = near.join(path.withColumnRenamed("module_id", "source_module_id"), "source_module_id").groupBy(F.col("target_module_id").alias("module_id")).agg(F.array_sort(F.collect_set("relative_path")).alias("direct_dependents"))
    used = near.join(path.withColumnRenamed("module_id", "target_module_id"), "target_module_id").groupBy(F.col("source_module_id").alias("module_id")).agg(F.array_sort(F.collect_set("relative_path")).alias("direct_dependencies"))
    none = F.array().cast("array<string>")
    joined = modules.select("module_id").join(users, "module_id", "left").join(used, "module_id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("direct_dependents", "direct_dependencies")})


def closure_and_self(modules: DataFrame, dependents: DataFrame) -> DataFrame:
    """(module_id, dependent): who reaches a module, and the module itself."""
    return dependents.select("module_id", "dependent").unionByName(modules.select("module_id", F.col("module_id").alias("dependent")))


def _spread_entries(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module_id, entries: the entry points among its dependents and itself. Only entry points spread along the edges, so no
    pair of other modules is made."""
    links = settled(edges.select(F.col("source_module_id").alias("via"), F.col("target_module_id").alias("module_id")).distinct())
    known = fresh = settled(modules.where("is_entry_point").select(F.col("module_id").alias("entry"), "module_id"))
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("module_id", "via").join(links, "via").select("entry", "module_id").distinct()
        fresh = settled(step.join(known, ["entry", "module_id"], "left_anti"))
        known = settled(known.unionByName(fresh))
    found = known.groupBy("module_id").agg(F.collect_list("entry").alias("entries"))
    return modules.select("module_id").join(found, "module_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast(found.schema["entries"].dataType)))


def affected_entry_points(modules: DataFrame, edges: DataFrame, project: str = "project_id") -> DataFrame:
    """module_id, affected_entry_points: sorted paths of the entry points among its dependents and itself."""
    return dependent_facts(modules, edges, project).select("module_id", "affected_entry_points")


def entry_point_texts(modules: DataFrame, edges: DataFrame, separator: str = ",", project: str = "project_id") -> DataFrame:
    """module_id, affected_entry_points as one text. Modules that share a list come together, and it is made once for them."""
    small, large = walks.split_by_size(settled(edges.select(project, "source_module_id", "target_module_id").distinct()), project)
    nodes = modules.select(project, "module_id", F.when(F.col("is_entry_point"), F.col("relative_path")).alias("label"))
    own = nodes.where(F.col(project).isNotNull()) if large is None else nodes.join(large.select(project).distinct(), project, "left_anti").where(F.col(project).isNotNull())
    texts = walks.entry_texts(small, own, project, "source_module_id", "target_module_id", separator).select("module_id", F.col("entries").alias("affected_entry_points"))
    texts = texts.unionByName(modules.where(F.col(project).isNull()).select("module_id", F.lit("").alias("affected_entry_points")))
    if large is None:
        return texts
    there = affected_entry_points(modules.join(large.select(project).distinct(), project, "left_semi"), large, project)
    return texts.unionByName(there.withColumn("affected_entry_points", F.array_join("affected_entry_points", separator)))


def module_graph(modules: DataFrame, edges: DataFrame, symbols: DataFrame, warnings: DataFrame, types: list[str] | None = None, include_external: bool = False, top: int = 5) -> dict[str, DataFrame]:
    """The graph of each project: nodes, edges, top connected modules, orphans, entry points, cycles (one for each back edge of
    a walk in id order) and the summary of counts.

    modules: project_id, module_id, relative_path, language, parse_status, line_count, complexity, is_entry_point; edges:
    project_id, ends, type, resolved, source_line; symbols and warnings (parse errors among them): module_id. External
    targets are nodes only with include_external, and then their edges count for degrees; their language is that of the
    module of least id that uses them. Edges are checkpointed, as most parts read them; cycles, which may be as long as a
    project, aren't: they are counted by a walk of their own, and go out as they come."""
    shown = settled(graph_edge_filter(edges, types, include_external).select("project_id", "source_module_id", "target_module_id", "type", "resolved", "source_line"))
    inside = shown.where("resolved")
    text = lambda name: F.col(name).cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    ends = shown.select(F.col("source_module_id").alias("module_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(inside.select(F.col("target_module_id").alias("module_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = ends.groupBy("module_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    rated = quality.node_metrics(modules, symbols, warnings).join(degree, "module_id", "left").fillna(0, ["in_degree", "out_degree"]).withColumn("complexity_rating", s.complexity_rating(F.col("complexity")))
    own = rated.select(
        "project_id", text("module_id").alias("node_id"), F.col("relative_path").alias("label"), F.lit("module").alias("kind"), "language", "parse_status", "line_count", F.col("complexity").alias("complexity_score"), "complexity_rating",
        "warning_count", "symbol_count", "is_entry_point", F.lit(False).alias("is_external"), "in_degree", "out_degree",
    )
    users = shown.where("not resolved").join(modules.select(F.col("module_id").alias("source_module_id"), "language"), "source_module_id", "left")
    outside = users.groupBy("project_id", text("target_module_id").alias("label")).agg(F.count(F.lit(1)).alias("in_degree"), F.min_by("language", "source_module_id").alias("language"))
    kinds = {f.name: f.dataType for f in own.schema}
    blank = {c: none(kinds[c]) for c in ("parse_status", "line_count", "complexity_score", "complexity_rating")} | {c: F.lit(0).cast(kinds[c]) for c in ("warning_count", "symbol_count", "out_degree")}
    external = outside.withColumns(blank | {"node_id": F.concat(F.lit("ext:"), "label"), "kind": F.lit("external"), "is_entry_point": F.lit(False), "is_external": F.lit(True)}).select(own.columns)
    target = F.when(F.col("resolved"), text("target_module_id")).otherwise(F.concat(F.lit("ext:"), text("target_module_id")))
    named = s.edge_id(F.col("source_module_id"), F.col("target_module_id"), F.col("type"), F.col("source_line"))
    drawn = shown.select("project_id", named.alias("id"), text("source_module_id").alias("source"), target.alias("target"), "type", "resolved", "source_line")
    rings, counts = dfs_cycles(inside), cycle_counts(inside)
    return {"nodes": own.unionByName(external), "edges": drawn, "top_connected": top_connected(rated, top), "orphans": orphans(rated), "entry_points": entry_points(modules), "cycles": rings, "summary": graph_summary(rated, shown, counts)}


def graph_summary(nodes: DataFrame, edges: DataFrame, cycle_count: DataFrame, project: str = "project_id") -> DataFrame:
    """Counts of one graph for each project. nodes: with degrees, complexity_rating and is_entry_point; edges: with resolved."""
    n = nodes.groupBy(project).agg(F.count(F.lit(1)).alias("internal_nodes"), F.count_if(F.expr("in_degree = 0 and out_degree = 0")).alias("orphan_count"), F.count_if("is_entry_point").alias("entry_point_count"), F.count_if(F.col("complexity_rating").isin("high", "critical")).alias("high_complexity_count"))
    e = edges.groupBy(project).agg(F.count_if("resolved").alias("internal_edges"), F.count_if(~F.col("resolved")).alias("external_edges"), F.count_distinct(F.when(~F.col("resolved"), F.col("target_module_id"))).alias("external_nodes"))
    out = n.join(e, project, "left").join(cycle_count, project, "left")
    return out.fillna(0, ["internal_edges", "external_edges", "external_nodes", "cycle_count"])


def link_methods(symbols: DataFrame) -> DataFrame:
    """Adds parent_id: the class before a dotted name, else the module."""
    classes = symbols.where("kind = 'class'").groupBy("module_id", F.col("name").alias("_class")).agg(F.max_by("symbol_id", "ord").alias("class_id"))
    own = symbols.withColumn("_class", F.when(F.contains("qualified_name", F.lit(".")), F.substring_index("qualified_name", ".", 1)))
    return own.join(classes, ["module_id", "_class"], "left").withColumn("parent_id", F.coalesce("class_id", F.col("module_id").cast("string"))).drop("_class", "class_id")


def resolve_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (module_id, symbol_id, target, ord) with target_id: the last symbol of that name in the module; calls of itself go."""
    names = symbols.where("kind <> 'variable'").select("module_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("target"), "symbol_id", "ord")
    last = names.groupBy("module_id", "target").agg(F.max_by("symbol_id", "ord").alias("target_id"))
    return calls.join(last, ["module_id", "target"]).where("symbol_id <> target_id")


def cap_call_edges(call_edges: DataFrame, most: int = 50, module: str = "module_id", order: list[str] | None = None) -> DataFrame:
    """The first call edges of each module, with how many there are in all."""
    order = order or ["function_ord", "ord"]
    ranked = call_edges.withColumn("rank", F.row_number().over(Window.partitionBy(module).orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(module)))
    return ranked.where(F.col("rank") <= most)


def symbol_graph(modules: DataFrame, symbols: DataFrame, calls: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, classes, functions) and edges (contains, call) of modules."""
    shown = link_methods(symbols.where("kind <> 'variable'"))
    root = modules.select("module_id", F.col("module_id").cast("string").alias("node_id"), F.lit("module").alias("kind"), F.col("relative_path").alias("label"))
    nodes = root.unionByName(shown.select("module_id", F.col("symbol_id").alias("node_id"), "kind", F.col("name").alias("label")))
    contains = shown.select("module_id", F.col("parent_id").alias("source"), F.col("symbol_id").alias("target"), F.lit("contains").alias("type"))
    capped = cap_call_edges(resolve_calls(symbols, calls), most, order=["symbol_id", "ord"])
    return nodes, contains.unionByName(capped.select("module_id", F.col("symbol_id").alias("source"), F.col("target_id").alias("target"), F.lit("call").alias("type")))
