"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

Equal vectors are one node, with the least of their ids (no answer needs more). Nodes are linked to their nearest by
similarity of augmented vectors: a further component makes all norms equal, so that inner products become distances.
Random projections give first neighbours; each round then joins nodes with the vectors of their neighbours, forward
and reverse, compares neighbours with each other where at least one is new, and keeps the best. Searches start at the
query's own node and expand the best unexpanded nodes of a beam until the beam stays.

A node's lists are bounded (K forward, K reverse), whoever is popular; the rounds are Spark joins, and each round's table
is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm import common as c

#: Neighbours of a node; what a member of a list may gain from one comparison of the list.
K, GAIN = 40, 6
#: Rounds of joins at most; they end when fewer than this share of the lists changed.
ROUNDS, SETTLED = 12, 0.01
#: Random projections for the first lists, and the nodes that are compared along each.
PROJECTIONS, CHUNK = 4, 256
#: Nodes that a search keeps, expands in a step, and steps at most.
BEAM, EXPAND, STEPS = 120, 24, 12


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector of the rows that take part: of the commonest size, without nulls, not zero, all finite."""
    v = F.col("vector")
    sound = F.expr("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(sound)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size")
    return rows.join(F.broadcast(sizes), F.size("vector") == F.col("size"), "left_semi")


def _dots(rows: DataFrame, left: str, right: str, keep: list[str], out: str = "sim") -> DataFrame:
    """keep and the inner product, in double precision, of two columns of float arrays."""
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in keep) + f", {out} double"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(len(keep) + i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.einsum("ij,ij->i", a, b))], [*keep, out])

    return rows.select(*keep, left, right).mapInArrow(run, schema)


EDGES = "a long, b long, sim double"


def _best_pairs(ids: np.ndarray, x: np.ndarray, most: int, least: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the ids its `most` best others that are better than its least, of pairs with a fresh member."""
    sim = (x @ x.T).astype(np.float64)
    np.fill_diagonal(sim, -np.inf)
    sim[~(fresh[:, None] | fresh[None, :])] = -np.inf
    sim[ids[:, None] == ids[None, :]] = -np.inf
    most = min(most, len(ids) - 1)
    if most < 1:
        return ids[:0], ids[:0], sim[0, :0]
    near = np.argpartition(-sim, most - 1, 1)[:, :most]
    best = np.take_along_axis(sim, near, 1)
    row, column = np.nonzero(best > least[:, None])
    return ids[row], ids[near[row, column]], best[row, column]


def _first_lists(nodes: DataFrame, dims: int) -> DataFrame:
    """Edges between nodes that are close along random directions."""
    spark, out = nodes.sparkSession, None
    n = nodes.count()
    size, most = max(1, min(4 * c.partitions(spark), n // (2 * CHUNK))), K if n <= CHUNK else K // 4
    for p in range(PROJECTIONS):
        direction = np.random.default_rng(p).normal(size=dims).tolist()
        along = F.aggregate(F.zip_with("x", F.array(*map(F.lit, direction)), lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)

        def compare(batches):
            for batch in batches:
                n = batch.num_rows
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(n, -1) if n else None
                for a in range(0, max(n - CHUNK // 2, min(n, 1)), CHUNK // 2):  # chunks overlap by half
                    own = slice(a, a + CHUNK)
                    m = len(ids[own])
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in _best_pairs(ids[own], x[own], most, np.full(m, -np.inf), np.ones(m, bool))], ["a", "b", "sim"])

        part = nodes.select("node", "x").withColumn("along", along).repartitionByRange(size, "along").sortWithinPartitions("along").select("node", "x").mapInArrow(compare, EDGES)
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(edges: DataFrame) -> DataFrame:
    """The K best of each node's edges, once each."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")).withColumn("rank", rank).where(F.col("rank") <= K).drop("rank")


def _reverse(edges: DataFrame) -> DataFrame:
    """Up to K edges to each node, turned round: the nearest, so a popular node's list is bounded too."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= K).select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh")


def graph(nodes: DataFrame) -> DataFrame:
    """(a, b, sim): each node's K nearest that NN-descent finds. nodes: node, x (augmented)."""
    first = nodes.select(F.size("x").alias("n")).first()
    if first is None:
        return nodes.sparkSession.createDataFrame([], EDGES)
    edges = c.kept(_nearest(_first_lists(nodes, first["n"]).withColumn("fresh", F.lit(True))), "edges")
    for _ in range(ROUNDS):
        least = edges.groupBy("a").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(F.lit(float("-inf"))).alias("least"))
        known = nodes.join(least.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("b"), "x", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        around = edges.select("a", "b", "fresh").unionByName(_reverse(edges).select("a", "b", "fresh")).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
        # each node's bounded list, with its members' vectors; those without a fresh member have been compared before
        active = around.where("fresh").select("a").distinct()
        lists = around.join(active, "a", "left_semi").join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "x", "least", "fresh")).alias("near")).select("near")

        def compare(batches):
            for batch in batches:
                near = batch.column(0)
                flat, offsets = near.flatten(), near.offsets.to_numpy()
                ids, least, fresh = flat.field(0).to_numpy(), flat.field(2).to_numpy(), flat.field(3).to_numpy(zero_copy_only=False)
                x = flat.field(1).flatten().to_numpy().reshape(len(ids), -1)
                offsets = offsets - offsets[0]
                found = [_best_pairs(ids[s:e], x[s:e], GAIN, least[s:e], fresh[s:e]) for s, e in zip(offsets, offsets[1:], strict=False) if fresh[s:e].any()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*found, strict=True)], ["a", "b", "sim"])

        better = lists.mapInArrow(compare, EDGES).withColumn("fresh", F.lit(True))
        edges = c.kept(_nearest(edges.withColumn("fresh", F.lit(False)).unionByName(better)), "edges")
        counts = edges.agg(F.count_if("fresh").alias("new"), F.count(F.lit(1)).alias("all")).first()
        if counts["new"] <= SETTLED * counts["all"]:
            break
    return edges.select("a", "b", "sim")


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """(q, b, sim): the beam of each query. queries: q (a node), y (its vector); nodes: node, vector; edges: a, b."""
    turned = _reverse(edges.withColumn("fresh", F.lit(False)))
    linked = c.kept(edges.select("a", "b").unionByName(turned.select("a", "b")).distinct(), "linked")
    vectors = nodes.select(F.col("node").alias("b"), "vector")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "b"))
    start = _dots(queries.withColumn("b", F.col("q")).withColumn("z", F.col("y")), "y", "z", ["q", "b"])
    beam = c.kept(start.withColumn("done", F.lit(False)), "beam")
    for _ in range(STEPS):
        open_rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "b"))
        opened = beam.where("not done").withColumn("r", open_rank).where(F.col("r") <= EXPAND).select("q", F.col("b").alias("a"))
        reached = opened.join(linked, "a").select("q", "b").distinct().join(beam.select("q", "b"), ["q", "b"], "left_anti")
        scored = _dots(reached.join(vectors, "b").join(queries, "q"), "y", "vector", ["q", "b"]).withColumn("done", F.lit(False))
        marked = beam.join(opened.select("q", F.col("a").alias("b"), F.lit(True).alias("now")), ["q", "b"], "left").select("q", "b", "sim", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        beam = c.kept(marked.unionByName(scored).withColumn("r", best).where(F.col("r") <= BEAM).drop("r"), "beam")
        # what may still improve an answer: an unexpanded node among the first of a beam
        ahead = beam.withColumn("r", best).where((F.col("r") <= top + EXPAND) & ~F.col("done"))
        if ahead.isEmpty():
            break
    return beam.select("q", "b", "sim")


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest found of each query: rows whose id is divisible by `every`.

    Nearness is the inner product of the original vectors in double precision, ties go to the smaller id. Null, zero
    and non-finite vectors, and those not of the commonest size, take no part, nor do null ids. A repeated row is one
    row. Fewer candidates than `top` are all returned; a query that is alone has no rows.
    """
    rows = c.kept(usable(vectors, vec_id, vector).dropDuplicates(["vec_id", "vector"]), "vectors")
    # nodes are different vectors; of each the least ids that an answer can need (its own row is none)
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = c.kept(rows.withColumn("r", rank).where(F.col("r") <= top + 1), "members")
    nodes = c.kept(members.where("r = 1").select(F.col("vec_id").alias("node"), "vector"), "nodes")
    ids = c.kept(members.join(nodes, "vector").select("node", "vec_id"), "ids")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, u: s + u.cast("double") * u.cast("double"))
    longest = nodes.agg(F.max(norm).alias("longest"))
    augmented = c.kept(nodes.crossJoin(F.broadcast(longest)).select("node", F.concat(F.col("vector").cast("array<double>"), F.array(F.sqrt(F.greatest(F.lit(0.0), F.col("longest") - norm)))).cast("array<float>").alias("x")), "augmented")
    edges = graph(augmented)
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = c.kept(asked.join(nodes, "vector").select("vec_id", "node"), "asked")
    own = c.kept(nodes.join(queries.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("q"), F.col("vector").alias("y")), "own")
    beam = search(own, nodes, edges, top)
    # one answer of top + 1 rows for each node, then for each query without its own row
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id"))
    answers = beam.join(ids, beam["b"] == ids["node"]).select("q", "vec_id", "sim").withColumn("r", order).where(F.col("r") <= top + 1)
    listed = answers.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "sim"))).alias("found"))
    mine = queries.withColumnRenamed("vec_id", "query_id").join(listed, queries["node"] == listed["q"])
    others = F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, top)
    return mine.select("query_id", F.posexplode(others).alias("pos", "s")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.sim").alias("score"))
