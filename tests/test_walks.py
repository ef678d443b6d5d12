"""Walks over projects' graphs against plain ones, and the two ways for small and large projects against each other."""

import itertools
import random
import tracemalloc

import pytest

from codecorpus.operators import graph, walks


def edges(spark, rows):
    return spark.createDataFrame(rows, "project_id string, source_module_id string, target_module_id string")


def plain_walk(pairs):
    """Back-edge cycles of a recursive walk in id order over a whole project."""
    nodes, after, done, path, found = {x for p in pairs for x in p}, {}, set(), [], set()
    for a, b in sorted(set(pairs)):
        if a != b:
            after.setdefault(a, []).append(b)

    def visit(x):
        done.add(x)
        path.append(x)
        for y in after.get(x, []):
            if y in path:
                ring = path[path.index(y) :]
                k = ring.index(min(ring))
                found.add((*ring[k:], *ring[:k], ring[k]))
            elif y not in done:
                visit(y)
        path.pop()

    for x in sorted(nodes):
        if x not in done:
            visit(x)
    return found


def plain_reach(pairs):
    after, out = {}, {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for x in {x for p in pairs for x in p}:
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[x] = seen
    return out


def random_pairs(seed, n, m):
    r = random.Random(seed)
    return [(f"{r.randrange(n):02d}", f"{r.randrange(n):02d}") for _ in range(m)]


GRAPHS = {f"p{i}": random_pairs(i, 4 + i % 12, 3 + 3 * (i % 9)) for i in range(60)}
ROWS = [(p, f"{p}-{a}", f"{p}-{b}") for p, pairs in GRAPHS.items() for a, b in pairs]
NAMED = {p: [(f"{p}-{a}", f"{p}-{b}") for a, b in pairs] for p, pairs in GRAPHS.items()}


def test_cycles_are_those_of_one_walk_over_the_whole_project(spark):
    got = {}
    for r in graph.dfs_cycles(edges(spark, ROWS)).collect():
        assert tuple(r.path) not in got.setdefault(r.project_id, set())
        got[r.project_id].add(tuple(r.path))
    want = {p: plain_walk(pairs) for p, pairs in NAMED.items()}
    assert got == {p: x for p, x in want.items() if x}
    assert {r.project_id: r.cycle_count for r in graph.cycle_counts(edges(spark, ROWS)).collect()} == {p: len(x) for p, x in want.items()}


def test_where_a_walk_enters_a_component_counts(spark):
    e = edges(spark, [("p", *x) for x in ["ad", "db", "bc", "cd", "cb", "bd"]])
    assert {"".join(r.path) for r in graph.dfs_cycles(e).collect()} == {"bcb", "bcdb", "bdb"}


def test_tight_components_and_long_chains(spark):
    full = [("full", f"{a:02d}", f"{b:02d}") for a, b in itertools.permutations(range(50), 2)]
    ring = [("ring", f"{i:06d}", f"{(i + 1) % 30_000:06d}") for i in range(30_000)]
    counts = {r.project_id: r.cycle_count for r in graph.cycle_counts(edges(spark, full + ring)).collect()}
    assert counts == {"full": 50 * 49 // 2, "ring": 1}
    facts = walks.Reach(walks.numbered([x[1] for x in ring], [x[2] for x in ring])[1])
    assert set(facts.counts()) == {29_999}


@pytest.mark.parametrize("limit", [10**6, 9, -1])
def test_small_and_large_projects_give_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(walks, "LIMIT", limit)
    few = {p: NAMED[p] for p in ["p1", "p2", "p5", "p17"]}
    e = edges(spark, [(p, *x) for p, pairs in few.items() for x in pairs])
    reach = {x: s for pairs in few.values() for x, s in plain_reach(pairs).items()}
    assert {tuple(r) for r in graph.transitive_dependents(e).collect()} == {(b, a) for a, s in reach.items() for b in s if a != b}
    components = {x: min(y for y in s if x in reach[y]) for x, s in reach.items() if any(y != x and x in reach[y] for y in s)}
    assert {tuple(r) for r in graph.cyclic_components(e).collect()} == set(components.items())
    modules = [(p, x, f"{x}.py", i % 3 == 0) for p, pairs in few.items() for i, x in enumerate(sorted({x for y in pairs for x in y} | {f"{p}-alone"}))]
    m = spark.createDataFrame(modules, "project_id string, module_id string, relative_path string, is_entry_point boolean")
    entries = {x for _, x, _, entry in modules if entry}
    want = {x: (sum(x in s and a != x for a, s in reach.items()), sorted(f"{y}.py" for y in entries if y == x or x in reach.get(y, ()))) for _, x, _, _ in modules}
    assert {r.module_id: (r.blast_radius, r.affected_entry_points) for r in graph.dependent_facts(m, e).collect()} == want
    assert {r.module_id: r.blast_radius for r in graph.blast_radii(m.select("project_id", "module_id"), e).collect()} == {x: n for x, (n, _) in want.items()}


def test_bits_in_many_blocks(monkeypatch):
    monkeypatch.setattr(walks, "BITS_BYTES", 1)
    monkeypatch.setattr(walks, "PIECE", 50)
    pairs = [(a, b) for a, b in random_pairs(7, 90, 150) if a != b] + [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(100)]
    ids, after = walks.numbered([a for a, _ in pairs], [b for _, b in pairs])
    reach, found = plain_reach(pairs), walks.Reach(after)
    others = {x: {a for a, s in reach.items() if x in s and a != x} for x in ids}
    assert found.counts() == [len(others[x]) for x in ids]
    assert {(ids[a], ids[b]) for x, y in found.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)} == {(x, y) for x, s in others.items() for y in s}
    assert found.listed([3, 90]) == [[i for i in (3, 90) if i == k or ids[k] in reach[ids[i]]] for k in range(len(ids))]


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pairs_go_out_in_small_pieces():
    """all pairs of a ring of 1,500 modules, 36 MB of numbers, while little of them is held."""
    after = [[(i + 1) % 1500] for i in range(1500)]
    sizes = []
    assert peak_mb(lambda: sizes.extend(len(a) for a, _ in walks.Reach(after).pairs())) < 20
    assert sum(sizes) == 1500 * 1499


def test_written_pairs_are_small(spark, tmp_path):
    """F2, F3: 9.6 M pairs of a ring of 3,000 modules and 200 that it leads to; files were 1.5 bytes a pair where lists were whole."""
    rows = [("p", i, (i + 1) % 3000) for i in range(3000)] + [("p", 7 * i, 3000 + i) for i in range(200)]
    pairs = graph.transitive_dependents(spark.createDataFrame(rows, "project_id string, source_module_id long, target_module_id long"))
    pairs.write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3000 * 2999 + 200 * 3000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 9_597_000


def test_small_projects_are_walked_side_by_side(spark):
    """all edges of three projects were one task's, as they are few bytes."""
    rows = [(p, i, (i + 1) % 9) for p in "abc" for i in range(9)]
    pairs = graph.transitive_dependents(spark.createDataFrame(rows, "project_id string, source_module_id long, target_module_id long"))
    assert pairs.select(graph.F.spark_partition_id().alias("at")).distinct().count() == 3


def test_entries_take_bits_in_blocks(monkeypatch):
    """6,000 entries reach each of 6,000 modules, all of which lead to one more: 36 M bits that no task holds at once."""
    monkeypatch.setattr(walks, "BITS_BYTES", 1 << 18)
    n = 6000
    after = [[i + 1] for i in range(n - 1)] + [list(range(n, 2 * n))] + [[2 * n] for _ in range(n)] + [[]]
    reach, lists = walks.Reach(after), {}
    assert peak_mb(lambda: lists.update((k, len(x)) for k, x in reach.marked({i: i for i in range(n)}, n))) < 5
    assert [lists[k] for k in reach.of] == [*range(1, n + 1), *[n] * (n + 1)]


@pytest.mark.parametrize("longest", [2, 3, 5, 8])
def test_elementary_cycles_of_a_length(spark, longest):
    pairs = NAMED["p8"] + NAMED["p20"]
    nodes, have, want = sorted({x for p in pairs for x in p}), set(pairs), set()

    def grow(path):
        if (path[-1], path[0]) in have and len(path) > 1:
            want.add((*path, path[0]))
        if len(path) < longest:
            for y in nodes:
                if y > path[0] and y not in path and (path[-1], y) in have:
                    grow([*path, y])

    for x in nodes:
        grow([x])
    got = graph.cycles(edges(spark, [("p", *x) for x in pairs]), longest).collect()
    assert len(got) == len(want) and {tuple(r.path) for r in got} == want and all(r.length == len(r.path) - 1 for r in got)


def test_dependency_cycles_of_any_length(spark, tmp_path):
    """a ring of 40 modules, each of which leads to the next."""
    from codecorpus import registry

    spark.createDataFrame([(i, "b") for i in range(40)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, (i + k) % 40, 2.0 - k) for i in range(40) for k in (0, 1)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["g3_dependency_cycles"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(40, "-".join(map(str, [*range(40), 0])))]


def test_odd_edges(spark):
    e = edges(spark, [("p", "a", "a"), ("p", None, "b"), ("p", "b", None), (None, "x", "y"), ("p", "b", "c"), ("p", "b", "c"), ("p", "c", "b")])
    assert [tuple(r) for r in graph.dfs_cycles(e).collect()] == [("p", ["b", "c", "b"])]
    assert {tuple(r) for r in graph.cyclic_components(e.where("project_id is not null")).collect()} == {("b", "b"), ("c", "b")}
    none = edges(spark, [])
    assert graph.dfs_cycles(none).count() == graph.cyclic_components(none).count() == graph.transitive_dependents(none).count() == graph.cycles(none, 4).count() == 0


def test_pieces_of_pairs_and_lists_stay_small(spark, monkeypatch):
    """A component whose members all reach each other comes in pieces too; the lists of entry points as well."""
    monkeypatch.setattr(walks, "PIECE", 500)
    monkeypatch.setattr(walks, "LISTED", 300)
    ring = [(f"{i:03d}", f"{(i + 1) % 100:03d}") for i in range(100)]
    sources, targets = [a for a, _ in ring], [b for _, b in ring]
    sizes = [len(a) for a, _ in walks.Reach(walks.numbered(sources, targets)[1]).pairs()]
    assert sum(sizes) == 100 * 99 and max(sizes) <= 2 * 500
    asked = [f"{i:03d}" for i in range(110)]
    labels = [None] * 100 + [f"{x}.py" if i % 10 == 0 else None for i, x in enumerate(asked)]
    rows = sources + asked, targets + [None] * len(asked)
    pieces = list(walks._facts(True)(*walks.numbered(*rows), *rows, labels))
    assert max(len(p[3].flatten()) for p in pieces) <= 300 and sum(len(p[0]) for p in pieces) == 110
    got = {x: (n, k, e) for p in pieces for x, n, k, e in zip(*p[:3], p[3].to_pylist(), strict=True)}
    assert got["007"] == (99, 10, [f"{i:03d}.py" for i in range(0, 100, 10)]) and got["100"] == (0, 1, ["100.py"]) and got["105"] == (0, 0, [])


def test_entry_points_of_one_path_count_once(spark):
    m = spark.createDataFrame([("p", "a", "x.py", True), ("p", "b", "x.py", True), ("p", "c", "c.py", False), (None, "d", "d.py", False)], "project_id string, module_id string, relative_path string, is_entry_point boolean")
    e = edges(spark, [("p", "a", "c"), ("p", "b", "c")])
    assert {r.module_id: (r.blast_radius, r.entry_count, r.affected_entry_points) for r in graph.dependent_facts(m, e).collect()} == {"a": (0, 1, ["x.py"]), "b": (0, 1, ["x.py"]), "c": (2, 1, ["x.py"]), "d": (0, 0, [])}
    assert {r.module_id: r.entry_count for r in graph.dependent_facts(m, e, listed=False).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}


@pytest.mark.parametrize("limit", [10**6, 9])
def test_modules_that_share_a_list_come_together(spark, monkeypatch, limit):
    """a list was made and handed on for each module, also where all have the same."""
    monkeypatch.setattr(walks, "LIMIT", limit)
    monkeypatch.setattr(walks, "LISTED", 30)
    m = spark.createDataFrame([(p, x, f"{x}.py", i % 3 == 0) for p, pairs in NAMED.items() for i, x in enumerate(sorted({x for y in pairs for x in y} | {f"{p}-alone"}))] + [(None, "none", "none.py", True)], "project_id string, module_id string, relative_path string, is_entry_point boolean")
    few = m.where("project_id is null or project_id in ('p1', 'p2', 'p5', 'p17')") if limit == 9 else m
    e = edges(spark, ROWS).join(few.select("project_id").distinct(), "project_id", "left_semi")
    want = {r.module_id: ",".join(r.affected_entry_points) for r in graph.affected_entry_points(few, e).collect()}
    got = graph.entry_point_texts(few, e).collect()
    assert {r.module_id: r.affected_entry_points for r in got} == want and len(got) == len(want)
    after = [[(i + 1) % 200] for i in range(200)] + [[200 + i] for i in range(1, 101)] + [[]]
    after[0] = [1, 200]
    n, labels = len(after), [f"{i:03d}" if i % 10 == 0 and i < 200 or i > 200 and i % 10 == 5 else None for i in range(len(after))]
    sources, targets = [a for a, bs in enumerate(after) for _ in bs] + list(range(n)), [b for bs in after for b in bs] + [None] * n
    pieces = list(walks._alike(*walks.numbered(sources, targets), sources, targets, [None] * (len(sources) - n) + labels))
    lists = [(tuple(x), tuple(y)) for nodes, entries in pieces for x, y in zip(nodes.to_pylist(), entries.to_pylist(), strict=True)]
    assert sum(len(x) for x, _ in lists) == n and len(lists[0][0]) == 205 and max(len(p[1].flatten()) for p in pieces) <= 30 + 31


def test_cycles_of_a_module_graph_arent_checkpointed(spark, monkeypatch):
    """Paths of cycles may be as long as a project; edges are what several parts read."""
    kept = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(set(df.columns)) or real(df))
    m = spark.createDataFrame([("p", x, f"{x}.py", "python", "complete", 1, 1, False) for x in "abc"], "project_id string, module_id string, relative_path string, language string, parse_status string, line_count int, complexity int, is_entry_point boolean")
    e = spark.createDataFrame([("p", a, b, "import", True, 1) for a, b in ("ab", "bc", "ca", "ba")], "project_id string, source_module_id string, target_module_id string, type string, resolved boolean, source_line int")
    none = m.select("module_id").where("false")
    g = graph.module_graph(m, e, none, none)
    assert kept and not any("path" in c for c in kept)
    assert sorted(r.path for r in g["cycles"].collect()) == [["a", "b", "a"], ["a", "b", "c", "a"]] and g["summary"].first().cycle_count == 2
