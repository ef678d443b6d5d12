"""What a walk over one project's graph gives: cycles of back edges, components, counts of dependents, entry points.

A project is a group of its own, so projects are walked side by side, each in memory that is linear in its edges (counts
of dependents take bits in blocks of bounded size). Projects of more than LIMIT edges don't go this way where a
distributed one exists; see the callers in `graph`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.shipping import ship

#: Edges of a project that one task takes where there is a distributed way for larger ones.
LIMIT = 2_000_000
#: Bytes of the bit sets that a task holds at a time.
BITS_BYTES = 16 << 20
#: Pairs, or nodes of paths, that one batch of results holds, about.
PIECE = 1 << 17
#: Nodes whose dependents are looked for at a time, and dependents that go out together for one node after the other: these repeat
#: while they are near, so what is written of all pairs stays small.
ASKED, RUN = 1 << 12, 1 << 8
#: Tasks for each core that projects are dealt over; Spark doesn't merge them, as few edges may be much work.
TASKS = 16
#: Labels that one batch of lists holds, about.
LISTED = 1 << 18


def numbered(sources: list, targets: list) -> tuple[list, list[list[int]]]:
    """Nodes in order, and each one's targets, once each and in order; no loops. A null end is no edge."""
    ids = sorted({x for ends in (sources, targets) for x in ends if x is not None})
    at = {x: i for i, x in enumerate(ids)}
    after: list[list[int]] = [[] for _ in ids]
    for a, b in zip(sources, targets, strict=True):
        if a is not None and b is not None and a != b:
            after[at[a]].append(at[b])
    return ids, [sorted(set(x)) for x in after]


def back_edges(after: list[list[int]]) -> Iterator[list[int]]:
    """The cycle of each back edge of a depth-first walk in id order, rotated to begin with its least node, not closed."""
    depth = [-1] * len(after)  # on the path: place in it; done: -2
    for root in range(len(after)):
        if depth[root] != -1:
            continue
        path, turns = [root], [iter(after[root])]
        depth[root] = 0
        while path:
            for b in turns[-1]:
                if depth[b] >= 0:
                    ring = path[depth[b] :]
                    k = ring.index(min(ring))
                    yield ring[k:] + ring[:k]
                elif depth[b] == -1:
                    depth[b] = len(path)
                    path.append(b)
                    turns.append(iter(after[b]))
                    break
            else:
                depth[path.pop()] = -2
                turns.pop()


def count_back_edges(after: list[list[int]]) -> int:
    """How many cycles `back_edges` gives; all differ, as each has one edge against the walk. Paths aren't made."""
    state, n = bytearray(len(after)), 0
    for root in range(len(after)):
        if state[root]:
            continue
        path, turns = [root], [iter(after[root])]
        state[root] = 1
        while path:
            for b in turns[-1]:
                if state[b] == 1:
                    n += 1
                elif not state[b]:
                    state[b] = 1
                    path.append(b)
                    turns.append(iter(after[b]))
                    break
            else:
                state[path.pop()] = 2
                turns.pop()
    return n


def components(after: list[list[int]]) -> tuple[list[int], int]:
    """Each node's strongly connected component and how many there are; numbers fall along edges between components."""
    n = len(after)
    low, found, of, count = [0] * n, [0] * n, [-1] * n, 0
    clock, held = 1, []
    for root in range(n):
        if found[root]:
            continue
        found[root] = low[root] = clock
        clock += 1
        held.append(root)
        path, turns = [root], [iter(after[root])]
        while path:
            a = path[-1]
            for b in turns[-1]:
                if not found[b]:
                    found[b] = low[b] = clock
                    clock += 1
                    held.append(b)
                    path.append(b)
                    turns.append(iter(after[b]))
                    break
                if of[b] < 0 and found[b] < low[a]:
                    low[a] = found[b]
            else:
                path.pop()
                turns.pop()
                if path and low[a] < low[path[-1]]:
                    low[path[-1]] = low[a]
                if low[a] == found[a]:
                    while True:
                        x = held.pop()
                        of[x] = count
                        if x == a:
                            break
                    count += 1
    return of, count


class Reach:
    """Who reaches whom: a component's set of those before it is the union of its neighbours' sets, as bits.

    Components are taken in order along the edges, and bits in blocks, so that all sets of a block fit into BITS_BYTES.
    """

    def __init__(self, after: list[list[int]]):
        self.n = len(after)
        self.of, count = components(after)
        self.before: list[set[int]] = [set() for _ in range(count)]
        self.members: list[list[int]] = [[] for _ in range(count)]
        for a, bs in enumerate(after):
            self.members[self.of[a]].append(a)
            for b in bs:
                if self.of[b] != self.of[a]:
                    self.before[self.of[b]].add(self.of[a])

    def sets(self, place: dict[int, int], size: int, width: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(first place of a block, component, the bits of the places in the block whose nodes reach it, its own included).

        place: of the nodes that are asked for, under size; several nodes may share one. A component's bits go once all
        that it leads to have theirs."""
        count = len(self.members)
        width = min(max(64, size), width or max(64, 8 * BITS_BYTES // max(1, count)))
        onward = [0] * count
        for js in self.before:
            for j in js:
                onward[j] += 1
        for first in range(0, size, width):
            held, left = [0] * count, onward.copy()
            for k in range(count - 1, -1, -1):  # a component after all that lead to it
                own = _mask([place[x] - first for x in self.members[k] if x in place and first <= place[x] < first + width], width)
                for j in self.before[k]:
                    own |= held[j]
                    left[j] -= 1
                    if not left[j]:
                        held[j] = 0
                if left[k]:
                    held[k] = own
                yield first, k, own

    def counts(self, place: dict[int, int] | None = None, size: int | None = None) -> list[int]:
        """For each node how many others reach it; with places, how many of them belong to nodes that reach it or to itself."""
        totals = [0] * len(self.members)
        for _, k, own in self.sets({i: i for i in range(self.n)} if place is None else place, self.n if place is None else size):
            totals[k] += own.bit_count()
        return [totals[k] - (place is None) for k in self.of]

    def marked(self, place: dict[int, int], size: int, near: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(component, the places whose nodes reach it or are in it, in order); with near, of the block that has this component.

        Blocks of components go back against the edges as bits, so that all sets of a block and its table of places fit into
        BITS_BYTES each."""
        count = len(self.members)
        width = max(64, 8 * BITS_BYTES // max(1, count, size))
        places: dict[int, list[int]] = {}
        for x, p in place.items():
            places.setdefault(self.of[x], []).append(p)
        for first in range(0, count if size else 0, width):
            if near is not None and not first <= near < first + width:
                continue
            led = [0] * count
            reaching = [0] * size
            here = min(width, count - first)
            for k in range(first, count):  # a component after all that it leads to
                own, led[k] = led[k] | (1 << k - first if k < first + here else 0), 0
                for p in places.get(k, ()):
                    reaching[p] |= own
                for j in self.before[k] if own else ():
                    led[j] |= own
            stride = (here + 7) // 8
            table = np.frombuffer(b"".join(x.to_bytes(stride, "little") for x in reaching), np.uint8).reshape(size, stride)
            del reaching
            for i in range(stride):
                bits = np.unpackbits(table[:, i : i + 1], axis=1, bitorder="little")
                for k in range(first + 8 * i, min(first + 8 * i + 8, first + here)):
                    yield k, np.flatnonzero(bits[:, k - first - 8 * i])

    def listed(self, chosen: list[int]) -> list[list[int]]:
        """For each node which of the chosen ones reach it or are it, in order."""
        found: list[list[int]] = [[] for _ in self.members]
        for k, at in self.marked({x: i for i, x in enumerate(chosen)}, len(chosen)):
            found[k] = [chosen[i] for i in at.tolist()]
        return [found[k] for k in self.of]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, others that all reach each of them, up to RUN): a node may be among its others.

        ASKED others are looked for at a time, fewer where their sets would take more than BITS_BYTES, and nodes that
        they reach alike are taken together, whatever their components."""
        width = min(ASKED, max(64, 8 * BITS_BYTES // max(1, len(self.members))))
        alike: dict[int, list[int]] = {}
        last = 0

        def found(first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for own, nodes in alike.items():
                reaching, nodes = first + _bits(own), np.asarray(nodes)
                for i in range(0, len(reaching), RUN):
                    yield nodes, reaching[i : i + RUN]

        for first, k, own in self.sets({i: i for i in range(self.n)}, self.n, width):
            if first != last:
                yield from found(last)
                alike, last = {}, first
            if own:
                alike.setdefault(own, []).extend(self.members[k])
        yield from found(last)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, another that reaches it), in pieces of about PIECE, in the order of `blocks`."""
        nodes, others, held = [], [], 0
        for members, reaching in self.blocks():
            step = max(1, PIECE // len(reaching))
            for i in range(0, len(members), step):
                x, y = np.repeat(members[i : i + step], len(reaching)), np.tile(reaching, len(members[i : i + step]))
                kept = x != y
                nodes.append(x[kept])
                others.append(y[kept])
                held += len(nodes[-1])
                if held >= PIECE:
                    yield np.concatenate(nodes), np.concatenate(others)
                    nodes, others, held = [], [], 0
        if held:
            yield np.concatenate(nodes), np.concatenate(others)


def _mask(places: list[int], width: int) -> int:
    if len(places) < 3:
        return sum(1 << p for p in set(places))
    held = bytearray((width + 7) // 8)
    for p in places:
        held[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(held, "little")


def _bits(own: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(own.to_bytes((own.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def split_by_size(edges: DataFrame, project: str, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the projects that a task may take each, and those of larger ones (None where there are none)."""
    large = edges.groupBy(project).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (LIMIT if limit is None else limit)).select(project)
    names = large.limit(1).count()
    if not names:
        return edges, None
    return edges.join(large, project, "left_anti"), edges.join(large, project, "left_semi")


def _walked(edges: DataFrame, project: str, source: str, target: str, walk, schema: str, label: str | None = None) -> DataFrame:
    """walk(nodes, targets, sources, targets of rows, their labels) of each project's graph yields columns after the project's;
    edges without a project go. Projects are dealt over tasks by themselves, however few their edges are."""
    ship(edges.sparkSession)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        sources, targets = held.column("_source").to_pylist(), held.column("_target").to_pylist()
        of, name = held.schema.field("_source").type, held.column("_project")[0]
        labels = held.column("_label").to_pylist() if label else []
        kinds = {"id": of, "ids": pa.list_(of), "n": pa.int64()}
        del held
        for columns in walk(*numbered(sources, targets), sources, targets, labels):
            arrays = [x if k == "made" else pa.array(x, kinds[k]) for x, k in zip(columns, walk.kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(arrays[0])), *arrays], ["_project", *names])

    picked = edges.select(F.col(project).alias("_project"), F.col(source).alias("_source"), F.col(target).alias("_target"), *([F.col(label).alias("_label")] if label else [])).where("_project is not null")
    dealt = picked.repartition(TASKS * edges.sparkSession.sparkContext.defaultParallelism, "_project")
    return dealt.groupBy("_project").applyInArrow(run, f"_project {edges.schema[project].dataType.simpleString()}, {schema}").withColumnRenamed("_project", project)


def _kinds(*kinds: str):
    def named(f):
        f.kinds = kinds
        return f

    return named


@_kinds("ids")
def _paths(ids, after, sources, targets, labels):
    rings, held = [], 0
    for r in back_edges(after):
        rings.append([ids[i] for i in [*r, r[0]]])
        held += len(r)
        if held > PIECE:
            yield [rings]
            rings, held = [], 0
    yield [rings]


@_kinds("n")
def _count(ids, after, sources, targets, labels):
    yield [[count_back_edges(after)]]


@_kinds("id", "id")
def _cyclic(ids, after, sources, targets, labels):
    of, count = components(after)
    least: dict[int, int] = {}
    size = [0] * count
    for x, k in enumerate(of):
        least.setdefault(k, x)
        size[k] += 1
    on = [x for x, k in enumerate(of) if size[k] > 1]
    yield [[ids[x] for x in on], [ids[least[of[x]]] for x in on]]


def _asked(ids: list, sources: list, targets: list, labels: list) -> tuple[dict[int, str | None], list[str], dict[int, int]]:
    """The nodes that rows without a target ask for with their labels, the different labels in order, and the place there of each node that has one."""
    at = {x: i for i, x in enumerate(ids)}
    asked = {at[a]: label for a, b, label in zip(sources, targets, labels, strict=True) if b is None and a is not None}
    shown = sorted({x for x in asked.values() if x is not None})
    number = {x: i for i, x in enumerate(shown)}
    return asked, shown, {i: number[x] for i, x in asked.items() if x is not None}


def _facts(listed: bool):
    """The walk of `dependent_facts`: rows without a target are the nodes that are asked for, their labels those of entries."""

    def walk(ids, after, sources, targets, labels):
        asked, shown, place = _asked(ids, sources, targets, labels)
        reach = Reach(after)
        dependents, entries = reach.counts(), reach.counts(place, len(shown))
        if not listed:
            nodes = list(asked)
            yield [[ids[i] for i in nodes], [dependents[i] for i in nodes], [entries[i] for i in nodes]]
            return
        paths, rest = pa.array(shown, pa.string()), set(asked)
        nodes, lists, held = [], [], 0

        def piece():
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), paths.take(pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))))
            return [[ids[i] for i in nodes], [dependents[i] for i in nodes], [entries[i] for i in nodes], found]

        for k, which in reach.marked(place, len(shown)):
            for x in reach.members[k]:
                if x not in asked:
                    continue
                rest.discard(x)
                nodes.append(x)
                lists.append(which)
                held += len(which) + 1
                if held >= LISTED:
                    yield piece()
                    nodes, lists, held = [], [], 0
        nodes, lists = nodes + sorted(rest), lists + [np.zeros(0, np.int64)] * len(rest)  # without entries nothing is marked
        yield piece()

    walk.kinds = ("id", "n", "n", "made") if listed else ("id", "n", "n")
    return walk


def _listed(arrays: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """Lists of the values at the places that each array names."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)], dtype=np.int32)), values.take(pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]))))


@_kinds("made", "made")
def _alike(ids, after, sources, targets, labels):
    """Rows as of `_facts`; yields lists of nodes that the same entries reach, and these entries' labels, in pieces of about LISTED labels.

    The list of the most nodes goes first: a file's dictionary then has it, also where all lists are too much for that."""
    asked, shown, place = _asked(ids, sources, targets, labels)
    names, paths, reach, size = pa.array(ids), pa.array(shown, pa.string()), Reach(after), len(shown)
    alike: dict[bytes, list[int]] = {}
    at: dict[bytes, int] = {}

    def digest(which):
        return hashlib.blake2b(which.tobytes(), digest_size=16).digest()

    rest = set(asked)
    for k, which in reach.marked(place, size):
        if nodes := [x for x in reach.members[k] if x in asked]:
            rest.difference_update(nodes)
            alike.setdefault(key := digest(which), []).extend(nodes)
            at.setdefault(key, k)
    nodes, lists, held = [], [], 0

    def piece():
        return [_listed(nodes, names), _listed(lists, paths)]

    if alike:
        most = max(alike, key=lambda x: len(alike[x]))
        nodes, lists = [np.asarray(alike.pop(most))], [next(which for k, which in reach.marked(place, size, at[most]) if k == at[most])]
        held = len(lists[0])
        for k, which in reach.marked(place, size):
            if (key := digest(which)) in alike:
                nodes.append(np.asarray(alike.pop(key)))
                lists.append(which)
                held += len(which) + 1
                if held >= LISTED:
                    yield piece()
                    nodes, lists, held = [], [], 0
    if rest:  # without entries nothing is marked
        nodes.append(np.asarray(sorted(rest)))
        lists.append(np.zeros(0, np.int64))
    yield piece()


@_kinds("made", "made")
def _blocks(ids, after, sources, targets, labels):
    names = pa.array(ids)
    members, others, held = [], [], 0

    def piece():
        return [_listed(members, names), _listed(others, names)]

    for nodes, reaching in Reach(after).blocks():
        step = max(1, PIECE // len(reaching))
        for i in range(0, len(nodes), step):
            members.append(nodes[i : i + step])
            others.append(reaching)
            held += len(members[-1]) * len(reaching)
            if held >= PIECE:
                yield piece()
                members, others, held = [], [], 0
    yield piece()


def cycle_paths(edges: DataFrame, project: str, source: str, target: str) -> DataFrame:
    """project, path: closed, from the least node."""
    return _walked(edges, project, source, target, _paths, f"path array<{edges.schema[source].dataType.simpleString()}>")


def cycle_counts(edges: DataFrame, project: str, source: str, target: str) -> DataFrame:
    """project, cycle_count (0 too)."""
    return _walked(edges, project, source, target, _count, "cycle_count bigint")


def cyclic_members(edges: DataFrame, project: str, source: str, target: str) -> DataFrame:
    """project, module_id, component: nodes on cycles; a component's name is its least node."""
    kind = edges.schema[source].dataType.simpleString()
    return _walked(edges, project, source, target, _cyclic, f"module_id {kind}, component {kind}")


def dependent_pairs(edges: DataFrame, project: str, source: str, target: str) -> DataFrame:
    """project, module_id, dependent: who reaches a node, without itself. Tasks hand on blocks of pairs, rows come of them in the JVM."""
    kind = edges.schema[source].dataType.simpleString()
    blocks = _walked(edges, project, source, target, _blocks, f"module_id array<{kind}>, dependent array<{kind}>")
    rows = blocks.select(project, F.explode("module_id").alias("module_id"), "dependent").select(project, "module_id", F.explode("dependent").alias("dependent"))
    return rows.where("module_id <> dependent")


def _with_nodes(edges: DataFrame, nodes: DataFrame, project: str, source: str, target: str, node: str, label: str) -> DataFrame:
    """Edges, and a row without a target for each node that is asked for."""
    none = F.lit(None)
    return edges.select(project, source, target, none.cast("string").alias(label)).unionByName(nodes.select(project, F.col(node).alias(source), none.cast(edges.schema[source].dataType).alias(target), label))


def entry_texts(edges: DataFrame, nodes: DataFrame, project: str, source: str, target: str, separator: str, node: str = "module_id", label: str = "label") -> DataFrame:
    """project, module_id, entries: what `dependent_facts` lists, as one text. It is made once for all nodes that share it, and these come
    together."""
    kind = edges.schema[source].dataType.simpleString()
    rows = _walked(_with_nodes(edges, nodes, project, source, target, node, label), project, source, target, _alike, f"module_id array<{kind}>, entries array<string>", label)
    return rows.select(project, "module_id", F.array_join("entries", separator).alias("entries")).select(project, F.explode("module_id").alias("module_id"), "entries")


def dependent_facts(edges: DataFrame, nodes: DataFrame, project: str, source: str, target: str, node: str = "module_id", label: str = "label", listed: bool = True) -> DataFrame:
    """project, module_id, dependents (how many others reach it), entry_count and, with listed, entries: the different labels of
    nodes that reach it, its own included, in order.

    A row for each of the given nodes (project, node, label: null of nodes that are no entries). Rows are made and handed on
    in pieces: a node's list is never held with all others."""
    kind = edges.schema[source].dataType.simpleString()
    rows = _with_nodes(edges, nodes, project, source, target, node, label)
    return _walked(rows, project, source, target, _facts(listed), f"module_id {kind}, dependents bigint, entry_count bigint" + (", entries array<string>" if listed else ""), label)
