"""Line differences of two texts: lines that stand once in each anchor them, and what lies between is aligned in turn."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.shipping import ship


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of lines that stand once in both, the most that keep their order (longest increasing subsequence)."""
    in_a, in_b = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if in_b[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a) if in_a[x] == 1 and x in at]
    ends: list[int] = []  # of the best chain of each length, the place in b
    last: list[int] = []  # and its pair
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before[n] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[k], last[k] = j, n
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def differences(a: list[str], b: list[str]) -> Iterator[tuple[str, int | None, int | None]]:
    """(op, place in a, place in b) in order: what is equal is left out; of a stretch without such anchors, lines are
    compared one by one as far as both sides go, the rest was removed or added."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
        if i == i_end or j == j_end or not (met := anchors(a[i:i_end], b[j:j_end])):
            both = min(i_end - i, j_end - j)
            yield from (("changed", i + k, j + k) for k in range(both) if a[i + k] != b[j + k])
            yield from (("removed", k, None) for k in range(i + both, i_end))
            yield from (("added", None, k) for k in range(j + both, j_end))
            continue
        cuts = [(i, j), *[(i + x, j + y) for x, y in met], (i_end, j_end)]
        # an anchor begins the stretch behind it, where it goes as a common line
        todo += [(p, q, r, s) for (p, r), (q, s) in reversed(list(zip(cuts, cuts[1:], strict=False)))]


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines, and where each row's begin and how many it has; a null array is an empty one."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return pc.list_flatten(lists), np.cumsum(sizes) - sizes, sizes


def in_place(before: pa.ListArray, after: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a row's differences are its unequal lines at equal places; row and place of these lines).

    They are if both texts have equally many lines and no unequal line of one stands among those of the other: an anchor
    off the diagonal would be such a line, as one that is equal at its place stands twice in a text then."""
    (a, a_at, a_n), (b, b_at, b_n) = _flat(before), _flat(after)
    simple = a_n == b_n
    each = np.where(simple, a_n, 0)
    row = np.repeat(np.arange(len(each)), each)
    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    was, now = a.take(pa.array(a_at[row] + place)), b.take(pa.array(b_at[row] + place))
    unequal = np.asarray(pc.fill_null(pc.not_equal(was, now), True))  # a null line: left to the whole comparison below
    broken = np.asarray(pc.or_(pc.is_null(was), pc.is_null(now)))
    row, place, was, now = row[unequal], place[unequal], was.filter(pa.array(unequal)), now.filter(pa.array(unequal))
    codes = pa.chunked_array([was, now]).combine_chunks().dictionary_encode()
    code = np.asarray(pc.fill_null(codes.indices, -1), np.int64)
    width = len(codes.dictionary) + 2
    met = np.intersect1d(row * width + code[: len(row)] + 1, row * width + code[len(row) :] + 1) // width
    simple[met] = False
    simple[row[broken[unequal]]] = False
    kept = simple[row]
    return simple, row[kept], place[kept]


def line_differences(files: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """keys, line_no, after_no, op (changed, added, removed), before, after of two arrays of lines. line_no is the number in the
    old text, of added lines that in the new one; after_no is the number in the new text (null of removed lines). A null
    array is an empty one. A row's two texts are compared in its task: no shuffle. Rows whose unequal lines stand at equal
    places are compared all at once (see `in_place`)."""
    ship(files.sparkSession)
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    names = [*keys, "line_no", "after_no", "op", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(n), batch.column(n + 1)
            simple, row, place = in_place(a, b)
            (was, was_at, _), (now, now_at, _) = _flat(a), _flat(b)
            number = pa.array(place + 1, pa.int32())
            keyed = [batch.column(k).take(pa.array(row)) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*keyed, number, number, pa.repeat("changed", len(row)), was.take(pa.array(was_at[row] + place)), now.take(pa.array(now_at[row] + place))], names)
            if simple.all():
                continue
            rest = batch.filter(pa.array(~simple))
            at, ops, olds, news, lost, got = [], [], [], [], [], []
            for r, (x, y) in enumerate(zip(rest.column(n).to_pylist(), rest.column(n + 1).to_pylist(), strict=True)):
                x, y = x or [], y or []
                for op, i, j in differences(x, y):
                    at.append(r)
                    ops.append(op)
                    olds.append((j if i is None else i) + 1)
                    news.append(None if j is None else j + 1)
                    lost.append(None if i is None else x[i])
                    got.append(None if j is None else y[j])
            keyed = [rest.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*keyed, *[pa.array(x, t) for x, t in ((olds, pa.int32()), (news, pa.int32()), (ops, pa.string()), (lost, pa.string()), (got, pa.string()))]], names)

    own = files.select(*keys, before.alias("_before"), after.alias("_after")).where(~F.col("_before").eqNullSafe(F.col("_after")))
    return own.mapInArrow(run, f"{kinds}, line_no int, after_no int, op string, before string, after string")
