"""Periodic runs of words: Lyndon arrays by suffix grouping under both orders, roots extended into runs.

Words are numbers. Suffixes are put into groups by their first word; groups are taken from the highest to the lowest. A
suffix whose next lower suffix to the left is p gives its group's context to p: p moves to a group of its own, above
the one it was in, with a context longer by one copy for each of them. When a group is taken its context is the
longest Lyndon word that begins at its members, so this first phase of a linear suffix sorter gives the Lyndon array at
once; no suffix is ever compared. Under one of the two orders (words as numbered, and the other way round; the end is
lowest in both) each run has a Lyndon root of its period's length at the places where it begins: a root is extended to
both sides by its longest common extensions, and what is long enough is a run.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codecorpus.llm import common as c

#: A run has so many words and so many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of a gram; each word of a run is in a gram that stands in its text twice or more, whatever the run's period.
GRAM = 5
#: Words that one comparison of an extension takes first; doubled while they are equal.
STRETCH = 64


def lyndon_array(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by grouping (phase one of the sorter)."""
    n = len(ranks)
    top = max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(top)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)
    context = [1] * top
    below, above = list(range(-1, top - 1)), list(range(1, top + 1))  # above top - 1: no group
    out = [0] * n
    left = list(range(-1, n - 1))  # a place at or before which the next one not yet taken stands
    taken = bytearray(n + 1)  # the last is for -1, never taken
    g = top - 1
    while g >= 0:
        size = context[g]
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            taken[i] = 1
            out[i] = size
        times: dict[int, int] = {}
        several = False
        for i in own:
            p = left[i]
            if taken[p]:
                passed = [i]
                while taken[p]:
                    passed.append(p)
                    p = left[p]
                for x in passed:
                    left[x] = p
            if p >= 0:
                if p in times:
                    times[p] += 1
                    several = True
                else:
                    times[p] = 1
        new: dict[tuple[int, int], int] = {}
        for p, k in sorted(times.items(), key=lambda x: -x[1]) if several else times.items():
            old = group[p]
            to = new.get((old, k))
            if to is None:  # right above the old group: of those with more copies that came before, below them
                to = new[old, k] = len(context)
                context.append(context[old] + k * size)
                members.append([])
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = to
                if up < len(below) - 1 and below[up] == old:
                    below[up] = to
            group[p] = to
            members[to].append(p)
        members[g] = []
        g = below[g]
    return out


def _equal_ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words are equal from i and from j > i on."""
    n, got, step = len(x), 0, STRETCH
    while j + got < n:
        stop = min(n, j + got + step)
        differ = x[j + got : stop] != x[i + got : i + stop - j]
        if differ.any():
            return got + int(differ.argmax())
        got, step = stop - j, 2 * step
    return got


def _equal_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words are equal before i and before j > i."""
    got, step = 0, STRETCH
    while got < i:
        more = min(step, i - got)
        differ = (x[i - got - more : i - got] != x[j - got - more : j - got])[::-1]
        if differ.any():
            return got + int(differ.argmax())
        got, step = got + more, 2 * step
    return got


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least LEAST_WORDS words and LEAST_TIMES periods in a sequence of numbers."""
    n, found = len(x), set()
    ranks = np.unique(x, return_inverse=True)[1]
    for order in (ranks, ranks.max(initial=0) - ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        # a root that a run begins with is followed by LEAST_TIMES - 2 whole copies at least: probes, then extensions
        i = np.flatnonzero(np.arange(n) + (LEAST_TIMES - 1) * period <= n)
        p = period[i]
        for place in (lambda q: 0 * q, lambda q: q - 1, lambda q: q // 2):
            at = i + place(p)
            same = x[at] == x[at + p]
            for k in range(2, LEAST_TIMES - 1):
                same &= x[at] == x[at + k * p]
            i, p = i[same], p[same]
        ends: dict[int, int] = {}  # by period: where its last run ends
        for a, q in zip(i.tolist(), p.tolist(), strict=True):
            if a + q <= ends.get(q, 0):
                continue
            stop = a + q + _equal_ahead(x, a, a + q)
            start = a - _equal_behind(x, a, a + q)
            ends[q] = stop
            if stop - start >= max(LEAST_WORDS, LEAST_TIMES * q):
                found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeated(x: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words that repeated grams of one text cover, LEAST_WORDS or more. first: where texts begin, and the end.

    The grams' hashes only choose where to look: equal grams have equal hashes, so no run is missed.
    """
    n = len(x) - GRAM + 1
    if n < 2:
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = text[:n].astype(c.U)
    for k in range(GRAM):
        h = c.mix(h * c.BASE + x[k : k + n].astype(c.U) + c.SALTS[k])
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    twice &= text[:n] == text[GRAM - 1 :]
    if not twice.any():
        return []
    upto = np.concatenate([np.zeros(GRAM, np.int64), np.cumsum(twice), np.full(GRAM - 1, int(twice.sum()))])
    covered = upto[GRAM:] > upto[:-GRAM]
    bounds = np.concatenate([[0], np.flatnonzero((covered[1:] != covered[:-1]) | (text[1:] != text[:-1])) + 1, [len(x)]]).tolist()
    return [(s, e) for s, e in zip(bounds, bounds[1:], strict=False) if covered[s] and e - s >= LEAST_WORDS]


def _periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: every tenth document, by the checksum of its id, repeats a part of itself."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, periodic: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_runs, of the run of greatest length/period its start, length, period and
    exponent_milli, runs_sha256 of the list of runs, and collapsed, the text with one copy of what runs repeat.

    Words are what stands between ASCII spaces and controls 9 to 13. With `periodic`, texts are changed as the query's
    contract says, which needs a doc_id. A run is as long as it can be with its smallest period q, and has at least 6
    words and 4 * q. Of equal exponents the first run counts, then that of the least period; without runs these columns
    are null. A word goes if it stands in a run after its first period. A null text is the empty one: no words, no runs.
    Repeated rows give repeated rows, very long texts one row like others, null doc_ids stay and their texts aren't
    changed. Columns other than doc_id and text are ignored, whatever their names. No rows give no rows. No shuffle.
    """

    def step(keys: list, texts: list[bytes]) -> dict:
        words = [_periodic(k, t.split()) if periodic else t.split() for k, t in zip(keys, texts, strict=True)]
        numbers: dict[bytes, int] = {}
        x = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, sum(map(len, words)))
        first = np.cumsum([0, *map(len, words)])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        for a, b in _repeated(x, first):
            k = int(np.searchsorted(first, a, "right")) - 1
            at = a - int(first[k])
            runs[k] += [(at + s, length, q) for s, length, q in runs_of(x[a:b])]
        cols: dict[str, list] = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed")}
        for ws, rs in zip(words, runs, strict=True):
            best = None
            for r in rs:  # in order of start and period: the first of the greatest
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            kept = ws
            if rs:
                stays = np.ones(len(ws), bool)
                for s, length, q in rs:
                    stays[s + q : s + length] = False
                kept = [ws[i] for i in np.flatnonzero(stays).tolist()]
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in rs)
            row = (len(rs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), b" ".join(kept))
            for name, v in zip(cols, row, strict=True):
                cols[name].append(v)
        kinds = {"runs_sha256": pa.string(), "collapsed": pa.binary()}
        return {"doc_id": pa.array(keys, pa.int64())} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in cols.items()}

    return c.map_blocks(c.clean_docs(docs), step, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed binary")
