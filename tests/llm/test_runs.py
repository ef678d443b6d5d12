import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codecorpus.llm import runs

from . import cases


def longest_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def period_of(x):
    return next(q for q in range(1, len(x) + 1) if all(x[k] == x[k + q] for k in range(len(x) - q)))


def plain_runs(x):
    found = set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and period_of(x[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        x = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            p = r.randint(1, 6)
            x = x[:3] + (x[3 : 3 + p] * 12)[: r.randint(1, 30)] + x[: r.randint(0, 8)]
        yield x


def test_grouping_gives_the_lyndon_array_under_both_orders():
    for x in [[], [0], [0] * 9, list(range(9)), list(range(9))[::-1], *sequences(1, 800)]:
        assert runs.lyndon_array(x) == longest_lyndon(x)
        turned = [max(x, default=0) - v for v in x]
        assert runs.lyndon_array(turned) == longest_lyndon(turned)


def test_runs_as_by_brute_force_and_none_outside_repeated_grams():
    for x in sequences(2, 1500):
        want = plain_runs(x)
        assert runs.runs_of(np.array(x, np.int64)) == want
        stretches = runs._repeated(np.array(x, np.int64), np.array([0, len(x)]))
        assert sorted(((a + s, n, q) for a, b in stretches for s, n, q in runs.runs_of(np.array(x[a:b]))), key=lambda r: (r[0], r[2])) == want


def contract(doc_id, text, periodic):
    words = (text or "").encode().split()
    n = len(words)
    if periodic and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("periodic", [True, False])
def test_documents_as_by_brute_force(spark, periodic):
    r = random.Random(3)
    some = [(100 + i, " ".join(r.choice(["x", "y", "zé", "x y x y"]) for _ in range(r.randint(0, 60))), *[None] * 7) for i in range(120)]
    some += [(300, "a b " * 3 + "c  \x0b\td " * 9, *[None] * 7), (301, "p " * 6 + "q " * 6, *[None] * 7), (302, "e " * 5, *[None] * 7), (-7, "f\x00g " * 8, *[None] * 7)]
    rows = [x for x in cases.ROWS if len(x[1] or "") < 10_000] + some
    got = runs.find_runs(cases.table(spark, rows), periodic).collect()
    assert Counter(map(tuple, got)) == Counter(contract(x[0], x[1], periodic) for x in rows)
    assert sum(x.n_runs > 1 for x in got) > 5


def test_very_long_texts_and_no_rows(spark):
    period = cases.prose(5, 700)
    rows = [(None, cases.prose(6, 900) + " " + " ".join([period] * 200), *[None] * 7)]
    (got,) = runs.find_runs(cases.table(spark, rows)).collect()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (1, 900, 140_000, 700, 200_000)
    assert got.collapsed == (cases.prose(6, 900) + " " + period).encode()
    assert runs.find_runs(cases.table(spark, [])).count() == 0
