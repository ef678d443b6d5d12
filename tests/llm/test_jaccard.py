import random
import re
from collections import Counter

import numpy as np
import pytest

from codecorpus.llm import jaccard

from . import cases


def shingle_set(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, num, den):
    sets = [(r[0], shingle_set(r[1], k)) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets))


def near_copies(seed, n):
    """Originals of many sizes with copies of 1 to 20 % edited words, chains of copies, and shared lines."""
    r, rows, i = random.Random(seed), [], 0
    line = cases.prose(999, 12)
    while len(rows) < n:
        words = cases.prose(seed * 1000 + i, r.choice([1, 2, 3, 4, 5, 6, 8, 11, 14, 20, 30, 60, 120, 300])).split()
        i += 1
        for _ in range(r.choice([1, 1, 2, 5, 9])):
            rows.append((len(rows), (line + "\n" if r.random() < 0.3 else "") + " ".join(words), *[None] * 7))
            words = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 15)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**9)}"
    return rows


@pytest.mark.parametrize("k,num,block,small", [(4, 85, 256, 32), (5, 80, 256, 32), (4, 85, 4, 3)])
def test_same_components_as_brute_force(spark, monkeypatch, k, num, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = near_copies(k * num + block, 350)
    got = Counter(tuple(r) for r in jaccard.join(cases.table(spark, rows), k, num, 100).collect())
    assert got == brute(rows, k, num, 100)


def test_awkward_rows(spark):
    rows = [*cases.ROWS, (None, cases.TEXTS[12] + " more", *[None] * 7), (None, "alone without an id", *[None] * 7)]
    assert Counter(tuple(r) for r in jaccard.join(cases.table(spark, rows), 4, 85, 100).collect()) == brute(rows, 4, 85, 100)
    assert jaccard.join(cases.table(spark, []), 4, 85, 100).count() == 0
    left = jaccard.firsts(cases.table(spark, rows), 4, 85, 100)
    groups = {c for d, n, c in brute(rows, 4, 85, 100) if n}
    assert left.columns == cases.table(spark).columns
    # rows without words stay; one row of each group, be its id null or not, and one of repeated rows
    wordless = sum(not (r[1] or "").split() for r in rows)
    assert left.count() == wordless + len(groups - {None}) + 2
    assert jaccard.firsts(cases.table(spark, []), 4, 85, 100).count() == 0


@pytest.mark.parametrize("common,salts", [(2, 3), (3, 64)])
def test_common_keys_are_salted(spark, monkeypatch, common, salts):
    monkeypatch.setattr(jaccard, "COMMON_ROWS", common)
    monkeypatch.setattr(jaccard, "SALTS", salts)
    rows = near_copies(5, 250)
    base = cases.prose(4242, 60).split()
    rows += [(1000 + i, " ".join([*base[:i % 60], f"x{i}", *base[i % 60 + 1 :]]), *[None] * 7) for i in range(150)]
    got = Counter(tuple(r) for r in jaccard.join(cases.table(spark, rows), 5, 80, 100).collect())
    assert got == brute(rows, 5, 80, 100)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(3)
    for size in (1, 40, 70, 300, 1000):
        a = r.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[size // 9 :], r.integers(0, 2**63, size // 7).astype(np.uint64)])
        x, y = jaccard.parities(a).view(np.uint64), jaccard.parities(b).view(np.uint64)
        x, y = (z[: len(z) // 2] ^ z[len(z) // 2 :] if len(z) > min(len(x), len(y)) else z for z in (x, y))
        apart = len(np.setxor1d(a, b))
        assert apart // 3 <= int(np.bitwise_count(x ^ y).sum()) <= apart


@pytest.mark.parametrize("num", [80, 85])
def test_similar_sets_share_a_key(num):
    r, t = np.random.default_rng(num), jaccard.Threshold(num, 100)
    for records in (10, 10**9):
        schemes = jaccard.Schemes(t, dict.fromkeys(range(60), records))
        for size in [*range(1, 60), 100, 257, 999]:
            for _ in range(20):
                a = r.integers(0, 2**63, size).astype(np.uint64)
                drop = r.integers(0, size * (100 - num) // 100 + 1)
                add = r.integers(0, size // 6 + 2)
                b = np.concatenate([a[drop:], r.integers(0, 2**63, add).astype(np.uint64)])
                if len(b) and t.met(size - drop, size, len(b)):
                    assert np.intersect1d(jaccard.keys(a, schemes.of(size)), jaccard.keys(b, schemes.of(len(b)))).size, (size, drop, add)


def test_allowance_is_dealt_by_cost():
    t = jaccard.Threshold(85, 100)
    few, many = jaccard.scheme(t, 30, 178, 210, 1000), jaccard.scheme(t, 30, 178, 210, 10**10)
    assert few.doubles == 0 < many.doubles
