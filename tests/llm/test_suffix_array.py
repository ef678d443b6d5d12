import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from codecorpus.llm import suffix_array as s

from . import cases


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_common_prefixes(seed):
    r = random.Random(seed)
    n, letters = r.choice([1, 2, 3, 10, 80, 600]), r.choice([1, 2, 3, 20])
    text = [r.randint(1, letters) for _ in range(n)]
    if seed % 3 == 0:
        text = (text * 4)[: 2 * n]
    t = np.array([*text, 0], np.int16)
    order = s.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    got = s.common_prefixes(t, order, 2000)
    for a, b in zip(order, order[1:], strict=False):
        x, y, k = t[a:].tolist(), t[b:].tolist(), 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        assert got[b] == k


def covered(texts, length):
    """Of each text, the bytes that strings of so many bytes cover that start elsewhere as well."""
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].add((i, p))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                gone[p : p + length] = True
        out.append(gone)
    return out


def brute(rows):
    texts = [(r[1] or "").encode() for r in rows]
    out = Counter()
    cores = [[(int(a), t[a : a + s.GRAM + s.side(s.SHORT)], int(k)) for k, _, _, a in zip(*s.contexts(t, s.SHORT)[0], strict=True)] for t in texts]
    often = Counter((x, k) for own in cores for _, x, k in own)
    for r, t, gone, own in zip(rows, texts, covered(texts, s.LENGTH), cores, strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        short = np.zeros(len(t), bool)
        for a, x, k in own:
            if often[x, k] > 1:
                short[a : a + len(x)] = True
        out[r[0], len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), int(short.sum()), kept] += 1
    return out


def removed(docs):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_repeated, bytes(r.kept)) for r in s.remove_repeats(docs).collect())


def corpus(seed, n):
    r = random.Random(seed)
    shared = [cases.prose(seed + 50 + i, r.randint(40, 160)) for i in range(8)]
    rows = []
    for i in range(n):
        parts = [cases.prose(seed * 100 + i * 9 + j, r.randint(1, 90)) for j in range(r.randint(0, 3))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            x = r.choice(shared)
            if r.random() < 0.5:
                p = r.randrange(len(x))
                x = x[:p] + "#" + x[p + 1 :]
            parts.insert(r.randint(0, len(parts)), x)
        if r.random() < 0.1:
            parts.append(r.choice("ab") * r.choice([255, 256, 257, 399, 400, 401, 900]))
        rows.append((i, "|".join(parts), *[None] * 7))
    return rows + [rows[3], (n, rows[4][1], *[None] * 7)]


@pytest.mark.parametrize("seed,hot,shard,piece", [(1, 8192, 1 << 20, 1 << 24), (2, 2, 5000, 1 << 24), (3, 8192, 3000, 700)])
def test_same_bytes_go_as_by_brute_force(spark, monkeypatch, seed, hot, shard, piece):
    monkeypatch.setattr(s, "HOT", hot)
    rows = corpus(seed, 120)
    assert removed(cases.table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("length", [s.LENGTH, s.SHORT])
def test_long_texts_are_scanned_in_pieces(monkeypatch, length):
    text = cases.prose(8, 700).encode()
    whole = s.contexts(text, s.LENGTH, s.SHORT)[length == s.SHORT]
    monkeypatch.setattr(s, "PIECE", 700)
    cut = s.contexts(text, s.LENGTH, s.SHORT)[length == s.SHORT]
    every = lambda x: [(int(k), p, int(core)) for k, a, b, core in zip(*x, strict=True) for p in range(a, b + 1)]
    assert every(whole) == every(cut) and [p for _, p, _ in every(whole)] == list(range(len(text) - length + 1))


def test_repeated_passages_show(spark):
    """A passage of SHORT bytes or more in two documents has a repeated core in both, whatever stands around it."""
    r = random.Random(9)
    rows = []
    for i in range(60):
        passage = cases.prose(900 + i, 200).encode()[:300].decode(errors="ignore")[: 300 - i % 40]
        passage = passage if len(passage.encode()) >= s.SHORT else passage + "x" * (s.SHORT - len(passage.encode()))
        rows += [(2 * i + j, f"{cases.prose(2000 + 2 * i + j, r.randint(0, 60))} #{j} {passage} {j}# {cases.prose(4000 + 2 * i + j, r.randint(0, 60))}", *[None] * 7) for j in (0, 1)]
    rows += [(500 + i, cases.prose(7000 + i, 120), *[None] * 7) for i in range(40)]
    got = {x.doc_id: x.n_repeated for x in s.remove_repeats(cases.table(spark, rows)).collect()}
    assert all(got[i] > 0 for i in range(120)) and not any(got[500 + i] for i in range(40))


def test_awkward_rows(spark):
    rows = [r for r in cases.ROWS if len(r[1] or "") < 20_000]
    assert removed(cases.table(spark, rows)) == brute(rows)
    assert s.remove_repeats(cases.table(spark)).count() == len(cases.ROWS)
    assert s.remove_repeats(cases.table(spark, [])).count() == 0
