import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codecorpus.llm import common as c
from codecorpus.llm import quality, spaced_seeds

from . import cases


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))


def brute(texts, items):
    """Every diagonal of every document and item that has a seed hit, verified."""
    out = set()
    for d, t in texts:
        a = words(t)
        for i, x in items:
            b = words(x)
            if len(b) < spaced_seeds.LEAST_WORDS:
                continue
            for start in range(-len(b) + 1, len(a)):
                lo, hi = max(start, 0), min(start + len(b), len(a))
                equal = np.array([a[p] == b[p - start] for p in range(lo, hi)])
                hit = any(all(equal[p + q] for q, on in enumerate(m) if on == "1") for m in spaced_seeds.MASKS for p in range(len(equal) - len(m) + 1))
                if hit and spaced_seeds.verify(equal)[2] >= min(spaced_seeds.EQUAL, int(np.ceil(0.8 * len(b)))):
                    out.add((d, i))
    return out


def test_masks_have_one_weight():
    assert {m.count("1") for m in spaced_seeds.MASKS} == {8} and all(m[0] == m[-1] == "1" for m in spaced_seeds.MASKS)


def test_leaks_as_by_brute_force(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, cases.prose(700 + i, r.choice([3, 8, 10, 15, 30, 50]))) for i in range(25)]
    texts = []
    for d in range(60):
        parts = [cases.prose(d, r.randint(0, 40))]
        if d % 3:
            w = r.choice(items)[1].split()
            for _ in range(r.randint(0, len(w) // 6)):
                w[r.randrange(len(w))] = "changed"
            parts.append("".join(ch.upper() if ch.isascii() else ch for ch in " ".join(w[r.randint(0, 3) :])))
        texts.append((d, "; ".join([*parts, cases.prose(d + 99, 9)])))
    for bound in (8 << 20, 400):
        monkeypatch.setattr(spaced_seeds, "BENCHMARK_BYTES", bound)
        docs = cases.table(spark, [(d, t, *[None] * 7) for d, t in texts])
        got = [(x.doc_id, x.item_id) for x in spaced_seeds.leaks(docs, spark.createDataFrame([*items, (None, "x"), (99, None)], "item_id long, text string")).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, items) and len(got) > 10


def test_awkward_rows_and_tables(spark):
    bench = spark.createDataFrame([(1, cases.TEXTS[10][:300]), (2, "")], "item_id long, text string")
    docs = cases.table(spark)
    assert Counter(x.doc_id for x in spaced_seeds.leaks(docs, bench).collect()) == Counter([cases.ROWS[10][0], cases.ROWS[11][0], cases.ROWS[10][0]])
    left = spaced_seeds.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(cases.ROWS) - 3
    assert spaced_seeds.leaks(docs, bench.limit(0)).count() == 0 == spaced_seeds.leaks(docs.limit(0), bench).count()


def junk(i):
    w = cases.prose(i, 80).split()
    return [" ".join(x + "%%%" for x in w), " | ".join(w), " ".join(w).upper() + "!!", " ".join(x + " " + x + " " + x for x in w)][i % 4]


def test_held_out_documents(spark):
    rows = [(i, junk(i // 5) if i % 5 == 0 else cases.prose(i, 30 + i % 90), "en", f"host{i % 3}", *[None] * 5) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(600) if i % 3], "doc_id long, quality int, toxic int")
    got = quality.score(cases.table(spark, rows), labels).collect()
    held = [x for x in got if x.doc_id % 3 == 0]
    assert len(got) == 600 and len(held) == 200 and sum(x.keep == (x.doc_id % 5 != 0) for x in held) >= 0.97 * len(held)


def test_sites_are_drawn_to_their_parents(spark):
    """A site of few documents stays near its parent's mean, a large one near its own."""
    sites = spark.createDataFrame([("a", 2, 0.0, 0.0, 0.8), ("b", 1000, 50.0, 20.0, 0.8), ("c", 1000, 950.0, 930.0, 0.8)], "host string, n long, s double, q double, up double")
    m = {x.host: x.m for x in quality._shrunk(sites).collect()}
    assert m["b"] < 0.1 and m["c"] > 0.9 and 0.05 < m["a"] < 0.8


def test_quality_of_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = cases.table(spark)
    got = quality.score(docs, none).collect()
    assert len(got) == len(cases.ROWS) and all(x.keep and abs(x.evidence - 0.5) < 1e-9 for x in got)
    assert quality.kept_documents(docs, none).columns == docs.columns
    labels = spark.createDataFrame([(0, 1, 0), (0, None, None), (None, 1, 1), (3, 0, 1), (5, 1, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == len(cases.ROWS)
    assert quality.score(cases.table(spark, []), labels).count() == 0


def test_substituted_words_as_by_the_rule_alone(spark):
    """Items of 8 to 17 words with any words substituted, against all diagonals without seeds; longer ones with regular substitutions."""
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(8 + i % 10))) for i in range(60)]
    texts = []
    for d in range(300):
        w = r.choice(items)[1].split()
        for j in r.sample(range(len(w)), r.randint(0, 5)):
            w[j] = "changed"
        texts.append((d, " ".join([*cases.prose(d, r.randint(0, 9)).split(), *w[r.choice([0, 0, 0, 1, 2]) :], *cases.prose(d + 99, r.randint(0, 9)).split()])))
    want = set()
    for d, t in texts:
        a = words(t)
        for i, x in items:
            b = words(x)
            if any(sum(0 <= s + j < len(a) and a[s + j] == y for j, y in enumerate(b)) >= min(13, -(-4 * len(b) // 5)) for s in range(-len(b) + 1, len(a))):
                want.add((d, i))
    long = [f"l{j}" for j in range(40)]
    shapes = [[1, 11], [4], [5, 6, 16, 17], *[list(range(k - 1, 40, k)) for k in (2, 3, 4, 5)]]
    for k, (size, changed) in enumerate(zip((15, 9, 25, 40, 40, 40, 40), shapes, strict=True)):
        own = [f"{x}x{k}" for x in long[:size]]
        items.append((1000 + k, " ".join(own)))
        texts.append((1000 + k, "before " + " ".join("changed" if j in changed else x for j, x in enumerate(own))))
        want.add((1000 + k, 1000 + k))
    docs = cases.table(spark, [(d, t, *[None] * 7) for d, t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in spaced_seeds.leaks(docs, bench, light=True).collect()} == want and len(want) > 150


def test_posteriors_follow_from_the_evidence(spark, monkeypatch):
    """Shrinkage at both levels, without the document itself, worked out again from the evidence that the query returns."""
    r = random.Random(8)
    rows = [(i if i % 7 else None, f"{'good prose about things. ' * (i % 4)}{'%%% ' * (i % 3)}x{i}", f"l{r.choice('abc')}", f"s{r.choice('ppppq')}", None, None, None, None, None) for i in range(400)]
    rows += [(900, "alone", "lz", "sz", None, None, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = quality.score(cases.table(spark, rows), labels).collect()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)  # by salted parts
    salted = quality.score(cases.table(spark, rows), labels).collect()
    assert sorted((x.host, x.path, round(x.posterior, 9)) for x in got) == sorted((x.host, x.path, round(x.posterior, 9)) for x in salted)

    def shrunk(sites, up):
        n = {k: len(v) for k, v in sites.items()}
        within = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in sites.values()) / max(1, sum(x - 1 for x in n.values()))
        total = sum(n.values())
        between = sum(n[k] * (sum(v) / n[k] - up[k]) ** 2 for k, v in sites.items()) / total - len(sites) * within / total
        strength = min(1000.0, max(1.0, within / max(between, 1e-9)))
        return strength, {k: (sum(v) + strength * up[k]) / (n[k] + strength) for k, v in sites.items()}

    hosts, paths = {}, {}
    for x in got:
        hosts.setdefault(x.host, []).append(x.evidence)
        paths.setdefault((x.host, x.path), []).append(x.evidence)
    everything = sum(x.evidence for x in got) / len(got)
    hk, means = shrunk(hosts, dict.fromkeys(hosts, everything))
    k, _ = shrunk(paths, {p: means[p[0]] for p in paths})
    for x in got:
        h, p, e = hosts[x.host], paths[x.host, x.path], x.evidence
        host = (sum(h) - e + hk * everything) / (len(h) - 1 + hk)
        site = (sum(p) - e + k * host) / (len(p) - 1 + k)
        odds = e / (1 - e) * site / (1 - site) / (everything / (1 - everything))
        assert abs(x.site - site) < 1e-6 and abs(x.posterior - odds / (1 + odds)) < 1e-6 and x.keep == (x.posterior >= quality.REJECT_BELOW - 1e-9)
