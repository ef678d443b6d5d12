import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from codecorpus.llm import hash_tree, licences

from . import cases


def test_tree_law(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('é', cast(id % 7 as int)) as text")
    rows = hash_tree.shard_documents(docs, 24).collect()
    for r in rows:
        t = ("é" * (r.doc_id % 7)).encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    n = Counter(r.shard for r in rows)
    assert len(n) == 24 and max(n.values()) < 1.4 * 250
    assert 150 < sum(r.grown_shard == 24 for r in rows) < 340
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))


def test_weights_confine_moves(spark):
    leaves = hash_tree.tree(12)
    heavier = [hash_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    rows = hash_tree.assign(hash_tree.assign(spark.range(3000), "id", leaves, "a"), "id", heavier, "b").collect()
    at = {x.shard: (x.region, x.rack) for x in leaves}
    for r in rows:
        if r.a != r.b:  # into the subtree whose weight grew, and inside it further down
            assert at[r.b][0] == at[5][0]
            assert at[r.a][0] != at[5][0] or at[r.b] == at[5]
            assert at[r.a] != at[5] or r.b == 5
    assert sum(r.b == 5 for r in rows) > 2 * sum(r.a == 5 for r in rows)


def hash64(value, size, seed):
    return xxhash.xxh64_intdigest((value % (1 << 8 * size)).to_bytes(size, "little"), seed)


def descend(key, leaves):
    """Level by level, each node with a draw of its own."""
    path, inside = [], list(leaves)
    for level, name in enumerate(("region", "rack", "shard")):
        best = []
        for child in {getattr(x, name) for x in inside}:
            h = 42 if key is None else hash64(key, 8, 42)
            for part in (level, *path, child):
                h = hash64(part, 4, h)
            weight = sum(x.weight for x in inside if getattr(x, name) == child)
            best.append((-math.log(((h >> 12) + 1) / (1 << 52)) / weight, child))
        path.append(min(best)[1])
        inside = [x for x in inside if getattr(x, name) == path[-1]]
    return path[-1]


def test_shards_as_by_brute_force(spark):
    r = random.Random(4)
    uneven = [hash_tree.Leaf(r.randint(0, 3), r.randint(2, 5), i, r.choice([0.5, 1.0, 4.0])) for i in range(17)]
    keys = [None, -1, 0, *(r.randrange(-(2**62), 2**62) for _ in range(300))]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for leaves in (hash_tree.tree(24), hash_tree.tree(25, 24), hash_tree.tree(1), uneven):
        got = hash_tree.assign(frame, "k", [*leaves, hash_tree.Leaf(9, 9, 99, 0.0)]).collect()
        assert {x.k: x.shard for x in got} == {k: descend(k, leaves) for k in keys}


def test_a_count_of_shards_decides(spark):
    docs = spark.range(800).selectExpr("id as doc_id", "'x' as text")
    before, after = ({r.doc_id: r for r in hash_tree.shard_documents(docs, n, 24).collect()} for n in (25, 26))
    assert all(after[d].shard == before[d].grown_shard and before[d].grown_shard in (before[d].shard, 25) for d in before)


def test_awkward_rows_are_sharded(spark):
    rows = hash_tree.shard_documents(cases.table(spark), 3).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in cases.ROWS)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert hash_tree.shard_documents(cases.table(spark, []), 24).count() == 0


def test_buckets_number_gaplessly(spark):
    rows = hash_tree.number(spark.range(1000).selectExpr("id", "0 as shard"), "shard", rows_per_bucket=37).collect()
    assert sorted(r.slot for r in rows) == list(range(1000))


def test_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "PIECE", 70)
    rows = hash_tree.number(spark.range(900).selectExpr("if(id < 500, null, id) as id", "cast(id % 2 as int) as shard"), "shard", rows_per_bucket=37).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(450))


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))
    found = [(i, licences.BASE[p]) for p in licences.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = sorted(i for i, _ in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({x for _, x in found}))


def test_base_phrases(spark):
    texts = [*cases.TEXTS, "mit license apache license mit license mit", "x mit license-apache license 9mit license general public license general"]
    docs = cases.table(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])
    for r in licences.scan_licences(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licences.scan_licences(cases.table(spark, [])).count() == 0


def test_expressions():
    assert licences.expression("MIT") == ({"mit"}, True)
    assert licences.expression("(MIT OR GPL-3.0) AND BSD-3-Clause") == ({"mit", "gpl", "bsd"}, True)
    assert licences.expression("MIT AND GPL-2.0 OR GPL-3.0") == ({"mit", "gpl"}, False)
    assert licences.expression("GPL-2.0 WITH Classpath-exception-2.0 OR Apache-2.0") == ({"gpl", "apache"}, True)
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT MIT", "hello"):
        assert licences.expression(bad) is None
    assert licences.leading_expression("MIT OR Apache-2.0 and some prose")[0] == {"mit", "apache"}
    got = licences.scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause".encode())
    assert got["labels"] == "apache,bsd,mit" and got["permissive"] is True and got["n_expressions"] == 1


def test_long_expressions_and_unknown_identifiers():
    got = licences.leading_expression(" AND ".join(["MIT"] * 200 + ["GPL-3.0"]) + " and so on")
    assert got == ({"mit", "gpl"}, False)
    assert licences.leading_expression("MIT" + " OR GPL-2.0" * 40 + " OR Zlib")[0] == {"mit", "gpl", "zlib"}
    assert licences.expression("Artistic-2.0 OR MIT") == ({"artistic-2.0", "mit"}, True)
    assert licences.leading_expression("MIT AND CDDL-1.0 */") == ({"mit", "cddl-1.0"}, False)
    assert licences.leading_expression("(LicenseRef-Own AND (PSF-2.0 OR MIT)) OR BSL-1.0.")[0] == {"licenseref-own", "psf-2.0", "mit", "bsl-1.0"}
    assert licences.leading_expression("Ruby") == ({"ruby"}, False) and licences.leading_expression("see below") is None
    assert licences.leading_expression("MIT OR see below") == ({"mit"}, True) and licences.leading_expression("MIT, GPL-2.0")[0] == {"mit"}
    assert licences.leading_expression("MIT OR (GPL-2.0 AND") == ({"mit"}, True) and licences.leading_expression("(MIT OR GPL-2.0") is None
    got = licences.scan(b"SPDX-License-Identifier: MIT AND CDDL-1.0")
    assert got["labels"] == "cddl-1.0,mit" and got["permissive"] is False


def test_expressions_as_a_plain_evaluation():
    r = random.Random(7)

    def grow(depth):
        if not depth or r.random() < 0.3:
            n = r.choice(["MIT", "GPL-2.0", "Zlib", "CDDL-1.0"])
            return n + r.choice(["", "", " WITH Some-exception"]), str(n in ("MIT", "Zlib"))
        op = r.choice(["and", "or"])
        (a, x), (b, y) = grow(depth - 1), grow(depth - 1)
        return r.choice([(f"{a} {op.upper()} {b}", f"{x} {op} {y}"), (f"({a} {op} {b})", f"({x} {op} {y})")])

    for _ in range(500):
        text, plain = grow(5)
        assert licences.expression(text)[1] == eval(plain), text


def test_labels_of_notices_and_tags():
    one = lambda t: licences.scan(t.encode())["labels"]
    assert one("Licensed under CC BY-NC 4.0.") == "cc-by-nc" and one("Released under the MIT License.") == "mit"
    assert one("SPDX-License-Identifier: mitre OR MIT-0") == ""  # prose is no expression
    assert one("// spdx license identifier : (Artistic-2.0 OR GPL-3.0-or-later WITH Classpath-exception-2.0) */") == "artistic-2.0,gpl"
    assert one("SPDX-License-Identifier: CC-BY-NC-4.0 AND LicenseRef-Own-1\nSPDX-License-Identifier: BSD-3-Clause") == "bsd,cc-by-nc,licenseref-own-1"
    assert licences.scan(b"spdx-license-identifier:\nMIT")["n_expressions"] == 0
    many = " OR ".join(f"MIT-{i}" for i in range(200)) + " OR GPL-3.0"
    found = licences.scan(f"é SPDX-License-Identifier: {many}\r\nnext".encode())
    assert found["labels"] == "gpl,mit" and found["permissive"] is True and found["n_expressions"] == 1
    assert [licences.licence(x) for x in ("mitre", "mit", "gplv3", "apache2", "lgpl-2.1+", "gplus")] == [None, "mit", "gpl", "apache", "lgpl", None]


def test_expressions_against_their_truth_tables():
    """Random expressions: permissive says whether they hold with the permissive licences alone."""
    r = random.Random(12)
    names = {"mit": True, "gpl-2.0-only": False, "bsd-2-clause": True, "mpl-2.0": False}

    def grow(depth):
        if depth == 0 or r.random() < 0.3:
            n = r.choice(sorted(names))
            return n, str(names[n])
        op, (a, x), (b, y) = r.choice(["and", "or"]), grow(depth - 1), grow(depth - 1)
        text, truth = f"{a} {op} {b}", f"{x} {op} {y}"
        return (f"({text})", f"({truth})") if r.random() < 0.5 else (text, truth)

    for _ in range(400):
        text, truth = grow(4)
        labels, free = licences.expression(text)
        assert free == eval(truth), text
        assert labels == {licences.licence(n) for n in re.findall(r"[a-z0-9.-]+", text) if n not in ("and", "or")}


@pytest.mark.parametrize(
    "line,labels,free",
    [
        ("MIT-style terms apply", "", None), ("mit-based", "mit-based", False), ("gpl-compatible with all", "", None), ("gpl-compatible", "gpl-compatible", False), ("Apache-2.0/MIT", "apache,mit", True), ("GPL-2.0-only/MIT", "gpl,mit", True), ("0BSD", "bsd", True), ("WTFPL", "wtfpl", True),
        ("GPL-2.0 WITH Classpath-exception-2.0", "gpl", False), ("GPL-2.0 WITH great ideas", "gpl", False), ("MIT WITH Linux-syscall-note AND GPL-2.0-only", "gpl,mit", False), ("MIT with LLVM-exception OR GPL-3.0+", "gpl,mit", True), ("BSL-1.0 OR GPL-3.0", "bsl-1.0,gpl", True), ("Artistic-2.0", "artistic-2.0", True),
        ("CDDL-1.0", "cddl-1.0", False), ("(MIT)/(GPL-2.0)", "gpl,mit", True), ("MIT */", "mit", True), ("MIT // see LICENSE", "mit", True), ("CC-BY-NC-SA-4.0", "cc-by-nc", False), ("LicenseRef-Own", "licenseref-own", False), ("Apache 2.0", "apache", True), ("LGPL-2.1-or-later", "lgpl", False),
    ],
)
def test_identifiers_are_taken_whole(line, labels, free):
    got = licences.scan(f"// SPDX-License-Identifier: {line}\n".encode())
    assert (got["labels"], got["permissive"]) == (labels, free)


@pytest.mark.parametrize("text,labels", [("under the GPLv3.", "gpl"), ("the GNU GPL version 3", "gpl"), ("Apache 2.0 licensed code", "apache"), ("MIT-licensed", "mit"), ("BSD 3-Clause", "bsd"), ("a gplv4 world", ""), ("we admit licensed users", "")])
def test_prose_names_licences(text, labels):
    assert licences.scan(text.encode())["labels"] == labels
