"""Substring search by postings, line differences, and content hashes of sorted streams."""

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import diff, inventory, jobs, search, text


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abC/_é") for _ in range(r.randint(0, 12))), [r.choice(["Python", "java", "go", None]) for _ in range(r.randint(0, 3))], "k") for i in range(400)]
    rows += [(500, None, None, "k"), (501, "", [], "k"), (502, "aaaaaaaaaa", None, "k")]
    df = spark.createDataFrame(rows, "id int, name string, langs array<string>, key string")
    path = str(tmp_path_factory.mktemp("postings"))
    search.write_postings(df, "id", ("name", "langs"), path)
    return df, rows, path


@pytest.mark.parametrize("query", ["abc", " ABC ", "a", "", "/_", "cé", "python", "YTHO", "ava", "aaaaaaa", "zzz", "abcabcabc", "b/_", "pythonjava"])
def test_postings_find_what_a_scan_finds(posted, query):
    df, rows, path = posted
    q = query.strip().lower()
    want = {i for i, name, langs, _ in rows if not q or any(x is not None and q in x.lower() for x in [name, *(langs or [])])}
    got = [r.id for r in jobs.search(df, query, "name", "langs", key="id", postings=path).collect()]
    assert len(got) == len(want) and set(got) == want == {r.id for r in jobs.search(df, query, "name", "langs").collect()}


def test_a_search_reads_few_buckets(spark, posted):
    df, _, path = posted
    plan = search.candidates(spark, path, "python")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(EqualTo(gram" in plan
    assert search.candidates(spark, path, "ab") is None


def plain(a, b):
    """Both texts from the differences, and how many lines they keep."""
    old, new = list(a), list(b)
    out = list(diff.differences(a, b))
    gone = {i for op, i, _ in out if op in ("removed", "changed")}
    come = {j for op, _, j in out if op in ("added", "changed")}
    assert [x for i, x in enumerate(old) if i not in gone] == [x for j, x in enumerate(new) if j not in come]
    assert len(gone) + len(come) == sum({"changed": 2}.get(op, 1) for op, _, _ in out)
    return out


def test_differences_leave_what_is_equal(monkeypatch):
    r = random.Random(2)
    for _ in range(1500):
        a = [r.choice("abcdefghij") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = [r.choice("abcxyz") for _ in range(r.randint(0, 2))]
        plain(a, b)
    a = [f"line {i}" for i in range(300)]
    b = [x for x in a if x not in ("line 7", "line 200")]
    b[50:50] = ["new", "new"]
    b[120] = "other"
    assert plain(a, b) == [("removed", 7, None), ("added", None, 50), ("added", None, 51), ("changed", 119, 120), ("removed", 200, None)]
    assert len(plain(a, b)) == sum(1 for x in difflib.ndiff(a, b) if x[0] in "+-") - 1


@pytest.mark.parametrize(
    "before,after,want",
    [
        ("a\nb\nc", "a\nx\nb\nc", [("added", 2, 2, None, "x")]), ("a\nb\nc\n", "a\nc\n", [("removed", 2, None, "b", None)]), ("a\nb", "a\nB", [("changed", 2, 2, "b", "B")]), ("", "a", [("added", 1, 1, None, "a")]), ("a", None, [("removed", 1, None, "a", None)]),
        (None, "a\nb", [("added", 1, 1, None, "a"), ("added", 2, 2, None, "b")]), (None, None, []), ("a\n", "a", []), ("x\nx\nx", "x\nx", [("removed", 3, None, "x", None)]),
    ],
)
def test_line_diff(spark, before, after, want):
    df = spark.createDataFrame([(1, before, after, "c")], "op int, content string, modern string, line_no string").select(F.col("op").alias("file"), "content", "modern", "line_no")
    assert sorted((r.op, r.line_no, r.after_no, r.before, r.after) for r in text.line_diff(df, ["file"]).collect()) == sorted(want)


def test_content_hashes_of_many_projects(spark):
    rows = [(p, f"f{i:03d}", hashlib.sha256(f"{p}{i}".encode()).hexdigest(), "python", 2) for p in ("p", "q", None) for i in range(150)] + [("one", "a", "e", None, 1)]
    df = spark.createDataFrame(rows, "project_id string, relative_path string, entry_hash string, language string, line_count int").repartition(9)
    got = {r.project_id: (r.total_files, r.total_lines, r.detected_languages, r.content_hash) for r in inventory.project_rollup(df).collect()}
    digest = lambda p: hashlib.sha256("".join(e for q, _, e, _, _ in rows if q == p).encode()).hexdigest()
    assert got == {p: (150, 300, ["python"], digest(p)) for p in ("p", "q", None)} | {"one": (1, 1, [], digest("one"))}


def test_postings_are_made_in_pieces_of_bounded_size(spark, tmp_path, monkeypatch):
    dealt, made = search.dealt, []
    monkeypatch.setattr(search, "RECORDS", 10)
    monkeypatch.setattr(search, "dealt", lambda rows, each, *columns: made.append(dealt(rows, each, *columns)) or made[-1])
    df = spark.createDataFrame([(i % 100, f"name {i % 7}") for i in range(200)], "id int, name string")  # a key stands in two rows
    search.write_postings(df, "id", ("name",), str(tmp_path))
    assert made[0].rdd.getNumPartitions() == 20
    found = spark.read.parquet(f"{tmp_path}/postings")
    assert found.count() == found.distinct().count() == df.select("id", F.explode(search.grams(F.col("name")))).distinct().count()
    assert {r.gram: r.n for r in spark.read.parquet(f"{tmp_path}/counts").collect()}["nam"] == 100


def test_names_of_modules_are_collected_in_pieces_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SYMBOLS", 10)
    symbols = spark.createDataFrame([(i % 7, "function", f"f{i % 14}") for i in range(100)], "module_id int, kind string, name string")
    modules = spark.range(7).selectExpr("cast(id as int) AS module_id", "'p' AS relative_path")
    found = jobs.module_texts(modules, symbols)
    assert "hashpartitioning(module_id#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    assert {(r.module_id, tuple(sorted(r.texts))) for r in found.collect()} == {(i, tuple(sorted(("p", f"f{i}", f"f{i + 7}")))) for i in range(7)}


def test_lines_that_differ_in_place_are_not_aligned(spark, monkeypatch):
    r = random.Random(3)
    pick = lambda letters: r.choice(letters)
    olds = [[pick("abcde") for _ in range(r.randint(0, 6))] for _ in range(2000)]
    news = [[x if r.random() < 0.5 else pick("abcdexyz") for x in a] if r.random() < 0.7 else [pick("abcxyz") for _ in range(r.randint(0, 6))] for a in olds]
    simple, row, place = diff.in_place(diff.pa.array(olds, diff.pa.list_(diff.pa.string())), diff.pa.array(news, diff.pa.list_(diff.pa.string())))
    got = {}
    for i, k in zip(row.tolist(), place.tolist(), strict=True):
        got.setdefault(i, []).append(("changed", k, k))
    assert simple.sum() > 1000
    assert all(got.get(i, []) == list(diff.differences(a, b)) for i, (a, b) in enumerate(zip(olds, news, strict=True)) if simple[i])
    null = diff.pa.array([None, ["a", None], ["a"]], diff.pa.list_(diff.pa.string()))
    assert diff.in_place(null, diff.pa.array([[], ["a", "b"], None], null.type))[0].tolist() == [True, False, False]


def test_recurring_lines_are_judged_once(spark):
    from codecorpus.queries import text as queries

    lines = spark.createDataFrame([(i, 1, "x = d.iteritems()" if i % 2 else "    except:") for i in range(400)], "file_id int, line_no int, line string")
    found = {(r.language, r.syntax_valid): (r.n, r.warnings) for r in queries._gated(lines).collect()}
    assert found == {("python", True): (200, 200), ("python", False): (200, 200), ("javascript", True): (400, 0)}
    plan = queries._gated(lines)._jdf.queryExecution().executedPlan().toString()
    judged, grouped = plan.index("ArrowEvalPython"), plan.index("keys=[content#")
    assert judged < grouped  # lines meet in groups below the parser
