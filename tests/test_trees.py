"""The tree source: every name is listed, folders are pruned, files are written in pieces and committed at the end."""

import os

import pytest
from pyspark.sql import functions as F

from codecorpus.sources import scan, trees

NAMES = {
    "p1/__init__.py": b"1", "p1/__main__.py": b"22", "p1/_private.py": b"", "p1/core.py": b"x\xff", "p1/_inner/x.py": b"333", "p1/.eslintrc.js": b"4", "p1/a b/c=d/%41.py": b"5", "p1/deep/er/and/deeper/y.js": b"66",
    "p1/node_modules/m/i.js": b"7", "p1/a b/Build/o.py": b"8", "p1/.git/hook.js": b"9", "p1/deep/.hidden/z.py": b"0", "_p2/__init__.py": b"a", ".p3/_a/_b.py": b"bb", "root.py": b"c", "p1/large.bin": b"L" * 100,
}
PRUNED = {"p1/node_modules/m/i.js", "p1/a b/Build/o.py", "p1/.git/hook.js", "p1/deep/.hidden/z.py"}


@pytest.fixture
def tree(tmp_path):
    for path, data in NAMES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "p1/link").symlink_to(tmp_path / "p1", target_is_directory=True)
    return tmp_path


def rows(df):
    return {(r.project_id, r.relative_path): (bytes(r.content) if r.content is not None else None, r.size_bytes) for r in df.collect()}


def of(paths):
    return {tuple(p.split("/", 1)) if "/" in p else ("", p): (NAMES[p], len(NAMES[p])) for p in paths}


def test_all_names_and_no_ignored_folders(spark, tree):
    assert rows(scan.scan_tree(spark, str(tree))) == of(set(NAMES) - PRUNED)
    assert rows(scan.scan_tree(spark, f"file://{tree}", ignored=(), hidden_folders=True)) == of(NAMES)
    assert rows(scan.scan_tree(spark, str(tree), max_bytes=99)) == of(set(NAMES) - PRUNED - {"p1/large.bin"})
    found = rows(scan.scan_tree(spark, str(tree), content=False))
    assert found == {k: (None, n) for k, (_, n) in of(set(NAMES) - PRUNED).items()}


@pytest.mark.parametrize("wanted", [1, 3, 8, 500])
def test_subtrees_share_the_work_and_miss_nothing(tree, wanted):
    reader = trees.TreeReader({"path": str(tree), "partitions": str(wanted)})
    parts = reader.partitions()
    found = [(b.column(0)[i].as_py(), b.column(1)[i].as_py()) for p in parts for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(found) == sorted(of(NAMES)) and (wanted < 8 or len(parts) >= 8)


def test_a_filter_on_projects_prunes_the_listing(spark, tree):
    df = scan.scan_tree(spark, str(tree)).where("project_id = '_p2'")
    assert rows(df) == of({"_p2/__init__.py"}) and df.rdd.getNumPartitions() == 1
    assert rows(scan.scan_tree(spark, str(tree)).where(F.col("project_id").isin("", ".p3", "none"))) == of({"root.py", ".p3/_a/_b.py"})


def test_unreadable_and_empty(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/gone.py").symlink_to(tmp_path / "nowhere")
    assert all(content is None for content, _ in rows(scan.scan_tree(spark, str(tmp_path))).values())
    assert scan.scan_tree(spark, str(tmp_path / "none")).count() == 0


def test_written_trees_are_read_again(spark, tmp_path):
    files = [(p, q, bytearray(c)) for (p, q), (c, _) in of(NAMES).items()]
    scan.write_tree(spark.createDataFrame(files, "project_id string, relative_path string, content binary").repartition(3), str(tmp_path / "t"))
    assert rows(scan.scan_tree(spark, str(tmp_path / "t"), ignored=(), hidden_folders=True)) == of(NAMES)
    assert not [x for x in os.listdir(tmp_path / "t") if x.startswith(trees.MAKING)]
    scan.write_tree(spark.createDataFrame([("p1", "core.py", "new é"), ("p9", "x/./y.py", None)], "project_id string, relative_path string, content string"), str(tmp_path / "t"))
    assert (tmp_path / "t/p1/core.py").read_text() == "new é" and (tmp_path / "t/p9/x/y.py").read_bytes() == b""
    scan.write_tree(spark.createDataFrame([], "project_id string, relative_path string, content string"), str(tmp_path / "u"))
    assert scan.scan_tree(spark, str(tmp_path / "u")).count() == 0


@pytest.mark.parametrize("project,path", [("p", "../x"), ("p", ""), ("..", "x"), ("p/q", "x"), ("p", "a/../../x")])
def test_no_file_leaves_its_project(spark, tmp_path, project, path):
    with pytest.raises(Exception, match="no place inside the tree"):
        scan.write_tree(spark.createDataFrame([("p", "kept.py", "1"), (project, path, "2")], "project_id string, relative_path string, content string").coalesce(1), str(tmp_path / "t"))
    assert not (tmp_path / "t/p/kept.py").exists()


def test_lines_stream_into_one_file_a_project(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "WRITE_BYTES", 7)
    lines = spark.createDataFrame([(f"p{i % 3}", i % 2, i, f"line {i}") for i in range(300)] + [("p9", 0, 0, "alone")], "project_id string, section int, ord int, line string").repartition(5)
    scan.write_lines(lines, str(tmp_path / "t"), "report.md", ["section", "ord"])
    for p in range(3):
        own = sorted((i % 2, i) for i in range(300) if i % 3 == p)
        assert (tmp_path / f"t/p{p}/report.md").read_text() == "\n".join(f"line {i}" for _, i in own)
    assert (tmp_path / "t/p9/report.md").read_text() == "alone"


@pytest.mark.parametrize("most", ["MOST_LISTED", "MOST_HELD"])
@pytest.mark.parametrize("wanted", [2, 5, 64])
def test_large_folders_are_dealt_among_tasks_by_name(tree, monkeypatch, most, wanted):
    monkeypatch.setattr(trees, most, 2)
    for root in (tree, tree / "p1"):  # many projects, and many entries in one
        reader = trees.TreeReader({"path": str(root), "partitions": str(wanted)})
        parts = reader.partitions()
        found = ["/".join(filter(None, (b.column(0)[i].as_py(), b.column(1)[i].as_py()))) for p in parts for b in reader.read(p) for i in range(b.num_rows)]
        assert sorted(found) == sorted(p if root == tree else p[3:] for p in NAMES if root == tree or p.startswith("p1/"))
        assert most != "MOST_LISTED" or len(parts) == wanted
    reader = trees.TreeReader({"path": str(tree), "partitions": str(wanted)})
    reader.projects = {"_p2", ""}
    found = [b.column(1)[i].as_py() for p in reader.partitions() for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(found) == ["__init__.py", "root.py"]


def test_a_commit_is_told_of_lists_not_of_files(tmp_path):
    import pickle

    batch = trees.pa.RecordBatch.from_pydict({"project_id": ["p"] * 500, "relative_path": [f"{i}/x.py" for i in range(500)], "content": ["1"] * 500})
    writer = trees.TreeWriter({"path": str(tmp_path)})
    messages = [writer.write(iter([batch])), writer.write(iter([]))]
    assert len(pickle.dumps(messages)) < 1000
    writer.commit(messages)
    assert sorted(os.listdir(tmp_path)) == ["p"] and len(os.listdir(tmp_path / "p")) == 500


def test_a_report_over_the_size_limit_of_sources_is_read_again(spark):
    """reports are files that the query wrote itself, so the limit of 50 MB for source files isn't theirs."""
    from codecorpus.queries import reports

    lines = spark.range(51).select(F.lit("build").alias("project_id"), F.lit(0).alias("section"), F.col("id").alias("ord"), F.repeat(F.lit("x"), 1 << 20).alias("line"))
    assert [tuple(r) for r in reports._files(lines).select("project_id", F.length("report")).collect()] == [("build", 51 * (1 << 20) + 50)]


def test_many_subtrees_share_few_partitions(tmp_path):
    """F8: each of up to 20,000 folders was a task of its own, which the driver has to keep."""
    for i in range(600):
        (tmp_path / f"p{i % 3}/d{i}").mkdir(parents=True)
        (tmp_path / f"p{i % 3}/d{i}/x.py").write_text("1")
    reader = trees.TreeReader({"path": str(tmp_path), "partitions": "8"})
    parts = reader.partitions()
    assert len(parts) <= 32
    found = [b.column(1)[i].as_py() for p in parts for b in reader.read(p) for i in range(b.num_rows)]
    assert sorted(found) == sorted(f"d{i}/x.py" for i in range(600))
