"""Inventory, hashes, limits and audits."""

import uuid

from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators import graph
from codecorpus.operators import inventory as op
from codecorpus.queries.register import adder
from codecorpus.shipping import shared_folder
from codecorpus.sources import scan

ALL: dict = {}
add = adder(ALL)

# paths of the files view, dressed up so that every rule has rows
_ODD = "CASE CAST(doc_id % 9 AS INT) WHEN 1 THEN concat('node_modules/', relative_path) WHEN 2 THEN concat('src/.hidden/', relative_path) WHEN 3 THEN concat('lib/', relative_path, '.map') WHEN 4 THEN 'pkg/Yarn.lock' WHEN 5 THEN concat('src/../', relative_path) WHEN 6 THEN concat('../', relative_path) WHEN 7 THEN concat('/abs/', relative_path) ELSE relative_path END"
_IGNORED = "('.git', 'node_modules', 'vendor', 'dist', 'build', 'coverage', '__pycache__', '.pytest_cache', '.mypy_cache', '.venv', 'venv', 'target')"
_LOCKS = "('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'pipfile.lock', 'poetry.lock', 'cargo.lock')"


def _odd(files):
    return files.selectExpr("doc_id", "project_id", f"{_ODD} AS path", "content", "size_bytes")


_odd_sql = f"SELECT doc_id, project_id, {_ODD} AS path, content, size_bytes FROM v_files"

add(
    "s2_filter_source_paths", "v_files", lambda f: op.filter_source_paths(_odd(f), "path").select("doc_id", "path"),
    f"""WITH o AS ({_odd_sql}) SELECT doc_id, path FROM o WHERE len(list_filter(string_split(path, '/')[:-2], lambda p: lower(p) IN {_IGNORED} OR starts_with(p, '.'))) = 0
    AND lower(string_split(path, '/')[-1]) NOT IN {_LOCKS} AND NOT ends_with(lower(string_split(path, '/')[-1]), '.map')""",
)
add(
    "s3_classify_language", "v_files", lambda f: f.select("doc_id", s.classify_language(F.col("relative_path")).alias("language")).where("language is not null"),
    "SELECT doc_id, CASE regexp_extract(relative_path, '\\.([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' END AS language FROM v_files WHERE regexp_extract(relative_path, '\\.([^.]+)$', 1) IN ('py', 'js', 'ts')",
)
add("s4_filter_max_size", "v_files", lambda f: op.filter_max_size(f, "size_bytes", 2000).select("doc_id", "size_bytes"), "SELECT doc_id, size_bytes FROM v_files WHERE size_bytes <= 2000")
add("s5_is_binary", "v_files", lambda f: f.select("doc_id", op.is_binary(F.concat(F.col("content").cast("binary"), F.unhex(F.lit("00")))).alias("is_binary")), "SELECT doc_id, octet_length(encode(content)) < 1024 AS is_binary FROM v_files")
add("s6_decode_text", "v_files", lambda f: f.select("doc_id", F.sha2(op.decode_text(F.col("content").cast("binary")), 256).alias("digest")), "SELECT doc_id, sha256(content) AS digest FROM v_files")
add("s7_line_count", "v_files", lambda f: f.select("doc_id", op.line_count(F.col("content")).alias("line_count")), "SELECT doc_id, CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS INT) AS line_count FROM v_files")
add(
    "s8_is_minified", "v_files",
    lambda f: f.select("doc_id", F.split("content", "\n").alias("l"), F.concat("relative_path", F.when(F.col("doc_id") % 5 == 0, ".min.js").otherwise("")).alias("p")).select("doc_id", op.is_minified(F.col("p"), F.col("l")[0], F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x)) / F.size("l")).alias("minified")),
    """SELECT doc_id, (doc_id % 5 = 0 OR length(replace(content, chr(10), '')) / len(string_split(content, chr(10))) > 500 OR length(string_split(content, chr(10))[1]) > 1000) AS minified FROM v_files""",
)
add("s9_hash_files", "v_files", lambda f: op.hash_files(f).select("doc_id", "sha256_hash", "entry_hash"), "SELECT doc_id, sha256(content) AS sha256_hash, sha256(concat(relative_path, ':', sha256(content))) AS entry_hash FROM v_files")


def _rollup(f):
    return op.project_rollup(op.hash_files(op.classified(f)).withColumn("line_count", op.line_count(F.col("content"))))


add(
    "s10_project_rollup", "v_files", lambda f: _rollup(f).select("project_id", "total_files", "total_lines", F.array_join("detected_languages", ",").alias("languages"), "content_hash"),
    """WITH h AS (SELECT project_id, relative_path, lang, sha256(concat(relative_path, ':', sha256(content))) AS e, length(content) - length(replace(content, chr(10), '')) + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS n
      FROM (SELECT *, CASE regexp_extract(relative_path, '\\.([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' END AS lang FROM v_files))
    SELECT project_id, count(*) AS total_files, CAST(sum(n) AS BIGINT) AS total_lines, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, sha256(string_agg(e, '' ORDER BY relative_path)) AS content_hash FROM h GROUP BY project_id""",
)
add(
    "s11_project_limits", "v_files v_modules", lambda f, m: op.project_limits(m.select("project_id").unionByName(f.select("project_id")).distinct(), _rollup(f), max_lines=400).select("project_id", "status"),
    """WITH n AS (SELECT project_id, sum(length(content) - length(replace(content, chr(10), '')) + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END) AS n FROM v_files GROUP BY project_id), p AS (SELECT project_id FROM v_modules UNION SELECT project_id FROM v_files)
    SELECT p.project_id, CASE WHEN n IS NULL THEN 'NO_SOURCE_FILES' WHEN n > 400 THEN 'EXCEEDED_LINE_LIMIT' ELSE 'OK' END AS status FROM p LEFT JOIN n USING (project_id)""",
)
add(
    "s12_audit_archive", "v_archive", lambda a: op.audit_archive_manifest(a, max_total=100_000, max_file=90_000, max_entries=6).select("archive_id", "entries", "code"),
    """WITH r AS (SELECT *, sum(file_size) OVER (PARTITION BY archive_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM v_archive),
    c AS (SELECT archive_id, seq, CASE WHEN flag_bits & 1 = 1 THEN 'ENCRYPTED_ZIP' WHEN file_size > 90000 THEN 'FILE_TOO_LARGE' WHEN (external_attr >> 16) & 61440 = 40960 THEN 'SYMLINK_NOT_ALLOWED' WHEN (external_attr >> 16) & 61440 NOT IN (0, 32768, 16384) THEN 'UNSUPPORTED_ENTRY_TYPE'
      WHEN running > 100000 THEN 'EXCESSIVE_UNCOMPRESSED_SIZE' WHEN compress_size > 0 AND file_size / compress_size > 100 AND file_size > 1048576 THEN 'EXCESSIVE_COMPRESSION_RATIO'
      WHEN contains(filename, ':') OR starts_with(filename, '/') OR starts_with(filename, '..') OR contains(filename, '/../../../') THEN 'PATH_TRAVERSAL' END AS code FROM r)
    SELECT archive_id, count(*) AS entries, CASE WHEN count(*) > 6 THEN 'EXCESSIVE_ENTRIES' ELSE coalesce(arg_min(code, seq) FILTER (code IS NOT NULL), 'OK') END AS code FROM c GROUP BY archive_id""",
)
add(
    "s13_validate_repo_url", "v_urls", lambda u: u.select("page_id", op.validate_repo_url(F.col("url")).alias("v")).select("page_id", "v.url", "v.error"),
    """SELECT page_id, CASE WHEN e IS NULL THEN concat('https://github.com/', regexp_extract(url, '^https://github\\.com/([a-zA-Z0-9_.-]+)/', 1), '/', regexp_replace(regexp_extract(url, '/([a-zA-Z0-9_.-]+)$', 1), '\\.git$', ''), '.git') END AS url, e AS error FROM (
      SELECT page_id, url, CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN 'QUERY_OR_FRAGMENT' WHEN NOT starts_with(url, 'https:') THEN 'NOT_HTTPS' WHEN url LIKE '%@%' THEN 'CREDENTIALS' WHEN NOT starts_with(url, 'https://github.com/') THEN 'OTHER_HOST' END AS e FROM v_urls)""",
)
add("s14_repo_display_name", "v_urls", lambda u: u.select("page_id", op.repo_display_name(F.col("url")).alias("name")), "SELECT page_id, string_split(regexp_replace(rtrim(url, '/'), '\\.git$', ''), '/')[-1] AS name FROM v_urls")
add("s15_tree_size", "v_files", lambda f: op.tree_size(f, most=120_000), "SELECT project_id, CAST(sum(size_bytes) AS BIGINT) AS bytes, sum(size_bytes) > 120000 AS too_large FROM v_files GROUP BY project_id")
add("s16_guard_paths", "v_files", lambda f: op.guard_paths(_odd(f), "path").select("doc_id", "path", "safe"), f"WITH o AS ({_odd_sql}) SELECT doc_id, path, NOT (starts_with(path, '/') OR starts_with(path, '../')) AS safe FROM o")
add("f1_hashed_ids", "v_modules", lambda m: m.select("module_id", s.module_id(F.col("project_id"), F.col("relative_path")).alias("hashed"), s.edge_id(F.col("module_id"), F.col("project_id"), F.col("language"), F.col("complexity")).alias("edge")), "SELECT module_id, concat('mod_', left(sha256(concat(project_id, ':', relative_path)), 12)) AS hashed, concat('edge_', left(sha256(concat(module_id, ':', project_id, ':', language, ':', complexity)), 12)) AS edge FROM v_modules")
add("f2_f3_import_names", "v_imports", lambda i: i.select("module_id", s.is_relative_import(F.col("module_name")).alias("relative"), s.base_package(F.col("module_name")).alias("base")), "SELECT module_id, starts_with(module_name, '.') AS relative, string_split(module_name, '.')[1] AS base FROM v_imports")
add("f4_complexity_rating", "v_modules", lambda m: m.select("module_id", s.complexity_rating(F.col("complexity")).alias("rating")), "SELECT module_id, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 20 THEN 'high' ELSE 'critical' END AS rating FROM v_modules")
add("f5_scores", "v_modules", lambda m: m.select("module_id", s.bounded_score(F.col("complexity") * 2.5 - 10).alias("score")).withColumn("status", s.score_status(F.col("score"))), "SELECT module_id, score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Ready with care' WHEN score >= 40 THEN 'Needs preparation' ELSE 'High risk' END AS status FROM (SELECT module_id, CAST(greatest(0, least(100, round_even(complexity * 2.5 - 10, 0))) AS INT) AS score FROM v_modules)")
add("f6_normalize_path", "v_modules", lambda m: m.select("module_id", s.normalize_path(F.concat(F.lit("./a/../"), "relative_path", F.lit("//x/./y"))).alias("path")), "SELECT module_id, concat(relative_path, '/x/y') AS path FROM v_modules")
add("f7_risk_level", "v_modules", lambda m: m.select("module_id", s.raw_risk(F.col("complexity") % 7, s.complexity_rating(F.col("complexity")), F.col("complexity") % 13, F.col("is_entry_point")).alias("raw")).select("module_id", "raw", s.risk_level(F.col("raw")).alias("risk"), s.risk_rank(s.risk_level(F.col("raw"))).alias("rank")), "SELECT module_id, raw, CASE WHEN raw >= 18 THEN 'critical' WHEN raw >= 10 THEN 'high' WHEN raw >= 4 THEN 'medium' ELSE 'low' END AS risk, CAST(CASE WHEN raw >= 18 THEN 4 WHEN raw >= 10 THEN 3 WHEN raw >= 4 THEN 2 ELSE 1 END AS INT) AS rank FROM (SELECT module_id, CAST(complexity % 7 + CASE WHEN complexity > 20 THEN 8 WHEN complexity > 10 THEN 5 WHEN complexity > 5 THEN 2 ELSE 0 END + least(complexity % 13, 10) + CASE WHEN is_entry_point THEN 5 ELSE 0 END AS INT) AS raw FROM v_modules)")
add("f9_python_import_name", "v_modules", lambda m: m.select("module_id", s.python_import_name(F.concat("relative_path", F.lit("/__init__.py"))).alias("package"), s.python_import_name(F.col("relative_path")).alias("name")), "SELECT module_id, replace(relative_path, '/', '.') AS package, regexp_replace(replace(regexp_replace(relative_path, '\\.py$', ''), '/', '.'), '^$', '') AS name FROM v_modules")
add("f10_safe_test_path", "v_modules", lambda m: m.select("module_id", s.safe_test_path(F.concat(F.lit("a.b/c."), "relative_path"), F.col("language")).alias("path")), "SELECT module_id, CASE WHEN language = 'python' THEN concat('tests/test_', n, '.py') ELSE concat('tests/', n, '.test.js') END AS path FROM (SELECT *, replace(regexp_replace(string_split(relative_path, '/')[-1], '\\.py$', ''), '.', '_') AS n FROM v_modules)")
_WORDS = "string_split(string_split(relative_path, '_')[1], '/')"
add(
    "f11_f12_arguments", "v_modules",
    lambda m: m.select("module_id", F.explode(F.split(F.substring_index("relative_path", "_", 1), "/")).alias("name")).select("module_id", "name", s.infer_argument(F.concat(F.col("name"), F.when(F.col("module_id") % 5 == 0, "_num").when(F.col("module_id") % 5 == 1, "_path").when(F.col("module_id") % 5 == 2, "is_").when(F.col("module_id") % 5 == 3, "_items").otherwise("_cfg"))).alias("argument"), s.boundary_argument(F.col("name")).alias("boundary")),
    f"SELECT module_id, name, CASE CAST(module_id % 5 AS INT) WHEN 0 THEN '10' WHEN 1 THEN '''test_value''' WHEN 2 THEN 'True' WHEN 3 THEN '[1, 2, 3]' ELSE '{{''key'': ''val''}}' END AS argument, CASE WHEN regexp_matches(lower(name), '[abxyn]|num|count|val') THEN '0' ELSE '''''' END AS boundary FROM (SELECT module_id, unnest({_WORDS}) AS name FROM v_modules)".replace("{{", "{").replace("}}", "}"),
)
add("f13_redact", "documents", lambda d: d.select("doc_id", F.md5(s.redact(F.col("text"), "/srv/x", 500)).alias("digest")), "SELECT doc_id, md5(left(regexp_replace(regexp_replace(text, 'https?://[^:\\s]+:[^@\\s]+@', 'https://[REDACTED_CREDENTIALS]@', 'g'), '(token|secret|password|bearer|auth)[=:]\\s*[\\w.-]+', '\\1=[REDACTED]', 'gi'), 500)) AS digest FROM documents")
add("f14_download_name", "v_urls", lambda u: u.select("page_id", s.download_name(F.col("url")).alias("name")), "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '-', 'g'), '-'), ''), 'project') AS name FROM v_urls")
add("f15_labels", "v_warnings", lambda w: w.select("ord", s.severity_label(F.col("severity")).alias("severity"), s.warning_title(F.col("code")).alias("title"), s.complexity_label(F.lit(None).cast("string"), F.col("line") * 4).alias("complexity"), s.clean_text(F.concat(F.lit(" `a`  "), "message")).alias("text")).distinct(), "SELECT DISTINCT ord, CASE severity WHEN 'risk' THEN 'Important' WHEN 'warning' THEN 'Review' ELSE 'Note' END AS severity, replace(code, '_', ' ') AS title, CASE WHEN line * 4 <= 5 THEN 'Low' WHEN line * 4 <= 10 THEN 'Moderate' WHEN line * 4 <= 20 THEN 'High' ELSE 'Critical' END AS complexity, concat('a ', message) AS text FROM v_warnings")
add(
    "f18_forbidden_pattern", "v_urls", lambda u: u.select("page_id", s.forbidden_pattern(F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(" execSync( child_process"))).when(F.col("page_id") % 5 == 1, F.concat("url", F.lit(" execSync( fs.rmdirSync"))).when(F.col("page_id") % 5 == 2, F.concat("url", F.lit(" fs.rmdirSync"))).when(F.col("page_id") % 5 == 3, "  ").otherwise(F.col("url"))).alias("found")),
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'child_process' WHEN 1 THEN 'execSync(' WHEN 2 THEN 'fs.rmdirSync' WHEN 3 THEN 'empty' END AS found FROM v_urls",
)


_NAMED = "concat('d', CAST(doc_id AS {t}), CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/_inner/_private.py' WHEN 2 THEN '/.eslintrc.js' WHEN 3 THEN '/node_modules/x/y.js' WHEN 4 THEN '/.git/hook.js' WHEN 5 THEN '/Build/out.py' WHEN 6 THEN '/a b/c=d/__main__.py' ELSE '/a/b/core.py' END)"


def _tree(files):
    """The files' texts as a tree in the shared folder, with names of all kinds, scanned again."""
    root = f"{shared_folder(files.sparkSession)}/tree-{uuid.uuid4().hex}"
    scan.write_tree(files.selectExpr("project_id", f"{_NAMED.format(t='STRING')} AS relative_path", "content"), root)
    found = graph.settled(scan.scan_tree(files.sparkSession, root).select("project_id", "relative_path", "size_bytes", F.sha2("content", 256).alias("digest")))
    scan.delete_tree(files.sparkSession, root)
    return found


add("s1_scan_tree", "v_files", _tree, f"SELECT project_id, {_NAMED.format(t='VARCHAR')} AS relative_path, CAST(octet_length(encode(coalesce(content, ''))) AS BIGINT) AS size_bytes, sha256(coalesce(content, '')) AS digest FROM v_files WHERE doc_id % 11 NOT IN (3, 4, 5)")


def _reports(c):
    """A report for each row; every tenth is malformed, some files lack a summary."""
    whole = F.concat(F.lit('{"files":{"'), "path", F.lit('":{"summary":{"num_statements":'), F.col("statements").cast("string"), F.lit(',"covered_lines":'), F.col("covered").cast("string"), F.lit('},"executed_lines":[1,2],"missing_lines":[]}}}'))
    return c.select("project_id", F.when(F.col("covered") % 10 == 0, "{no report").when(F.col("covered") % 10 == 1, F.concat(F.lit('{"files":{"'), "path", F.lit('":{}}}'))).otherwise(whole).alias("body"))


add(
    "s17_read_coverage_json", "v_coverage", lambda c: scan.read_coverage_json(_reports(c)).groupBy("project_id", "path", "covered", "statements").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("covered_lines"), F.lit(0))).alias("lines")),
    "SELECT project_id, path, CASE WHEN covered % 10 = 1 THEN 0 ELSE covered END AS covered, CASE WHEN covered % 10 = 1 THEN 0 ELSE statements END AS statements, count(*) AS n, CAST(sum(CASE WHEN covered % 10 = 1 THEN 0 ELSE 2 END) AS BIGINT) AS lines FROM v_coverage WHERE covered % 10 <> 0 GROUP BY 1, 2, 3, 4",
)


def _written_twice(m):
    """All projects' records, then those of some projects again by a later version."""
    path = f"{shared_folder(m.sparkSession)}/analyses-{uuid.uuid4().hex}"
    record = m.select("module_id", "complexity", "project_id")
    scan.write_by_project(record.withColumn("analyzer_version", F.lit(1)), path)
    scan.write_by_project(record.where("project_id like '%1'").withColumn("analyzer_version", F.lit(2)), path)
    found = graph.settled(m.sparkSession.read.parquet(path).select("project_id", "module_id", "complexity", "analyzer_version"))
    scan.delete_tree(m.sparkSession, path)
    return found


add("k1_write_analysis", "v_modules", _written_twice, "SELECT project_id, module_id, complexity, CASE WHEN project_id LIKE '%1' THEN 2 ELSE 1 END AS analyzer_version FROM v_modules")
add("f23_human_bytes", "v_archive", lambda a: a.select("archive_id", "seq", s.human_bytes(F.col("file_size") * F.when(F.col("seq") % 2 == 0, 1).otherwise(3000)).alias("size")), "SELECT archive_id, seq, CASE WHEN n >= 1073741824 THEN concat(regexp_replace(printf('%.1f', round(n / 1073741824, 1)), '\\.0$', ''), ' GB') WHEN n >= 1048576 THEN concat(regexp_replace(printf('%.1f', round(n / 1048576, 1)), '\\.0$', ''), ' MB') WHEN n >= 1024 THEN concat(regexp_replace(printf('%.1f', round(n / 1024, 1)), '\\.0$', ''), ' KB') ELSE concat(n, ' B') END AS size FROM (SELECT archive_id, seq, file_size * CASE WHEN seq % 2 = 0 THEN 1 ELSE 3000 END AS n FROM v_archive)")
