"""Source-code tables derived from the driver's tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codecorpus.shipping import dealt, ship

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views by name; {x} is a base table or another view.
VIEWS = {
    "v_files": """SELECT source AS project_id,
        concat(lang, '/doc_', CAST(doc_id AS STRING), CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.ts' ELSE '.txt' END) AS relative_path,
        text AS content, n_chars AS size_bytes, doc_id FROM {documents}""",
    "v_modules": """SELECT p_brand AS project_id, p_partkey AS module_id,
        concat(replace(p_name, ' ', '/'), '_', CAST(p_partkey AS STRING), '.py') AS relative_path,
        CASE WHEN p_partkey % 3 = 0 THEN 'javascript' ELSE 'python' END AS language,
        CAST(p_size AS INT) AS complexity, CAST(floor(p_retailprice) AS BIGINT) AS line_count, p_partkey % 40 = 0 AS is_entry_point,
        CASE WHEN p_size % 10 = 0 THEN 'failed' WHEN p_size % 10 = 5 THEN 'partial' ELSE 'complete' END AS parse_status FROM {part}""",
    "v_pairs": """SELECT DISTINCT pa.p_brand AS project_id, a.l_partkey AS source_module_id, b.l_partkey AS target_module_id, pb.p_brand AS target_project, CASE WHEN b.l_quantity >= 40 THEN 'require' ELSE 'import' END AS type
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_quantity > b.l_quantity AND a.l_partkey <> b.l_partkey
        JOIN {part} pa ON pa.p_partkey = a.l_partkey JOIN {part} pb ON pb.p_partkey = b.l_partkey""",
    "v_edges": """SELECT project_id, source_module_id, target_module_id, type, CAST(source_module_id % 90 + 1 AS INT) AS source_line FROM {v_pairs} WHERE project_id = target_project""",
    "v_all_edges": """SELECT project_id, source_module_id, target_module_id, type, CAST(source_module_id % 90 + 1 AS INT) AS source_line, project_id = target_project AS resolved FROM {v_pairs}""",
    "v_dense": """SELECT DISTINCT pa.p_brand AS project_id, a.l_partkey AS source_module_id, b.l_partkey AS target_module_id
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_quantity > b.l_quantity AND a.l_partkey <> b.l_partkey
        JOIN {part} pa ON pa.p_partkey = a.l_partkey JOIN {part} pb ON pb.p_partkey = b.l_partkey AND pa.p_brand = pb.p_brand""",
    "v_warnings": """SELECT l_partkey AS module_id, concat('RULE_', l_linestatus) AS code, concat('line ', CAST(l_linenumber AS STRING)) AS message,
        CASE l_returnflag WHEN 'R' THEN 'risk' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity, CAST(l_linenumber AS INT) AS line, l_orderkey * 100 + l_linenumber AS ord FROM {lineitem}""",
    "v_symbols": """SELECT l_partkey AS module_id, concat('fn_', CAST(l_suppkey AS STRING)) AS name, CASE WHEN l_linenumber = 1 THEN 'class' WHEN l_linenumber = 7 THEN 'variable' ELSE 'function' END AS kind,
        CAST(l_quantity AS INT) AS complexity, l_orderkey * 100 + l_linenumber AS ord, l_suppkey % 4 = 0 AS is_async FROM {lineitem}""",
    "v_jobs": """SELECT o_orderkey AS job_id, o_custkey AS project_id, o_orderpriority AS source_type, CAST(o_orderdate AS DATE) AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'analyzing' END AS state FROM {orders}""",
    "v_archive": """SELECT l_orderkey AS archive_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq,
        concat(CASE l_partkey % 37 WHEN 1 THEN '../' WHEN 2 THEN '/etc/' WHEN 3 THEN 'C:/' ELSE '' END, 'f', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 23 = 0 THEN '/../../../x' ELSE '.py' END) AS filename,
        CAST(CASE WHEN l_suppkey % 41 = 0 THEN 1 ELSE 0 END AS INT) AS flag_bits, CAST(floor(l_extendedprice) AS BIGINT) AS file_size, CAST(floor(l_quantity) AS BIGINT) AS compress_size,
        CAST(CASE l_partkey % 29 WHEN 4 THEN 2716663808 WHEN 5 THEN 275513344 ELSE 2175008768 END AS BIGINT) AS external_attr FROM {lineitem}""",
    "v_coverage": """SELECT event_type AS project_id, concat(event_type, '/m', CAST(user_id % 50 AS STRING), '.py') AS path, CAST(event_id % 100 AS INT) AS covered, 100 AS statements FROM {events}""",
    "v_imports": """SELECT doc_id AS module_id, source AS project_id, lang, CASE lang WHEN 'en' THEN concat('en.doc_', CAST((doc_id * 7) % 1000 AS STRING)) WHEN 'fr' THEN concat('./doc_', CAST((doc_id * 7) % 1000 AS STRING)) WHEN 'de' THEN concat('../de/doc_', CAST((doc_id * 7) % 1000 AS STRING)) ELSE CASE WHEN doc_id % 2 = 0 THEN 'os.path' ELSE '' END END AS module_name, CAST(doc_id % 50 AS INT) AS source_line FROM {documents}""",
    "v_tests": """SELECT project_id, module_id AS test_id, relative_path AS target_relative_path, concat('tests/test_', CAST(module_id AS STRING), '.py') AS safe_test_path, CASE WHEN language = 'python' THEN 'pytest' ELSE 'jest' END AS framework,
        complexity % 4 <> 0 AS syntax_valid, complexity % 7 <> 0 AS download_eligible, complexity AS test_count, CASE complexity % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not_run' END AS execution_status, CAST(complexity % 3 AS INT) AS iteration,
        CASE WHEN complexity % 6 = 0 THEN NULL ELSE CAST(complexity * 2 AS DOUBLE) END AS line_coverage FROM {v_modules} WHERE module_id % 3 = 0""",
    "v_lines": """SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS line_no,
        CASE CAST(l_partkey % 17 AS INT) WHEN 0 THEN 'import imp' WHEN 1 THEN 'from os import *' WHEN 2 THEN concat('for i in xrange(', CAST(l_suppkey AS STRING), '):')
        WHEN 3 THEN concat('    print "', l_returnflag, '"') WHEN 4 THEN 'except ValueError, exc:' WHEN 5 THEN '    except:' WHEN 6 THEN 'x = d.iteritems()'
        WHEN 7 THEN concat('y = raw_input("', CAST(l_suppkey AS STRING), '")') WHEN 8 THEN concat('var a', CAST(l_suppkey AS STRING), ' = b == ', CAST(l_suppkey AS STRING), ';')
        WHEN 9 THEN concat('const m', CAST(l_suppkey AS STRING), ' = require(', chr(39), './m', CAST(l_suppkey AS STRING), chr(39), ');') WHEN 10 THEN concat('module.exports = {{ a', CAST(l_suppkey AS STRING), ' }};')
        WHEN 11 THEN 'z = d.iterkeys()' WHEN 12 THEN 'z = d.itervalues ()' WHEN 13 THEN 'if isinstance(s, basestring): s = unicode(s)' WHEN 14 THEN 'def g(a, b=[], c=1):' WHEN 15 THEN 'exports.q = 1;'
        ELSE concat('function f', CAST(l_suppkey AS STRING), '(cb) {{ eval("', CAST(l_suppkey AS STRING), '"); }}') END AS line FROM {lineitem}""",
    "v_scripts": """SELECT file_id, seq, kind, n, replace(replace(replace(replace(CASE kind
          WHEN 0 THEN 'class K@ extends B {{~  constructor(a, b = 2) {{~    super(a);~  }}~  async run(cb) {{ if (cb && a) {{ return go@(cb); }} }}~  get v() {{~    return 1;~  }}~}}'
          WHEN 1 THEN 'const t@ = `import q from "zzz"~function no() {{}} §{{pick@(1)}}`;~import a from "m@"; import {{b}} from ^./b@^;'
          WHEN 2 THEN 'export {{~  a@,~  c as d@~}};~// import x from "no"~/* eval(1)~*/ export * from "all@";'
          WHEN 3 THEN 'const f@ = async (x, {{y}} = {{}}) => {{~  do {{ x ? h@(x) : y; }} while (x);~}};~module.exports = {{ run(cb) {{ return f@(cb); }} }};'
          WHEN 4 THEN 'const r@ = /["^`{{]/g.test(s), k@ = 4 / 2 / n;~export default function () {{~  switch (k) {{ case 1: one@(); break; default: }}~}}'
          ELSE 'function g@(a, cb) {{~  try {{ a(); }} catch (e) {{ for (const i of a) {{ while (i || cb) {{ w@(i); }} }} }}~  function inner@() {{}}~}}~exports.g@ = g@;' END,
        '@', CAST(n AS STRING)), '~', chr(10)), '^', chr(39)), '§', '$') AS content
        FROM (SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq, CAST(l_partkey % 6 AS INT) AS kind, l_suppkey AS n FROM {lineitem})""",
    "v_code": """SELECT concat('p', CAST(block % 25 AS STRING)) AS project_id, concat('pkg/mod_', CAST(block AS STRING), CASE WHEN block % 2 = 0 THEN '.py' ELSE '.js' END) AS relative_path, block, CAST(block % 2 AS INT) AS script, seq, kind, m,
        replace(replace(replace(CASE WHEN block % 2 = 0 THEN CASE kind WHEN 0 THEN 'from pkg.mod_# import f_@' WHEN 1 THEN 'def f_@(a, b=1):~    return a + b' WHEN 2 THEN 'x_@ = g(@)' WHEN 3 THEN 'class K_@:~    def m(self): return @' WHEN 4 THEN 'def h_@(a, b=[]):~    return eval(a)'
            WHEN 5 THEN 'try:~    h(@)~except:~    pass' WHEN 6 THEN 'd = {{}}~for k in xrange(@): d.iteritems()' ELSE 'import imp as imp_@' END
          ELSE CASE kind WHEN 0 THEN 'import {{ a_@ }} from "./mod_#.js";' WHEN 1 THEN 'function f_@(cb) {{~  if (cb == null) {{ return g(@); }}~}}' WHEN 2 THEN 'var v_@ = require("./mod_#");' WHEN 3 THEN 'class C_@ {{~  m(a) {{ return a || @; }}~}}' WHEN 4 THEN 'const a_@ = (x) => x ? @ : 0;'
            WHEN 5 THEN 'exports.x_@ = eval("@");' WHEN 6 THEN 'let s_@ = `import q from "z"`;' ELSE 'module.exports = {{ q: @ }};' END END,
        '@', CAST(n AS STRING)), '#', CAST(m AS STRING)), '~', chr(10)) AS piece
        FROM (SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq, CAST(l_partkey % 8 AS INT) AS kind, l_suppkey AS n, CAST(l_partkey % 200 AS BIGINT) AS m
          FROM (SELECT *, CAST(floor(l_orderkey / 50) AS BIGINT) AS block FROM {lineitem}))""",
    "v_urls": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://github.com/owner', CAST(page_id % 7 AS STRING), '/repo-', CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END) WHEN page_id % 31 = 1 THEN concat('https://user:pw@github.com/a/b', CAST(page_id AS STRING)) ELSE url END AS url FROM {pages}""",
}

#: Views that join a table with itself: the table, and the column that must be equal.
SELF_JOINS = {"v_pairs": ("lineitem", "l_orderkey"), "v_dense": ("lineitem", "l_orderkey")}
#: Rows of such a table that one task takes, about. Some ten pairs come of a row, and a task holds its different ones.
JOINED_ROWS = 1 << 17


def _needs(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or view as a DataFrame."""
    ship(spark)
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {n: frame(spark, sf_dir, n) for n in dict.fromkeys(_needs(VIEWS[name]))}
    if name in SELF_JOINS:
        table, column = SELF_JOINS[name]
        tables[table] = dealt(tables[table], JOINED_ROWS, column)
    return spark.sql(VIEWS[name], **tables)


def oracle(sql: str, *more: str) -> str:
    """The SQL with the views that it uses in front."""
    out: dict[str, str] = {}

    def add(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if n in VIEWS and n not in out:
                add(VIEWS[n])
                out[n] = VIEWS[n].format(**{x: x for x in _needs(VIEWS[n])}).replace("AS STRING)", "AS VARCHAR)")

    add(sql)
    for text in more:
        add(text)
    head, recursive = ", ".join(f"{n} AS ({text})" for n, text in out.items()), "WITH RECURSIVE "
    if not head:
        return sql
    if sql.lstrip().upper().startswith(recursive):
        return f"{recursive}{head}, {sql.lstrip()[len(recursive):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {sql.lstrip()[5:]}"
    return f"WITH {head} {sql}"
