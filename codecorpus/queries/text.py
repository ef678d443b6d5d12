"""Rewrites, warnings and facts over generated source lines."""

from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators import deps, facts
from codecorpus.operators import text as op
from codecorpus.queries.register import adder

ALL: dict = {}
add = adder(ALL)

CODE = "SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM v_lines GROUP BY file_id"


def code(lines):
    """One text for each file."""
    return lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))


def _duck(pattern: str) -> str:
    return pattern.replace("(?md)", "(?m)").replace("'", "''")


def _duck_to(r: op.Rewrite) -> str:
    return r.replacement.replace("$1", "\\1").replace("$2", "\\2")


#: What the oracle expects of each rule: pattern, replacement, change, whether it has a singular, warning. Written out, so that a wrong rule shows.
EXPECTED = (
    ("r1_py2_xrange", "\\bxrange\\s*\\(", "range(", "Replaced Python 2 xrange with range.", True, "Replaced Python 2 xrange with range."),
    ("r2_py2_iteritems", "\\.iteritems\\s*\\(", ".items(", "Replaced iteritems with items.", True, "Replaced iteritems with items. Review behavior before merging."),
    ("r3_py2_iterkeys", "\\.iterkeys\\s*\\(", ".keys(", "Replaced iterkeys with keys.", True, "Replaced iterkeys with keys. Review behavior before merging."),
    ("r4_py2_itervalues", "\\.itervalues\\s*\\(", ".values(", "Replaced itervalues with values.", True, "Replaced itervalues with values. Review behavior before merging."),
    ("r5_py2_raw_input", "\\braw_input\\s*\\(", "input(", "Replaced raw_input with input.", True, "Replaced raw_input with input. Review behavior before merging."),
    ("r6_py2_basestring", "\\bbasestring\\b", "str", "Replaced basestring with str.", True, "Replaced basestring with str. Review behavior before merging."),
    ("r7_py2_unicode", "\\bunicode\\s*\\(", "str(", "Replaced unicode constructor with str.", True, "Replaced unicode constructor with str. Review behavior before merging."),
    ("r8_py2_print", '(?m)^( *)print +("[^\\n]*)$', "\\1print(\\2)", "Converted Python 2 print statements to print calls.", False, "Converted print statement syntax."),
    ("r9_py2_except", "(?m)^( *except [^:\\n,]+), *([A-Za-z_]\\w*):", "\\1 as \\2:", "Converted legacy exception binding syntax.", False, "Converted exception binding to ''as'' syntax."),
    ("r10_js_var_declaration", "(?m)^( *)var +", "\\1let ", "Replaced function-scoped var with block-scoped let.", True, "Replaced function-scoped var with block-scoped let. Review behavior before merging."),
)
for (_name, _pattern, _to, _change, _singular, _warning), _r in zip(EXPECTED, [*op.PYTHON_REWRITES, op.JAVASCRIPT_REWRITES[0]], strict=True):
    add(
        _name, "v_lines",
        lambda v, r=_r: op.rewrite(code(v), (r,)).where("changed").select("file_id", F.md5("modern").alias("digest"), F.col("changes")[0].alias("change"), F.col("warnings")[0]["line"].alias("line"), F.col("warnings")[0]["message"].alias("warning")),
        f"""WITH c AS ({CODE}), n AS (SELECT *, len(regexp_extract_all(text, '{_pattern}')) AS n FROM c),
        f AS (SELECT file_id, min(line_no) AS line FROM v_lines WHERE regexp_matches(line, '{_pattern}') GROUP BY file_id)
        SELECT file_id, md5(regexp_replace(text, '{_pattern}', '{_to}', 'g')) AS digest, concat('{_change} (', n, CASE WHEN n = 1 AND {_singular} THEN ' occurrence)' ELSE ' occurrences)' END) AS change, CAST(line AS INT) AS line, '{_warning}' AS warning FROM n JOIN f USING (file_id) WHERE n > 0""",
    )

_ALL_PYTHON = "text"
for _, _pattern, _to, *_ in EXPECTED[:-1]:
    _ALL_PYTHON = f"regexp_replace({_ALL_PYTHON}, '{_pattern}', '{_to}', 'g')"
add("r13_r14_rewrite", "v_lines", lambda v: op.rewrite(code(v), op.PYTHON_REWRITES).select("file_id", F.md5("modern").alias("digest"), "changed"), f"WITH c AS ({CODE}) SELECT file_id, md5({_ALL_PYTHON}) AS digest, {_ALL_PYTHON} <> text AS changed FROM c")
def _unequal(v):
    """Every second line with != for its ==, and one strict comparison that stays."""
    line = F.when(F.col("line_no") % 2 == 0, F.replace("line", F.lit(" == "), F.lit(" != "))).otherwise(F.col("line"))
    return v.select("file_id", "line_no", F.concat(line, F.lit(" a === b !== c")).alias("content"))


add(
    "r11_r12_strict_equality", "v_lines", lambda v: op.rewrite(_unequal(v), op.JAVASCRIPT_REWRITES).where("changed").select("file_id", "line_no", F.array_join("changes", " ").alias("changes"), "modern"),
    """SELECT file_id, line_no, concat('Replaced function-scoped var with block-scoped let. (1 occurrence) Replaced loose ', CASE WHEN line_no % 2 = 0 THEN 'inequality with strict inequality' ELSE 'equality with strict equality' END, '. (1 occurrence)') AS changes,
    concat('let ', replace(substr(line, 5), ' == ', CASE WHEN line_no % 2 = 0 THEN ' !== ' ELSE ' === ' END), ' a === b !== c') AS modern FROM v_lines WHERE starts_with(line, 'var ')""",
)
#: Which of v_lines are Python by themselves once they are rewritten; written out for the oracle.
VALID = "NOT (starts_with(line, 'for ') OR starts_with(line, ' ') OR starts_with(line, 'except') OR starts_with(line, 'var ') OR starts_with(line, 'const ') OR starts_with(line, 'def ') OR starts_with(line, 'function '))"


def by_line(lines):
    """Each line as a text of its own."""
    return lines.withColumnRenamed("line", "content")


def _open(lines):
    """JavaScript of which some texts have an open bracket."""
    return code(lines).withColumn("content", F.replace("content", F.lit("exports.q = 1;"), F.lit("exports.q = (1;")))


def _gated(v):
    """Lines recur, so each different one is rewritten and judged once, and counts as often as it stands."""
    lines = by_line(v).groupBy("content").agg(F.count(F.lit(1)).alias("times"))
    python = op.syntax_gate(op.rewrite(lines, op.PYTHON_REWRITES)).select(F.lit("python").alias("language"), "syntax_valid", "warnings", "times")
    script = op.syntax_gate(op.rewrite(_open(v), op.JAVASCRIPT_REWRITES[:1]), "javascript").select(F.lit("javascript").alias("language"), "syntax_valid", "warnings", F.lit(1).cast("long").alias("times"))
    return python.unionByName(script).groupBy("language", "syntax_valid").agg(F.sum("times").alias("n"), F.sum(F.size("warnings") * F.col("times")).alias("warnings"))


def _sum(*conditions):
    return "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in conditions) + ")"


_BREAK = ("contains(line, 'iteritems')", "contains(line, 'iterkeys')", "contains(line, 'itervalues')", "contains(line, 'raw_input')", "contains(line, 'basestring')", "contains(line, 'unicode(')")
_HITS = _sum("contains(line, 'xrange')", *_BREAK, "contains(line, 'print ')", "contains(line, ', exc:')")
add(
    "r15_syntax_gate", "v_lines", _gated,
    f"""WITH c AS ({CODE}), p AS (SELECT 'python' AS language, {VALID} AS syntax_valid, {_HITS} + {_sum(f'NOT ({VALID})')} AS warnings FROM v_lines),
    j AS (SELECT 'javascript' AS language, NOT contains(text, 'exports.q') AS syntax_valid, {_sum("regexp_matches(text, '(?m)^var ')", "contains(text, 'exports.q')")} AS warnings FROM c)
    SELECT language, syntax_valid, count(*) AS n, CAST(sum(warnings) AS BIGINT) AS warnings FROM (SELECT * FROM p UNION ALL SELECT * FROM j) GROUP BY 1, 2""",
)
add(
    "r16_line_diff", "v_lines", lambda v: op.line_diff(op.rewrite(code(v), op.PYTHON_REWRITES), ["file_id"]).select("file_id", "line_no", "op", F.col("before").alias("was"), F.col("after").alias("now")),
    f"SELECT file_id, CAST(line_no AS INT) AS line_no, 'changed' AS op, text AS was, {_ALL_PYTHON} AS now FROM (SELECT file_id, line_no, line AS text FROM v_lines) WHERE {_ALL_PYTHON} <> text",
)
add(
    "a12_rewrite_rollup", "v_lines", lambda v: op.rewrite_rollup(op.syntax_gate(op.rewrite(by_line(v), op.PYTHON_REWRITES)), ["file_id"]),
    f"WITH r AS (SELECT file_id, {_HITS} AS hits, {_sum(*_BREAK, f'NOT ({VALID})')} AS breaking FROM v_lines) SELECT file_id, count(*) AS analyzed, count(*) FILTER (hits > 0) AS changed, CAST(sum(hits) AS BIGINT) AS rule_groups, CAST(sum(breaking) AS BIGINT) AS breaking, count(*) FILTER (hits > 0) > 0 AND sum(breaking) = 0 AS safe FROM r GROUP BY 1",
)
add("k5_rewrite_bundle", "v_lines", lambda v: op.rewrite_bundle(op.syntax_gate(op.rewrite(by_line(v), op.PYTHON_REWRITES))).select("file_id", "line_no", "modern"), f"SELECT file_id, line_no, {_ALL_PYTHON} AS modern FROM (SELECT *, line AS text FROM v_lines) WHERE {_HITS} > 0 AND {VALID}")


def _review():
    """Rows of both kinds of each rule, and of the gate."""
    for name, pattern, _, change, singular, warning in EXPECTED[:-1]:
        yield f"SELECT file_id, line_no, 'change' AS kind, '{change} (1 {'occurrence' if singular else 'occurrences'})' AS line FROM v_lines WHERE regexp_matches(line, '{pattern}')"
        yield f"SELECT file_id, line_no, 'warning', '{name.split('_', 1)[1].upper()}: {warning}' FROM v_lines WHERE regexp_matches(line, '{pattern}')"
    yield f"SELECT file_id, line_no, 'warning', 'SYNTAX_REVIEW_REQUIRED: The proposal did not pass static syntax validation; do not apply it automatically.' FROM v_lines WHERE {_HITS} > 0 AND NOT ({VALID})"


add("k5_review_lines", "v_lines", lambda v: op.review_lines(op.syntax_gate(op.rewrite(by_line(v), op.PYTHON_REWRITES)), ["file_id", "line_no"]), " UNION ALL ".join(_review()))
add("p8_changed_files", "v_lines", lambda v: op.changed_files(op.rewrite(code(v), op.PYTHON_REWRITES)).select("file_id"), f"WITH c AS ({CODE}) SELECT file_id FROM c WHERE {_ALL_PYTHON} <> text")
add("p11_rewritable_files", "v_files", lambda f: f.select("doc_id", s.classify_language(F.col("relative_path")).alias("language")).where(F.col("language").isin("python", "javascript", "typescript")), "SELECT doc_id, CASE WHEN relative_path LIKE '%.py' THEN 'python' WHEN relative_path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language FROM v_files WHERE relative_path LIKE '%.py' OR relative_path LIKE '%.js' OR relative_path LIKE '%.ts'")
add("lines_frame", "v_files", lambda f: op.lines(f, ["doc_id"]).select("doc_id", "line_no", F.md5("line").alias("digest")), "SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INT) AS line_no, md5(unnest(l[:n])) AS digest FROM (SELECT doc_id, string_split(content, chr(10)) AS l, len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) OR content = '' THEN 1 ELSE 0 END AS n FROM v_files)")
#: What the oracle expects of each warning rule: language, code, severity, pattern, message ({} is the pattern's group), unless. Written out, so that a wrong rule shows.
EXPECTED_WARNINGS = (
    ("python", "DEPRECATED_MODULE", "warning", "^\\s*(?:import|from)\\s+(imp|optparse|cgi|asyncore|smtpd|nntplib|telnetlib|pipes|audioop|formatter|spwd|aifc|sunau)\\b", "Use of deprecated Python module '{}'.", None),
    ("python", "WILDCARD_IMPORT", "warning", "^\\s*from\\s+(\\S+)\\s+import\\s+[*]", "Wildcard import 'from {} import *' hampers static analysis.", None),
    ("python", "EVAL_EXEC_USAGE", "risk", "(?:^|[^.\\w])(eval|exec)\\s*[(]", "Use of '{}()' presents severe security and static-analysis risks.", None),
    ("python", "LEGACY_PYTHON2_CONSTRUCT", "warning", "(?:\\b|[.])(xrange|raw_input|iteritems|iterkeys|itervalues)\\s*[(]", "Use of Python 2 built-in '{}'. Replace with Python 3 equivalent.", None),
    ("python", "LEGACY_PYTHON2_PRINT", "warning", "^\\s*print\\s+[\"']", "Python 2 print statement without parentheses.", None),
    ("python", "BARE_EXCEPT", "warning", "^\\s*except\\s*:", "Bare 'except:' handler catches SystemExit and KeyboardInterrupt. Use 'except Exception:'.", None),
    ("python", "MUTABLE_DEFAULT_ARG", "warning", "\\bdef\\s+\\w+\\s*[(][^)]*\\b(\\w+)\\s*=\\s*[{\\[]", "Parameter '{}' has a mutable default argument.", None),
    ("javascript", "VAR_USAGE", "warning", "^var\\s", "Use of 'var' keyword. Prefer block-scoped 'const' or 'let'.", None),
    ("javascript", "COMMONJS_USAGE", "info", "^\\s*(?:const|let|var)\\s+[^=]+=\\s*require[(]['\"]([^'\"]*)", "Use of CommonJS require('{}'). Prefer ES module import syntax.", None),
    ("javascript", "COMMONJS_EXPORTS", "info", "module[.]exports|^exports[.]", "Use of CommonJS module.exports assignment. Prefer ES module export syntax.", None),
    ("javascript", "CALLBACK_HEAVY", "warning", "[(](?:[^()]*[,\\s])?(cb|callback|next|done)\\s*(?:,[^()]*)?[)]\\s*(?:=>|[{])", "Parameter '{}': callback pattern instead of Async/Await or Promises.", None),
    ("javascript", "LOOSE_EQUALITY", "warning", " [=!]= ", "Loose equality operator ('==' or '!=') used. Prefer strict ('===' or '!==').", " [=!]== "),
    ("javascript", "EVAL_EXEC_USAGE", "risk", "(?:^|[^.\\w])(eval|Function)\\s*[(]", "Use of '{}()' presents severe security and static-analysis risks.", None),
)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
for _lang, _code, _severity, _pattern, _message, _unless in EXPECTED_WARNINGS:
    _rules = tuple(w for w in op.WARNINGS if (w.language, w.code) == (_lang, _code))
    _before, _named, _behind = _message.partition("{}")
    _text = f"concat({_quoted(_before)}, regexp_extract(line, {_quoted(_pattern)}, 1), {_quoted(_behind)})" if _named else _quoted(_message)
    add(
        f"l_{_lang[:2]}_{_code.lower()}", "v_lines", lambda v, rules=_rules: op.scan_warnings(v, ["file_id"], rules).withColumn("line_no", F.col("line_no").cast("long")),
        f"SELECT file_id, line_no, '{_code}' AS code, '{_severity}' AS severity, {_text} AS message FROM v_lines WHERE regexp_matches(line, {_quoted(_pattern)})" + (f" AND NOT regexp_matches(line, {_quoted(_unless)})" if _unless else ""),
    )
add("l8_high_complexity", "v_symbols", lambda y: facts.complexity_warnings(y.withColumn("start_line", (F.col("ord") % 90).cast("int")), ["module_id", "ord"]), "SELECT module_id, ord, 'HIGH_COMPLEXITY' AS code, concat('Function ', chr(39), name, chr(39), ' has high cyclomatic complexity (', complexity, ').') AS message, CAST(ord % 90 AS INT) AS line, 'warning' AS severity FROM v_symbols WHERE complexity > 10 AND kind = 'function'")
add("l9_syntax_error", "v_lines", lambda v: facts.syntax_warnings(facts.python_facts(by_line(v), ["file_id", "line_no"], errors_only=True), ["file_id", "line_no"]), f"SELECT file_id, line_no, 'SYNTAX_ERROR' AS code, 'Python parser could not fully parse this file.' AS message, CAST(1 AS INT) AS line, 'risk' AS severity FROM v_lines WHERE NOT ({VALID})")
add("w2_dedup_warnings", "v_warnings", lambda w: op.dedup_warnings(w, ["module_id"]), "SELECT module_id, code, line, message, arg_max(severity, (ord, severity)) AS severity FROM v_warnings GROUP BY ALL")
add("x1_python_imports", "v_lines", lambda v: facts.python_imports(v, ["file_id"]).select("file_id", "module_name", F.array_join("imported_symbols", ",").alias("symbols"), "is_relative", F.col("source_line").cast("long").alias("source_line")), "SELECT file_id, CASE WHEN line = 'import imp' THEN 'imp' ELSE 'os' END AS module_name, CASE WHEN line = 'import imp' THEN 'imp' ELSE '*' END AS symbols, false AS is_relative, line_no AS source_line FROM v_lines WHERE line IN ('import imp', 'from os import *')")
def _modules(v):
    """Requires as they stand; each wildcard import as an import of two lines, each print as one of a default and names."""
    two = v.where("line = 'from os import *'").select("file_id", F.explode(F.array(F.struct((F.col("line_no") * 10).alias("line_no"), F.lit("import {a,").alias("line")), F.struct((F.col("line_no") * 10 + 1).alias("line_no"), F.lit("  b} from '../os.js';").alias("line")))).alias("x")).select("file_id", "x.*")
    one = v.select("file_id", (F.col("line_no") * 10).alias("line_no"), F.when(F.col("line").startswith("    print"), "import D, { e as f } from \"pkg\";").otherwise(F.col("line")).alias("line")).where("line <> 'from os import *'")
    return one.unionByName(two)


add(
    "x2_javascript_imports", "v_lines", lambda v: facts.javascript_imports(_modules(v), ["file_id"]).withColumn("imported_symbols", F.array_join("imported_symbols", "|")),
    """SELECT file_id, regexp_extract(line, '\\./m[0-9]+') AS module_name, 'require' AS import_kind, regexp_extract(line, '^const (\\w+)', 1) AS imported_symbols, line_no * 10 AS source_line, true AS is_relative FROM v_lines WHERE starts_with(line, 'const m')
    UNION ALL SELECT file_id, '../os.js', 'import', '{a, b}', line_no * 10, true FROM v_lines WHERE line = 'from os import *'
    UNION ALL SELECT file_id, 'pkg', 'import', 'D, { e as f }', line_no * 10, false FROM v_lines WHERE starts_with(line, '    print')""",
)
add("x4_javascript_symbols", "v_lines", lambda v: facts.javascript_symbols(v, ["file_id"]).select("file_id", "kind", "name", F.col("start_line").cast("long").alias("start_line")), "SELECT file_id, CASE WHEN starts_with(line, 'function') THEN 'function' ELSE 'variable' END AS kind, regexp_extract(line, '^(?:function|var|const) (\\w+)', 1) AS name, line_no AS start_line FROM v_lines WHERE regexp_matches(line, '^(function|var|const) ')")
add("x3_python_symbols", "v_lines", lambda v: facts.python_symbols(v, ["file_id"]).select("file_id", "kind", "name", F.col("start_line").cast("long").alias("start_line")), "SELECT file_id, CASE WHEN starts_with(line, 'def') THEN 'function' ELSE 'variable' END AS kind, CASE WHEN starts_with(line, 'def') THEN 'g' ELSE left(line, 1) END AS name, line_no AS start_line FROM v_lines WHERE regexp_matches(line, '^[xyz] = |^def ')")
def _exporting(v):
    """Definitions as exported classes, imports as a clause of names, jumps as a re-export."""
    line = F.col("line")
    return v.withColumn("line", F.when(line.startswith("def "), "export default class G {}").when(line == "import imp", "export { a, b as c };").when(line == "    except:", "export * from './x';").when(line.startswith("function "), F.concat(F.lit("export async "), "line")).otherwise(line))


add(
    "x5_exports", "v_lines", lambda v: facts.javascript_exports(_exporting(v), ["file_id"]).withColumn("source_line", F.col("source_line").cast("long")),
    """SELECT file_id, 'q' AS name, 'variable' AS kind, line_no AS source_line FROM v_lines WHERE starts_with(line, 'exports')
    UNION ALL SELECT file_id, 'default', 'default', line_no FROM v_lines WHERE starts_with(line, 'module.exports')
    UNION ALL SELECT file_id, 'G', 'class', line_no FROM v_lines WHERE starts_with(line, 'def ')
    UNION ALL SELECT file_id, unnest(['a', 'c']), 'variable', line_no FROM v_lines WHERE line = 'import imp'
    UNION ALL SELECT file_id, '*', 'all', line_no FROM v_lines WHERE line = '    except:'
    UNION ALL SELECT file_id, regexp_extract(line, '^function (\\w+)', 1), 'function', line_no FROM v_lines WHERE starts_with(line, 'function ')""",
)
add("x6_calls", "v_lines", lambda v: facts.calls(v, ["file_id"]).select("file_id", "target_name", F.col("source_line").cast("long").alias("source_line")), "SELECT file_id, unnest(CASE WHEN line LIKE 'for i%' THEN ['xrange'] WHEN line LIKE '%iteritems%' THEN ['d.iteritems'] WHEN line LIKE '%iterkeys%' THEN ['d.iterkeys'] WHEN line LIKE '%itervalues%' THEN ['d.itervalues'] WHEN line LIKE '%raw_input%' THEN ['raw_input'] WHEN line LIKE '%require%' THEN ['require'] WHEN line LIKE '%isinstance%' THEN ['isinstance', 'unicode'] WHEN line LIKE 'function%' THEN ['eval'] ELSE [] END) AS target_name, line_no AS source_line FROM v_lines")
add("x7_parameters", "v_lines", lambda v: facts.signatures(v, ["file_id"]).select("file_id", "name", F.col("line_no").cast("long").alias("line_no"), F.col("parameters")[0]["name"].alias("first")), "SELECT file_id, regexp_extract(line, '^(?:function|def) (\\w+)', 1) AS name, line_no, CASE WHEN starts_with(line, 'def') THEN 'a' ELSE 'cb' END AS first FROM v_lines WHERE regexp_matches(line, '^(function|def) ')")
add("x8_entry_points", "v_lines", lambda v: facts.entry_points(v.withColumn("relative_path", F.when(F.col("file_id") % 7 == 0, "src/Index.js").otherwise("a.py")), ["file_id"]), "SELECT file_id, file_id % 7 = 0 AS is_entry_point FROM v_lines GROUP BY file_id")
add("x9_decision_points", "v_lines", lambda v: v.groupBy("file_id").agg(F.sum(facts.decision_points(F.col("line"))).alias("points")), "SELECT file_id, CAST(sum(CASE WHEN line LIKE 'for i%' OR line LIKE 'except V%' OR line = '    except:' OR line LIKE 'if %' THEN 1 ELSE 0 END) AS BIGINT) AS points FROM v_lines GROUP BY file_id")
#: Facts of each kind of script; @ is its number. Written out for the oracle.
_SCRIPTS = {
    "imports": "(1, 'm@', 'import', 'a', 3), (1, './b@', 'import', '{b}', 3), (2, 'all@', 'import', '*', 7)",
    "symbols": """(0, 'class', 'K@', 1, 9, false, 0), (0, 'constructor', 'K@.constructor', 2, 4, false, 1), (0, 'method', 'K@.run', 5, 5, true, 1), (0, 'method', 'K@.v', 6, 8, false, 1), (1, 'variable', 't@', 1, 2, false, 0), (3, 'function', 'f@', 1, 3, true, 0),
      (4, 'variable', 'r@', 1, 1, false, 0), (4, 'variable', 'k@', 1, 1, false, 0), (5, 'function', 'g@', 1, 4, false, 0), (5, 'function', 'inner@', 3, 3, false, 1)""",
    "exports": "(0, 'K@', 'class', 1), (2, 'a@', 'variable', 1), (2, 'd@', 'variable', 1), (2, '*', 'all', 7), (3, 'default', 'default', 4), (4, 'default', 'default', 2), (5, 'g@', 'function', 1), (5, 'g@', 'variable', 5)",
    "calls": "(0, 'K@.run', 'go@', 5), (1, '', 'pick@', 2), (3, 'f@', 'h@', 2), (3, '', 'f@', 4), (4, '', 'test', 1), (4, '', 'one@', 3), (5, 'g@', 'a', 2), (5, 'g@', 'w@', 2)",
    "parameters": "(0, 'K@.constructor', 'a|b=2'), (0, 'K@.run', 'cb'), (0, 'K@.v', ''), (3, 'f@', 'x|{y}={}'), (5, 'g@', 'a|cb'), (5, 'inner@', '')",
    "complexity": "(0, 'K@.constructor', 1), (0, 'K@.run', 3), (0, 'K@.v', 1), (3, 'f@', 3), (5, 'g@', 5), (5, 'inner@', 1)",
}


def _script_sql(name: str, columns: dict[str, str]) -> str:
    shown = ", ".join(f"replace({c}, '@', CAST(n AS VARCHAR)) AS {c}" if kind == "text" else f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
    return f"SELECT file_id, seq, {shown} FROM v_scripts s JOIN (VALUES {_SCRIPTS[name]}) AS f(k, {', '.join(columns)}) ON f.k = s.kind"


_KEYS = ["file_id", "seq"]
_own = lambda v: facts.javascript_symbols(v, _KEYS)
add("x2_javascript_statements", "v_scripts", lambda v: facts.javascript_imports(v, _KEYS).select(*_KEYS, "module_name", "import_kind", F.array_join("imported_symbols", ",").alias("symbols"), "source_line"), _script_sql("imports", {"module_name": "text", "import_kind": "text", "symbols": "text", "source_line": "BIGINT"}))
add("x4_javascript_members", "v_scripts", lambda v: _own(v).select(*_KEYS, "kind", "qualified_name", "start_line", "end_line", "is_async", "depth"), _script_sql("symbols", {"kind": "VARCHAR", "qualified_name": "text", "start_line": "BIGINT", "end_line": "BIGINT", "is_async": "BOOLEAN", "depth": "INT"}).replace("CAST(kind AS VARCHAR)", "f.kind"))
add("x5_javascript_clauses", "v_scripts", lambda v: facts.javascript_exports(v, _KEYS), _script_sql("exports", {"name": "text", "kind": "VARCHAR", "source_line": "BIGINT"}).replace("CAST(kind AS VARCHAR)", "f.kind"))
add("x6_javascript_calls", "v_scripts", lambda v: facts.javascript_calls(v, _KEYS), _script_sql("calls", {"caller": "text", "target_name": "text", "source_line": "BIGINT"}))
add("x7_javascript_parameters", "v_scripts", lambda v: _own(v).where("parameters is not null").select(*_KEYS, "qualified_name", F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit("="), p["default"]), F.lit("")))), "|").alias("parameters")), _script_sql("parameters", {"qualified_name": "text", "parameters": "text"}))
add("x9_javascript_complexity", "v_scripts", lambda v: _own(v).where("kind in ('function', 'method', 'constructor')").select(*_KEYS, "qualified_name", "complexity"), _script_sql("complexity", {"qualified_name": "text", "complexity": "INT"}))
#: What each kind of line holds by itself: by the syntax tree if it parses, else by its tokens. Written out for the oracle.
_FACTS = (
    ("line = 'import imp'", "('import', 'imp', 'imp'), ('warning', 'DEPRECATED_MODULE', 'imp')"),
    ("line = 'from os import *'", "('import', 'os', '*'), ('warning', 'WILDCARD_IMPORT', 'os')"),
    ("contains(line, 'iteritems')", "('call', 'd.iteritems', ''), ('warning', 'LEGACY_PYTHON2_CONSTRUCT', 'iteritems'), ('variable', 'x', ''), ('export', 'x', 'variable')"),
    ("contains(line, 'iterkeys')", "('call', 'd.iterkeys', ''), ('warning', 'LEGACY_PYTHON2_CONSTRUCT', 'iterkeys'), ('variable', 'z', ''), ('export', 'z', 'variable')"),
    ("contains(line, 'itervalues')", "('call', 'd.itervalues', ''), ('warning', 'LEGACY_PYTHON2_CONSTRUCT', 'itervalues'), ('variable', 'z', ''), ('export', 'z', 'variable')"),
    ("contains(line, 'raw_input')", "('call', 'raw_input', ''), ('warning', 'LEGACY_PYTHON2_CONSTRUCT', 'raw_input'), ('variable', 'y', ''), ('export', 'y', 'variable')"),
    ("contains(line, 'basestring')", "('call', 'isinstance', ''), ('call', 'unicode', '')"),
    ("starts_with(line, 'def ')", "('error', '', ''), ('function', 'g', '')"),
    ("contains(line, 'xrange')", "('error', '', ''), ('warning', 'LEGACY_PYTHON2_CONSTRUCT', 'xrange')"),
    ("starts_with(line, '    print')", "('error', '', ''), ('warning', 'LEGACY_PYTHON2_PRINT', 'print')"),
    ("starts_with(line, 'except') OR line = '    except:' OR starts_with(line, 'var ') OR starts_with(line, 'const ') OR starts_with(line, 'function ')", "('error', '', '')"),
)
add(
    "u1_python_facts", "v_lines", lambda v: facts.python_facts(by_line(v), ["file_id", "line_no"]).select("file_id", "line_no", "kind", F.when(F.col("kind") == "error", "").otherwise(F.col("name")).alias("name"), F.coalesce("detail", F.lit("")).alias("detail")),
    " UNION ALL ".join(f"SELECT file_id, line_no, f.kind, f.name, f.detail FROM v_lines, (VALUES {rows}) AS f(kind, name, detail) WHERE {where}" for where, rows in _FACTS),
)

# dependency resolution
_PATHS = {"en": "py", "fr": "js", "de": "ts"}


def _resolved(imports, language):
    own = imports.where(F.col("lang") == language).withColumns({"project_id": F.lit("all"), "relative_path": F.concat("lang", F.lit("/doc_"), "module_id", F.lit(f".{_PATHS[language]}")), "import_kind": F.lit("import")})
    modules = imports.where("lang in ('en', 'fr', 'de')").select(F.lit("all").alias("project_id"), "module_id", F.concat("lang", F.lit("/doc_"), "module_id", F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".js").otherwise(".ts")).alias("relative_path"))
    resolver = deps.resolve_python_imports if language == "en" else deps.resolve_javascript_imports
    return resolver(own, modules, ["module_id"])


def _sql(language):
    return f"SELECT a.module_id, a.module_name, b.module_id AS target_id FROM v_imports a LEFT JOIN v_imports b ON b.module_id = (a.module_id * 7) % 1000 AND b.lang = '{language}' WHERE a.lang = '{language}'"


add("j1_resolve_python_imports", "v_imports", lambda i: _resolved(i, "en").select("module_id", "module_name", "target_id"), _sql("en"))
add("j2_resolve_javascript_imports", "v_imports", lambda i: _resolved(i, "fr").unionByName(_resolved(i, "de")).select("module_id", "module_name", "target_id"), f"{_sql('fr')} UNION ALL {_sql('de')}")
add(
    "j3_build_edges", "v_imports",
    lambda i: deps.build_edges(_resolved(i, "en").unionByName(i.where("lang = 'es'").select("*", F.lit("").alias("relative_path"), F.lit("import").alias("import_kind"), F.lit(None).cast("long").alias("target_id")).withColumn("project_id", F.lit("all")), allowMissingColumns=True)).select("source_module_id", "target_module_id", "resolved", "edge_id"),
    """WITH r AS (SELECT a.module_id AS source_module_id, coalesce(CAST(b.module_id AS VARCHAR), a.module_name) AS target_module_id, b.module_id IS NOT NULL AS resolved, a.source_line FROM v_imports a LEFT JOIN v_imports b ON b.module_id = (a.module_id * 7) % 1000 AND b.lang = 'en' WHERE a.lang = 'en'
      UNION ALL SELECT module_id, CASE WHEN module_name = '' THEN 'external' ELSE 'os' END, false, source_line FROM v_imports WHERE lang = 'es')
    SELECT source_module_id, target_module_id, resolved, concat('edge_', left(sha256(concat(source_module_id, ':', target_module_id, ':import:', source_line)), 12)) AS edge_id FROM r""",
)
add("w1_dedup_edges", "v_edges", lambda e: deps.dedup_edges(e.unionByName(e)).select("source_module_id", "target_module_id", "type", "source_line"), "SELECT DISTINCT source_module_id, target_module_id, type, source_line FROM v_edges")
add("j4_split_external", "v_all_edges v_modules", lambda e, m: deps.split_external(e.withColumn("target_module_id", F.when(F.col("resolved"), F.col("target_module_id")).otherwise(-1 - F.col("target_module_id"))), m)[1].select("node_id"), "SELECT DISTINCT concat('ext:', -1 - target_module_id) AS node_id FROM v_all_edges WHERE NOT resolved")
add(
    "f16_brackets_balanced", "v_lines", lambda v: v.select("file_id", "line_no", s.brackets_balanced(F.replace("line", F.lit("exports.q = 1;"), F.lit("]exports.q = [1;"))).alias("balanced"), s.brackets_balanced_quoted(F.concat(F.replace("line", F.lit("('"), F.lit("(')', '")), F.lit(" \"((\" `]` '}'"), F.when(F.col("line").startswith("z "), "{").otherwise(""))).alias("quoted")),
    "SELECT file_id, line_no, NOT starts_with(line, 'exports') AS balanced, NOT starts_with(line, 'z ') AS quoted FROM v_lines",
)


def _documented(v):
    """Marks for imports, docstrings for jumps."""
    return v.withColumn("line", F.when(F.col("line") == "import imp", "@cached").when(F.col("line") == "    except:", '    """Does it."""').otherwise(F.col("line")))


add(
    "x10_docstrings", "v_lines", lambda v: facts.docstrings(_documented(v), ["file_id"]).select("file_id", F.col("line_no").cast("long").alias("line_no"), "name", "docstring", F.array_join("decorators", ",").alias("decorators")),
    """WITH n AS (SELECT *, lead(line) OVER w AS after, sum(CASE WHEN line = 'import imp' THEN 0 ELSE 1 END) OVER w AS run FROM v_lines WINDOW w AS (PARTITION BY file_id ORDER BY line_no)), m AS (SELECT file_id, run, string_agg('cached', ',') AS marks FROM n WHERE line = 'import imp' GROUP BY 1, 2)
    SELECT n.file_id, line_no, 'g' AS name, CASE WHEN after = '    except:' THEN 'Does it.' END AS docstring, coalesce(marks, '') AS decorators FROM n LEFT JOIN m ON m.file_id = n.file_id AND m.run = n.run - 1 WHERE starts_with(line, 'def ')""",
)
