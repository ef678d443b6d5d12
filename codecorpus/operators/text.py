"""Line-level rules over source texts: rewrites, warnings, line diffs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.operators.diff import line_differences
from codecorpus.operators.inventory import BREAKS
from codecorpus.shipping import uncollected


@dataclass(frozen=True)
class Rewrite:
    code: str
    pattern: str
    replacement: str
    message: str
    breaking: bool = False
    #: Statement forms have a warning text of their own, count in the plural and give the line of the original text.
    warning: str = ""


@dataclass(frozen=True)
class Warn:
    code: str
    severity: str
    pattern: str
    message: str
    language: str
    unless: str = ""


# -- fixed values --------------------------------------------------------------------------------------------------
PYTHON_REWRITES = (
    Rewrite("PY2_XRANGE", r"\bxrange\s*\(", "range(", "Replaced Python 2 xrange with range."),
    Rewrite("PY2_ITERITEMS", r"\.iteritems\s*\(", ".items(", "Replaced iteritems with items.", True),
    Rewrite("PY2_ITERKEYS", r"\.iterkeys\s*\(", ".keys(", "Replaced iterkeys with keys.", True),
    Rewrite("PY2_ITERVALUES", r"\.itervalues\s*\(", ".values(", "Replaced itervalues with values.", True),
    Rewrite("PY2_RAW_INPUT", r"\braw_input\s*\(", "input(", "Replaced raw_input with input.", True),
    Rewrite("PY2_BASESTRING", r"\bbasestring\b", "str", "Replaced basestring with str.", True),
    Rewrite("PY2_UNICODE", r"\bunicode\s*\(", "str(", "Replaced unicode constructor with str.", True),
    Rewrite("PY2_PRINT", r"(?md)^(\s*)print\s+([^>\n][^\n]*?)[ \t\r]*$", "$1print($2)", "Converted Python 2 print statements to print calls.", warning="Converted print statement syntax."),
    Rewrite("PY2_EXCEPT", r"(?md)^(\s*except\s+[^:\n,]+),\s*([A-Za-z_]\w*)\s*:", "$1 as $2:", "Converted legacy exception binding syntax.", warning="Converted exception binding to 'as' syntax."),
)
JAVASCRIPT_REWRITES = (
    Rewrite("JS_VAR_DECLARATION", r"(?md)^(\s*)var\s+", "$1let ", "Replaced function-scoped var with block-scoped let.", True),
    Rewrite("JS_STRICT_EQUALITY", r"(?<![=!])==(?!=)", "===", "Replaced loose equality with strict equality.", True),
    Rewrite("JS_STRICT_INEQUALITY", r"(?<![=!])!=(?!=)", "!==", "Replaced loose inequality with strict inequality.", True),
)
REVIEW = " Review behavior before merging."
SYNTAX_REVIEW = "The proposal did not pass static syntax validation; do not apply it automatically."
DEPRECATED_MODULES = ("imp", "optparse", "cgi", "asyncore", "smtpd", "nntplib", "telnetlib", "pipes", "audioop", "formatter", "spwd", "aifc", "sunau")
# {} in a message is what the pattern's group holds
WARNINGS = (
    Warn("DEPRECATED_MODULE", "warning", r"^\s*(?:import|from)\s+(" + "|".join(DEPRECATED_MODULES) + r")\b", "Use of deprecated Python module '{}'.", "python"),
    Warn("WILDCARD_IMPORT", "warning", r"^\s*from\s+(\S+)\s+import\s+\*", "Wildcard import 'from {} import *' hampers static analysis.", "python"),
    Warn("EVAL_EXEC_USAGE", "risk", r"(?:^|[^.\w])(eval|exec)\s*\(", "Use of '{}()' presents severe security and static-analysis risks.", "python"),
    Warn("LEGACY_PYTHON2_CONSTRUCT", "warning", r"\b(xrange|raw_input)\s*\(", "Use of Python 2 built-in '{}'. Replace with Python 3 equivalent.", "python"),
    Warn("LEGACY_PYTHON2_CONSTRUCT", "warning", r"\.(iteritems|iterkeys|itervalues)\s*\(", "Use of Python 2 built-in '{}'. Replace with Python 3 equivalent.", "python"),
    Warn("LEGACY_PYTHON2_PRINT", "warning", r"^\s*print\s+[\"']", "Python 2 print statement without parentheses.", "python"),
    Warn("BARE_EXCEPT", "warning", r"^\s*except\s*:", "Bare 'except:' handler catches SystemExit and KeyboardInterrupt. Use 'except Exception:'.", "python"),
    Warn("MUTABLE_DEFAULT_ARG", "warning", r"\bdef\s+\w+\s*\((?:[^)]*?[\s,(*])??(\w+)\s*(?::[^=)]*)?=\s*[\[{]", "Parameter '{}' has a mutable default argument.", "python"),
    Warn("VAR_USAGE", "warning", r"^var\s", "Use of 'var' keyword. Prefer block-scoped 'const' or 'let'.", "javascript"),
    Warn("COMMONJS_USAGE", "info", r"^\s*(?:const|let|var)\s+[\w{}, ]+\s*=\s*require\(\s*[\"']?([^\"')]*)", "Use of CommonJS require('{}'). Prefer ES module import syntax.", "javascript"),
    Warn("COMMONJS_EXPORTS", "info", r"module\.exports|^exports\.", "Use of CommonJS module.exports assignment. Prefer ES module export syntax.", "javascript"),
    Warn("CALLBACK_HEAVY", "warning", r"\((?:[^()]*[,\s])?(cb|callback|next|done)\s*(?:,[^()]*)?\)\s*(?:=>|\{)", "Parameter '{}': callback pattern instead of Async/Await or Promises.", "javascript"),
    Warn("LOOSE_EQUALITY", "warning", r" [=!]= ", "Loose equality operator ('==' or '!=') used. Prefer strict ('===' or '!==').", "javascript", r" [=!]== "),
    Warn("EVAL_EXEC_USAGE", "risk", r"(?:^|[^.\w])(eval|Function)\s*\(", "Use of '{}()' presents severe security and static-analysis risks.", "javascript"),
)
# ------------------------------------------------------------------------------------------------------------------


def line_array(text: Column | str) -> Column:
    """The lines of a text. An empty text has none; a break at the end begins none."""
    parts = F.split(text, BREAKS)
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """keys, line_no from 1, line of every text. An empty text has no lines; a break at the end begins none."""
    return files.select(*keys, F.posexplode(line_array(text)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def rewrite(files: DataFrame, rules: tuple[Rewrite, ...], text: str = "content") -> DataFrame:
    """Adds modern, changes (array of text), warnings (code, severity, message, line, breaking) and changed; columns of
    these names are replaced.

    Each rule works on what the one before it left; a warning's line is that of the rule's first match at that step.
    """
    out = files.drop("changes", "warnings", "changed").withColumn("modern", F.col(text))
    steps = []
    for i, r in enumerate(rules):
        hits, at = F.regexp_count("modern", F.lit(r.pattern)), F.regexp_instr("modern", F.lit(r.pattern))
        before = F.left(text if r.warning else "modern", at - 1)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        out = out.withColumns({f"_hits{i}": hits, f"_line{i}": line, "modern": F.regexp_replace("modern", r.pattern, r.replacement)})
        n = F.col(f"_hits{i}")
        plural = F.lit(" occurrences)")
        change = F.concat(F.lit(f"{r.message} ("), n.cast("string"), plural if r.warning else F.when(n == 1, " occurrence)").otherwise(plural))
        message = r.warning or r.message + (REVIEW if r.breaking else "")
        warning = F.struct(F.lit(r.code).alias("code"), F.lit("risk" if r.breaking else "info").alias("severity"), F.lit(message).alias("message"), F.col(f"_line{i}").alias("line"), F.lit(r.breaking).alias("breaking"))
        steps.append((F.when(n > 0, change), F.when(n > 0, warning)))
    some = lambda columns: F.filter(F.array(*columns), lambda x: x.isNotNull())
    done = out.withColumns({"changes": some([a for a, _ in steps]), "warnings": some([b for _, b in steps]), "changed": ~F.col("modern").eqNullSafe(F.col(text))})
    return done.drop(*[f"_{k}{i}" for i in range(len(rules)) for k in ("hits", "line")])


def parses(text: str | None) -> bool:
    """Whether a text is Python that its own parser takes. A null text is the empty one."""
    import ast
    import warnings

    with warnings.catch_warnings(), uncollected():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


#: Texts of at most so many characters whose verdict a worker remembers, and how many of them: lines and small files recur.
REMEMBERED_LENGTH, REMEMBERED = 4096, 8192


@lru_cache(REMEMBERED)
def parses_again(text: str) -> bool:
    return parses(text)


def python_valid(rows: DataFrame, text: str, language: Column, out: str) -> DataFrame:
    """Adds out: whether the text parses, for rows in Python; null for others. Only the text travels to Python."""
    from codecorpus.shipping import ship

    ship(rows.sparkSession)

    @F.arrow_udf("boolean")
    def valid(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else parses_again(t) if len(t) <= REMEMBERED_LENGTH else parses(t) for t in texts.to_pylist()], pa.bool_())

    return rows.withColumn(out, valid(F.when(language == "python", F.coalesce(text, F.lit("")))))


def syntax_gate(rewrites: DataFrame, language: Column | str = "python") -> DataFrame:
    """Adds syntax_valid, and a warning where it is false: Python by its parser, other languages by bracket balance.

    language: a column, or one language for all rows."""
    language = F.lit(language) if isinstance(language, str) else language
    judged = python_valid(rewrites.drop("syntax_valid").withColumn("_language", language), "modern", F.col("_language"), "syntax_valid").drop("_language")
    gated = judged.withColumn("syntax_valid", F.coalesce("syntax_valid", s.brackets_balanced(F.coalesce("modern", F.lit("")))))
    bad = F.struct(F.lit("SYNTAX_REVIEW_REQUIRED").alias("code"), F.lit("risk").alias("severity"), F.lit(SYNTAX_REVIEW).alias("message"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("breaking"))
    return gated.withColumn("warnings", F.when(F.col("syntax_valid"), F.col("warnings")).otherwise(F.array_append("warnings", bad)))


def line_diff(files: DataFrame, keys: list[str], before: str = "content", after: str = "modern") -> DataFrame:
    """keys, line_no, after_no, op (changed, added, removed), before, after: lines that differ once the texts are aligned by the
    lines that stand once in both, so that an inserted line is one added line. See `diff.line_differences`."""
    return line_differences(files, keys, line_array(before), line_array(after))


def rewrite_rollup(rewrites: DataFrame, keys: list[str]) -> DataFrame:
    """analyzed, changed, rule groups and breaking warnings; safe: something changed, nothing breaks, all valid."""
    breaking = F.size(F.filter("warnings", lambda w: w["breaking"]))
    rolled = rewrites.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if("changed").alias("changed"), F.sum(F.size("changes")).alias("rule_groups"), F.sum(breaking).alias("breaking"), F.bool_and("syntax_valid").alias("valid")
    )
    return rolled.withColumn("safe", (F.col("changed") > 0) & (F.col("breaking") == 0) & F.col("valid")).drop("valid")


def changed_files(rewrites: DataFrame) -> DataFrame:
    return rewrites.where("changed")


def rewrite_bundle(rewrites: DataFrame) -> DataFrame:
    """What is exported: changed and valid."""
    return rewrites.where("changed and syntax_valid")


def review_lines(rewrites: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, line: changes and warnings of all changed files."""
    own = changed_files(rewrites)
    changes = own.select(*keys, F.lit("change").alias("kind"), F.explode("changes").alias("line"))
    return changes.unionByName(own.select(*keys, F.lit("warning").alias("kind"), F.explode(F.transform("warnings", lambda w: F.concat(w["code"], F.lit(": "), w["message"]))).alias("line")))


def scan_warnings(line_rows: DataFrame, keys: list[str], rules: tuple[Warn, ...] = WARNINGS) -> DataFrame:
    """keys, line_no, code, severity, message (with its subject) of each line and rule that it meets; one pass over the lines."""

    def met(r: Warn) -> Column:
        hit = F.rlike("line", F.lit(r.pattern))
        return hit & ~F.rlike("line", F.lit(r.unless)) if r.unless else hit

    def message(r: Warn) -> Column:
        before, named, behind = r.message.partition("{}")
        return F.concat(F.lit(before), F.regexp_extract("line", r.pattern, 1), F.lit(behind)) if named else F.lit(before)

    found = F.filter(F.array(*[F.when(met(r), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), message(r).alias("message"))) for r in rules]), lambda x: x.isNotNull())
    return line_rows.select(*keys, "line_no", F.explode(found).alias("w")).select(*keys, "line_no", "w.*")


def dedup_warnings(warnings: DataFrame, keys: list[str], line: str = "line", order: str = "ord") -> DataFrame:
    """One row for each code, line and message; the severity of the last (of equal order, the larger)."""
    return warnings.groupBy(*keys, "code", line, "message").agg(F.max_by("severity", F.struct(order, "severity")).alias("severity"))
