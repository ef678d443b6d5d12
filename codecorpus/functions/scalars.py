"""Column functions: names, identifiers, paths, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values --------------------------------------------------------------------------------------------------
LANGUAGES = {
    "py": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
}
RISKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
#: Literal, words inside the name, whole names.
ARGUMENT_RULES = (
    ("10", ("num", "count", "total"), ("a", "b", "x", "y", "n", "i", "val", "value", "price", "amount")),
    ("'test_value'", ("str", "name", "text", "msg", "url", "path"), ("s", "key")),
    ("True", ("flag", "is_", "has_", "enable"), ("bool",)),
    ("[1, 2, 3]", ("list", "items", "data"), ("arr", "arrs", "lines")),
    ("{'key': 'val'}", ("dict", "cfg", "config", "opts"), ()),
)
BOUNDARY_WORDS = ("a", "b", "x", "y", "n", "num", "count", "val")
REDACTIONS = (
    (r"https?://[^:\s]+:[^@\s]+@", "https://[REDACTED_CREDENTIALS]@"),
    (r"(?i)(token|secret|password|bearer|auth)[=:]\s*[\w.-]+", "$1=[REDACTED]"),
    (r"[A-Za-z]:\\[^\s:\"']+", "[REDACTED_PATH]"),
    (r"/[^\s:\"']+/workspaces/[^\s:\"']+", "[REDACTED_PATH]"),
)
SEVERITY_LABELS = {"risk": "Important", "warning": "Review"}
SOURCE_LABELS = {"demo_benchmark": "Built-in demo", "github": "GitHub repository", "zip": "ZIP upload"}
WARNING_TITLES = {
    "VAR_USAGE": "Replace var with const or let",
    "COMMONJS_USAGE": "Consider modern ES module imports",
    "CALLBACK_HEAVY": "Consider promises or async/await",
    "LEGACY_PYTHON2_CONSTRUCT": "Update Python 2 syntax",
    "MUTABLE_DEFAULT_ARG": "Avoid mutable default arguments",
    "BARE_EXCEPT": "Catch specific exceptions",
    "HIGH_COMPLEXITY": "Simplify complex logic",
    "EVAL_USAGE": "Remove unsafe dynamic evaluation",
}
FORBIDDEN_CALLS = ("child_process", "execSync(", "fs.rmdirSync")
# ------------------------------------------------------------------------------------------------------------------


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 12 hex digits of a SHA-256 over the parts, joined by colons."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(12)))


def module_id(project: Column, path: Column) -> Column:
    return hashed_id("mod_", project.cast("string"), F.btrim(F.translate(path, "\\", "/"), F.lit("/")))


def symbol_id(module: Column, qualified_name: Column) -> Column:
    return hashed_id("sym_", module.cast("string"), qualified_name)


def edge_id(source: Column, target: Column, kind: Column, line: Column) -> Column:
    return hashed_id("edge_", source.cast("string"), target.cast("string"), kind, line.cast("string"))


def is_relative_import(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def base_package(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the file name; none for names such as `.py`."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^/]\.([^./]+)$", 1))


def classify_language(path: Column) -> Column:
    """python, javascript or typescript; null for other suffixes."""
    out = F.lit(None).cast("string")
    for suffix, language in LANGUAGES.items():
        out = F.when(extension(path) == suffix, language).otherwise(out)
    return out


def complexity_rating(n: Column) -> Column:
    return F.when(n <= 5, "low").when(n <= 10, "medium").when(n <= 20, "high").otherwise("critical")


def bounded_score(x: Column) -> Column:
    """0 to 100, half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x, 0))).cast("int")


def score_status(n: Column) -> Column:
    return F.when(n >= 80, "Strong").when(n >= 60, "Ready with care").when(n >= 40, "Needs preparation").otherwise("High risk")


def normalize_path(path: Column) -> Column:
    """Folds `.` and `..` and empty parts; `..` at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(folded, "/")


def raw_risk(weight: Column, rating: Column, blast: Column, is_entry: Column) -> Column:
    by_rating = F.when(rating == "critical", 8).when(rating == "high", 5).when(rating == "medium", 2).when(rating == "low", 0).otherwise(1)
    return weight + by_rating + F.least(blast, F.lit(10)) + F.when(is_entry, 5).otherwise(0)


def risk_level(raw: Column) -> Column:
    return F.when(raw >= 18, "critical").when(raw >= 10, "high").when(raw >= 4, "medium").otherwise("low")


def risk_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in RISKS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "risk", 3).when(severity == "warning", 2).otherwise(1)


def python_import_name(path: Column) -> Column:
    """a/b.py is a.b; an __init__ part goes."""
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def safe_test_path(path: Column, language: Column) -> Column:
    name = F.translate(stem(path), ".", "_")
    return F.when(language == "python", F.concat(F.lit("tests/test_"), name, F.lit(".py"))).otherwise(F.concat(F.lit("tests/"), name, F.lit(".test.js")))


def infer_argument(name: Column) -> Column:
    """A literal for a parameter, by the first rule of ARGUMENT_RULES that its lower-cased name meets; 0 if none."""
    low, out = F.lower(name), F.lit("0")
    for literal, inside, whole in reversed(ARGUMENT_RULES):
        met = low.isin(*whole) if whole else F.lit(False)
        for word in inside:
            met = met | F.contains(low, F.lit(word))
        out = F.when(met, literal).otherwise(out)
    return out


def boundary_argument(name: Column) -> Column:
    return F.when(F.rlike(F.lower(name), F.lit("|".join(BOUNDARY_WORDS))), "0").otherwise("''")


def is_receiver(name: Column) -> Column:
    return F.lower(name).isin("self", "cls")


def redact(text: Column, root: str, most: int = 500, mark: str = "") -> Column:
    """The root folder, credentials in URLs, named secrets, drive paths and workspace paths go; then the text is cut at
    `most` characters and marked. A null text is empty."""
    out = F.coalesce(text, F.lit(""))
    if root:
        out = F.replace(out, F.lit(root), F.lit("[TARGET_DIR]"))
    for pattern, instead in REDACTIONS:
        out = F.regexp_replace(out, pattern, instead)
    return F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most)), F.lit(mark))).otherwise(out)


def download_name(text: Column) -> Column:
    """Letters, digits, - and _ stay; an empty name is `project`."""
    name = F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-"), F.lit("-"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("project"))


def human_bytes(n: Column) -> Column:
    """1024-based, one decimal, `.0` dropped."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        value = F.regexp_replace(F.round(n / F.lit(size), 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
        out = F.when(n >= size, F.concat(value, F.lit(f" {unit}"))).otherwise(out)
    return out


def title_case(x: Column) -> Column:
    """Runs of _ and - become spaces, the first letter of each word a capital; the rest stays."""
    words = F.split(F.regexp_replace(x, "[_-]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def _label(x: Column, labels: dict[str, str], otherwise: Column) -> Column:
    known = F.create_map(*[F.lit(y) for pair in labels.items() for y in pair])
    return F.coalesce(F.try_element_at(known, x), otherwise)


def severity_label(x: Column) -> Column:
    return _label(x, SEVERITY_LABELS, F.lit("Note"))


def source_label(x: Column) -> Column:
    return _label(x, SOURCE_LABELS, title_case(x))


def warning_title(x: Column) -> Column:
    return _label(x, WARNING_TITLES, title_case(x))


def complexity_label(rating: Column, score: Column) -> Column:
    n = F.coalesce(score, F.lit(0))
    by_score = F.when(n <= 5, "Low").when(n <= 10, "Moderate").when(n <= 20, "High").otherwise("Critical")
    return F.when(F.coalesce(rating, F.lit("")) != "", title_case(rating)).otherwise(by_score)


def clean_text(x: Column) -> Column:
    """Without backticks, with single spaces; a null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("`"), F.lit("")), r"\s+", " "))


def brackets_balanced(text: Column) -> Column:
    """A stack of ()[]{} over all of a text; strings and comments count like the rest."""
    pairs = F.regexp_replace(text, r"[^()\[\]{}]", "")
    stack = F.aggregate(
        F.split(pairs, ""),
        F.lit(""),
        lambda s, ch: F.when((s == "!") | (ch == ""), s)
        .when(ch.isin("(", "[", "{"), F.concat(s, ch))
        .when(((ch == ")") & F.endswith(s, F.lit("("))) | ((ch == "]") & F.endswith(s, F.lit("["))) | ((ch == "}") & F.endswith(s, F.lit("{"))), F.substring(s, F.lit(1), F.length(s) - 1))
        .otherwise(F.lit("!")),
    )
    return stack == ""


def brackets_balanced_quoted(text: Column) -> Column:
    """As brackets_balanced, without what stands in quotes; an open quote drops the rest."""
    return brackets_balanced(F.regexp_replace(text, "(?s)\"[^\"]*(\"|$)|'[^']*('|$)|`[^`]*(`|$)", ""))


def forbidden_pattern(text: Column) -> Column:
    """The first of the calls that a generated test may not hold, or `empty`; null if none."""
    out = F.when(F.trim(text) == "", "empty")
    for call in FORBIDDEN_CALLS:
        out = out.when(F.contains(text, F.lit(call)), call)
    return out
