"""Imports, symbols, calls and other facts of source texts, by line-level jobs, and exact Python facts by its own parser."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.operators.javascript import EXPORTS, SYMBOLS, javascript_facts
from codecorpus.shipping import uncollected

# -- fixed values --------------------------------------------------------------------------------------------------
ENTRY_FILES = ("index.js", "index.jsx", "index.ts", "index.tsx", "index.mjs", "index.cjs", "main.js", "main.jsx", "server.js", "app.js", "cli.js")
CALL_WORDS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "class", "and", "or", "not", "in", "elif", "with", "except", "print", "lambda", "async", "await", "typeof", "new")
# messages of warnings; {} is the subject, then the score
TOO_COMPLEX = "Function '{}' has high cyclomatic complexity ({})."
NOT_PARSED = "Python parser could not fully parse this file."
# ------------------------------------------------------------------------------------------------------------------

CODE = r"(?s)\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"


def stripped(line: Column, comment: str = "#") -> Column:
    """A line without what stands in quotes, and without its comment."""
    return F.regexp_replace(F.regexp_replace(line, CODE, "\"\""), comment + ".*$" if comment == "#" else "//.*$", "")


def _outside_bodies(line_rows: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """keys, line_no, line of the wanted lines that stand in no body of a def. One sorted pass over a file's heads
    and wanted lines: a head's body ends with the next line of code that is indented no deeper."""
    import pyarrow as pa

    from codecorpus.shipping import ship

    ship(line_rows.sparkSession)
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    code = line_rows.where(~F.rlike("line", F.lit(r"^\s*(#.*)?$"))).select(*keys, "line_no", "line", indent.alias("_indent"), F.rlike("line", F.lit(r"^\s*(?:async\s+)?def\s")).alias("_head"), F.rlike("line", F.lit(wanted)).alias("_wanted"))
    n = len(keys)

    def run(batches):
        file, bodies = None, []
        for batch in batches:
            keep = []
            for i, (*own, depth, head, hit) in enumerate(zip(*[batch.column(k).to_pylist() for k in (*range(n), n + 2, n + 3, n + 4)], strict=True)):
                if own != file:
                    file, bodies = own, []
                while bodies and bodies[-1] >= depth:
                    bodies.pop()
                if hit and not bodies:
                    keep.append(i)
                if head:
                    bodies.append(depth)
            yield batch.take(pa.array(keep, pa.int64())).select(list(range(n + 2)))

    types = ", ".join(f"`{c}` {code.schema[c].dataType.simpleString()}" for c in (*keys, "line_no", "line"))
    return code.repartition(*keys).sortWithinPartitions(*keys, "line_no").mapInArrow(run, types)


def python_imports(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """module_name, imported_symbols, is_relative, source_line: one row for each alias of `import`, one for each `from`. What
    stands in the body of a def doesn't count. Columns other than the keys, line_no and line are ignored."""
    line_rows = _outside_bodies(line_rows, keys, r"^\s*(?:import|from)\s")
    plain = F.regexp_extract("line", r"^\s*import\s+(.+?)\s*(?:#.*)?$", 1)
    one = line_rows.where(plain != "").select(*keys, "line_no", F.explode(F.split(plain, r"\s*,\s*")).alias("part"))
    one = one.select(*keys, F.regexp_extract("part", r"^([\w.]+)", 1).alias("module_name"), F.array(F.coalesce(F.nullif(F.regexp_extract("part", r"\bas\s+(\w+)", 1), F.lit("")), F.regexp_extract("part", r"^([\w.]+)", 1))).alias("imported_symbols"), F.lit(False).alias("is_relative"), F.col("line_no").alias("source_line"))
    head = r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?(.+?)\)?\s*(?:#.*)?$"
    names = F.transform(F.filter(F.split(F.regexp_extract("line", head, 2), r"\s*,\s*"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"^(\*|\w+)", 1))
    two = line_rows.where(F.rlike("line", F.lit(head))).select(*keys, F.regexp_extract("line", head, 1).alias("module_name"), names.alias("imported_symbols"), F.startswith(F.regexp_extract("line", head, 1), F.lit(".")).alias("is_relative"), F.col("line_no").alias("source_line"))
    return one.unionByName(two)


def javascript_imports(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """module_name, import_kind (import or require), imported_symbols, is_relative, source_line, from tokens.

    An import's symbols are its clause as it stands; a require's is the variable. Only statements of the top level count;
    they may run over lines or share one. Of exports, those that name a source count. Columns other than the keys, line_no
    and line are ignored.
    """
    found = javascript_facts(line_rows, keys, ("import", "require"))
    return found.select(*keys, F.col("_name").alias("module_name"), F.col("_kind").alias("import_kind"), F.col("_symbols").alias("imported_symbols"), F.col("_line").alias("source_line"), F.startswith("_name", F.lit(".")).alias("is_relative"))


def python_symbols(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """kind, name, is_async, indent, start_line, end_line of defs, classes and module-level names. A body ends before
    the next line that is indented no deeper; blank lines and comments don't count. One sorted pass over a file's lines.
    Columns other than the keys, line_no and line are ignored."""
    head = r"^\s*(async\s+)?(def|class)\s+(\w+)"
    name = r"^([A-Za-z_]\w*)\s*(?::[^=]+)?=[^=]"
    from codecorpus.shipping import ship

    ship(line_rows.sparkSession)
    code = line_rows.where(~F.rlike("line", F.lit(r"^\s*(#.*)?$"))).select(*keys, "line_no", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"), F.regexp_extract("line", head, 2).alias("_head"), F.regexp_extract("line", name, 1).alias("_own"), F.regexp_extract("line", head, 3).alias("_name"), (F.regexp_extract("line", head, 1) != "").alias("is_async"))
    kinds = [code.schema[k].dataType.simpleString() for k in keys]
    types = f"{', '.join(f'`{k}` {t}' for k, t in zip(keys, kinds, strict=True))}, line_no {code.schema['line_no'].dataType.simpleString()}, kind string, name string, is_async boolean, indent int, end_line {code.schema['line_no'].dataType.simpleString()}"

    def run(batches):
        # a stack of open bodies: a line closes those that are indented as deep or deeper
        import pyarrow as pa

        file, last, open_now = None, None, []
        n = len(keys)

        def closed(bodies: list, end: int) -> list:
            return [(*file, start, kind, name, is_async, indent, end) for start, kind, name, is_async, indent in bodies]

        for batch in batches:
            out = []
            for *own, line_no, indent, head, variable, name, is_async in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if own != file:
                    out += closed(open_now, last)
                    file, open_now = own, []
                while open_now and open_now[-1][-1] >= indent:
                    out += closed([open_now.pop()], line_no - 1)
                if head:
                    open_now.append((line_no, "function" if head == "def" else "class", name, is_async, indent))
                elif variable:
                    out.append((*file, line_no, "variable", variable, False, indent, line_no))
                last = line_no
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*(batch.schema.field(i).type for i in range(n + 1)), pa.string(), pa.string(), pa.bool_(), pa.int32(), batch.schema.field(n).type], strict=True)], [*keys, "line_no", "kind", "name", "is_async", "indent", "end_line"])
        if open_now:
            rest = list(zip(*closed(open_now, last), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rest, [*(batch.schema.field(i).type for i in range(n + 1)), pa.string(), pa.string(), pa.bool_(), pa.int32(), batch.schema.field(n).type], strict=True)], [*keys, "line_no", "kind", "name", "is_async", "indent", "end_line"])

    found = code.repartition(*keys).sortWithinPartitions(*keys, "line_no").mapInArrow(run, types)
    return found.select(*keys, "kind", "name", "is_async", "indent", F.col("line_no").alias("start_line"), "end_line")


def javascript_symbols(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """kind (function, method, constructor, class, variable), name, qualified_name, is_async, start_line, end_line, depth,
    parameters, complexity, from tokens; depth counts the braces around it. Columns other than the keys, line_no and line
    are ignored."""
    found = javascript_facts(line_rows, keys, SYMBOLS)
    return found.select(*keys, F.col("_kind").alias("kind"), F.col("_name").alias("name"), F.col("_qualified_name").alias("qualified_name"), F.col("_is_async").alias("is_async"), F.col("_line").alias("start_line"), F.col("_end_line").alias("end_line"), F.col("_depth").alias("depth"), F.col("_parameters").alias("parameters"), F.col("_complexity").alias("complexity"))


def javascript_exports(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """name, kind, source_line of what a file exports, from tokens.

    Kinds: function, class, variable, default; `export { a as b }` gives variables by their new names, `export * from`
    one of kind all. Plain declarations of functions and classes at the top level count as exports too. Columns other than
    the keys, line_no and line are ignored.
    """
    found = javascript_facts(line_rows, keys, EXPORTS)
    return found.select(*keys, F.col("_name").alias("name"), F.substring("_kind", 8, 20).alias("kind"), F.col("_line").alias("source_line"))


def javascript_calls(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """caller (the innermost function around it, or ''), target_name, source_line of each call, from tokens: definitions, and
    what stands in strings, templates and comments, are none; code inside templates is."""
    found = javascript_facts(line_rows, keys, ("call",))
    return found.select(*keys, F.col("_qualified_name").alias("caller"), F.col("_name").alias("target_name"), F.col("_line").alias("source_line"))


def javascript_points(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, complexity: 1 and a whole file's branch points, from tokens."""
    return javascript_facts(line_rows, keys, ("points",)).select(*keys, F.col("_complexity").alias("complexity"))


def calls(line_rows: DataFrame, keys: list[str], comment: str = "#") -> DataFrame:
    """target_name, source_line of each call on a line; words that open a definition or a block aren't calls."""
    code = F.regexp_replace(stripped(F.col("line"), comment), r"\b(?:def|class|function)\s+\w+", "")
    found = line_rows.select(*keys, F.col("line_no").alias("source_line"), F.explode(F.regexp_extract_all(code, F.lit(r"([A-Za-z_$][\w.$]*)\s*\("), 1)).alias("target_name"))
    return found.where(~F.col("target_name").isin(*CALL_WORDS))


def enclosing(call_rows: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, caller, target_name, source_line: caller is the innermost symbol whose lines hold the call, or ''.

    Two passes over a file's sorted starts, calls and ends: how many symbols are open at each, then the last that began at
    that depth. Columns other than the named ones are ignored."""
    own = symbols.where("kind <> 'variable'")
    nothing = F.lit(None).cast("string")
    event = lambda rows, at, order, step, name, target: rows.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(order).alias("_order"), F.lit(step).alias("_step"), name.alias("_name"), target.alias("target_name"))
    events = event(own, "start_line", 0, 1, F.col("name"), nothing).unionByName(event(call_rows, "source_line", 1, 0, nothing, F.col("target_name"))).unionByName(event(own, "end_line", 2, -1, nothing, nothing))
    before = Window.partitionBy(*keys).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = events.withColumn("_depth", F.sum("_step").over(before)).where("_order < 2")
    begun = Window.partitionBy(*keys, "_depth").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caller = F.when(F.col("_depth") > 0, F.last("_name", ignorenulls=True).over(begun))
    return deep.withColumn("caller", F.coalesce(caller, F.lit(""))).where("_order = 1").select(*keys, "caller", "target_name", F.col("_at").cast(call_rows.schema["source_line"].dataType).alias("source_line"))


def parameters(signature: Column) -> Column:
    """array<struct<name, annotation, default>> of a parameter list without brackets inside."""
    parts = F.filter(F.transform(F.split(signature, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "*") & (x != "/"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\*{0,2}\w+)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(x, r":\s*([^=]+)", 1)), F.lit("")).alias("annotation"), F.nullif(F.trim(F.regexp_extract(x, r"=\s*(.+)$", 1)), F.lit("")).alias("default")))


def signatures(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """name, parameters, return_annotation of each one-line def or function."""
    head = r"\b(?:def|function)\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?"
    rows = line_rows.where(F.rlike("line", F.lit(head)))
    return rows.select(*keys, "line_no", F.regexp_extract("line", head, 1).alias("name"), parameters(F.regexp_extract("line", head, 2)).alias("parameters"), F.nullif(F.trim(F.regexp_extract("line", head, 3)), F.lit("")).alias("return_annotation"))


def entry_points(line_rows: DataFrame, keys: list[str], path: str = "relative_path") -> DataFrame:
    """keys, is_entry_point: a main guard, a server start at the top level, or an entry file's name."""
    guard = F.rlike("line", F.lit(r"""^if\s.*__name__\s*==\s*['"]__main__['"]""")) | F.rlike("line", F.lit(r"""^if\s.*['"]__main__['"]\s*==\s*__name__"""))
    server = F.rlike("line", F.lit(r"^[^\s].*(?:\.listen\(|http\.createServer\()"))
    name = F.lower(F.element_at(F.split(path, "/"), -1)).isin(*ENTRY_FILES)
    return line_rows.groupBy(*keys).agg(F.bool_or(guard | server | name).alias("is_entry_point"))


def decision_points(line: Column, language: str = "python") -> Column:
    """Branch points of a line; `and` and `or` (&&, ||, ??) count each."""
    if language == "python":
        return F.regexp_count(stripped(line), F.lit(r"\b(?:if|elif|for|while|except|with|and|or|case)\b")) - F.regexp_count(stripped(line), F.lit(r"\S+\s+if\s+[^:]+\belse\b"))
    return F.regexp_count(stripped(line, "//"), F.lit(r"\b(?:if|for|while|do|catch|case)\b|&&|\|\||\?\?|\?(?![?.:])"))


def complexity(line_rows: DataFrame, symbols: DataFrame, keys: list[str], language: str = "python") -> DataFrame:
    """keys, name, start_line, complexity: 1 and the branch points of a function's lines. A running sum over a file's lines is
    read at each function's start and end. Columns other than the named ones are ignored."""
    own = symbols.where("kind = 'function'")
    none = F.lit(None)
    points = line_rows.select(*keys, F.col("line_no").cast("long").alias("_at"), F.lit(1).alias("_order"), decision_points(F.col("line"), language).cast("long").alias("_points"), none.cast("string").alias("name"), none.cast("long").alias("start_line"))
    edge = lambda at, order: own.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(order).alias("_order"), F.lit(0).cast("long").alias("_points"), "name", F.col("start_line").cast("long").alias("start_line"))
    before = Window.partitionBy(*keys).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = points.unionByName(edge("start_line", 0)).unionByName(edge("end_line", 2)).withColumn("_sum", F.sum("_points").over(before)).where("_order <> 1")
    return summed.groupBy(*keys, "name", "start_line").agg((F.max("_sum") - F.min("_sum") + 1).cast("int").alias("complexity")).withColumn("start_line", F.col("start_line").cast(own.schema["start_line"].dataType))


def docstrings(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, docstring (its first line), decorators of each def and class, from the lines around it."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    head = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    doc = F.regexp_extract(F.lead("line").over(w), r"""^\s*[rRuU]?(?:\"\"\"|'''|"|')(.*?)(?:\"\"\"|'''|"|')?\s*$""", 1)
    run = F.sum(F.when(F.rlike("line", F.lit(r"^\s*@")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = line_rows.withColumns({"name": head, "docstring": F.nullif(doc, F.lit("")), "group": F.when(head != "", run - 1).otherwise(run), "mark": F.nullif(F.regexp_extract("line", r"^\s*@([\w.]+)", 1), F.lit(""))})
    marks = marked.where("mark is not null").groupBy(*keys, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "mark"))), lambda x: x["mark"]).alias("decorators"))
    return marked.where("name <> ''").join(marks, [*keys, "group"], "left").select(*keys, "line_no", "name", "docstring", F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"))


def complexity_warnings(symbols: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """keys, code, message, line, severity of the functions whose complexity is above `most`. symbols: keys, kind, name, complexity, start_line."""
    before, between, behind = TOO_COMPLEX.split("{}")
    message = F.concat(F.lit(before), "name", F.lit(between), F.col("complexity").cast("string"), F.lit(behind))
    return symbols.where((F.col("complexity") > most) & F.col("kind").isin("function", "method", "constructor")).select(*keys, F.lit("HIGH_COMPLEXITY").alias("code"), message.alias("message"), F.col("start_line").alias("line"), F.lit("warning").alias("severity"))


def syntax_warnings(fact_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, message, line, severity of the files that `python_facts` couldn't parse."""
    return fact_rows.where("kind = 'error'").select(*keys, F.lit("SYNTAX_ERROR").alias("code"), F.lit(NOT_PARSED).alias("message"), "line", F.lit("risk").alias("severity"))


FACTS = "kind string, name string, line int, end_line int, complexity int, detail string"
LEGACY_NAMES = ("xrange", "raw_input", "iteritems", "iterkeys", "itervalues")


def _dotted(node) -> str:
    """The dotted name of an expression, '' if it has none."""
    import ast

    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}".lstrip(".")
    return _dotted(node.func) if isinstance(node, ast.Call) else ""


def _shown(node) -> str:
    """What `ast.unparse` gives, faster of names with attributes, which most called expressions are."""
    import ast

    names, x = [], node
    while type(x) is ast.Attribute:
        names.append(x.attr)
        x = x.value
    return ".".join([x.id, *reversed(names)]) if type(x) is ast.Name else ast.unparse(node)


@lru_cache(1)
def _leaves() -> frozenset[type]:
    """Kinds of nodes with nothing below them, but for others of these kinds, and kinds of what isn't a node."""
    import ast

    return frozenset(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST) and not c._fields) | {ast.Name, ast.Constant, ast.alias, str, int, bool, type(None)}


def _below(node) -> list:
    """The nodes right below one, in order, without leaves."""
    leaves, out = _leaves(), []
    for x in vars(node).values():
        kind = type(x)
        if kind is list:
            out += [y for y in x if type(y) not in leaves]
        elif kind not in leaves:
            out.append(x)
    return out


def _python_facts(text: str) -> list[tuple]:
    with uncollected():
        return _tree_facts(text)


def _tree_facts(text: str) -> list[tuple]:
    """Facts of one text by its syntax tree; of a text that isn't Python an `error` and what its tokens show.

    detail: of functions a parameter list (name, annotation and default as they stand) with `async` in front, of classes
    their bases, of imports their symbols, of docstrings and decorators the symbol they belong to, of warnings the subject.
    """
    import ast
    import warnings

    from codecorpus.operators.text import DEPRECATED_MODULES

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return [("error", type(e).__name__, getattr(e, "lineno", None) or 1, None, None, None), *_token_facts(text)]
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    watched = frozenset((*functions, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Call, ast.ExceptHandler, ast.Assign, ast.AnnAssign, ast.If))

    def points(node: ast.AST) -> int:
        n, todo = 1, [node]
        while todo:
            x = todo.pop()
            todo += _below(x)
            n += isinstance(x, branches)
            n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
            n += 1 + len(x.ifs) if isinstance(x, ast.comprehension) else 0
            n += len(x.cases) if isinstance(x, ast.Match) else 0
        return n

    out: list[tuple] = []

    def warn(code: str, line: int, subject: str) -> None:
        out.append(("warning", code, line, None, None, subject))

    def symbol(x: ast.AST, name: str) -> None:
        if (doc := ast.get_docstring(x)) is not None:
            out.append(("docstring", doc, x.lineno, None, None, name))
        out.extend(("decorator", _dotted(d), d.lineno, None, None, name) for d in x.decorator_list)

    def visit(node: ast.AST, prefix: str, lazy: bool) -> None:
        for x in _below(node):
            if type(x) not in watched:
                visit(x, prefix, lazy)
                continue
            inner = prefix
            if isinstance(x, functions):
                inner = f"{prefix}{x.name}."
                kind = "function" if not isinstance(node, ast.ClassDef) else "constructor" if x.name == "__init__" else "method"
                score = points(x)
                out.append((kind, prefix + x.name, x.lineno, x.end_lineno, score, ("async " if isinstance(x, ast.AsyncFunctionDef) else "") + f"({ast.unparse(x.args)})"))
                symbol(x, prefix + x.name)
                if score > 10:
                    warn("HIGH_COMPLEXITY", x.lineno, prefix + x.name)
                for d in [*x.args.defaults, *x.args.kw_defaults]:
                    if isinstance(d, (ast.List, ast.Dict, ast.Set)):
                        warn("MUTABLE_DEFAULT_ARG", x.lineno, prefix + x.name)
            elif isinstance(x, ast.ClassDef):
                inner = f"{prefix}{x.name}."
                out.append(("class", prefix + x.name, x.lineno, x.end_lineno, None, ",".join(filter(None, map(_dotted, x.bases)))))
                symbol(x, prefix + x.name)
            elif isinstance(x, (ast.Import, ast.ImportFrom)) and lazy:
                continue  # imports in functions' bodies aren't the module's
            elif isinstance(x, ast.Import):
                for a in x.names:
                    out.append(("import", a.name, x.lineno, None, None, a.asname or a.name))
                    if a.name.split(".")[0] in DEPRECATED_MODULES:
                        warn("DEPRECATED_MODULE", x.lineno, a.name.split(".")[0])
            elif isinstance(x, ast.ImportFrom):
                out.append(("import", "." * x.level + (x.module or ""), x.lineno, None, None, ",".join("*" if a.name == "*" else a.asname or a.name for a in x.names)))
                if any(a.name == "*" for a in x.names):
                    warn("WILDCARD_IMPORT", x.lineno, x.module or "")
                if (x.module or "").split(".")[0] in DEPRECATED_MODULES:
                    warn("DEPRECATED_MODULE", x.lineno, x.module.split(".")[0])
            elif isinstance(x, ast.Call):
                out.append(("call", _shown(x.func), x.lineno, None, None, prefix.rstrip(".")))
                if isinstance(x.func, ast.Name) and x.func.id in ("eval", "exec"):
                    warn("EVAL_EXEC_USAGE", x.lineno, x.func.id)
                if _dotted(x.func).rpartition(".")[2] in LEGACY_NAMES:
                    warn("LEGACY_PYTHON2_CONSTRUCT", x.lineno, _dotted(x.func).rpartition(".")[2])
            elif isinstance(x, ast.ExceptHandler) and x.type is None:
                warn("BARE_EXCEPT", x.lineno, "")
            elif isinstance(x, (ast.Assign, ast.AnnAssign)) and isinstance(node, ast.Module):
                names = [t.id for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)]
                out.extend(("variable", n, x.lineno, x.end_lineno, None, "") for n in names)
                out.extend(("export", n, x.lineno, None, None, "variable") for n in names)
            elif isinstance(x, ast.If) and isinstance(x.test, ast.Compare) and _dotted(x.test.left) == "__name__" and any(isinstance(v, ast.Constant) and v.value == "__main__" for v in x.test.comparators):
                out.append(("entry_point", "__main__", x.lineno, None, None, ""))
            if isinstance(node, ast.Module) and isinstance(x, (*functions, ast.ClassDef)):
                out.append(("export", x.name, x.lineno, None, None, "class" if isinstance(x, ast.ClassDef) else "function"))
            visit(x, inner, lazy or isinstance(x, functions))

    try:
        visit(tree, "", False)
    except RecursionError:  # nested deeper than the walk can go
        return [("error", "RecursionError", 1, None, None, None), *_token_facts(text)]
    return out


def _token_facts(text: str) -> list[tuple]:
    """What the tokens of a text show that doesn't parse: imports, classes, functions, marks of Python 2. As far as its tokens can be read."""
    import io
    import tokenize

    tokens, out = [], []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            tokens.append(t)
    except (tokenize.TokenError, SyntaxError, ValueError):  # the rest can't be read
        pass
    kinds = {"import": "import", "from": "import", "class": "class", "def": "function"}
    for t, after in zip(tokens, [*tokens[1:], None], strict=True):
        line = t.start[0]
        if t.string in kinds and after is not None and after.type == tokenize.NAME:
            kind = kinds[t.string]
            out.append((kind, after.string, line, line if kind != "import" else None, 1 if kind == "function" else None, after.string if t.string == "import" else ""))
        elif t.string == "print" and after is not None and after.type == tokenize.STRING:
            out.append(("warning", "LEGACY_PYTHON2_PRINT", line, None, None, "print"))
        elif t.string in LEGACY_NAMES:
            out.append(("warning", "LEGACY_PYTHON2_CONSTRUCT", line, None, None, t.string))
    return out


def python_facts(files: DataFrame, keys: list[str], text: str = "content", errors_only: bool = False) -> DataFrame:
    """keys, kind, name, line, end_line, complexity, detail: exact facts of Python texts, in parallel over the files; with
    errors_only those of kind error, for which texts are parsed but their trees not read. Lines and small files recur, so a
    worker remembers what it found in some.

    Kinds: import, export, class, function, method, constructor, variable, call, docstring, decorator, entry_point,
    warning, error. A text that doesn't parse has an error and what its tokens show. A null text is the empty one.
    """
    import pyarrow as pa

    from codecorpus.operators.text import REMEMBERED, REMEMBERED_LENGTH, parses
    from codecorpus.shipping import ship

    ship(files.sparkSession)
    names = [x.split()[0] for x in FACTS.split(",")]
    schema = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)

    def facts_of(t):
        if errors_only:
            return [] if parses(t) else [f for f in _python_facts(t) if f[0] == "error"]
        return _python_facts(t)

    def run(batches):
        remembered = lru_cache(REMEMBERED)(facts_of)
        for batch in batches:
            found = [remembered(t) if len(t) <= REMEMBERED_LENGTH else facts_of(t) for t in (t or "" for t in batch.column(len(keys)).to_pylist())]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], *[pa.array([x[j] for x in flat], kinds[j]) for j in range(6)]], [*keys, *names])

    return files.select(*keys, text).mapInArrow(run, f"{schema}, {FACTS}")
