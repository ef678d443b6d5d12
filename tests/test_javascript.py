"""Facts of JavaScript from tokens: what stands in strings is no code, statements run over lines or share one, classes have members."""

import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import facts, javascript, text


def rows_of(source):
    return javascript.Facts(source).rows


def named(source, *kinds):
    return [(r["kind"], r["name"]) for r in rows_of(source) if r["kind"] in kinds]


IMPORTS = ("import", "require")
SYMBOLS = ("function", "method", "constructor", "class", "variable")


@pytest.mark.parametrize(
    "source,want",
    [
        ("const s = `import q from \"x\"`", []), ("const s = `${`import q from \"x\"`}`; import a from 'b'", ["b"]), ('import a from "a"; import b from "b"', ["a", "b"]), ("import {\n a,\n b as c,\n} from './m'\n", ["./m"]),
        ("// import a from 'b'\n/* import c from 'd'\n*/import 'e'", ["e"]), ("import type { T } from 't'", ["t"]), ("import type, { x } from 'u'", ["u"]), ("import x = require('y')", ["y"]), ("import a, * as n from 'n'", ["n"]),
        ("const x = import('lazy')", []), ("function f() { const a = require('inner') }", []), ("export const a = require('outer')", ["outer"]), ("export { a } from 'r'; export * from 's'; export * as t from 't'", ["r", "s", "t"]), ("x.import('q')", []), ("import imp\ny = 'z'", []),
        ("const r = /import a from 'b'/; import c from 'd'", ["d"]), ("const a = b / c; import d from 'e' // /", ["e"]), ("'\\\nimport a from \"b\"'", []), ("import a from", []), ("import {a from 'b'", []),
    ],
)
def test_imports(source, want):
    assert [n for _, n in named(source, *IMPORTS)] == want


@pytest.mark.parametrize(
    "source,want",
    [
        ("class A { constructor(a) {} async m() {} get v() { return 1 } set v(x) {} static s() {} *g() {} #p() {} }", ["class A", "constructor constructor", "method m", "method v", "method v", "method s", "method g", "method #p"]),
        ("class A { x = 1; y = () => { f() }; m() {} }", ["class A", "method m"]), ("class A {\n x = 1\n y = g(1)\n m() {}\n}", ["class A", "method m"]), ("class A { get() {} static() {} async() {} }", ["class A", "method get", "method static", "method async"]),
        ("const B = class extends C { m() {} }", ["variable B", "class AnonymousClass", "method m"]), ("const a = 1, b = function () {}, c = (x) => x, { d, e } = f, [g] = h", ["variable a", "function b", "function c", "variable { d, e }", "variable [g]"]),
        ("for (const i of x) { let j = 1 }", ["variable j"]), ("const f = async x => { let y }", ["function f", "variable y"]), ("function* gen() {} async function af() {}", ["function gen", "function af"]), ("class T<A> extends U<A> { private readonly m<B>(a: B): Map<A, B> { } }", ["class T", "method m"]),
        ("const s = 'function no() {}', t = `class No {}`", ["variable s", "variable t"]), ("let a: number = 1, b: () => void", ["variable a", "variable b"]), ("abstract class A { abstract m(): void; n() {} }", ["class A", "method n"]),
    ],
)
def test_symbols(source, want):
    assert sorted(f"{k} {n}" for k, n in named(source, *SYMBOLS)) == sorted(want)


@pytest.mark.parametrize(
    "source,want",
    [
        ("export {\n a,\n c as d\n}", [("variable", "a"), ("variable", "d")]), ("export default function () {}", [("default", "default")]), ("export default async function f() {}", [("default", "f")]), ("export default class {}", [("class", "default")]), ("export default x", [("default", "x")]),
        ("export default x.y", [("default", "default")]), ("export const a = 1, b = () => 2", [("variable", "a"), ("function", "b")]), ("export * from 'x'", [("all", "*")]), ("module.exports = {}; exports.a = 1; module.exports.b = 2", [("default", "default"), ("variable", "a"), ("variable", "b")]),
        ("class K {}\nfunction f() { class L {} function g() {} }", [("class", "K"), ("function", "f")]), ("const t = `export const no = 1`", []), ("export type { T, U }", [("variable", "T"), ("variable", "U")]), ("if (a) { exports.b = 1 }", []),
    ],
)
def test_exports(source, want):
    assert sorted((r["kind"][7:], r["name"]) for r in rows_of(source) if r["kind"].startswith("export_")) == sorted(want)


@pytest.mark.parametrize(
    "source,want",
    [
        ("class A { constructor(a, b) { super(a) } async run(cb) { cb(1) } get v() { return go() } }", [("A.run", "cb"), ("A.v", "go")]), ("const o = { run(cb) { k() }, f: g() }", [("", "k"), ("", "g")]), ("a.b?.(1); a?.c(2); new D(3); e()()", [("", "a.b"), ("", "a.c"), ("", "D"), ("", "e")]),
        ("const t = `${f(1)} g(2)`; // h(3)", [("", "f")]), ("if (a) { b() } while (c()) {}", [("", "b"), ("", "c")]), ("function f() { g(() => h()) }", [("f", "g"), ("f", "h")]), ("'x(1)'; /y(2)/.test(z)", [("", "test")]), ("x.if(1); y.catch(2)", [("", "x.if"), ("", "y.catch")]),
    ],
)
def test_calls(source, want):
    assert sorted((r["qualified_name"], r["name"]) for r in rows_of(source) if r["kind"] == "call") == sorted(want)


@pytest.mark.parametrize("body,want", [("", 1), ("if (a) {} else if (b) {}", 3), ("do { x } while (y)", 2), ("while (y) {}", 2), ("for (const a of b) {}", 2), ("switch (a) { case 1: case 2: default: }", 3), ("a ? b : c", 2), ("a?.b; c ?? d", 2), ("a && b || c", 3), ("try {} catch (e) {}", 2), ("'if (a) {}'; `while ${a ? 1 : 2}`", 2), ("x.if; y.case; ({ if: 1, do: 2 })", 1), ("() => a && b", 2)])
def test_complexity(body, want):
    assert [r["complexity"] for r in rows_of(f"function f(x?: number) {{ {body} }}") if r["kind"] == "function"] == [want]


def test_parameters():
    (f,) = [r for r in rows_of("const f = (a, b = [1, 2], { c, d = 3 } = {}, ...rest) => a") if r["kind"] == "function"]
    assert [(p["name"], p["default"]) for p in f["parameters"]] == [("a", None), ("b", "[1, 2]"), ("{ c, d = 3 }", "{}"), ("...rest", None)]
    (g,) = [r for r in rows_of("function g(a: string, b?: Map<string, number>, c: { d: 1 } = e) {}") if r["kind"] == "function"]
    assert [(p["name"], p["annotation"], p["default"]) for p in g["parameters"] if p["name"]][0] == ("a", "string", None)


def test_any_text_is_read_to_its_end():
    r = random.Random(1)
    parts = ["{", "}", "(", ")", "[", "]", "`", "${", "'", '"', "/", "//", "/*", "*/", "\\", "\n", " ", "a", "class A", "function f", "import", "export", "const", "=", "=>", ",", ";", ":", "?", "async", "é", "0", "from", "default", "#", "<", "do", "while"]
    for _ in range(4000):
        source = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        t = javascript.Tokens(source)
        assert all(source[s:e] == x or x in "()" for s, e, x in zip(t.start, t.end, t.text, strict=True))
        rows_of(source)


def test_files_side_by_side_with_gaps_and_clashing_columns(spark):
    files = [(i, "", f"class K{i} {{\n\n  m() {{}}\n}}", "k", 1) for i in range(20)] + [(20, "", None, "k", 1), (21, "", "", "k", 1)]
    df = spark.createDataFrame(files, "name int, kind string, content string, line string, depth int")
    lines = text.lines(df, ["name", "kind"]).where("line <> ''").repartition(7)
    got = facts.javascript_facts(lines, ["name", "kind"]).where("_kind = 'method'").collect()
    assert {(r.name, r.kind, r._qualified_name, r._line, r._end_line) for r in got} == {(i, "", f"K{i}.m", 3, 3) for i in range(20)}
    assert facts.javascript_facts(lines.where("false"), ["name", "kind"]).count() == 0


def test_python_imports_of_bodies_dont_count(spark):
    source = "import a\nif x:\n    import b\ndef f():\n    import no\n    if y:\n        from no import z\ntry:\n    from c import d\nexcept E:\n    async def g():\n        import no\nclass K:\n    import e\n    def m(self):\n        import no\n\n    import f\n"
    df = spark.createDataFrame([(1, source)], "file int, content string")
    assert sorted(r.module_name for r in facts.python_imports(text.lines(df, ["file"]), ["file"]).collect()) == ["a", "b", "c", "e", "f"]
    assert sorted(r.name for r in facts.python_facts(df, ["file"]).where(F.col("kind") == "import").collect()) == ["a", "b", "c", "e", "f"]


def test_files_share_batches_and_kinds_are_read_alone(spark):
    """Whole texts, lines, chosen kinds and remembered copies give the same; few batches leave a task."""
    from codecorpus.operators import javascript as j

    texts = ["import a from 'a';\nconst f = (x) => g(x);", "export { a as b } from './c';", "x = 1;", "", "function q() {}\r\nclass K { m() { return q(); } }", "const r = require('r');\n" * 3]
    texts = [texts[i % 6] + (f"\nh{i}();" if i % 4 == 0 else "") for i in range(300)]
    whole = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    rows = spark.createDataFrame([(i, k + 1, x) for i, t in enumerate(texts) for k, x in enumerate(t.splitlines())], "id int, line_no int, line string")
    shown = lambda df: sorted(map(str, df.collect()))
    for kinds in (("import", "require"), j.EXPORTS, j.SYMBOLS, ("call",)):
        want = shown(j.javascript_text_facts(whole, ["id"]).where(j_in(kinds)))
        assert want and shown(j.javascript_facts(whole, ["id"], kinds)) == want == shown(j.javascript_facts(rows, ["id"], kinds))
        assert [r for t in texts for r in j.reader(kinds)(t.replace("\r", ""))] == [r for t in texts for r in j._rows(t.replace("\r", "")) if r["kind"] in kinds]
    batches = []
    real, j._batch = j._batch, lambda *x: batches.append(1) or real(*x)
    try:
        run = captured(j, rows)  # the function that Spark would run, on lines of 300 files in one batch
        assert sum(b.num_rows for b in run(iter([pa_batch(rows)]))) == j.javascript_facts(rows, ["id"]).count() and len(batches) == 1
    finally:
        j._batch = real


def j_in(kinds):
    return "_kind in ({})".format(", ".join(f"'{k}'" for k in kinds))


def pa_batch(rows):
    import pyarrow as pa

    found = sorted(map(tuple, rows.collect()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found])], ["id", "line_no", "line"])


def captured(j, rows):
    """What javascript_facts gives to mapInArrow."""
    from unittest import mock

    with mock.patch("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, run, schema: run):
        return j.javascript_facts(rows, ["id"])


@pytest.mark.parametrize("text", ["a = 'x  ", "  ", "b(\n\n) ", "c ?.d ?.5 ?? e\\\n ", "'f\\\ng' h", "i\x1c j @k #l …"])
def test_plain_tokens_are_those_of_the_whole_reader(text):
    plain, whole = (javascript.Tokens.__new__(javascript.Tokens) for _ in range(2))
    for t in (plain, whole):
        t.source, t.kind, t.text, t.line, t.start, t.end = text, [], [], [], [], []
    whole._read(text)
    assert plain._read_plain(text)
    assert vars(plain) == vars(whole)
    assert not plain._read_plain("m / n") and not plain._read_plain("`o`") and plain._read_plain("'/p`'")


def test_equal_texts_come_together_and_each_row_has_its_facts(spark):
    texts = [f"import {{a}} from './m{i % 5}';\nfunction f{i % 5}(cb) {{ return cb(); }}" if i % 6 else None for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string").repartition(7)
    want = {(i, r["kind"], r["name"], r["line"]) for i, t in enumerate(texts) for r in javascript._rows(t or "")}
    for recurring in (True, False):
        found = javascript.javascript_text_facts(df, ["id"], recurring=recurring)
        assert {(r.id, r._kind, r._name, r._line) for r in found.collect()} == want
    at = javascript.javascript_facts(df, ["id"]).withColumn("part", F.spark_partition_id()).where("_kind = 'import'")
    assert at.groupBy("_name").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()


def test_only_what_may_import_is_looked_at(monkeypatch):
    seen = []
    monkeypatch.setattr(javascript.Facts, "_at", lambda self, i: seen.append(self.t.text[i]))
    javascript.reader(("import", "require"))("import a from 'b'; var c = 1; function d() {}")
    javascript.reader(("import", "require"))("exports.e = 1;")
    assert seen == ["import"]
