"""Facts of JavaScript and TypeScript texts: a lexer with state over lines gives tokens, and facts come from the tokens.

Quotes, templates with code in them, comments, regular expressions and brackets are told apart once, so that what stands
in a string is never code and statements may run over lines or share one. Whole texts are read where they lie; a file's
lines are sorted together by Spark and read in one pass, file after file. A task holds one file's tokens at a time. Texts
that recur may be brought together first, so that each is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.shipping import dealt, ship, uncollected

# -- fixed values --------------------------------------------------------------------------------------------------
BRANCHES = ("if", "for", "while", "do", "catch", "case")
LOGICAL = ("&&", "||", "??")
# ------------------------------------------------------------------------------------------------------------------

#: Words that open no call, whatever bracket follows them.
NO_CALL = frozenset("if for while switch catch return function class typeof new in of do else delete void throw await yield case instanceof with async super import export default extends var let const".split())
#: After these words a slash begins a regular expression.
BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
#: Words that begin what is read: all of them, and those that may import; variables only do where something is required.
STATEMENTS = frozenset("import export function class const let var module exports".split())
IMPORTING, REQUIRING = frozenset(("import", "export")), frozenset("import export const let var".split())
MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare accessor * export default".split())
OPEN, CLOSE = "([{", ")]}"
BRACKETS = frozenset(OPEN + CLOSE)
_token = re.compile(
    r"""(?P<space>[^\S\n]+|\n)
    |(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\A\#![^\n]*)
    |(?P<word>[\w$\u0080-￿\#@]+)
    |(?P<string>"(?:[^"\\\n]|\\(?s:.))*"?|'(?:[^'\\\n]|\\(?s:.))*'?)
    |(?P<mark>===|!==|==|!=|=>|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\.\.\.|(?s:.))""",
    re.VERBOSE,
)
#: A token with the white space before it, where no comment, pattern or template may be met: a slash or a backtick ends that.
_plain = re.compile(
    r"""[^\S\n]*+(?:(?P<word>[\w$\u0080-￿\#@]+)
    |(?P<string>"(?:[^"\\\n]|\\(?s:.))*"?|'(?:[^'\\\n]|\\(?s:.))*'?)
    |(?P<newline>\n)
    |(?P<end>\Z)
    |(?P<mark>===|!==|==|!=|=>|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\.\.\.|(?s:.)))""",
    re.VERBOSE,
)
_template = re.compile(r"(?:[^`\\$]|\\(?:(?s:.)|\Z)|\$(?!\{))*(`|\$\{|\Z)")
_pattern = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[\w$]*")


class Tokens:
    """kind (word, string, template, pattern, mark), text, line, place in the text, partner of each bracket, depth."""

    def __init__(self, text: str):
        self.source = text
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        if text.startswith("#!") or not self._read_plain(text):
            self._read(text)
        self.partner = partner = [-1] * len(self.text)
        self.depth, self.inside = [], []  # inside: the bracket that a token stands in
        depth, inside = self.depth.append, self.inside.append
        held: list[int] = []
        for i, (kind, x) in enumerate(zip(self.kind, self.text, strict=True)):
            bracket = kind == "mark" and x in BRACKETS
            if bracket and x in CLOSE and held and self.text[held[-1]] == OPEN[CLOSE.index(x)]:
                partner[i], partner[held[-1]] = held[-1], i
                held.pop()
            depth(len(held))
            inside(held[-1] if held else -1)
            if bracket and x in OPEN:
                held.append(i)

    def _add(self, kind: str, text: str, line: int, start: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)
        self.start.append(start)
        self.end.append(start + len(text))

    def _read_plain(self, text: str) -> bool:
        """What `_read` does, as long as no slash or backtick stands outside a string; False if one does."""
        kinds, texts, lines, starts, line = [], [], [], [], 1
        for m in _plain.finditer(text):
            kind = m.lastgroup
            if kind == "newline":
                line += 1
                continue
            if kind == "end":
                break
            x = m[kind]
            if x == "/" or x == "`":
                return False
            kinds.append(kind)
            texts.append(x)
            lines.append(line)
            starts.append(m.start(kind))
            if kind == "string" and "\n" in x:
                line += x.count("\n")
        self.kind, self.text, self.line, self.start = kinds, texts, lines, starts
        self.end = [a + len(x) for a, x in zip(starts, texts, strict=True)]
        return True

    def _read(self, text: str) -> None:
        at, line, n = 0, 1, len(text)
        templates: list[int] = []  # open braces since each `${`
        while at < n:
            m = None
            if text[at] == "`":
                at, line = self._template(text, at, at + 1, line, templates)
                continue
            if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and self._pattern_may_begin():
                m = _pattern.match(text, at)
                kind = "pattern"
            if m is None:
                m = _token.match(text, at)
                kind = m.lastgroup
            x = m[0]
            if kind == "mark" and templates:
                if x == "{":
                    templates[-1] += 1
                elif x == "}":
                    if not templates[-1]:
                        templates.pop()
                        self._add("mark", ")", line, at)
                        at, line = self._template(text, at, at + 1, line, templates)
                        continue
                    templates[-1] -= 1
            if kind not in ("space", "comment"):
                self._add(kind, x, line, at)
            line += x.count("\n")
            at = m.end()

    def _template(self, text: str, begin: int, at: int, line: int, templates: list[int]) -> tuple[int, int]:
        """A template's text from `at` on; code in it stands between round brackets."""
        m = _template.match(text, at)
        self._add("template", text[begin : m.end()], line, begin)
        line += text.count("\n", at, m.end())
        if m[1] == "${":
            templates.append(0)
            self._add("mark", "(", line, m.end() - 1)
        return m.end(), line

    def _pattern_may_begin(self) -> bool:
        if not self.text:
            return True
        kind, x = self.kind[-1], self.text[-1]
        return x in BEFORE_PATTERN if kind == "word" else kind == "mark" and x not in CLOSE

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] in ("word", "mark") and self.text[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word" and not self.text[i][0].isdigit()

    def begins(self, i: int) -> bool:
        """Whether a statement may begin at i."""
        return i == 0 or self.is_(i - 1, ";", "{", "}", ")", ":") or self.line[i] != self.line[i - 1] and not self.is_(i - 1, ",", "=", "=>", "(", "[", ".", "?.", "?", "&&", "||", "??")

    def slice(self, a: int, b: int) -> str:
        """The source of tokens a to b - 1, white space as one space."""
        return " ".join(self.source[self.start[a] : self.end[b - 1]].split()) if a < b else ""


def unquoted(x: str) -> str:
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] else x[1:]


def parsed_parameters(t: Tokens, first: int, stop: int) -> list[dict]:
    """name, annotation, default of the parameters between two brackets (their content: first to stop - 1)."""
    found, begin, depth = [], first, t.depth[first] if first < stop else 0
    for i in range(first, stop + 1):
        if i < stop and not (t.is_(i, ",") and t.depth[i] == depth):
            continue
        parts = {"name": None, "annotation": None, "default": None}
        cut = [k for k in range(begin, i) if t.depth[k] == depth and t.is_(k, ":", "=")]
        colon = next((k for k in cut if t.text[k] == ":"), None)
        equals = next((k for k in cut if t.text[k] == "="), None)
        if colon is not None and equals is not None and equals < colon:
            colon = None
        if begin < i:
            parts["name"] = t.slice(begin, min(x for x in (colon, equals, i) if x is not None)).rstrip(" ?")
            parts["annotation"] = t.slice(colon + 1, equals if equals is not None else i) if colon is not None else None
            parts["default"] = t.slice(equals + 1, i) if equals is not None else None
            found.append(parts)
        begin = i + 1
    return found


class Facts:
    """Rows of one file. Scopes (functions, methods, classes) are kept by their first and last token."""

    def __init__(self, text: str, counted: bool = True, words: frozenset[str] | None = None):
        self.t = Tokens(text)
        self.rows: list[dict] = []
        self.scopes: list[tuple[int, int, dict]] = []
        self.defined: set[int] = set()  # name tokens of definitions
        words = STATEMENTS if words is None else words
        for i, (kind, x) in enumerate(zip(self.t.kind, self.t.text, strict=True)):
            if kind == "word" and x in words:
                self._at(i)
        if counted:
            self._counted()

    def add(self, kind: str, name: str, line: int, **more) -> dict:
        row = {"kind": kind, "name": name, "line": line, "end_line": line, "qualified_name": name, "symbols": None, "is_async": None, "depth": None, "parameters": None, "complexity": None} | more
        self.rows.append(row)
        return row

    # -- statements ---------------------------------------------------------------------------------------------

    def _at(self, i: int) -> None:
        t, x = self.t, self.t.text[i]
        if x == "import" and t.begins(i) and t.inside[i] < 0:
            self._import(i)
        elif x == "export" and t.begins(i) and t.inside[i] < 0:
            self._export(i)
        elif x == "function" and not t.is_(i - 1, ".", "?."):
            self._function(i)
        elif x == "class" and not t.is_(i - 1, ".", "?.") and (t.word(i + 1) or t.is_(i + 1, "{")):
            self._class(i)
        elif x in ("const", "let", "var") and not t.is_(i - 1, ".", "?."):
            self._variables(i)
        elif x in ("module", "exports") and t.begins(i) and t.inside[i] < 0:
            self._assigned_export(i)

    def _clause(self, i: int) -> tuple[int, int] | None:
        """(end of the clause that begins at i, place of the source's string) of `clause from "source"`."""
        t = self.t
        while True:
            if t.is_(i, "{") and t.partner[i] > 0:
                i = t.partner[i] + 1
            elif t.is_(i, "*"):
                i += 3 if t.is_(i + 1, "as") else 1
            elif t.word(i) and not t.is_(i, "from"):
                i += 1
            else:
                return None
            if t.is_(i, "from") and i + 1 < len(t.text) and t.kind[i + 1] == "string":
                return i, i + 1
            if not t.is_(i, ","):
                return None
            i += 1

    def _import(self, i: int) -> None:
        t = self.t
        if i + 1 < len(t.text) and t.kind[i + 1] == "string":
            self.add("import", unquoted(t.text[i + 1]), t.line[i], symbols=[])
            return
        first = i + 2 if t.is_(i + 1, "type") and not t.is_(i + 2, ",", "from") else i + 1
        if found := self._clause(first):
            self.add("import", unquoted(t.text[found[1]]), t.line[i], symbols=[t.slice(first, found[0])])
        elif t.word(first) and t.is_(first + 1, "=") and t.is_(first + 2, "require") and t.is_(first + 3, "(") and first + 4 < len(t.text) and t.kind[first + 4] == "string":
            self.add("require", unquoted(t.text[first + 4]), t.line[i], symbols=[t.text[first]])

    def _export(self, i: int) -> None:
        t, k = self.t, i + 1
        default = t.is_(k, "default")
        k += default
        k += t.is_(k, "declare", "abstract")
        k += t.is_(k, "type") and t.is_(k + 1, "{", "*")
        asynchronous = t.is_(k, "async") and t.is_(k + 1, "function")
        k += asynchronous
        if t.is_(k, "function"):
            name = k + 1 + t.is_(k + 1, "*")
            self.add("export_default" if default else "export_function", t.text[name] if t.word(name) else "default", t.line[i])
            self.defined.add(-k - 1)
        elif t.is_(k, "class"):
            self.defined.add(-k - 1)
            self.add("export_class", t.text[k + 1] if t.word(k + 1) and t.text[k + 1] != "extends" else "default", t.line[i])
        elif default:
            alone = t.word(k) and (k + 1 >= len(t.text) or t.is_(k + 1, ";") or t.line[k + 1] != t.line[k])
            self.add("export_default", t.text[k] if alone and not t.is_(k, "async") else "default", t.line[i])
        elif t.is_(k, "{") and t.partner[k] > 0:
            part = k + 1
            for j in range(k + 1, t.partner[k] + 1):
                if t.is_(j, ",") or j == t.partner[k]:
                    if part < j:
                        self.add("export_variable", unquoted(t.text[j - 1]) if t.kind[j - 1] == "string" else t.text[j - 1], t.line[i])
                    part = j + 1
            if found := self._clause(k):
                self.add("import", unquoted(t.text[found[1]]), t.line[i], symbols=[t.slice(k, found[0])])
        elif t.is_(k, "*"):
            self.add("export_all", t.text[k + 2] if t.is_(k + 1, "as") and k + 2 < len(t.text) else "*", t.line[i])
            if found := self._clause(k):
                self.add("import", unquoted(t.text[found[1]]), t.line[i], symbols=[t.slice(k, found[0])])

    def _assigned_export(self, i: int) -> None:
        """exports.x = and module.exports =, at the top level."""
        t, k = self.t, i
        if t.is_(i, "module"):
            if not (t.is_(i + 1, ".") and t.is_(i + 2, "exports")):
                return
            k = i + 2
            if t.is_(k + 1, "="):
                self.add("export_default", "default", t.line[i])
                return
        if t.is_(k + 1, ".") and t.word(k + 2) and t.is_(k + 3, "="):
            self.add("export_variable", t.text[k + 2], t.line[i])

    # -- definitions --------------------------------------------------------------------------------------------

    def _exported(self, i: int) -> bool:
        """Whether the declaration at i belongs to an export statement."""
        t = self.t
        while t.is_(i - 1, "async", "default", "declare", "abstract"):
            i -= 1
        return t.is_(i - 1, "export")

    def _body(self, close: int) -> int:
        """The brace that opens the body behind a parameter list; a return type may stand between. Else -1."""
        t, k = self.t, close + 1
        if t.is_(k, ":"):
            k += 1
            while k < len(t.text) and not t.is_(k, "{", ";", "}", ")", "=>", "="):
                k = t.partner[k] + 1 if t.partner[k] > k else k + 1
        return k if t.is_(k, "{") and t.partner[k] > 0 else -1

    def _scope(self, kind: str, name: str, begin: int, brackets: int, end: int, **more) -> dict:
        t = self.t
        parameters = parsed_parameters(t, brackets + 1, t.partner[brackets]) if brackets >= 0 else None
        row = self.add(kind, name, t.line[begin], end_line=t.line[end] + t.text[end].count("\n"), depth=self._braces(begin), parameters=parameters, is_async=False, **more)
        self.scopes.append((begin, end, row))
        return row

    def _braces(self, i: int) -> int:
        t, n, k = self.t, 0, self.t.inside[i]
        while k >= 0:
            n += t.text[k] == "{"
            k = t.inside[k]
        return n

    def _function(self, i: int) -> None:
        t, name = self.t, i + 1 + self.t.is_(i + 1, "*")
        named = t.word(name)
        brackets = name + named
        if t.is_(brackets, "<"):
            while brackets < len(t.text) and not t.is_(brackets, "("):
                brackets += 1
        if not named or not t.is_(brackets, "(") or t.partner[brackets] < 0:
            return
        self.defined.add(name)
        body = self._body(t.partner[brackets])
        end = t.partner[body] if body >= 0 else t.partner[brackets]
        asynchronous = t.is_(i - 1, "async")
        begin = i - asynchronous
        self._scope("function", t.text[name], begin, brackets, end)["is_async"] = asynchronous
        if t.inside[i] < 0 and t.begins(begin) and not self._exported(i):
            self.add("export_function", t.text[name], t.line[begin])

    def _class(self, i: int) -> None:
        t = self.t
        named = t.word(i + 1) and t.text[i + 1] not in ("extends", "implements")
        name, k = t.text[i + 1] if named else "AnonymousClass", i + 1
        while k < len(t.text) and not t.is_(k, "{", ";"):
            k = t.partner[k] + 1 if t.partner[k] > k else k + 1
        if not t.is_(k, "{") or t.partner[k] < 0:
            return
        if named:
            self.defined.add(i + 1)
        row = self._scope("class", name, i, -1, t.partner[k])
        row["complexity"] = 1
        if t.inside[i] < 0 and t.begins(i) and not self._exported(i):
            self.add("export_class", name, t.line[i])
        j = k + 1
        while j < t.partner[k]:
            start, asynchronous = j, False
            while t.is_(j, *MODIFIERS) and not t.is_(j + 1, "(", "=", ";", "?", ":", "!"):
                asynchronous |= t.text[j] == "async"
                j += 1
            own = t.slice(j, t.partner[j] + 1) if t.is_(j, "[") and t.partner[j] > 0 else t.text[j]
            after = t.partner[j] + 1 if t.is_(j, "[") and t.partner[j] > 0 else j + 1
            if t.is_(after, "<"):
                while after < t.partner[k] and not t.is_(after, "("):
                    after += 1
            if (t.word(j) or t.kind[j] == "string" or t.is_(j, "[")) and t.is_(after, "(") and t.partner[after] > 0:
                body = self._body(t.partner[after])
                if t.word(j):
                    self.defined.add(j)
                if body >= 0:
                    method = self._scope("constructor" if own == "constructor" else "method", own, start, after, t.partner[body], qualified_name=f"{name}.{own}")
                    method["is_async"] = asynchronous
                    j = t.partner[body] + 1
                    continue
                j = t.partner[after] + 1
                continue
            # a field, a semicolon or something else: on to the next member
            while j < t.partner[k] and not t.is_(j, ";"):
                if t.partner[j] > j:
                    j = t.partner[j]
                j += 1
                if j < t.partner[k] and t.line[j] != t.line[j - 1] and not t.is_(j, "=", ".", "?.", "(", "?", ":", "+", "&&", "||") and not t.is_(j - 1, "=", "=>", ",", ".", "?", ":", "+", "&&", "||"):
                    break
            j += t.is_(j, ";") and j < t.partner[k]

    def _value_is_function(self, k: int) -> tuple[int, int, bool] | None:
        """(brackets or -1, last token, async) of an arrow or function expression that begins at k."""
        t, asynchronous = self.t, False
        if t.is_(k, "async") and not t.is_(k + 1, "=>"):
            asynchronous, k = True, k + 1
        if t.is_(k, "function"):
            b = k + 1
            while b < len(t.text) and not t.is_(b, "("):
                b += 1
            body = self._body(t.partner[b]) if b < len(t.text) and t.partner[b] > 0 else -1
            return (b, t.partner[body], asynchronous) if body >= 0 else None
        if t.is_(k, "(") and t.partner[k] > 0:
            arrow = t.partner[k] + 1
            if t.is_(arrow, ":"):
                while arrow < len(t.text) and not t.is_(arrow, "=>", ";", ",", ")", "}"):
                    arrow = t.partner[arrow] + 1 if t.partner[arrow] > arrow else arrow + 1
            brackets = k
        elif t.word(k):
            arrow, brackets = k + 1, -1
        else:
            return None
        if not t.is_(arrow, "=>"):
            return None
        if t.is_(arrow + 1, "{") and t.partner[arrow + 1] > 0:
            return brackets, t.partner[arrow + 1], asynchronous
        return brackets, self._expression_end(arrow + 1), asynchronous

    def _expression_end(self, k: int) -> int:
        """The last token of the expression that begins at k: before a comma, a semicolon, a closing bracket or a new statement."""
        t, first = self.t, k
        while k < len(t.text) and not t.is_(k, ",", ";", ")", "]", "}"):
            if k > first and t.line[k] != t.line[k - 1] and t.begins(k) and not t.is_(k, ".", "?.", "+", "-", "*", "/", "?", ":", "&&", "||", "??", "(", "[", "=", "==", "===", "!=", "!=="):
                break
            k = t.partner[k] + 1 if t.partner[k] > k else k + 1
        return max(first, k - 1) if first < len(t.text) else len(t.text) - 1

    def _variables(self, i: int) -> None:
        t, k = self.t, i + 1
        exported = self._exported(i)
        top = t.inside[i] < 0
        in_loop = t.inside[i] >= 0 and t.text[t.inside[i]] == "("
        while k < len(t.text):
            pattern = t.is_(k, "{", "[") and t.partner[k] > 0
            if not pattern and not t.word(k):
                return
            end = t.partner[k] if pattern else k
            name = t.slice(k, end + 1)
            equals = end + 1
            if t.is_(equals, "!"):
                equals += 1
            if t.is_(equals, ":"):  # a type
                while equals < len(t.text) and not t.is_(equals, "=", ",", ";", ")", "}") and (t.line[equals] == t.line[equals - 1] or not t.begins(equals)):
                    equals = t.partner[equals] + 1 if t.partner[equals] > equals else equals + 1
            last = equals - 1
            function = None
            if t.is_(equals, "="):
                function = self._value_is_function(equals + 1)
                last = max(function[1], self._expression_end(equals + 1)) if function else self._expression_end(equals + 1)
                if t.is_(equals + 1, "require") and t.is_(equals + 2, "(") and equals + 3 < len(t.text) and t.kind[equals + 3] == "string" and top:
                    self.add("require", unquoted(t.text[equals + 3]), t.line[i], symbols=[name])
            if function and not pattern:
                self._scope("function", name, k, function[0], function[1])["is_async"] = function[2]
            elif not in_loop:
                ends = max(k, min(last, len(t.text) - 1))
                self.add("variable", name, t.line[k], end_line=t.line[ends] + t.text[ends].count("\n"), depth=self._braces(i), is_async=False)
            if exported:
                self.add("export_function" if function and not pattern else "export_variable", name, t.line[i])
            if not t.is_(last + 1, ","):
                return
            k = last + 2

    # -- calls and branch points --------------------------------------------------------------------------------

    def _calls(self) -> Iterator[tuple[int, str]]:
        t = self.t
        for i in range(len(t.text) - 1):
            after = i + 2 if t.is_(i + 1, "?.") else i + 1
            if not t.word(i) or i in self.defined or not t.is_(after, "(") or t.text[i] in NO_CALL and not t.is_(i - 1, ".", "?."):
                continue
            first = i
            while t.is_(first - 1, ".", "?.") and t.word(first - 2):
                first -= 2
            dotted = t.is_(first - 1, ".", "?.")
            close = t.partner[after]
            if first == i and not dotted and close > 0 and t.is_(close + 1, "{") and not t.is_(i - 1, "new", "=", "return", "(") and t.inside[i] >= 0 and t.text[t.inside[i]] == "{":
                continue  # a method of an object
            yield first, "".join("." if t.text[k] == "?." else t.text[k] for k in range(first, i + 1))

    def _branches(self) -> Iterator[int]:
        t, ends = self.t, set()
        for i, (kind, x) in enumerate(zip(t.kind, t.text, strict=True)):
            if kind == "word" and x in BRANCHES and not t.is_(i - 1, ".", "?.") and not t.is_(i + 1, ":", "=", ","):
                if x == "do" and t.is_(i + 1, "{") and t.partner[i + 1] > 0:
                    ends.add(t.partner[i + 1] + 1)
                if x == "while" and i in ends:
                    continue
                yield i
            elif kind == "mark" and (x in LOGICAL or x == "?" and not t.is_(i + 1, ":", ")", ",", ";", "=") and not t.is_(i + 1, "?")):
                yield i

    def _counted(self) -> None:
        """Calls with the innermost function around them, and each function's branch points."""
        calls, branches = list(self._calls()), list(self._branches())
        events = sorted([(b, 0, s) for s, (b, _, _) in enumerate(self.scopes)] + [(e, 3, s) for s, (_, e, _) in enumerate(self.scopes)] + [(i, 1, -1) for i in branches] + [(i, 2, c) for c, (i, _) in enumerate(calls)])
        open_now: list[int] = []
        points = [0] * len(self.scopes)
        for at, what, which in events:
            if what == 0:
                open_now.append(which)
            elif what == 3:
                if which in open_now:
                    open_now.remove(which)
            elif what == 1:
                for s in open_now:
                    points[s] += 1
            else:
                caller = next((self.scopes[s][2]["qualified_name"] for s in reversed(open_now) if self.scopes[s][2]["kind"] != "class"), "")
                self.add("call", calls[which][1], self.t.line[at], qualified_name=caller)
        for (_, _, row), n in zip(self.scopes, points, strict=True):
            if row["kind"] != "class":
                row["complexity"] = n + 1
        self.points = len(branches)


PARAMETER = pa.struct([("name", pa.string()), ("annotation", pa.string()), ("default", pa.string())])
FACT = {"kind": pa.string(), "name": pa.string(), "qualified_name": pa.string(), "symbols": pa.list_(pa.string()), "is_async": pa.bool_(), "line": pa.int64(), "end_line": pa.int64(), "depth": pa.int32(), "parameters": pa.list_(PARAMETER), "complexity": pa.int32()}
SCHEMA = "_kind string, _name string, _qualified_name string, _symbols array<string>, _is_async boolean, _line bigint, _end_line bigint, _depth int, _parameters array<struct<name:string,annotation:string,default:string>>, _complexity int"


#: Facts that one batch of results holds, about.
BATCH_FACTS = 8192
#: Texts of at most so many characters whose facts a worker remembers, and how many of them: copies of a file are read once.
REMEMBERED_LENGTH, REMEMBERED = 4096, 4096
#: Texts that one task takes where equal ones come together, about.
TEXTS = 1 << 18
SYMBOLS = ("function", "method", "constructor", "class", "variable")
EXPORTS = ("export_function", "export_class", "export_variable", "export_default", "export_all")
KINDS = ("import", "require", *EXPORTS, *SYMBOLS, "call", "points")
#: Without such a word a text has no facts of these kinds, so its tokens aren't looked at.
_WORDS = {**dict.fromkeys(("import", "require"), "import|require|from"), **dict.fromkeys(EXPORTS, "export|function|class"), **dict.fromkeys(SYMBOLS, "function|class|const|let|var"), "call": r"\(", "points": ""}


def _columns(found: list[list[dict]]) -> list[pa.Array]:
    """Facts of texts, one text after another."""
    return [pa.array([r[c] for rows in found for r in rows], t) for c, t in FACT.items()]


def _batch(found: list[list[dict]], own: list[pa.Array], keys: list[str], bases: list[int] | None = None, places: list[int] | None = None) -> pa.RecordBatch:
    """Facts of texts as rows behind their keys; bases: each text's number of the line before the first; places: which text each
    row of keys has, if not its own."""
    sizes = np.array([len(rows) for rows in found], np.int64)
    which = np.arange(len(found)) if places is None else np.array(places, np.int64)
    each = sizes[which]
    row = np.repeat(np.arange(len(which)), each)
    within = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    at = pa.array((np.cumsum(sizes) - sizes)[which][row] + within)
    columns = dict(zip(FACT, _columns(found), strict=True))
    if places is not None:
        columns = {c: x.take(at) for c, x in columns.items()}
    if bases:
        added = pa.array(np.array(bases, np.int64)[row])
        columns |= {c: pc.add(columns[c], added) for c in ("line", "end_line")}
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([*[x.take(row) for x in own], *columns.values()], [*keys, *[f"_{c}" for c in FACT]])


def _rows(text: str, wanted: frozenset[str] = frozenset(KINDS)) -> list[dict]:
    words = None if wanted - {"import", "require"} else REQUIRING if "require" in text else IMPORTING
    with uncollected():
        found = Facts(text, bool(wanted - {"import", "require", *EXPORTS}), words)
    if "points" in wanted:
        found.add("points", "", 1, complexity=found.points + 1)
    return [r for r in found.rows if r["kind"] in wanted]


def reader(kinds: tuple[str, ...]):
    """A function that gives the facts of these kinds of a text."""
    wanted = frozenset(kinds)
    word = re.compile("|".join(sorted({_WORDS[k] for k in wanted}))) if "points" not in wanted else re.compile("")
    remembered = lru_cache(REMEMBERED)(lambda text: _rows(text, wanted))

    def read(text: str) -> list[dict]:
        if not word.search(text):
            return []
        return remembered(text) if len(text) <= REMEMBERED_LENGTH else _rows(text, wanted)

    return read


def javascript_text_facts(files: DataFrame, keys: list[str], text: str = "content", kinds: tuple[str, ...] = KINDS, recurring: bool = False) -> DataFrame:
    """What `javascript_facts` gives, of whole texts. A null text is the empty one. No shuffle, but with recurring, for texts of
    which many are equal: these come together first, and each is read once, however many rows have it."""
    ship(files.sparkSession)
    types = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(kinds)
        for batch in batches:
            texts = batch.column(n).dictionary_encode()
            different = texts.dictionary.to_pylist()
            found, places, known, first, held, rows = [], [], {}, 0, 0, 0
            for i, code in enumerate(texts.indices.to_pylist()):
                place = known.get(code)
                if place is None:
                    place = known[code] = len(found)
                    found.append(read("\n".join(("" if code is None else different[code]).splitlines())))
                    held += len(found[-1])
                places.append(place)
                rows += len(found[place])
                if held >= BATCH_FACTS or rows >= 4 * BATCH_FACTS:
                    yield _batch(found, [c.slice(first, len(places)) for c in batch.columns[:n]], keys, places=places)
                    found, places, known, first, held, rows = [], [], {}, i + 1, 0, 0
            if rows:
                yield _batch(found, [c.slice(first, len(places)) for c in batch.columns[:n]], keys, places=places)

    own = files.select(*keys, F.col(text).alias("_text"))
    if recurring:
        own = dealt(own.withColumn("_same", F.xxhash64("_text")), TEXTS, "_same").sortWithinPartitions("_same").drop("_same")
    return own.mapInArrow(run, f"{types}, {SCHEMA}")


def javascript_facts(rows: DataFrame, keys: list[str], kinds: tuple[str, ...] = KINDS, recurring: bool = True) -> DataFrame:
    """keys and _kind, _name, _qualified_name, _symbols, _is_async, _line, _end_line, _depth, _parameters, _complexity of each fact
    of these kinds.

    rows: lines (keys, line_no, line), or whole texts (keys, content; see `javascript_text_facts` on recurring). Kinds: import, require (top
    level; name: the source, symbols: the clause or variable), export_function, export_class, export_variable,
    export_default, export_all, function, method, constructor, class, variable, call (qualified_name: the innermost
    function around it, or ''), points (complexity: the whole file's branch points and 1). Lines that are missing are empty
    ones. Other columns are ignored. Files share the batches of results."""
    if "line_no" not in rows.columns:
        return javascript_text_facts(rows, keys, kinds=kinds, recurring=recurring)
    ship(rows.sparkSession)
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, own, held, last, base, kept = reader(kinds), None, [], 0, 0, []
        files, found, bases, facts = [], [], [], 0

        def end() -> None:
            nonlocal facts
            if own is not None and (new := read("\n".join(held))):
                files.append(own)
                found.append(new)
                bases.append(base)
                facts += len(new)

        def batch_of() -> pa.RecordBatch:
            return _batch(found, [pa.array(c, t) for c, t in zip(zip(*files, strict=True), kept, strict=True)], keys, bases)

        for batch in batches:
            kept = [batch.schema.field(i).type for i in range(n)]
            for *file, line_no, line in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if file != own:
                    end()
                    if facts >= BATCH_FACTS:
                        yield batch_of()
                        files, found, bases, facts = [], [], [], 0
                    own, held, base = file, [], line_no - 1
                    last = base
                if line_no - last > 1:
                    held += [""] * (line_no - last - 1)
                held.append(line or "")
                last = line_no
        end()
        if facts:
            yield batch_of()

    picked = rows.where("line_no is not null").select(*keys, "line_no", "line")
    return picked.repartition(*keys).sortWithinPartitions(*keys, "line_no").mapInArrow(run, f"{types}, {SCHEMA}")
