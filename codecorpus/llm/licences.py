"""Licence scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates the
and/or/with expression behind a tag.

Texts stay where they are read: no shuffle, one small automaton in each Python worker.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from codecorpus.llm import common as c

#: Phrases (words, consecutive) and their labels. BASE is the contract's.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "bsd license": "bsd",
    "isc license": "isc",
    "all rights reserved": "proprietary",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "attribution noncommercial": "cc-by-nc",
    "attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "boost software license": "bsl",
    "python software foundation license": "psf",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "gpl version 2": "gpl",
    "gpl version 3": "gpl",
    "apache 2 0 license": "apache",
    "apache 2 0 licensed": "apache",
    "apache 2 licensed": "apache",
    "mit licensed": "mit",
    "isc licensed": "isc",
    "bsd licensed": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "zlib license": "zlib",
    "mpl 2 0": "mpl",
}
TAG = "spdx license identifier"
#: Families of identifiers in expressions, each by all of its identifiers.
_GNU = r"(?:-?v?[0-9]+(?:\.[0-9]+)*)?(?:-only|-or-later|\+)?"
FAMILIES = {
    "mit": r"mit(?:-[0-9]+|-advertising|-cmu|-enna|-feh|-festival|-khronos-old|-modern-variant|-open-group|-testregex|-wu)?",
    "apache": r"apache(?:-?v?[0-9]+(?:\.[0-9]+)*)?\+?",
    "agpl": "agpl" + _GNU,
    "lgpl": "lgpl" + _GNU,
    "gpl": "gpl" + _GNU,
    "bsd": r"0bsd|bsd(?:-[0-9]-clause(?:-[a-z0-9]+)*)?",
    "mpl": r"mpl(?:-[0-9.]+)?\+?(?:-no-copyleft-exception)?",
    "epl": r"epl(?:-[0-9.]+)?\+?",
    "cc-by-nc": r"cc-by-nc(?:-[0-9.]+(?:-[a-z]+)?|-sa(?:-[0-9.]+)?(?:-[a-z]+)?|-nd(?:-[0-9.]+)?(?:-[a-z]+)?)?",
    "cc-by-nd": r"cc-by-nd(?:-[0-9.]+(?:-[a-z]+)?)?",
    "cc-by-sa": r"cc-by-sa(?:-[0-9.]+(?:-[a-z]+)?)?",
    "cc-by": r"cc-by(?:-[0-9.]+(?:-[a-z]+)?)?",
    "cc0": r"cc0(?:-[0-9.]+)?",
    "isc": r"isc(?:-veillard)?",
    "unlicense": r"unlicense",
    "zlib": r"zlib(?:-acknowledgement)?",
}
#: Families and single identifiers (without version) that ask for no more than notices.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "unlicense", "zlib"}
PERMISSIVE_IDS = frozenset("afl artistic beerware blueoak bsl curl fsfap fsful hpnd icu ijg libpng libtiff ms-pl mulanpsl ncsa ntp openssl pddl php postgresql psf python tcl unicode-3 unicode-dfs upl vim w3c wtfpl x11 xfree86 xnet zpl".split())
_version = re.compile(r"(?:-v?[0-9][0-9.]*)+\+?$")
#: What may stand behind `with`: exceptions, by their last words.
_exception = re.compile(r"(?:[a-z0-9.+]+-)*exception(?:-[0-9.]+)?|linux-syscall-note|gpl-cc-1\.0|shl-2\.[01]|additionref-[a-z0-9.-]+")
PRECEDENCE = {"or": 1, "and": 2}
#: SPDX identifiers that have neither a digit nor a hyphen, so that only their names tell them from prose.
BARE = frozenset("aal abstyles adsl afmparse aladdin aml ampas apafml barr beerware blessing caldera catharon clartistic clips crossword crystalstacker cube curl diffmark dotseqn dsdp dtoa dvipdfm entessa epics etalab eurosym fsfap fsful ftl furuseth fwlw giftware glide glulxe gnuplot gtkbook haskellreport hdparm hpnd htmltidy icu ijg imagemagick imatix intel ipa jam jpnic jplicense json kastrup leptonica libpng libtiff lsof magaz mailprio maketindex miros motosoto mtll mup naist naumen ncsa netcdf newsletr ngpl nlpl nokia noweb nrl ntp oclc ogtsl oldap openpbs openssl padl php pixar plexus postgresql psfrag psutils python qhull radvd rdisc ruby saxpath scea schemereport sendmail sissl sleepycat smppl snia snprintf softsurfer soundex spl swl swrule symlinks tcl tgppl threeparttable tmate tosl ttwl ucar ulem unixcrypt upl vim vostrom wsuipa wtfpl xerox xfig xinetd xlock xnet xpp xskat xzoom zed zeeff".split())
#: An unknown identifier has a version, or names itself a reference; one with a hyphen alone only where a whole line is an expression.
_identifier = re.compile(r"(?=[^a-z]*[a-z])[a-z0-9][a-z0-9._+-]*-v?[0-9][a-z0-9._+-]*|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_hyphened = re.compile(r"(?=[^a-z]*[a-z])[a-z0-9][a-z0-9._+]*(?:-[a-z0-9._+]+)+")
_family = re.compile("|".join(f"(?P<_{i}>{p})" for i, p in enumerate(FAMILIES.values())))
_names = list(FAMILIES)
_word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_rest = re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
_token = re.compile(r"[()]|(?<=[a-z0-9.+])/(?=[a-z0-9(])|[^\s()/]+|/")

_to_space = bytes(0x20 if c.NOT_ALNUM[b] else b for b in c.LOWER)


def licence(token: str, loose: bool = False) -> str | None:
    """The family of an identifier, an unknown identifier's own name, None for what isn't one."""
    family = _family.fullmatch(token)
    if family:
        return _names[int(family.lastgroup[1:])]
    return token if token in BARE or _identifier.fullmatch(token) or loose and _hyphened.fullmatch(token) else None


def permissive(name: str) -> bool:
    return name in PERMISSIVE or _version.sub("", name) in PERMISSIVE_IDS


def parse(text: str, loose: bool = False) -> tuple[tuple[set[str], bool] | None, bool]:
    """The longest beginning of a text that is an expression (None if there is none), and whether it is the whole text. One pass.

    Operands and operators go through a shunting yard: `with` binds closest, then `and`, then `or`; parentheses group, and a
    slash between two identifiers is an `or`. Behind `with` stands an exception, or the expression ends before it. Unknown
    identifiers are operands too, and not permissive; `loose` takes any hyphenated name for one.
    """
    names: list[str] = []  # of all operands so far
    values: list[bool] = []
    pending: list[str] = []
    opened = 0
    best: tuple[int, bool] | None = None  # operands of the longest expression so far, and whether it is permissive
    whole = False

    def both(op: str, left: bool, right: bool) -> bool:
        return left and right if op == "and" else left or right

    def reduce(least: int) -> None:
        while pending and PRECEDENCE.get(pending[-1], 0) >= least:
            right = values.pop()
            values[-1] = both(pending.pop(), values[-1], right)

    def complete() -> None:
        nonlocal best, whole
        if not opened:  # at most an `or` and an `and` are pending
            free = values[-1]
            for op, left in zip(reversed(pending), reversed(values[:-1]), strict=True):
                free = both(op, left, free)
            best, whole = (len(names), free), True

    operand, exception = True, False
    for m in _token.finditer(text.lower()):
        token, whole = m[0], False
        bare = token.rstrip(".,;:*->\"'")
        if token == "/":
            token = bare = "or"
        if exception:  # only loosens the licence that it stands with
            if not _exception.fullmatch(bare):
                break
            exception = False
            complete()
        elif operand and token == "(":
            pending.append(token)
            opened += 1
            continue
        elif operand and token not in PRECEDENCE and token not in (")", "with"):
            if not bare or not (name := licence(bare, loose)):
                break
            names.append(name)
            values.append(permissive(name))
            operand = False
            complete()
        elif not operand and token == "with":
            exception = True
            continue
        elif not operand and token in PRECEDENCE:
            reduce(PRECEDENCE[token])
            pending.append(token)
            operand = True
            continue
        elif not operand and token == ")" and opened:
            reduce(1)
            pending.pop()
            opened -= 1
            complete()
            continue
        else:
            break
        if bare != token and token != ")":  # punctuation ends the expression
            whole = whole and not text[m.end() :].strip()
            break
    return (None if best is None else (set(names[: best[0]]), best[1])), whole


def expression(text: str) -> tuple[set[str], bool] | None:
    """The licences that an expression names, and whether it can be met by permissive ones alone; None if it isn't one."""
    found, whole = parse(text, True)
    return found if whole else None


def leading_expression(line: str) -> tuple[set[str], bool] | None:
    """The longest beginning of a line that is an expression: prose may follow a tag. A hyphenated name without a version is an
    identifier only if the whole line is an expression."""
    return expression(line) or parse(line)[0]


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes) -> dict:
    """One text's words, hits and labels. Words are runs of digits, letters a-z and bytes from 128 after lower-casing."""
    words = text.translate(_to_space).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    hits: dict[str, list[int]] = {}
    if words:
        last_at, last_word = 0, 0
        for end, phrase in automaton().iter(joined):
            start = end - len(phrase) - 1  # of the space before the phrase
            last_word += joined.count(" ", last_at, start) if start >= last_at else -joined.count(" ", start, last_at)
            last_at = start
            hits.setdefault(phrase, []).append(last_word)
    base = {p: w for p, w in hits.items() if p in BASE}
    labels = {BASE[p] for p in base} | {NOTICES[p] for p in hits if p in NOTICES}
    base_labels = {BASE[p] for p in base}
    expressions, free = 0, None
    if TAG in hits:
        # what stands behind each tag that the automaton found, to the end of its line
        ends = [m.end() for m in _word.finditer(text)]
        for first in hits[TAG]:
            line = _rest.match(text, ends[first + TAG.count(" ")])[1].decode("utf-8", "replace")
            if found := leading_expression(line.lower()):
                expressions += 1
                labels |= found[0] - {""}
                free = found[1] if free is None else free and found[1]
    places = sorted(w for x in base.values() for w in x)
    notices = sum(len(w) for p, w in hits.items() if p in NOTICES)
    miss = 0.5 ** len(places) * 0.6**notices * 0.1**expressions  # each finding leaves less doubt
    return {"n_words": len(words), "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None, "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": 1 - miss, "n_expressions": expressions, "permissive": free}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, permissive boolean"


def scan_licences(docs: DataFrame) -> DataFrame:
    """Per row of docs: words, places of the base phrases, labels and a score in 0 to 1.

    A null or empty text has no words and no labels (empty strings), null places and score 0. Repeated rows give repeated
    rows, very long texts one row like others. Columns other than doc_id and text are ignored, whatever their names. No
    rows give no rows.
    """
    types = {"first_word": pa.int64(), "last_word": pa.int64(), "permissive": pa.bool_()}

    def step(ids: list, texts: list[bytes]) -> dict:
        found = [scan(t) for t in texts]
        return {"doc_id": pa.array(ids, pa.int64())} | {k: pa.array([f[k] for f in found], types.get(k)) for k in found[0]}

    return c.map_blocks(c.clean_docs(docs), step, SCHEMA)
