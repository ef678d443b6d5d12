"""Personal data: high-recall candidates, gradient-boosted trees, calibrated thresholds.

Generators propose overlapping spans of a text: those of the fixed patterns and many looser ones. Boosted trees score
each from its format and the words around it; a threshold per kind, set on held-out candidates so that a wanted
precision holds, selects. Overlapping selected spans give way to the likelier one. Spans of the fixed patterns always
stay.

The trees are fitted to a bounded number of candidates of each kind, drawn by least hash from all texts and labelled by
the strict validators that the features don't contain; the thresholds come from histograms of the scores of all other
candidates. Texts are never shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import common as c

KINDS = ("email", "ip", "card", "phone", "secret")
#: Candidates of each kind that are drawn to fit the trees, at most. A third of them is held out.
FIT_CANDIDATES = 8000
#: Bins of a histogram of scores, which lie in 0 to 1.
BINS = 1 << 14
#: Partitions that the drawn candidates pass through on their way to the driver.
FEWER = 16
PRECISION = 0.97

# -- fixed patterns ------------------------------------------------------------------------------------------------

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match takes whole runs of digits, so it can begin where a run does only: one look at each run, however long.
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: around each @, as a scan by the whole pattern would find them but without trying every word."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
            a -= 1
        if a < at and (m := _domain.match(text, at + 1)):
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; failing matches are dropped, nothing is tried again."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _digit.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _card.finditer(text):
        if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


# -- candidates ----------------------------------------------------------------------------------------------------

GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.:][0-9]{1,4}){2,7}"),
    "card": re.compile(r"[0-9](?:[\x20./-]?[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|\(|00)?[0-9](?:[\x20().0-9-]{5,18})[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9+/_-]{16,128}"),
}
_hints = (("mail", "email", "contact"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "pay"), ("phone", "call", "tel", "fax", "mobile"), ("password", "token", "secret", "key", "passwd", "pwd"))


#: What an email's generator can't match without.
_at = re.compile(r"@|\(at\)|\[at\]|\sat\s")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of all generators. Each is left out only of texts without what its own pattern needs: an at sign or word, or a digit."""
    digit = _digit.search(text) is not None
    own = lambda kind: kind == "secret" or (digit if kind != "email" else _at.search(text) is not None)
    return [(kind, *m.span()) for kind, pattern in GENERATORS.items() if own(kind) for m in pattern.finditer(text)]


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and hints of its context; the validators' own checks are left out."""
    s = text[a:b]
    digits = only_digits(s)
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 8].lower()
    letters = sum(ch.isalpha() for ch in s)
    hexa = sum(ch in "0123456789abcdef" for ch in s)
    groups = re.findall(r"[0-9]+", s)
    lengths = [len(g) for g in groups] or [0]
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    odd = lambda x: bool(x) and (x.isalnum() or x in "_@.-/=")
    return [KINDS.index(kind), len(s), len(digits), letters, hexa / len(s), len(groups), max(lengths), min(lengths), switches / len(s), len(set(s)) / len(s), s.count("."), s.count("-"), s.count(" "), s.count("@"), s[0] == "+", s[0] == "(", odd(before[-1:]), odd(after[:1]), before.rstrip(" \"'")[-1:] in ("=", ":"), float(digits[:1] or -1), float(digits[1:2] or -1), *[any(h in before for h in hints) for hints in _hints]]


_secret_context = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?$", re.IGNORECASE)


def label(text: str, kind: str, a: int, b: int) -> bool:
    """What strict rules say of a candidate, for fitting."""
    s = text[a:b]
    digits = only_digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isdigit() and small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return (s[0] in "+(" or s.startswith("00")) and 8 <= len(digits) <= 15
    return bool(_secret_context.search(text[max(0, a - 24) : a])) or bool(re.fullmatch(r"[0-9a-f]{32,64}", s) and sum(x.isdigit() for x in s) > 6)


# -- trees ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Complete binary tree: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node - len(self.feature)]


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float) -> Tree:
    """One boosting step: the split of most gain at each node, from histograms of gradients."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for k in range(inner):
        rows = np.flatnonzero(node == k)
        best, g, h = 1e-6, gradient[rows].sum(), hessian[rows].sum()
        for f in range(x.shape[1]):
            bins = len(edges[f]) + 1
            if bins < 2 or len(rows) < 8:
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], bins))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], hessian[rows], bins))[:-1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            j = int(gain.argmax())
            if gain[j] > best:
                best, feature[k], cut[k] = gain[j], f, edges[f][j]
        node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
    leaf = node - inner
    value = np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + ridge)
    return Tree(feature, cut, value)


@dataclass(frozen=True)
class Boosted:
    prior: float
    trees: tuple[Tree, ...]
    rate: float
    thresholds: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, held: np.ndarray | None = None) -> Boosted:
    """Boosted trees on two thirds of the candidates; on the others the lowest threshold of each kind that keeps PRECISION.

    Kinds without held-out positives get a threshold that nothing reaches. `held` marks the candidates to hold out.
    """
    never = (2.0,) * len(KINDS)
    if len(y) < 30 or y.all() or not y.any():
        return Boosted(0.0, (), rate, never)
    held = np.arange(len(y)) % 3 == 0 if held is None else held
    own, z = x[~held], y[~held].astype(float)
    if not len(z) or z.all() or not z.any():
        return Boosted(0.0, (), rate, never)
    edges = [np.unique(np.quantile(own[:, f], np.linspace(0, 1, 33)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, own[:, f], "left") for f, e in enumerate(edges)], 1)
    prior = float(np.log(z.mean() / (1 - z.mean())))
    logit, trees = np.full(len(z), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        trees.append(grow(own, binned, edges, z - p, p * (1 - p), depth, ridge))
        logit += rate * trees[-1].predict(own)
    model = Boosted(prior, tuple(trees), rate, never)
    p, thresholds = model.scores(x[held]), []
    for k in range(len(KINDS)):
        mine = x[held][:, 0] == k
        order = np.argsort(-p[mine], kind="stable")
        hits = y[held][mine][order]
        good = np.flatnonzero(np.cumsum(hits) / np.arange(1, len(hits) + 1) >= PRECISION) if len(hits) else []
        thresholds.append(max(0.5, float(p[mine][order][good[-1]])) if len(good) and hits[: good[-1] + 1].sum() >= 5 else 2.0)
    return Boosted(prior, tuple(trees), rate, tuple(thresholds))


def spans(texts: list[str], model: Boosted, bases: list | None = None) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind and start: those of the fixed patterns (bases, if known), and selected others that overlap none of them. The texts' candidates are scored at once."""
    bases = [base_spans(t) for t in texts] if bases is None else bases
    if not model.trees:
        return bases
    proposed = [[x for x in candidates(t) if x not in base] for t, base in zip(texts, map(set, bases), strict=True)]
    rows = [describe(t, *x) for t, own in zip(texts, proposed, strict=True) for x in own]
    if not rows:
        return bases
    scores = model.scores(np.array(rows, float))
    cut = np.cumsum([len(own) for own in proposed])[:-1]
    return [selected(base, own, p, model) if own else base for base, own, p in zip(bases, proposed, np.split(scores, cut), strict=True)]


def selected(base: list[tuple[str, int, int]], proposed: list[tuple[str, int, int]], p: np.ndarray, model: Boosted) -> list[tuple[str, int, int]]:
    """The fixed spans and those of the proposed ones that their scores select, likeliest first."""
    least = np.array([model.thresholds[KINDS.index(kind)] for kind, _, _ in proposed])
    starts, ends = [], []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    extra = []
    for i in np.argsort(-p, kind="stable").tolist():
        _, a, b = proposed[i]
        at = bisect.bisect_left(ends, a + 1)  # the first that ends behind a
        if p[i] >= least[i] and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            extra.append(proposed[i])
    return sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# -- over tables ---------------------------------------------------------------------------------------------------


def place(doc_id: int | None, text: str, kind: str, a: int, b: int) -> int:
    """A candidate's 63-bit hash by its row, place and surroundings: it orders candidates alike however the table is dealt out."""
    near = text[max(0, a - 24) : b + 8].encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(f"{doc_id} {kind} {a} {b} ".encode() + near, digest_size=8).digest(), "little") >> 1


DRAWN = "kind int, hash long, x array<double>, y boolean"


def _least(found: dict[int, list], most: int) -> None:
    for k, rows in found.items():
        rows.sort(key=lambda r: (r[0], r[1]))
        del rows[most:]


def _drawn_batches(found: dict[int, list]):
    rows = [(k, *r) for k, own in found.items() for r in own]
    for i in range(0, len(rows), 4096):
        k, h, x, y = zip(*rows[i : i + 4096], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], ["kind", "hash", "x", "y"])


def drawn(docs: DataFrame, most: int) -> DataFrame:
    """kind, hash, features and label of the `most` candidates of least hash of each kind, over all texts: each partition keeps its own least, then the least of several are merged."""

    def draw(batches):
        found: dict[int, list] = {k: [] for k in range(len(KINDS))}
        bound = [1 << 63] * len(KINDS)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in candidates(t):
                    k = KINDS.index(x[0])
                    if (h := place(i, t, *x)) <= bound[k]:
                        found[k].append((h, describe(t, *x), label(t, *x)))
                        if len(found[k]) >= 2 * most:
                            _least({k: found[k]}, most)
                            bound[k] = found[k][-1][0]
        _least(found, most)
        yield from _drawn_batches(found)

    def merge(batches):
        found: dict[int, list] = {k: [] for k in range(len(KINDS))}
        for batch in batches:
            for k, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found[k].append(tuple(row))
                if len(found[k]) >= 2 * most:
                    _least({k: found[k]}, most)
        _least(found, most)
        yield from _drawn_batches(found)

    own = c.clean_docs(docs).mapInArrow(draw, DRAWN)
    return own.repartition(FEWER, "hash").mapInArrow(merge, DRAWN).repartition(1).mapInArrow(merge, DRAWN)


HISTOGRAM = "kind int, bin int, n long, hits long"


def histogram(docs: DataFrame, model: Boosted, bounds: list[int]) -> DataFrame:
    """kind, bin, n, hits: scores of all candidates that the trees weren't fitted to, and how many of them the rules affirm.

    bounds has for each kind the greatest hash of those drawn; a third of the drawn ones (by hash) is held out.
    """

    def count(batches):
        n, hits = np.zeros((2, len(KINDS) * BINS), np.int64)
        for batch in batches:
            texts = batch.column(1)
            for first, end in c.blocks(texts.cast(pa.binary())):
                rows, at, good = [], [], []
                for i, t in zip(batch.column(0).slice(first, end - first).to_pylist(), texts.slice(first, end - first).to_pylist(), strict=True):
                    for x in candidates(t):
                        k = KINDS.index(x[0])
                        h = place(i, t, *x)
                        if h > bounds[k] or h % 3 == 0:
                            rows.append(describe(t, *x))
                            at.append(k)
                            good.append(label(t, *x))
                if rows:
                    bins = np.array(at) * BINS + np.minimum((model.scores(np.array(rows, float)) * BINS).astype(np.int64), BINS - 1)
                    n += np.bincount(bins, minlength=len(n))
                    hits += np.bincount(bins[np.array(good)], minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used // BINS, pa.int32()), pa.array(used % BINS, pa.int32()), pa.array(n[used]), pa.array(hits[used])], ["kind", "bin", "n", "hits"])

    return c.clean_docs(docs).mapInArrow(count, HISTOGRAM).groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def calibrated(model: Boosted, rows: list) -> Boosted:
    """The model with the lowest threshold of each kind that keeps PRECISION over a histogram's rows."""
    thresholds = []
    for k in range(len(KINDS)):
        own = sorted((r for r in rows if r["kind"] == k), key=lambda r: -r["bin"])
        n, hits = (np.cumsum([r[name] for r in own], dtype=np.int64) for name in ("n", "hits"))
        good = np.flatnonzero((hits >= PRECISION * n) & (hits >= 5))
        thresholds.append(max(0.5, own[good[-1]]["bin"] / BINS) if len(good) else 2.0)
    return replace(model, thresholds=tuple(thresholds))


def fitted(docs: DataFrame, most: int = FIT_CANDIDATES) -> Boosted:
    """The model of at most `most` candidates of each kind, drawn from all texts, with thresholds over all the others.

    Kinds with fewer than 5 other candidates that the rules affirm, in the whole table, get a threshold that nothing reaches.
    """
    found = drawn(docs, most).toPandas().sort_values(["hash", "kind"], kind="stable")
    x = np.array(found["x"].tolist(), float) if len(found) else np.zeros((0, 1))
    hashes, kinds = found["hash"].to_numpy(np.int64), found["kind"].to_numpy()
    model = fit(x, found["y"].to_numpy(bool), held=hashes % 3 == 0)
    if not model.trees:
        return model
    bounds = [int(hashes[kinds == k].max(initial=-1)) for k in range(len(KINDS))]
    return calibrated(model, histogram(docs, model, bounds).collect())


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and spans (all) of each row of docs: kind, start, end in characters.

    A null or empty text has none. Repeated rows give repeated rows. A very long text takes time in proportion. Columns other
    than doc_id and text are ignored, whatever their names. No rows give no rows. Without a model one is fitted to docs.
    """
    model = model or fitted(docs)
    named = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]

    def step(ids: list, texts: list[bytes]) -> dict:
        texts = [t.decode() for t in texts]
        bases = [base_spans(t) for t in texts]
        return {"doc_id": pa.array(ids, pa.int64()), "base": pa.array([named(s) for s in bases], _span), "spans": pa.array([named(s) for s in spans(texts, model, bases)], _span)}

    return c.map_blocks(c.clean_docs(docs), step, SCHEMA)


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars (where docs has it) of the new text. Null texts stay null."""
    model = model or fitted(docs)

    def run(batches):
        for batch in batches:
            out, column = [], batch.column(batch.schema.get_field_index("text"))
            for first, end in c.blocks(column.cast(pa.binary())):
                texts = column.slice(first, end - first).to_pylist()
                for t, found in zip(texts, spans([t or "" for t in texts], model), strict=True):
                    parts, at = [], 0
                    for k, a, b in sorted(found, key=lambda s: (s[1], s[2])):
                        if a >= at:
                            parts += [t[at:a], f"[{k.upper()}]"]
                        at = max(at, b)
                    out.append(None if t is None else "".join([*parts, t[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def joined(column: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
