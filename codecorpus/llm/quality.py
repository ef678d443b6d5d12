"""Quality by hierarchical empirical Bayes.

A classifier gives each document its own evidence: surface counts, and how its hashed word and byte n-grams are spread
over the labelled documents' classes. Hosts and their paths add theirs: the mean evidence of a site's other documents,
drawn towards its parent's mean by a strength that the spread between sites says (empirical Bayes): a path towards its
host, a host towards all documents, so a site of few documents says hardly more than its parent. A document's posterior
log-odds are its own plus its path's against the global ones; its own evidence isn't counted again in its path's.

`documents` has no URLs: the host is `source`, the path below it `lang`.

The sites' sums are grouped aggregations with partial sums, over all documents; the classifier alone is fitted to a
bounded sample of labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import common as c

#: Labelled documents that the classifier is fitted to, at most.
FIT_ROWS = 20_000
#: Documents with a lower posterior are rejected.
REJECT_BELOW = 0.5
#: Sites' table is broadcast up to so many rows, about 10 MB.
BROADCAST_ROWS = 100_000

FEATURES = ("size", "upper", "digits", "marks", "symbols", "bars", "shouts", "foreign", "word_length", "stutter", "variety", "marked_words", "word_ratio", "byte_ratio")
#: Cells of each hashed n-gram table, and what is added to their counts.
CELLS, SMOOTH = 1 << 16, 1.0
#: Parts of a large site's rows in the join with its mean.
SALTS = 32

SURFACE = len(FEATURES) - 2
U = np.uint64

_class = np.zeros(256, np.int64)  # 0 others, then as below
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-?", b"#$%&*@^~+=<>{}[]\\/_`", b"|", b"!", b" \t\n\r\x0b\x0c"), 1):
    _class[list(_chars)] = _i
_class[128:] = 9


def ngrams(texts: list[bytes], words: tuple | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of words with their pairs, and of three following bytes: the text's index and the cell of each, by text."""
    doc, _, _, h = words or c.words(texts, c.SPACE)
    pair = doc[1:] == doc[:-1]
    d = np.concatenate([doc, doc[1:][pair]])
    cells = np.concatenate([h, c.mix(h[1:][pair] + h[:-1][pair] * c.BASE)]) >> U(48)
    order = np.argsort(d, kind="stable")
    size = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    inside = owner[:-2] == owner[2:]
    three = (((b[:-2] * 257 + b[1:-1]) * 257 + b[2:]) * np.uint32(2654435761) >> np.uint32(16))[inside]
    return [(d[order], cells[order].astype(np.int64)), (owner[:-2][inside], three.astype(np.int64))]


def evidence(texts: list[bytes], ratios: np.ndarray | None = None) -> np.ndarray:
    """Features of each text, as in FEATURES; ratios: log-odds of the cells of both tables. An empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    all_words = c.words(texts, c.SPACE)
    doc, first, end, words = all_words
    if ratios is not None:
        for j, (d, cells) in enumerate(ngrams(texts, all_words)):
            out[:, SURFACE + j] = np.bincount(d, ratios[j][cells], len(texts)) / np.maximum(1, np.bincount(d, minlength=len(texts)))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        if not text:
            continue
        n = np.bincount(_class[np.frombuffer(text, np.uint8)], minlength=10)
        ink = max(1, len(text) - int(n[8]))
        w = words[cut[i] : cut[i + 1]]
        size = end[cut[i] : cut[i + 1]] - first[cut[i] : cut[i + 1]]
        k = max(1, len(w))
        stutter = int((w[1:] == w[:-1]).sum()) / k
        last = _class[np.frombuffer(text, np.uint8)[end[cut[i] : cut[i + 1]] - 1]] if len(w) else np.zeros(0)
        marked = float(((last == 5) | (last == 7) | (last == 6)).mean()) if len(w) else 0.0
        out[i, :SURFACE] = [np.log1p(len(text)), n[1] / max(1, n[1] + n[2]), n[3] / ink, n[4] / ink, n[5] / ink, n[6] / ink, n[7] / ink, n[9] / ink, size.mean() if len(w) else 0, stutter, len(np.unique(w)) / k**0.8, marked]
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(np.column_stack([np.ones(len(z)), z, z * z]) @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression on features and their squares, by Newton steps. One class alone gives its prior."""
    if not len(y):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES) + 1))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    design = np.column_stack([np.ones(len(z)), z, z * z])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + penalty * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, quality and fold of at most `most` labels (those of the least hashes of doc_id) and their documents."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = c.clean_docs(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    return c.kept(own.select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")), "labelled")


def class_ratios(rows: DataFrame) -> np.ndarray:
    """For each fold and both folds, and each of the two tables: the log-odds of a good document's n-grams to fall into each cell."""

    def count(batches):
        n = np.zeros((2, 2, 2, CELLS), np.int64)  # fold, class, table
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in c.blocks(texts):
                y, fold = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (1, 2))
                for j, (d, cells) in enumerate(ngrams(texts.slice(a, b - a).to_pylist())):
                    at = (fold[d] * 2 + (y[d] > 0)) * CELLS + cells
                    n[:, :, j] += np.bincount(at, minlength=4 * CELLS).reshape(2, 2, CELLS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n.ravel()[used])], ["at", "n"])

    sums = rows.select("text", "quality", "fold").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most 8 * CELLS rows
    n = np.zeros(8 * CELLS)
    n[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy()
    n = n.reshape(2, 2, 2, CELLS)
    n = np.concatenate([n, n.sum(0, keepdims=True)])
    share = np.log((n + SMOOTH) / (n.sum(-1, keepdims=True) + SMOOTH * CELLS))
    return share[:, 1] - share[:, 0]


def fitted(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The classifier, fitted to at most `most` labelled documents. A document's n-grams are judged by the other fold's."""
    rows = labelled(docs, labels, most)
    ratios = class_ratios(rows)

    def describe(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in c.blocks(texts):
                own, fold = texts.slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_numpy()
                x = np.where((fold == 0)[:, None], evidence(own, ratios[1]), evidence(own, ratios[0]))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel())), batch.column(1).slice(a, b - a)], ["x", "quality"])

    pairs = rows.select("text", "quality", "fold").mapInArrow(describe, "x array<double>, quality int").toPandas()
    c.release(rows)
    model = fit(np.array(pairs["x"].tolist()).reshape(len(pairs), len(FEATURES)), pairs["quality"].to_numpy(np.float64))
    return Model(model.mean, model.scale, model.weights, ratios[2])


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """rid (see `common.row_hash`), doc_id, host, path and the classifier's log-odds of each row of docs; null sources and languages are empty names."""

    def run(batches):
        for batch in batches:
            texts = batch.column(4).cast(pa.binary())
            for a, b in c.blocks(texts):
                x = evidence(texts.slice(a, b - a).to_pylist(), model.ratios)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(4)], pa.array(model.log_odds(x))], ["rid", "doc_id", "host", "path", "odds"])

    wanted = docs.select(c.row_hash(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("host"), F.coalesce(F.col("lang"), F.lit("")).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return wanted.mapInArrow(run, "rid long, doc_id long, host string, path string, odds double")


def _shrunk(sites: DataFrame) -> DataFrame:
    """Adds k and m: a site's mean is drawn to its parent's (column up) by a strength k from the spread of all sites of its level.

    Strength is the within-site variance over the between-site variance (method of moments), from 1 to 1000 documents.
    """
    rate = F.col("s") / F.col("n")
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    between = F.sum(F.col("n") * (rate - F.col("up")) ** 2) / F.sum("n") - F.count(F.lit(1)) * within / F.sum("n")
    strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), within / F.greatest(between, F.lit(1e-9))))
    one = sites.agg(strength.alias("k"))  # one row
    return sites.crossJoin(F.broadcast(one)).withColumn("m", (F.col("s") + F.col("k") * F.col("up")) / (F.col("n") + F.col("k")))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, evidence (the classifier's probability), site (the mean of the path's other documents, drawn to
    its parents'), posterior, keep of each row of docs.

    A null or empty text has no features of its own and is judged like any other row of them; a very long one like any
    other. Without labels the classifier says 0.5 for all and nothing is rejected. Labels of unknown documents are
    ignored; of several labels of a document the largest counts. Repeated rows give repeated rows. Columns other than
    doc_id, text, source and lang are ignored, whatever their names. No rows give no rows.
    """
    return _scored(docs, labels).drop("rid")


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = c.kept(judged(docs, fitted(docs, labels)).withColumn("evidence", 1 / (1 + F.exp(-F.col("odds")))), "judged")
    p = F.col("evidence")
    paths = c.kept(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
    everything = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.coalesce(F.col("s") / F.col("n"), F.lit(0.5)).alias("up"))
    host_means = _shrunk(hosts.crossJoin(F.broadcast(everything))).select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), F.col("k").alias("hk"), F.col("up").alias("all"), F.col("m").alias("up"))
    sites = c.kept(_shrunk(paths.join(host_means, "host")).select("host", "path", "n", "s", "k", "hn", "hs", "hk", "all"), "sites")
    if sites.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(sites), ["host", "path"])
    else:  # a site may hold any share of the rows: they meet its mean in parts
        salted = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("_salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "_salt"])
    # without the document itself, at both levels
    host = (F.col("hs") - p + F.col("hk") * F.col("all")) / (F.col("hn") - 1 + F.col("hk"))
    site = (F.col("s") - p + F.col("k") * host) / (F.col("n") - 1 + F.col("k"))
    logit = lambda x: F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(1 - x, F.lit(1e-9)))
    odds = F.col("odds") + logit(F.col("site")) - logit(F.col("all"))
    return both.withColumn("site", site).withColumn("posterior", 1 / (1 + F.exp(-odds))).select("rid", "doc_id", "host", "path", "evidence", "site", "posterior", (F.col("posterior") >= REJECT_BELOW - 1e-9).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are rejected, each by its own text whatever its doc_id. See `score` for odd rows and tables."""
    bad = _scored(docs, labels).where("not keep").select(F.col("rid").alias("_bad")).distinct()
    return docs.join(bad, c.row_hash(docs) == bad["_bad"], "left_anti")
