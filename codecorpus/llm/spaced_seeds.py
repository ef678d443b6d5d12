"""Benchmark decontamination with spaced seeds.

A seed is a mask over word positions: marked positions are hashed, the others may hold any word, so a copied passage
with substituted words is still hit wherever the substitutions fall on unmarked positions of some mask. Test hashes
meet training hashes in sorted order; on each hit's diagonal (this item against this place of the document) the equal
words are counted over the whole overlap. Items of up to LIGHT words are hit by lighter seeds too, which leave no leak
out: of one more piece of an item than it may have differing words, one is whole.

Documents are read once for each block of the benchmark and never shuffled. A block is bounded in bytes, whatever the
benchmark's size; it is the only thing that is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import common as c

U = np.uint64
#: Weight 8 each: one contiguous, three that leave substituted words out, four for each second to fifth word substituted.
MASKS = ("11111111", "110110010111", "111010011011", "1011011100011", "101010101010101", "11011011011", "1110111011", "111101111")
#: Items of fewer words can't be told from chance and take no part.
LEAST_WORDS = 8
#: A leak has this many equal words on a diagonal, or this share of a short item's.
EQUAL, SHARE = 13, 0.8
#: Items of up to so many words have light seeds: they may differ in 4 words at most.
LIGHT = 17
#: Hits of light seeds that are verified at a time.
HITS = 1 << 18
#: Text bytes of the benchmark that one pass over the documents holds.
BENCHMARK_BYTES = 8 << 20


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(len(mask)))
    for i, on in enumerate(mask):
        if on == "1":
            h = h * c.BASE + hashes[i : i + n]
    return c.mix(h)


def needed(n: int) -> int:
    """Equal words that a leak of an item of n words has at least."""
    return min(EQUAL, int(np.ceil(SHARE * n)))


class Block:
    """Items of the benchmark with the sorted hashes of all their positions under all masks."""

    def __init__(self, items: list[tuple[int, bytes]], light: bool = False):
        doc, _, _, words = c.words([t for _, t in items], c.NOT_ALNUM)
        cut = np.searchsorted(doc, np.arange(len(items) + 1))
        own = [(i, words[a:b]) for (i, _), a, b in zip(items, cut, cut[1:], strict=False) if b - a >= LEAST_WORDS]
        self.ids, self.words = [i for i, _ in own], [w for _, w in own]
        hashes, item, place = [], [], []
        for k, w in enumerate(self.words):
            for mask in MASKS:
                h = seed_hashes(w, mask)
                hashes.append(h)
                item.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        self.light: set[int] = set()
        self.padded = np.zeros((len(own), LIGHT), U)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([needed(len(w)) for w in self.words], np.int64)
        for k, w in enumerate(self.words):
            if light and len(w) <= LIGHT:
                pieces = len(w) - needed(len(w)) + 1
                q = len(w) // pieces
                self.light.add(q)
                self.padded[k, : len(w)] = w
                hashes.append(seed_hashes(w, "1" * q)[: pieces * q : q])
                item.append(np.full(pieces, k))
                place.append(np.arange(pieces) * q)
        joined = np.concatenate(hashes) if hashes else np.zeros(0, U)
        order = np.argsort(joined)
        self.hashes = joined[order]
        self.item, self.place = (np.concatenate(x)[order] if hashes else np.zeros(0, np.int64) for x in (item, place))
        self.bits = max(16, min(26, len(joined).bit_length() + 5))
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.hashes >> U(64 - self.bits)).astype(np.int64)] = True

    def leaks(self, doc: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document's index, item's index, first word in the item, words, equal words) of each verified overlap: the best of each document and item."""
        found = []
        for mask in (*MASKS, *("1" * q for q in sorted(self.light))):
            h = seed_hashes(words, mask)
            at = np.flatnonzero(self.there[(h >> U(64 - self.bits)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            first, sums = 0, np.cumsum(n)
            while first < len(n):  # parts of bounded memory
                end = max(first + 1, int(np.searchsorted(sums, sums[first] - n[first] + HITS, "right")))
                k = n[first:end]
                row = np.repeat(at[first:end], k)
                match = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[first:end], k)
                start, item = row - self.place[match], self.item[match]
                if mask not in MASKS:
                    good = self.equal(doc, words, doc[row], start, item) >= self.need[item]
                    row, start, item = row[good], start[good], item[good]
                if len(row):
                    found.append(np.stack([doc[row], item, start], 1))
                first = end
        if not found:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, start in np.unique(np.concatenate(found), axis=0).tolist():
            own = self.words[item]
            a, b = max(start, int(np.searchsorted(doc, d))), min(start + len(own), int(np.searchsorted(doc, d, "right")))
            first, n, equal = verify(words[a:b] == own[a - start : b - start])
            if equal >= needed(len(own)) and equal > best.get((d, item), (0, 0, 0))[2]:
                best[d, item] = first + a - start, n, equal
        return [(d, i, *x) for (d, i), x in best.items()]


    def equal(self, doc: np.ndarray, words: np.ndarray, d: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Equal words of each short item at its place of document d."""
        out = np.zeros(len(start), np.int64)
        for j in range(LIGHT):
            at = np.clip(start + j, 0, len(words) - 1)
            out += (j < self.size[item]) & (at == start + j) & (doc[at] == d) & (words[at] == self.padded[item, j])
        return out


def verify(equal: np.ndarray) -> tuple[int, int, int]:
    """Of a diagonal's overlap: first equal word, words to the last one, equal words."""
    at = np.flatnonzero(equal)
    return (int(at[0]), int(at[-1] - at[0] + 1), len(at)) if len(at) else (0, 0, 0)


def _blocks(benchmark: DataFrame):
    """Bounded blocks of (item_id, text), streamed to the driver one partition at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        items.append((row.item_id, row.text.encode()))
        size += len(items[-1][1])
        if size >= BENCHMARK_BYTES:
            yield items
            items, size = [], 0
    if items:
        yield items


LEAKS = "doc_id long, item_id long, item_word long, n_words long, n_equal long"
FOUND = f"rid long, {LEAKS}"


def leaks(docs: DataFrame, benchmark: DataFrame, light: bool = False) -> DataFrame:
    """doc_id, item_id, item_word, n_words, n_equal: each document and item that it overlaps, with the best overlap.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null texts, null item_ids and items
    under LEAST_WORDS words overlap with nothing; an empty benchmark gives no rows; a repeated row of docs gives its
    rows again. With `light`, items of up to LIGHT words have light seeds too and none of their leaks is left out; the
    query and `clean` set it. Very long texts are read like others, their hits verified in parts of bounded size. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    return _found(docs, benchmark, light).drop("rid")


def _found(docs: DataFrame, benchmark: DataFrame, light: bool) -> DataFrame:
    spark, out = docs.sparkSession, None
    for items in _blocks(benchmark):
        held = spark.sparkContext.broadcast(Block(items, light))

        def step(rows: list, texts: list[bytes], held=held) -> dict | None:
            doc, _, _, words = c.words(texts, c.NOT_ALNUM)
            found = held.value.leaks(doc, words)
            if not found:
                return None
            d, i, first, n, equal = zip(*found, strict=True)
            return {"rid": pa.array([rows[x]["rid"] for x in d], pa.int64()), "doc_id": pa.array([rows[x]["doc_id"] for x in d], pa.int64()), "item_id": [held.value.ids[x] for x in i], "item_word": first, "n_words": n, "n_equal": equal}

        rows = docs.select(F.struct(c.row_hash(docs).alias("rid"), docs["doc_id"].cast("long").alias("doc_id")).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        part = c.map_blocks(rows, step, FOUND, key="row")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap the benchmark, each by its own text whatever its doc_id. See `leaks` for odd rows and tables."""
    found = _found(docs, benchmark, light=True).select(F.col("rid").alias("_leak")).distinct()
    return docs.join(found, c.row_hash(docs) == found["_leak"], "left_anti")
