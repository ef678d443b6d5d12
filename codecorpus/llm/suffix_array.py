"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a string of LENGTH bytes covers it that also starts anywhere else in the corpus. Equal strings must meet
in one suffix array, and a corpus has no single one; so strings are dealt to shards by what they contain. Each string of
LENGTH bytes has an anchor, the least (then leftmost) hash of its GRAM-byte grams: equal strings have it at the same
place. The starts with one anchor are neighbours; cut in two by where the anchor stands, they all hold the same core
around it (GRAM bytes and half of the rest), whose hash is their key. A run of starts with its bytes is a context. Keys
that occur once go in the first aggregation, contexts that are equal as a whole are repeated as a whole, and one of each
is kept for the others.

The contexts of a key go to one shard, many keys to a shard. There suffixes are classified, leftmost-smaller substrings
sorted and named, the string of names sorted recursively in the same way, the array induced from it in two linear
passes, and the permuted common prefixes computed from the irreducible ones: neighbours with a common prefix of LENGTH
are repeated strings. Keys with more contexts than one shard takes are resolved exactly by aggregating their strings'
hashes.

Shorter repeats stay, but are counted: the cores of all strings of SHORT bytes that stand at another place as well. A
passage of SHORT bytes or more that repeats always has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import common as c

U = np.uint64
#: Bytes of the strings that are removed, and of those whose repeated cores are counted.
LENGTH, SHORT = 400, 256
GRAM = 32
#: Bytes of context that make one suffix array.
SHARD_BYTES = 1 << 20
#: Contexts of one key that may meet in one array: about 5 MB.
HOT = 8192
#: Slots of an array that are looked through at once for the next open one; so few are taken one by one.
AHEAD, FEW = 4096, 16
#: A longer text is scanned in pieces that overlap by LENGTH - 1.
PIECE = 1 << 24

# -- the suffix array ----------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True: the suffix is smaller than the next one. The last symbol is the only least one."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(n, bool)
    out[: n - 1] = (t[:-1] < t[1:])[change[np.searchsorted(change, np.arange(n - 1))]]
    return out


def _grouped(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted symbols: each one's number within its group, the groups' symbols and their sizes."""
    n = len(symbols)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
    at = first.nonzero()[0]
    size = np.empty(len(at), np.int64)
    np.subtract(at[1:], at[:-1], out=size[:-1])
    size[-1] = n - at[-1]
    return np.arange(n) - at.repeat(size), symbols[at], size


def _pass(t: np.ndarray, small: np.ndarray, kind: bool, out: np.ndarray, is_open: np.ndarray, free: np.ndarray, step: int) -> None:
    """Fills the open slots of one type: up (step 1) from each bucket's first free slot on, or down (-1) from its last one.

    As many slots are taken at once as are filled, up to the next open one, which one of these fills."""
    n = len(t)
    at = 0 if step > 0 else n - 1  # the next slot, in the pass's order
    done = 0
    while done < n:
        window = is_open[at : at + AHEAD] if step > 0 else is_open[max(0, at + 1 - AHEAD) : at + 1][::-1]
        k = int(window.argmax()) or len(window)
        p = out[at : at + k] if step > 0 else out[at + 1 - k : at + 1][::-1]
        at += step * k
        done += k
        if k <= FEW:
            for q in p.tolist():
                if q > 0 and small[q - 1] == kind:
                    symbol = t[q - 1]
                    slot = free[symbol]
                    out[slot] = q - 1
                    is_open[slot] = False
                    free[symbol] = slot + step
            continue
        p = p[p > 0] - 1
        p = p[small[p] == kind]
        if len(p):
            symbols = t[p]
            order = symbols.argsort(kind="stable")
            nth, symbols, count = _grouped(symbols[order])
            slot = free[symbols].repeat(count) + step * nth
            out[slot] = p[order]
            is_open[slot] = False
            free[symbols] += step * count


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array of all suffixes from the sorted leftmost-smaller ones: the larger-type ones in a pass up, the smaller-type ones in a pass down."""
    n = len(t)
    size, larger = np.bincount(t), np.bincount(t[~small], minlength=int(t.max()) + 1)
    end = np.cumsum(size)
    head = end - size
    out = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    nth, symbols, count = _grouped(t[seeds])
    out[np.repeat(end[symbols] - count, count) + nth] = seeds
    kind = np.repeat(np.tile([False, True], len(size)), np.stack([larger, size - larger], 1).ravel())  # of each slot
    _pass(t, small, False, out, ~kind, head, 1)
    out[kind] = -1
    out[0] = n - 1
    kind[0] = False
    _pass(t, small, True, out, kind, end - 1, -1)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, whose last symbol is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = np.asarray(t, np.int16 if int(t.max()) < 1 << 15 else np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        order = _induce(t, small, lms[np.argsort(t[lms], kind="stable")])
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        # names: equal substrings, up to and with the next leftmost-smaller position, have equal hashes and lengths
        after = np.append(lms[1:], n - 1)
        size = after - lms + 1
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        content = c.mix(np.add.reduceat((t[np.repeat(lms, size) + inside].astype(U) + U(1)) * c.powers(int(size.max()))[inside], first) + size.astype(U) * c.GOLD)
        by_position = np.zeros(n, U)
        by_position[lms] = content
        ordered = by_position[order]
        name = np.zeros(n, np.int64)
        name[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        names = name[lms]
        lms = order if names.max() == len(lms) - 1 else lms[suffix_array(names)]
    return _induce(t, small, lms)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int, stop: int = -1) -> np.ndarray:
    """Permuted: for each position, the symbols that its suffix shares with the one before it in the array; none from a
    `stop` symbol on. `most`: no value is larger.

    Only irreducible values, where the symbols in front differ, are compared; the others are one less than their
    predecessor's.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    odd = (before <= 0) | (own == 0) | (t[own - 1] != t[before - 1])
    odd |= t[own - 1] == stop
    value = np.zeros(n, np.int64)
    active = np.flatnonzero(odd & (before >= 0))
    padded = np.concatenate([t, np.full(most + 32, -1, t.dtype)])
    step = np.arange(16)
    for offset in range(0, most, 16):
        if not len(active):
            break
        a, b = padded[(active + offset)[:, None] + step], padded[(before[active] + offset)[:, None] + step]
        same = (a == b) & (a >= 0) & (a != stop)
        whole = same.all(1)
        value[active] = offset + np.where(whole, 16, same.argmin(1))
        active = active[whole]
    last = np.maximum.accumulate(np.where(odd, own, 0))
    return np.maximum(0, value[last] + last - own)


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context, the starts of strings of `length` bytes that start elsewhere in the contexts as well."""
    size = np.array([len(x) for x in contexts])
    t = np.frombuffer(b"".join(x + b"\0" for x in contexts) + b"\0", np.uint8).astype(np.int16) + 2
    first = np.cumsum(size + 1) - size - 1
    t[first + size] = 1
    t[-1] = 0
    nth = np.arange(len(t)) - np.repeat(np.append(first, len(t) - 1), np.append(size + 1, 1))
    starts = nth + length <= np.append(np.repeat(size, size + 1), 0)
    order = suffix_array(t).astype(np.int64)
    group = np.cumsum(common_prefixes(t, order, int(size.max()) + 1, stop=1)[order] < length)
    found = np.zeros(len(t), bool)
    found[order] = np.bincount(group, weights=starts[order])[group] >= 2
    found &= starts
    return [np.flatnonzero(found[f : f + n]) for f, n in zip(first.tolist(), size.tolist(), strict=True)]


# -- anchors --------------------------------------------------------------------------------------------------------

_symbol = c.mix(np.arange(1, 257, dtype=np.uint64))


def side(length: int) -> int:
    """Bytes of a string's core on one side of its anchor."""
    return (length - GRAM) // 2


def contexts(text: bytes, *lengths: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For strings of each length: runs of starts with one anchor on one side, as key, first and last start, and the core's first byte."""
    parts: list[list[tuple]] = [[] for _ in lengths]
    overlap = max(lengths) - 1
    for at in range(0, max(1, len(text) - min(lengths) + 1), PIECE):
        piece = np.frombuffer(text, np.uint8)[at : at + PIECE + overlap]
        if len(piece) < GRAM:
            continue
        h = _symbol[piece]
        width = 1
        while width < GRAM:
            h = h[:-width] * c.SALTS[width] + h[width:]
            width *= 2
        mask = U((1 << 25) - 1)
        marked = (c.mix(h) & ~mask) | np.arange(len(h), dtype=np.uint64)
        for length, own in zip(lengths, parts, strict=True):
            grams, most = length - GRAM + 1, min(PIECE, len(piece) - length + 1)
            if most < 1:
                continue
            least, width = marked[: most + grams - 1], 1
            while 2 * width <= grams:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < grams:
                least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
            anchor = (least & mask).astype(np.int64)
            start = np.arange(len(anchor))
            right = start >= anchor - side(length)
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1])) + 1
            lo = np.concatenate([[0], change])
            hi = np.append(change, len(anchor)) - 1
            core = np.where(right[lo], anchor[lo], anchor[lo] - side(length))
            key = np.where(right[lo], U(11), U(13))
            for offset in [*range(0, side(length), GRAM), side(length)]:
                key = c.mix(key * c.BASE + h[core + offset])
            own.append((key, lo + at, hi + at, core + at))
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate(x) for x in zip(*own, strict=True)) if own else (none.view(U), none, none, none) for own in parts]


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _rows(docs: DataFrame, schema: str, step) -> DataFrame:
    """step(doc_id, rid, text) over blocks gives columns."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            rest = [x.to_pylist() for x in batch.columns[3:]]
            for a, b in c.blocks(texts):
                out = step(ids[a:b], rids[a:b], texts.slice(a, b - a).to_pylist(), *[x[a:b] for x in rest])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names)

    return docs.mapInArrow(run, schema)


def _scan(docs: DataFrame) -> DataFrame:
    """(key, whole, doc_id, rid, lo, hi) of each context; whole: a digest of all its bytes. Of strings of SHORT bytes whole is
    null, and lo to hi are the core's bytes."""

    def step(ids: list, rids: list, texts: list[bytes]) -> dict | None:
        found: list[tuple] = []
        for i, text in enumerate(texts):
            (key, lo, hi, _), (short, _, _, core) = contexts(text, LENGTH, SHORT)
            whole = np.array([_digest(text[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)
            found.append((np.full(len(key), i), key, whole, np.zeros(len(key), bool), lo, hi))
            found.append((np.full(len(short), i), short, np.zeros(len(short), np.int64), np.ones(len(short), bool), core, core + GRAM + side(SHORT) - 1))
        row, key, whole, none, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(key):
            return None
        return {"key": key.view(np.int64), "whole": pa.array(whole, mask=none), "doc_id": pa.array(ids, pa.int64()).take(pa.array(row)), "rid": np.array(rids, np.int64)[row], "lo": lo, "hi": hi}

    return _rows(docs, "key long, whole long, doc_id long, rid long, lo long, hi long", step)


def _cut(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bytes of chosen contexts (key, doc_id, rid, lo, hi, hot)."""
    wanted = chosen.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("key", "lo", "hi", "hot")).alias("wanted"))
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["rid"] == wanted["rid"])

    joined = docs.join(wanted, same).select(docs["doc_id"], docs["rid"], "text", "wanted")

    def step(ids: list, rids: list, texts: list[bytes], wanted: list) -> dict:
        out = [(w["key"], i, r, w["lo"], t[w["lo"] : w["hi"] + LENGTH], w["hot"]) for i, r, t, ws in zip(ids, rids, texts, wanted, strict=True) for w in ws]
        key, i, r, lo, data, hot = (list(x) for x in zip(*out, strict=True))
        return {"key": key, "doc_id": pa.array(i, pa.int64()), "rid": pa.array(r, pa.int64()), "lo": lo, "bytes": pa.array(data, pa.binary()), "hot": hot}

    return _rows(joined, "key long, doc_id long, rid long, lo long, bytes binary, hot boolean", step)


SPANS = "doc_id long, rid long, lo long, end long"


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts, as first byte and end of what they cover."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.append(cut, len(starts)) - 1] + LENGTH


def _in_shards(cut: DataFrame) -> DataFrame:
    """Spans found by suffix arrays over whole keys, many keys to an array."""
    spark = cut.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def solve() -> Iterator[pa.RecordBatch]:
            # a row of docs that comes twice gives a context twice: one will do
            unique = list({(i, r, lo): x for i, r, lo, x in rows}.items())
            ids, rids, los, ends = [], [], [], []
            for ((i, r, lo), _), starts in zip(unique, repeated_starts([x for _, x in unique]), strict=True):
                if len(starts):
                    a, b = _spans(starts)
                    ids += [i] * len(a)
                    rids += [r] * len(a)
                    los += (a + lo).tolist()
                    ends += (b + lo).tolist()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, rids, los, ends)], ["doc_id", "rid", "lo", "end"])

        for batch in batches:
            for key, i, r, lo, data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if key != last and size >= SHARD_BYTES:
                    yield from solve()
                    rows, size = [], 0
                rows.append((i, r, lo, data))
                size += len(data)
                last = key
        if rows:
            yield from solve()

    dealt = cut.select("key", "doc_id", "rid", "lo", "bytes").repartition(4 * c.partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, SPANS)


def _by_hashes(cut: DataFrame) -> DataFrame:
    """Spans of keys with too many contexts: every string's hash is counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r, lo, data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                n = len(data) - LENGTH + 1
                two = [hashlib.blake2b(data[s : s + LENGTH], digest_size=16).digest() for s in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(two, pa.binary()), pa.array([i] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64())], ["h", "doc_id", "rid", "lo"])

    rows = c.kept(cut.select("doc_id", "rid", "lo", "bytes").mapInArrow(run, "h binary, doc_id long, rid long, lo long").distinct(), "strings")
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return rows.join(twice, "h").select("doc_id", "rid", "lo", (F.col("lo") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, rid, lo, end, short of spans: those that repeated strings of LENGTH bytes cover, and (short) repeated cores of
    strings of SHORT bytes; spans may touch and overlap. docs: doc_id, rid, text."""
    every = c.kept(_scan(docs), "contexts")
    # keys of either length are hashes of different strings; one that both have is as rare as any collision
    # written, so that the join's hot keys can be split: it shares no stage with the aggregation
    keys = c.kept(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    both = c.kept(every.join(keys.hint("shuffle_hash"), "key"), "rows")
    c.release(every, keys)
    cores = both.where("whole is null").select("doc_id", "rid", "lo", (F.col("hi") + 1).alias("end"))
    rows = both.where("whole is not null")
    classes = c.kept(rows.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "rid", "lo", "hi")).alias("one")), "classes")
    copies = rows.join(classes.where("n > 1").select("key", "whole"), ["key", "whole"]).select("doc_id", "rid", "lo", (F.col("hi") + LENGTH).alias("end"))
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    chosen = classes.join(several, "key").select("key", "one.*", (F.col("contexts") > HOT).alias("hot"))
    cut = c.kept(_cut(docs, chosen), "cut")
    long = copies.unionByName(_in_shards(cut.where("not hot"))).unionByName(_by_hashes(cut.where("hot")))
    out = c.kept(long.withColumn("short", F.lit(False)).unionByName(cores.withColumn("short", F.lit(True))), "spans")
    c.release(both, classes, cut)
    return out


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), n_repeated (bytes in cores of strings of SHORT bytes that
    stand elsewhere as well; they stay) and kept (the bytes that aren't removed) of each row of docs.

    A null text is the empty one. Texts under SHORT bytes repeat nothing, those under LENGTH lose nothing. A row that is
    repeated is a copy: all of its strings start elsewhere. Null doc_ids are ids like others. Very long texts are scanned
    in pieces and give as many contexts as they need. Columns other than doc_id and text are ignored, whatever their
    names. No rows give no rows.
    """
    docs = c.clean_docs(docs).withColumn("rid", F.xxhash64("doc_id", "text")).select("doc_id", "rid", "text")
    spans = repeated_spans(docs).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list(F.struct("lo", "end", "short"))).alias("spans")).select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "spans")
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["d"]) & (docs["rid"] == spans["r"]), "left").select("doc_id", "rid", "text", "spans")

    def step(ids: list, rids: list, texts: list[bytes], spans: list) -> dict:
        removed, runs, repeated, kept = [], [], [], []
        for text, own in zip(texts, spans, strict=True):
            gone, short = (_covered([(s["lo"], s["end"]) for s in own or () if s["short"] == which]) for which in (False, True))
            edges = [0, *(x for span in gone for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(sum(b - a for a, b in gone))
            runs.append(len(gone))
            repeated.append(sum(b - a for a, b in short))
        return {"doc_id": pa.array(ids, pa.int64()), "n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": runs, "n_repeated": repeated, "kept": pa.array(kept, pa.binary())}

    return _rows(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary", step)
