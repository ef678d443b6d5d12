"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

Two sets of similarity t or more differ in at most H elements, H known from their sizes. Sizes fall into bands; a band's
scheme hashes the universe of n-grams into segments whose allowances add up to H + 1 and a few more. By the pigeonhole
principle a similar pair then differs by less than the allowance in some segment: an allowance of 1 asks for equal
segment subsets, one of 2 for subsets that are equal after one deletion, so those segments are indexed by their subset
and its one-deletion neighbourhood. How much allowance goes to segments of either kind is chosen by estimated cost:
keys to be indexed against partners that share a nearly empty segment by chance, which grows with the band's records.
Subsets of no element say nothing; the few more allowances make up for them (see Scheme).

Sets enter once per distinct set (a signature), so exact copies cost nothing more. One sorted pass over the keys drops
those of one set alone; rows of very common keys are dealt by a salt as well. Pairs are first bounded by bitmaps of
their sets' parities, then verified exactly: the likeliest partner of each set first, then that of each two connected
groups. What is already connected need not be compared again, and what remains is compared in blocks of bounded size.
Only sets of pairs within the bound are fetched, and intermediate tables go as soon as they have been read.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import common as c

U = np.uint64
#: Share of the records with a segment of at most one n-gram that are taken to share it by chance, in the cost model.
COMMON = 1e-4
#: Members of one block of a residual key; two blocks, of sets' bitmaps alone, are compared in one task.
BLOCK = 2048
#: Residual keys of up to so many sets give their pairs of different components; larger ones are compared in blocks.
SMALL = 32
#: Bits of a set's parity bitmap per element, and at least.
BITS, LEAST_BITS = 2, 128
#: Rows of one key in a block of texts that are dealt by the key alone (2 at least: they show that the key is shared); further ones are salted.
COMMON_ROWS, SALTS = 16, 64
#: Signatures that a task remembers in order to index a set once.
MEMO = 1 << 20


@dataclass(frozen=True)
class Threshold:
    num: int
    den: int

    def met(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def largest(self, a: int) -> int:
        """The largest size that can be similar to size a."""
        return a * self.den // self.num

    def smallest(self, a: int) -> int:
        return -(-a * self.num // self.den)


@functools.cache
def bands(t: Threshold, top: int) -> list[int]:
    """The first size of each band up to top: a partner of a set is in its own band or the next one."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, t.largest(out[-1] - 1) + 1))
    return out


@dataclass(frozen=True)
class Scheme:
    """singles segments of allowance 1 and doubles of allowance 2. The allowances add up to H + 1 + spare.

    Of a pair, segments of a summed allowance of at least 1 + spare match. A set whose segments that could match
    through an empty subset have no more than spare allowance thus matches through another one as well, and gives no
    keys for empty subsets; only sets beyond that do.
    """

    band: int
    singles: int
    doubles: int
    spare: int

    @property
    def allowance(self) -> int:
        return self.singles + 2 * self.doubles


@functools.cache
def scheme(t: Threshold, band: int, first: int, after: int, records: int) -> Scheme:
    """The cheapest scheme of a band of sizes first to after - 1 that holds so many records."""
    h = (after - 1 + t.largest(after - 1)) * (t.den - t.num) // (t.den + t.num)
    best = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for more in range(2 * h + 8):
            doubles = math.ceil(share * (h + 1 + more) / 2)
            singles = max(0, h + 1 + more - 2 * doubles)
            allowance = singles + 2 * doubles
            spare, rest = allowance - h - 1, first - 1
            alone, two = 1 - 1 / allowance, 1 - 2 / allowance if allowance > 2 else 0.0
            empty, one = alone**first, alone**first + first / allowance * alone**rest
            one2 = two**first + first * 2 / allowance * two**rest if allowance > 2 else float(first <= 1)
            mean = singles * (empty if allowance > 1 else 0.0) + 2 * doubles * one2
            enough = spare >= mean + 4 * math.sqrt(mean)
            keys = singles + doubles * (1 + 2 * first / allowance)
            # sets beyond the spare allowance are indexed by empty subsets too, which all of their kind share
            cost = keys + records * COMMON * (singles * one**2 + doubles * one2**2) + (0 if enough else keys + records)
            if best is None or cost < best[0]:
                best = cost, Scheme(band, singles, doubles, spare)
            if enough:
                break
    return best[1]


class Schemes:
    """The schemes of all bands; records: sets by band."""

    def __init__(self, t: Threshold, records: dict[int, int]):
        self.t, self.records = t, records

    def of(self, size: int) -> list[Scheme]:
        """A set's own band's, and the band's below if a partner can be there."""
        starts = bands(self.t, 1 << max(10, size.bit_length()))
        own = bisect.bisect_right(starts, size) - 1
        wanted = [own, own - 1] if own and self.t.smallest(size) < starts[own] else [own]
        return [scheme(self.t, j, starts[j], starts[j + 1], self.records.get(j, 0)) for j in wanted]


def keys(tokens: np.ndarray, schemes: list[Scheme]) -> np.ndarray:
    """Hashes of the segment subsets of one set of distinct n-grams, and of their one-deletion neighbourhoods."""
    content = c.mix(tokens * c.GOLD + U(1))  # a subset's hash is the sum of its elements' hashes
    out = []
    for s in schemes:
        place = (c.mix(tokens ^ U(0xA5A5 + s.band)) % U(s.allowance)).astype(np.int64)
        segment = np.where(place < s.singles, place, s.singles + (place - s.singles) // 2)
        n = s.singles + s.doubles
        count = np.bincount(segment, minlength=n)
        low = np.bincount(segment, (content & U(0xFFFFFFFF)).astype(np.float64), n).astype(U)
        high = np.bincount(segment, (content >> U(32)).astype(np.float64), n).astype(U)
        total = low + (high << U(32))
        name = c.mix(np.arange(n, dtype=np.uint64) + U(s.band << 32) + U(7))
        risky = int((count[: s.singles] == 0).sum()) + 2 * int((count[s.singles :] <= 1).sum())
        full = count > 0 if risky <= s.spare else np.ones(n, bool)
        out.append(c.mix(total[full] + name[full]))
        if s.doubles:
            own = segment >= s.singles
            if risky <= s.spare:
                own &= count[segment] > 1
            out.append(c.mix(total[segment[own]] - content[own] + name[segment[own]]))
    return np.unique(np.concatenate(out))


# -- over tables ---------------------------------------------------------------------------------------------------


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    doc, _, _, hashes = c.words(texts, c.SPACE)
    d, h = c.shingles(doc, hashes, len(texts), k)
    cut = np.searchsorted(d, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    x = c.mix(tokens + c.GOLD)
    return int(x.sum(dtype=U).view(np.int64)), int(c.mix(x ^ U(99)).sum(dtype=U).view(np.int64))


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap as 64-bit words: a bit says whether the bucket holds an odd number of elements. Two sets' bitmaps differ in no
    more bits than the sets do in elements. Its length is a power of 2; the upper half folds onto the lower one by xor."""
    m = max(LEAST_BITS, 1 << (BITS * len(tokens) - 1).bit_length()) if len(tokens) else LEAST_BITS
    odd = np.bincount((tokens & U(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid (see `common.row_hash`)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), c.row_hash(docs).alias("rid"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, rid, n (distinct n-grams), a signature of the set (sig, sig2) and its bitmap. docs: see `identified`."""

    def step(rids: list, texts: list[bytes]) -> dict:
        sets = _sets(texts, k)
        sig = np.array([_signature(s) for s in sets], np.int64)
        return {"rid": pa.array(rids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": sig[:, 0], "sig2": sig[:, 1], "bits": pa.array([parities(s) for s in sets], pa.list_(pa.int64()))}

    return c.map_blocks(docs, step, "doc_id long, rid long, n long, sig long, sig2 long, bits array<long>", key="rid", carry=("doc_id",))


def index(docs: DataFrame, k: int, schemes: Schemes) -> DataFrame:
    """(key, salt, sig): what each set is indexed by.

    A task gives a set once, as long as it remembers it. Of a key that comes more than COMMON_ROWS times in a block of
    texts, further rows of the task have a salt: they need no proof that others share the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        common = np.zeros(0, U)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in c.blocks(texts):
                if len(seen) > MEMO:
                    seen.clear()
                own = []
                for s in _sets(texts.slice(a, b - a).to_pylist(), k):
                    if len(s) and (sig := _signature(s)[0]) not in seen:
                        seen.add(sig)
                        own.append((keys(s, schemes.of(len(s))), sig))
                if not own:
                    continue
                key, sig = np.concatenate([x for x, _ in own]), np.repeat(np.array([s for _, s in own], np.int64), [len(x) for x, _ in own])
                order = np.argsort(key, kind="stable")
                key, sig = key[order], sig[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                apart = (place >= COMMON_ROWS) | np.isin(key, common) if len(common) else place >= COMMON_ROWS
                common = np.union1d(common, key[place == COMMON_ROWS])
                salt = np.where(apart, (c.mix(sig.view(U)) % U(SALTS)).astype(np.int32) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(sig)], ["key", "salt", "sig"])

    return docs.select("text").mapInArrow(run, "key long, salt int, sig long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, sig), once each, of the keys that several sets share. Each partition is sorted and read in a stream, so a key may
    have any number of rows; those with a salt pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = None, True  # the row before, and whether it has been given
        for batch in batches:
            key, salt, sig = (x.to_numpy() for x in batch.columns)
            if not len(key):
                continue
            if last is not None:
                key, salt, sig = (np.append(np.array([x], y.dtype), y) for x, y in zip(last, (key, salt, sig), strict=True))
            new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (sig[1:] != sig[:-1]))
            if last is not None and not new[1:].any():  # nothing but repeats of the row before
                continue
            key, salt, sig = key[new], salt[new], sig[new]
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            wanted = (salt > 0) | np.append(False, same) | np.append(same, False)
            give = wanted.copy()
            if last is not None and passed:
                give[0] = False
            passed = bool(wanted[-1]) if len(key) > 1 or last is None else passed or bool(wanted[-1])
            last = key[-1], salt[-1], sig[-1]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(sig[give])], ["key", "sig"])

    n = c.partitions(rows.sparkSession)
    return rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "sig").mapInArrow(run, "key long, sig long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sig, tokens) of the documents whose rid is wanted; a repeated row once in each task."""
    seen: set[int] = set()  # each task unpickles its own

    def step(rids: list, texts: list[bytes]) -> dict | None:
        texts = [t for r, t in zip(rids, texts, strict=True) if r not in seen and not seen.add(r)]
        if not texts:
            return None
        sets = _sets(texts, k)
        return {"sig": pa.array([_signature(s)[0] for s in sets], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

    return c.map_blocks(docs.join(wanted.select("rid").distinct(), "rid", "left_semi"), step, "sig long, tokens array<long>", key="rid")


def _most_different(t: Threshold, a: str, b: str) -> str:
    """SQL: the largest symmetric difference of similar sets of sizes a and b; negative if none can be similar."""
    return f"{a} + {b} - 2 * ceil({t.num} * ({a} + {b}) / {t.num + t.den}D)"


def _least_different(a: str, b: str) -> str:
    """SQL: the bits in which two bitmaps differ, the longer one folded."""
    apart = lambda u, v: f"aggregate(zip_with({u}, {v}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
    half = lambda u: f"zip_with(slice({u}, 1, size({u}) div 2), slice({u}, size({u}) div 2 + 1, size({u}) div 2), (p, q) -> p ^ q)"
    return f"case when size({a}) = size({b}) then {apart(a, b)} when size({a}) > size({b}) then {apart(half(a), b)} else {apart(a, half(b))} end"


def within_bound(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (x, y) of signatures whose sizes and bitmaps leave it open whether they are similar. classes: sig, n, bits."""
    side = lambda name: classes.select(F.col("sig").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    size = f"{t.den} * least(n_x, n_y) >= {t.num} * greatest(n_x, n_y)"
    return pairs.join(side("x"), "x").join(side("y"), "y").where(size).where(f"{_least_different('bits_x', 'bits_y')} <= {_most_different(t, 'n_x', 'n_y')}").select(*pairs.columns)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The links (a, b) among pairs (x, y) of signatures, written."""
    close = c.kept(within_bound(pairs.select("x", "y"), classes, t), "close")
    ends = close.select(F.col("x").alias("sig")).unionByName(close.select(F.col("y").alias("sig"))).distinct()
    sets = c.kept(sets_of(docs, classes.join(ends, "sig", "left_semi"), k), "sets")
    both = close.join(sets.select(F.col("sig").alias("x"), F.col("tokens").alias("left")), "x").join(sets.select(F.col("sig").alias("y"), F.col("tokens").alias("right")), "y")
    common = F.size(F.array_intersect("left", "right"))
    out = c.kept(both.where(F.lit(t.den) * common >= F.lit(t.num) * (F.size("left") + F.size("right") - common)).select(F.col("x").alias("a"), F.col("y").alias("b")), "found")
    c.release(close, sets)
    return out


def _open_pairs(t: Threshold, sig: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that sizes and bitmaps leave open."""
    words = np.array([len(x) for x in bits])
    tables = {w: (np.flatnonzero(words == w), np.stack([b for b in bits if len(b) == w]).view(U)) for w in np.unique(words).tolist()}
    xs, ys = [], []
    for w, (rows, table) in tables.items():
        # each pair once: with rows of as many words (later ones), and with those of twice as many, folded
        for other, twice in ((w, False), (2 * w, True)):
            if other not in tables:
                continue
            there, across = tables[other]
            if twice:
                across = across[:, :w] ^ across[:, w:]
            for i, r in enumerate(rows.tolist()):
                rest, own = (there, across) if twice else (there[i + 1 :], across[i + 1 :])
                good = (comp[rest] != comp[r]) & (t.den * np.minimum(n[rest], n[r]) >= t.num * np.maximum(n[rest], n[r]))
                rest, own = rest[good], own[good]
                if len(rest):
                    total = n[rest] + n[r]
                    most = total - 2 * -(-t.num * total // (t.num + t.den))
                    close = rest[np.bitwise_count(own ^ table[i]).sum(1, dtype=np.int64) <= most]
                    xs.append(np.full(len(close), sig[r]))
                    ys.append(sig[close])
    none = np.zeros(0, np.int64)
    return np.concatenate(xs) if xs else none, np.concatenate(ys) if ys else none


def blockwise(members: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (x, y) within large groups that bitmaps leave open: members (grp, sig, comp, n, bits). A group is cut by size, as
    similar sets are of one cell or two neighbouring ones, and cells into blocks of about BLOCK by a hash; each pair of
    blocks is compared in one task, so no task holds a group."""
    cell = F.floor(F.log(F.col("n").cast("double")) / math.log(t.den / t.num * 1.0001))
    cells = members.withColumn("cell", F.explode(F.array(cell, cell - 1)))  # a cell holds its own sizes and the next one's
    blocks = cells.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.count_distinct("comp").alias("comps")).where("comps > 1").drop("comps")
    dealt = cells.join(blocks, ["grp", "cell"]).withColumn("own", F.pmod(F.xxhash64("sig"), "blocks"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig", "comp", "n", "bits")

    def compare(frame):
        import pandas as pd

        x, y = _open_pairs(t, frame["sig"].to_numpy(), frame["n"].to_numpy(), frame["comp"].to_numpy(), list(frame["bits"]))
        return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    return spread.groupBy("grp", "cell", "i", "j").applyInPandas(compare, "x long, y long").distinct()


def links(docs: DataFrame, classes: DataFrame, k: int, t: Threshold, schemes: Schemes) -> DataFrame:
    """(node, component) of signatures: what the links between all similar sets connect."""
    members = c.kept(shared_keys(index(docs, k, schemes)), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    degree = members.join(sizes, "key").groupBy("sig").agg(F.sum("size").alias("degree"))
    # a key's pivot is its member with the most company: of near copies, mostly their original
    pivots = c.kept(members.join(degree, "sig").groupBy("key").agg(F.max(F.struct("degree", "sig")).alias("p"), F.count(F.lit(1)).alias("size")).select("key", F.col("p.sig").alias("x"), "size"), "pivots")
    shared = members.withColumnRenamed("sig", "y").join(pivots, "key").where("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    found = verified(shared.groupBy("y").agg(F.max_by("x", F.struct("shared", "x")).alias("x")), docs, classes, k, t)

    # the likeliest pair of each two components that meet at a pivot
    placed = c.kept(_apart(members, found), "placed")
    c.release(members)
    heads = placed.join(pivots, "key")
    star = heads.where("sig = x").select("key", "x", F.col("comp").alias("cx")).join(placed.select("key", F.col("sig").alias("y"), F.col("comp").alias("cy")), "key").where("cx <> cy")
    pairs = star.groupBy("x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.groupBy(F.least("cx", "cy").alias("c1"), F.greatest("cx", "cy").alias("c2")).agg(F.max(F.struct("shared", "x", "y")).alias("p")).select("p.x", "p.y")
    more = verified(both, docs, classes, k, t)

    # all pairs of components that are still apart
    rest = c.kept(_apart(placed.select("key", "sig"), found.unionByName(more)).join(pivots, "key"), "rest")
    c.release(placed, pivots)
    few = rest.where(F.col("size") <= SMALL).select("key", "sig", "comp")
    close = few.select("key", F.col("sig").alias("x"), F.col("comp").alias("cx")).join(few.select("key", F.col("sig").alias("y"), F.col("comp").alias("cy")), "key").where("cx < cy").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    many = rest.where(F.col("size") > SMALL).select(F.col("x").alias("grp"), "sig", "comp").distinct().join(classes.select("sig", "n", "bits"), "sig")
    last = verified(within_bound(close, classes, t).unionByName(blockwise(many, t)).distinct(), docs, classes, k, t)
    c.release(rest)
    labels = c.components(found.unionByName(more).unionByName(last))
    c.release(found, more, last)
    return labels


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, sig, comp) of the keys whose members are of several components so far."""
    labels = c.components(found).withColumnRenamed("node", "sig")
    placed = members.join(labels, "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return placed.join(several, "key")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs.

    Documents link when den * intersection >= num * union of their sets of k-word shingles (words between ASCII white
    space, A-Z lower-cased; fewer words make one shingle). A document without words, or with a null text, links with
    none. Rows of equal doc_id are one document each; equal sets always link. Null doc_ids count as larger than all
    others: their texts link like any other, and a document that reaches none but these keeps a null component. Very
    long texts are sets like others. Other columns of docs are ignored, whatever their names; no rows give no rows.
    """
    rows = grouped(docs, k, num, den)
    firsts = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(firsts, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def firsts(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group that `join`'s links connect: that of the least doc_id (null: the largest), then of the
    least hash. Rows without words are in no group and stay."""
    rows = grouped(docs, k, num, den)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    chosen = c.kept(rows.where("n > 0").groupBy("component").agg(least).select(F.col("first.rid").alias("_first")).unionByName(rows.where("n = 0").select(F.col("rid").alias("_first"))), "chosen")
    wanted = chosen.select("_first").distinct()
    left = docs.join(wanted, c.row_hash(docs) == wanted["_first"], "left_semi")
    repeated = rows.where("n > 0").groupBy("rid").agg(F.count(F.lit(1)).alias("times")).where("times > 1").join(chosen, F.col("rid") == F.col("_first"), "left_semi")
    # a repeated row is its own near copy
    return left if repeated.isEmpty() else _once(left, repeated.select("rid"))


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of each row whose hash is repeated, one."""
    own = repeated.select(F.col("rid").alias("_again"))
    others = docs.join(own, c.row_hash(docs) == own["_again"], "left_anti")
    again = docs.join(own, c.row_hash(docs) == own["_again"], "left_semi")
    one = again.groupBy(c.row_hash(again).alias("_hash")).agg(F.min_by(F.struct(*[again[x] for x in again.columns]), F.xxhash64(*again.columns)).alias("_row"))
    return others.unionByName(one.select("_row.*"))


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, rid, n and component (a signature that its whole group shares; null without words) of each row of docs."""
    docs, t = identified(docs), Threshold(num, den)
    signed = c.kept(signatures(docs, k), "signatures")
    classes = c.kept(signed.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("rid").alias("rid"), F.any_value("bits").alias("bits")), "classes")
    starts = bands(t, 1 << 40)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) * 4).alias("cell")  # fine cells: a few hundred rows
    records: dict[int, int] = {}
    for r in classes.groupBy(band).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("sets")).collect():
        j = bisect.bisect_right(starts, r["n"]) - 1
        records[j] = records.get(j, 0) + r["sets"]
    labels = links(docs, classes, k, t, Schemes(t, records)).withColumnRenamed("node", "sig")
    named = classes.select("sig", "sig2", "n").join(labels, "sig", "left").select("sig", "sig2", "n", F.coalesce("component", "sig").alias("component"))
    rows = signed.drop("bits").join(named, ["sig", "sig2", "n"], "left").select("doc_id", "rid", "n", "component")
    out = c.kept(rows, "groups")
    c.release(signed, classes)
    return out
