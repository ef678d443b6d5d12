"""Hard negatives by exact integer scores: matrix products modulo small primes in float32, put together by the Chinese
remainder theorem, then selected by windows.

Rows are dealt over parts by hash, anchors over blocks; a task meets one block with one part. It holds the block, streams
the part, and keeps only the best few for each anchor, so what is shuffled on is a few rows for each anchor and part. Two
such passes: one for positives, one for negatives under each positive's score. All anchors meet all rows, in blocks; the
scores themselves are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm import common as c

#: Anchors of a block and rows of a part, at most or about; rows of a part that are worth a task.
BLOCK, PART, SMALL_PART = 32_768, 1 << 20, 2_048
#: Anchors and rows of one product.
TILE_ANCHORS, TILE_ROWS = 512, 2_048
#: Float32 holds integers up to here exactly.
EXACT = 1 << 24
NONE = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes under 1024 whose product is over 2.1 times the bound: enough for signed scores up to it."""
    out, product = [], 1
    for p in range(1023, 2, -2):
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2.1 * bound:
                return out
    raise ValueError("scores beyond the small primes")


def _residue(x: np.ndarray, p: int) -> np.ndarray:
    """Float32 integers that are congruent to x, in -(p + 1) / 2 to (p + 1) / 2."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """A matrix of integers modulo each prime, near zero, as float32."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in moduli]


def scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """All inner products of the rows of two matrices, given by residues: exact 64-bit integers."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(moduli):
        wide = max(1, EXACT // ((p + 1) // 2) ** 2)  # components whose products add up exactly
        dims = a[k].shape[1]
        total = _residue(a[k][:, :wide] @ b[k][:, :wide].T, p)
        for at in range(wide, dims, wide):
            total = _residue(total + _residue(a[k][:, at : at + wide] @ b[k][:, at : at + wide].T, p), p)
        for q, digit in zip(moduli, digits, strict=False):  # mixed radix: what is left after the digits so far
            inverse = pow(q, -1, p)
            total = _residue(_residue(total - digit, p) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(total)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(moduli[-2::-1], digits[-2::-1], strict=True):
        out = out * p + digit.astype(np.int64)
    return out


class Best:
    """The first `most` of each list: highest scores, then smallest ids."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.score = np.full((lists, most), NONE)
        self.id = np.zeros((lists, most), np.int64)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores for the lists from `at` on; NONE is no candidate."""
        n, width = score.shape
        least = self.score[at : at + n, -1]
        if width > self.most:
            least = np.maximum(least, np.partition(score, width - self.most, 1)[:, width - self.most])
        row, column = np.nonzero((score >= least[:, None]) & (score > NONE))
        if not len(row):
            return
        held, rank = np.nonzero(self.score[at : at + n] > NONE)
        of = np.concatenate([held, row])
        value = np.concatenate([self.score[at + held, rank], score[row, column]])
        number = np.concatenate([self.id[at + held, rank], ids[column]])
        order = np.lexsort((number, -value, of))
        of, value, number = of[order], value[order], number[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        first = place < self.most
        self.score[at + of[first], place[first]] = value[first]
        self.id[at + of[first], place[first]] = number[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, id and score of all that is held."""
        of, rank = np.nonzero(self.score > NONE)
        return of, self.id[of, rank], self.score[of, rank]


WANTED = "array<struct<id:bigint,score:bigint>>"


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Each anchor once for each part, each row once for each block; a cell's anchors come before its rows."""
    wanted = F.col("wanted") if "wanted" in anchors.columns else F.lit(None).cast(WANTED).alias("wanted")
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    own = anchors.select("size", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("anchor"), "rid", "vec_id", "label", "q", wanted)
    others = rows.select("size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("rid", F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("anchor"), "rid", "vec_id", "label", "q", F.lit(None).cast(WANTED).alias("wanted"))
    tasks = max(c.partitions(rows.sparkSession), blocks * parts)
    return own.unionByName(others).repartition(tasks, "size", "block", "part").sortWithinPartitions("size", "block", "part", F.desc("anchor"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


class _Meeting:
    """One block's anchors, and the best that it has found among the rows so far."""

    def __init__(self, size: int, moduli: list[int], most: int, negatives: bool):
        self.size, self.moduli, self.most, self.negatives = size, moduli, most, negatives
        self.batches: list[pa.RecordBatch] = []
        self.best: Best | None = None

    def anchors(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def _begin(self) -> None:
        held = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches = []
        column = lambda name: held.column(name).combine_chunks()
        self.rid, self.vec_id, self.label = (column(n).to_numpy(zero_copy_only=False) for n in ("rid", "vec_id", "label"))
        q = column("q")
        self.x = residues(_matrix(q.chunk(0) if isinstance(q, pa.ChunkedArray) else q, self.size), self.moduli)
        if self.negatives:
            wanted = column("wanted")
            lists = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            self.positive, self.bound = flat.field("id").to_numpy(zero_copy_only=False), flat.field("score").to_numpy(zero_copy_only=False)
            self.list_of = np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=len(wanted)))])  # an anchor's lists
            self.owner = lists
        self.best = Best(len(self.owner) if self.negatives else len(self.rid), self.most)

    def rows(self, batch: pa.RecordBatch) -> None:
        if self.best is None:
            if not self.batches:
                return
            self._begin()
        ids, label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label"))
        y = residues(_matrix(batch.column("q"), self.size), self.moduli)
        for b in range(0, len(ids), TILE_ROWS):
            near = slice(b, b + TILE_ROWS)
            for a in range(0, len(self.rid), TILE_ANCHORS):
                own = slice(a, a + TILE_ANCHORS)
                found = scores([x[own] for x in self.x], [x[near] for x in y], self.moduli)
                same = self.label[own, None] == label[None, near]
                if not self.negatives:
                    found[~same | (self.vec_id[own, None] == ids[None, near])] = NONE
                    self.best.add(a, found, ids[near])
                    continue
                found[same | (self.vec_id[own, None] == ids[None, near])] = NONE
                first, last = self.list_of[a], self.list_of[min(a + TILE_ANCHORS, len(self.rid))]
                bound = self.bound[first:last, None]
                each = found[self.owner[first:last] - a]
                # 80 * positive <= 100 * negative <= 100 * positive, without products that overflow
                each[(each > bound) | (each < bound - bound // 5)] = NONE
                self.best.add(first, each, ids[near])

    def results(self) -> pa.RecordBatch | None:
        if self.best is None:
            return None
        of, ids, score = self.best.rows()
        if not self.negatives:
            return pa.RecordBatch.from_arrays([pa.array(self.rid[of]), pa.array(ids), pa.array(score)], ["rid", "id", "score"])
        anchor = self.owner[of]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.rid[anchor], self.vec_id[anchor], self.positive[of], self.bound[of], ids, score)], ["rid", "anchor_id", "positive_id", "positive_score", "id", "score"])


def _met(cells: DataFrame, moduli: list[int], most: int, negatives: bool, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, meeting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("size", "block", "part", "anchor")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(keys[s, :3])) != cell:
                    if meeting and (out := meeting.results()):
                        yield out
                    cell, meeting = now, _Meeting(int(keys[s, 0]), moduli, most, negatives)
                piece = batch.slice(s, e - s)
                meeting.anchors(piece) if keys[s, 3] else meeting.rows(piece)
        if meeting and (out := meeting.results()):
            yield out

    return cells.mapInArrow(run, schema)


def usable(vectors: DataFrame, label: Column, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, label, q (components as integers), size, rid of the rows that take part, equal ones once."""
    picked = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    scaled = picked.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))").withColumn("v", F.transform("v", lambda x: F.lit(float(scale)) * x))
    # else a score might not be a long
    fits = F.expr("forall(v, x -> abs(x) <= 0.999999 * sqrt(9223372036854775807D / size(v)))")
    q = F.transform("v", lambda x: F.floor(x).cast("long"))
    return scaled.where(fits).select("vec_id", "label", q.alias("q")).distinct().select("*", F.size("q").alias("size"), F.xxhash64("vec_id", "label", "q").alias("rid"))


def mine(vectors: DataFrame, label: Column | str = "label", vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first `negatives` rows of another label
    for each of the first `positives` rows of an anchor's own label, where 80 % of the positive's score <= the negative's
    score <= the positive's.

    Anchors are the rows whose id is divisible by `every`. A component x counts as floor(scale * x), a score is the inner
    product of these integers, exactly; higher scores come first, ties go to the smaller id. Rows with a null id, label or
    vector or a null or non-finite component take no part; nor do rows with a component of over sqrt(2**63 / size), whose
    scores might not be longs. Vectors meet those of their own size only; an empty vector has the score 0 with others.
    Rows that are equal in id, label and integers are one row. Rows that share an id and differ are rows of their own, but
    never candidates of an anchor of that id. Fewer positives or negatives than asked for are all returned; without any
    an anchor has no rows. Other columns are ignored, whatever their names. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = c.kept(usable(vectors, F.col(label) if isinstance(label, str) else label, vec_id, vector, scale), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    most = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("size"), F.coalesce(F.max(F.array_max(F.transform("q", F.abs))), F.lit(0)).alias("high"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    moduli = primes(max(1, most["size"] * most["high"] ** 2))
    blocks = max(1, math.ceil(most["anchors"] / BLOCK))
    parts = max(math.ceil(most["n"] / PART), min(math.ceil(c.partitions(spark) / blocks), math.ceil(most["n"] / SMALL_PART)), 1)
    first = lambda keys, k: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")) <= k
    near = _met(_cells(anchors, rows, blocks, parts), moduli, positives, False, "rid long, id long, score long")
    listed = near.withColumn("first", first(["rid"], positives)).where("first").groupBy("rid").agg(F.collect_list(F.struct("id", "score")).alias("wanted"))
    asked = c.kept(anchors.join(listed, "rid"), "positives")
    found = _met(_cells(asked, rows, blocks, parts), moduli, negatives, True, "rid long, anchor_id long, positive_id long, positive_score long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid", "positive_id", "positive_score").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
