"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codecorpus.shipping import shared_folder, ship

#: Rows and bytes of one Arrow batch at most; whole texts travel in it, so its bytes are kept few.
BATCH_ROWS, BATCH_BYTES = 16_384, 4 << 20
#: Text bytes that one vectorised step takes at a time; a longer text is its own step.
BLOCK_BYTES = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII white space as the contracts name it: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All of ASCII but digits and a-z (used after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded bytes, and shuffle files that go as soon as their query has ended.

    Set for the session's whole life, as Spark reads them when a query runs, which may be long after this call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    with contextlib.suppress(Exception):  # releases without it keep them until their plan is collected
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but in local mode alone."""
    return shared_folder(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, is computed once. See `release`."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from `kept` once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, df._folder
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of doc_id and text: tells rows apart whose doc_ids are null or equal."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def map_blocks(df: DataFrame, step: Callable[[list, list[bytes]], dict[str, object] | None], schema: str, key: str = "doc_id", value: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs step(keys, UTF-8 texts) on blocks of about BLOCK_BYTES; it returns columns by name in the schema's order, or None for no rows.

    Columns to carry come first in the schema; step then returns a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for a, b in blocks(texts):
                out = step(keys[a:b], texts.slice(a, b - a).to_pylist())
                if out is not None:
                    along = [batch.column(2 + i).slice(a, b - a) for i in range(len(carry))]
                    yield pa.RecordBatch.from_arrays([*along, *[pa.array(x) for x in out.values()]], [*carry, *out])

    return df.select(key, value, *carry).mapInArrow(run, schema)


def blocks(texts: pa.BinaryArray) -> Iterator[tuple[int, int]]:
    size, a = 0, 0
    for i, n in enumerate(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else ()):
        if size and size + n > BLOCK_BYTES:
            yield a, i
            size, a = 0, i
        size += int(n)
    if len(texts) > a:
        yield a, len(texts)


# -- hashing, vectorised over bytes ------------------------------------------------------------------------------

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
BASE = U(0x5851F42D4C957F2D)


SALTS = np.arange(1, 201, dtype=U) * GOLD


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_powers = np.cumprod(np.full(64, BASE, U))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(2 * n, BASE, U))
    return _powers


def words(texts: list[bytes], separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each maximal run of bytes that aren't separators, after lower-casing A-Z: its text's index, first byte and end in the text, 64-bit hash."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), np.uint8)
    gap = separator[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends, np.zeros(0, U)
    hashes = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # pieces of bounded memory, cut at words
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + 2 * BLOCK_BYTES)))
        s, size = starts[at:stop], ends[at:stop] - starts[at:stop]
        total = int(size.sum())
        first = np.cumsum(size) - size
        inside = np.arange(total) - np.repeat(first, size)
        terms = (buf[np.repeat(s, size) + inside].astype(U) + U(1)) * powers(int(size.max()))[inside]
        hashes[at:stop] = mix(np.add.reduceat(terms, first) + size.astype(U) * GOLD)
        at = stop
    doc = np.searchsorted(offsets, starts, "right") - 1
    return doc, starts - offsets[doc], ends - offsets[doc], hashes


def shingles(doc: np.ndarray, hashes: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k following words; of a text of fewer words, one for all of them. Returns texts' indexes and hashes."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    out = []
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        h = np.zeros(n, U)
        for i in range(k):
            h = h * BASE + mix(hashes[i : i + n] + SALTS[i])
        whole = doc[:n] == doc[k - 1 :]
        out.append((doc[:n][whole], mix(h[whole])))
    short = np.flatnonzero((count > 0) & (count < k))
    h = np.zeros(len(short), U)
    for i in range(k - 1):
        more = count[short] > i
        h[more] = h[more] * BASE + mix(hashes[first[short[more]] + i] + SALTS[100 + i])
    out.append((short, mix(h + count[short].astype(U))))
    d, h = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


# -- connected components ----------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the least node that links reach. Min-label steps with pointer jumping; a round's table is written to the shared folder, and the one before goes."""
    both = kept(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    last = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("node"), "l"), "label")
    while True:
        label = last.select("node", "l")
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = step.join(label.select(F.col("node").alias("l"), F.col("l").alias("j")), "l", "left").select("node", "old", F.least("l", F.coalesce("j", "l")).alias("l"))
        seen = Observation()
        new = kept(jump.observe(seen, F.count_if(F.col("old") != F.col("l")).alias("moved")), "label")
        release(last)
        last = new
        if not seen.get["moved"]:
            release(both)
            return new.select("node", F.col("l").alias("component"))
