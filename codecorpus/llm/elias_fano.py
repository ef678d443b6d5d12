"""Token ids on disk: shards of concatenated ids whose document boundaries are Elias-Fano encoded.

A shard is two files. `.ids` holds the ids of its documents, one after another, as little-endian unsigned integers of
16 bits if the vocabulary allows it, else of 32. `.ef` holds that width, the ends of its documents in ids, and their doc_ids, as two Elias-Fano sequences: the low bits of
each number packed together, the high parts as gaps in unary, and for select the places of every 64th one of the unary
part. n ends up to u take about n * (2 + log2(u / n)) bits, and the i-th end is read without a table of 64-bit offsets.
"""

from __future__ import annotations

import functools
import io
import itertools
import operator
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm import common as c

MAGIC = b"IDEF0001"
SAMPLE = 64
#: Ids of a shard: it is closed after the document that reaches this.
SHARD_IDS = 1 << 20
END_ID = 2
#: Documents whose ids are read at a time.
READ_ROWS = 256
#: Pre-tokens that a Python worker remembers, about 200 bytes each.
MEMO = 1_000_000


# -- the sequence ------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if width and n:
            bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample on, at most SAMPLE ones of the unary part are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        value = one - i << self.width
        for b in range(self.width):
            j = i * self.width + b
            value |= (int(self.low[j >> 3]) >> (j & 7) & 1) << b
        return value

    def select_range(self, a: int, b: int) -> np.ndarray:
        """The a-th to the b-1-th number, as `select` finds each: from the sample before the a-th on, up to the one after the last."""
        if not 0 <= a <= b <= self.n:
            raise IndexError(a, b)
        if a == b:
            return np.zeros(0, np.uint64)
        first, last = a // SAMPLE, -(-b // SAMPLE)
        at = int(self.samples[first])
        stop = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 3 : stop], bitorder="little")) + (at >> 3 << 3)
        skip = int(np.searchsorted(ones, at)) + a - first * SAMPLE
        own = np.arange(a, b)
        out = (ones[skip : skip + b - a] - own).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = a * self.width
            bits = np.unpackbits(self.low[bit >> 3 : (b * self.width + 7) >> 3], bitorder="little")[bit & 7 :][: (b - a) * self.width].reshape(b - a, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def all(self) -> np.ndarray:
        return self.select_range(0, self.n)

    def dump(self) -> bytes:
        return struct.pack("<5Q", self.n, self.width, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def load(cls, f: io.BytesIO) -> EliasFano:
        n, width, low, high, samples = struct.unpack("<5Q", f.read(40))
        part = lambda k: np.frombuffer(f.read(k), np.uint8)
        return cls(n, width, part(low), part(high), np.frombuffer(f.read(8 * samples), "<u8"))


def dump_shard(doc_ids: list, sizes: list[int], width: int = 4) -> bytes:
    """Nulls come first in doc_id order; the others are stored from the least on."""
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    ids = EliasFano.of(np.array([x - least for x in known], np.uint64))
    return MAGIC + struct.pack("<QqQ", len(doc_ids) - len(known), least, width) + EliasFano.of(np.cumsum(sizes)).dump() + ids.dump()


def load_shard(data: bytes) -> tuple[list, EliasFano, int]:
    """doc_ids, ends and the bytes of an id."""
    f = io.BytesIO(data)
    if f.read(8) != MAGIC:
        raise ValueError("not a boundary file")
    nulls, least, width = struct.unpack("<QqQ", f.read(24))
    ends = EliasFano.load(f)
    return [None] * nulls + [int(x) + least for x in EliasFano.load(f).all()], ends, width


# -- files in any store -------------------------------------------------------------------------------------------


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Written beside its place and then moved there: another attempt at the same shard writes the same bytes, as its documents' order is total but for equal ones."""
    fs, at = _store(path)
    with fs.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as f:
        f.write(data)
    fs.move(part, at)


def _get(path: str) -> bytes:
    fs, at = _store(path)
    with fs.open_input_stream(at) as f:
        return f.read()


# -- tokenizing ---------------------------------------------------------------------------------------------------


class Tokens:
    """Ids by the tokenizers library, as it gives them without adding special tokens. It cuts a text into pre-tokens that it
    encodes independently; as most of them come again, each is given to it once, and its ids are remembered (up to MEMO
    pre-tokens). Texts that hold one of the vocabulary's added tokens, which the library cuts out first, go to it whole."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("texts are cut before any normalizer: the tokenizer must have none")
        self.pattern = pattern
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of `width` bytes."""
        from codecorpus.llm.bpe import pre_tokens

        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, out, open_rows, new = self.memo, [], [], set()
        for t in texts:
            if self.added is not None and self.added.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, f"<u{self.width}").tobytes())
                continue
            pieces = pre_tokens(t, self.pattern)
            ids = list(map(memo.get, pieces))
            if None in ids:
                missing = list(itertools.compress(pieces, map(operator.is_, ids, itertools.repeat(None))))
                new.update(missing)
                open_rows.append((len(out), ids, missing))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            self._learn(list(new))
            for i, ids, missing in open_rows:
                found = map(memo.__getitem__, missing)
                out[i] = b"".join([next(found) if x is None else x for x in ids])
        return out

    def _learn(self, pieces: list[str]) -> None:
        """One call for all of them, each as a word of its own."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(found.ids, f"<u{self.width}"), np.array(found.word_ids)
        cut = np.searchsorted(word, np.arange(len(pieces) + 1)) * self.width
        data = ids.tobytes()
        self.memo.update((p, data[a:b]) for p, a, b in zip(pieces, cut.tolist(), cut[1:].tolist(), strict=False))


@functools.cache
def tokens(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


# -- writing and reading ------------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = END_ID, n: int | None = None) -> DataFrame:
    """Writes the shards of docs into folder, in ascending doc_id order; returns their table (part, shard, path, n_docs,
    n_tokens, start).

    path is a file of the tokenizers library whose pre-tokens are the matches of pattern. A null or empty text's document
    has the end id alone. Rows of a null doc_id come first; those of equal doc_id follow by a hash of their text, then the
    text. Repeated rows are documents of their own. A very long text makes a shard of its own size. Columns of docs other
    than doc_id and text are ignored, whatever their names. No rows give no files.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, made = tokens(path, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{own.width}").tobytes()
        ids, doc_ids, sizes = [], [], []

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{made:06d}"
            _put(f"{name}.ids", b"".join(ids))
            _put(f"{name}.ef", dump_shard(doc_ids, sizes, own.width))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([made], pa.int32()), "path": [name], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([sum(sizes)], pa.int64())})

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in c.blocks(texts.cast(pa.binary())):
                for key, x in zip(keys[a:b], own.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    ids += (x, end)
                    doc_ids.append(key)
                    sizes.append(len(x) // own.width + 1)
                if sum(sizes) >= SHARD_IDS:
                    yield close()
                    made += 1
                    ids, doc_ids, sizes = [], [], []
        if sizes:
            yield close()

    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # a hot doc_id is cut by its texts' hashes
    ordered = c.clean_docs(docs).repartitionByRange(n or c.partitions(spark), *order).sortWithinPartitions(*order, "text")
    files = c.kept(ordered.mapInArrow(shards, "part int, shard int, path string, n_docs long, n_tokens long"), "shards")
    # first the few totals of parts are added up, then the shards of each part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("_in", inside).join(parts, "part").select("part", "shard", "path", "n_docs", "n_tokens", (F.col("first") + F.col("_in")).alias("start"))


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document, from the files of shards.

    Documents' places come from the boundaries' select structures, a few hundred at a time."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, boundaries, width = load_shard(_get(f"{path}.ef"))
                data, last = np.frombuffer(_get(f"{path}.ids"), f"<u{width}"), 0
                for a in range(0, boundaries.n, READ_ROWS):
                    e = boundaries.select_range(a, min(a + READ_ROWS, boundaries.n)).astype(np.int64)
                    s = np.append(last, e[:-1])
                    last = e[-1]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[a : a + READ_ROWS], pa.int64()), "start": pa.array(s + start), "n_tokens": pa.array(e - s), "ids": pa.array([data[x:y].astype("<u4").tobytes() for x, y in zip(s, e, strict=True)], pa.binary())})

    spark = shards.sparkSession
    return shards.select("path", "start").repartition(4 * c.partitions(spark), "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def offset(path: str, i: int) -> int:
    """The first id of the i-th document of a shard, by select alone."""
    return 0 if i == 0 else load_shard(_get(f"{path}.ef"))[1].select(i - 1)
