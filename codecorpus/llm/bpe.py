"""Byte-level BPE by a rank queue over a hierarchical bitmap.

Each merge rank has a bucket of positions of a linked list of parts. A two-level bitmap marks the buckets in use:
find-first-set on the upper level, then on the word below, gives the least rank at once, however long the pre-token.
An entry is stale when the part at its position has gone or its pair now has another rank; it is skipped.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codecorpus.llm import common as c

#: Pre-tokens whose ids a Python worker remembers.
MEMO = 400_000
#: Characters of which re and regex hold the same to be letters, digits and spaces.
_plain = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ‐-‧‰-⁞]*")
_letters = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
#: The one pattern that _quick stands for.
QUICK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same matches as it gives of such characters: only contractions must come before other marks.
_quick = re.compile(rf" ?[{_letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_letters}]+|\s+(?!\S)|\s+")


@functools.cache
def _exact(pattern: str):
    import regex

    return regex.compile(pattern)


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of a pattern; those of QUICK_PATTERN by re for texts of common characters (it is twice as fast)."""
    return (_quick if pattern == QUICK_PATTERN and _plain.fullmatch(text) else _exact(pattern)).findall(text)


class RankQueue:
    """Positions in buckets by rank; the least rank first, and in it the least position."""

    #: Of each place in a word, its bit.
    BITS = [1 << k for k in range(256)]

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // 256 + 1)
        self.tops = [1 << k for k in range(len(self.words))]
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        self.words[rank >> 8] |= self.BITS[rank & 255]
        self.top |= self.tops[rank >> 8]

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[word] = bits = bits & (bits - 1)
            if not bits:
                self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token: the pair of least rank is merged, the leftmost first, until no pair has a rank.

    The queue, which is empty before and after, is filled and emptied in place: a call for each push and pop would take
    longer than they do."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    words, tops, buckets, bits = queue.words, queue.tops, queue.buckets, queue.BITS
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # parts begin at i and end at after[i]
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins at i
    pair.append(-1)
    top = 0
    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)  # in order, so a heap
            else:
                buckets[r] = [i]
                words[r >> 8] |= bits[r & 255]
                top |= tops[r >> 8]
    while top:
        word = (top & -top).bit_length() - 1
        held = words[word]
        rank = word << 8 | (held & -held).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            words[word] = held = held & (held - 1)
            if not held:
                top &= top - 1
        if pair[i] != rank:
            continue
        gone = after[i]
        after[i] = end = after[gone]
        pair[gone] = pair[i] = -1
        left = before[i]
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]], -1)
            if r >= 0:
                pair[i] = r
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= bits[r & 255]
                    top |= tops[r >> 8]
        if left >= 0:
            r = get(piece[left:end], -1)
            if r != pair[left]:
                pair[left] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], left)
                    else:
                        buckets[r] = [left]
                        words[r >> 8] |= bits[r & 255]
                        top |= tops[r >> 8]
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


class Encoder:
    """Ids of texts and back, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.vocabulary = {v: k for k, v in self.ranks.items()}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        memo, pieces = self.memo, pre_tokens(text, self.pattern)
        out = list(map(memo.get, pieces))
        if not all(out):  # a piece has an id at least
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = memo.get(pieces[k]) or self.first(pieces[k])
        return b"".join(out)

    def first(self, piece: str) -> bytes:
        """The ids of a pre-token that isn't remembered."""
        found = merge(piece.encode(), self.ranks, self.queue)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded bytes of each row of docs.

    path names a file of ranks that every worker can open. A null text is encoded as the empty one: no ids. Repeated
    rows give repeated rows, very long texts one row like others. Columns other than doc_id and text are ignored, whatever
    their names. No rows give no rows. No shuffle.
    """

    def step(keys: list, texts: list[bytes]) -> dict:
        own = encoder(path, pattern)
        ids = [own.encode(t.decode()) for t in texts]
        return {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([own.decode(x) for x in ids], pa.binary())}

    return c.map_blocks(c.clean_docs(docs), step, "doc_id long, n_tokens long, ids binary, decoded binary")
