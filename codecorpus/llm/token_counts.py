"""Token counts of a BPE model with byte fallback, by a heap and a linked list; no ids are made.

A text's symbols are its characters. The adjacent pair of the best piece (least rank, then leftmost) is merged again and
again; the count is the number of symbols less the merges, with the UTF-8 bytes of each character that is no piece in
place of that character. Merges never cross the begin of a run of spaces, as no piece holds a space after another
character, so a text's words are counted by themselves and the counts of short ones are remembered.
"""

from __future__ import annotations

import functools
import heapq
import operator
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from codecorpus.llm import common as c

#: Words and parts whose counts a Python worker remembers, and the longest of them.
MEMO, MEMO_LENGTH = 1_500_000, 64
#: What the model's library puts for a space.
SPACE = "▁"
#: Texts on which a model must count as its library does.
PROBES = ("Merge these  words,\tplease: 2024\n", "   é日本 ▁ \x00﷽ <s></s><unk><0x0A> ", "aaaaaaaabbbbbbbb" * 4)


def merged_count(symbols: str, ranks: dict[str, int]) -> int:
    """Symbols less merges; characters that are no piece count by their bytes.

    The heap holds the rank, left symbol and end of pairs, as one number each. An entry is stale once its left symbol
    has gone into another or the pair that begins there ends elsewhere.
    """
    n = len(symbols)
    get, shift = ranks.get, n.bit_length()
    mask, high = (1 << shift) - 1, 2 * shift
    count = n + sum([len(ch.encode()) - 1 for ch in symbols if ch not in ranks])
    heap = [r << high | i << shift | i + 2 for i, r in enumerate(map(get, map(operator.add, symbols, symbols[1:]))) if r is not None]
    if not heap:
        return count
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after = list(range(1, n + 1))  # the symbol at i ends where the next begins; -1: merged into one before
    before = list(range(-1, n))
    while heap:
        entry = pop(heap)
        i, end = entry >> shift & mask, entry & mask
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, -1
        before[end] = i
        count -= 1
        if end < n and (r := get(symbols[i : (far := after[end])])) is not None:
            push(heap, r << high | i << shift | far)
        if i and (r := get(symbols[(left := before[i]) : end])) is not None:
            push(heap, r << high | left << shift | end)
    return count


def _marks(pieces: list[str]) -> set[str]:
    """Characters, no letters or digits, that no piece has beside another character than such a one (or after a space)."""
    marks = {ch for p in pieces for ch in p if not ch.isalnum() and ch != SPACE} | set("\t\n\r")
    while True:
        beside = {x for p in pieces for a, b in zip(p, p[1:], strict=False) if a != SPACE and (a in marks) != (b in marks) for x in (a, b)}
        if not beside & marks:
            return marks
        marks -= beside


class Counter:
    """Counts tokens of texts with a bounded memory of words and their parts.

    A word is what follows one space, without it; a part that follows no SPACE is remembered with " " before it.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        places = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: places[x] for p, x in scores.items()}
        own = "".join(map(re.escape, sorted(_marks(list(scores)))))
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{own}]+|{SPACE}*[{own}]+|{SPACE}+").findall
        self.memo: dict[str, int] = {}
        if any(SPACE in p.lstrip(SPACE) for p in scores) or any(self.count(t) != len(model.encode(t)) for t in PROBES):
            raise ValueError(f"{path} is no BPE model with byte fallback whose words can be counted by themselves")

    def _remember(self, key: str, n: int) -> int:
        if len(key) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = n
        return n

    def _word(self, word: str) -> int:
        """Of a word, or any text that has a space before it."""
        total, parts = 0, self.parts(SPACE + word)
        for part in parts:
            key = part[1:] if part[0] == SPACE else " " + part
            n = self.memo.get(key)
            total += self._remember(key, merged_count(part, self.ranks)) if n is None else n
        return self._remember(word, total) if len(parts) > 1 else total

    def count(self, text: str) -> int:
        if not (text := self.model.normalize(text)):
            return 0
        words = text[1:].split(SPACE)
        if text[0] != SPACE or "" in words:  # several spaces together
            parts, memo = self.parts(text), self.memo
            keys = [p[1:] if p[0] == SPACE else " " + p for p in parts]
            return sum([self._remember(k, merged_count(p, self.ranks)) if (n := memo.get(k)) is None else n for k, p in zip(keys, parts, strict=True)])
        found = list(map(self.memo.get, words))
        if None not in found:
            return sum(found)
        return sum([self._word(w) if n is None else n for w, n in zip(words, found, strict=True)])


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_documents(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of docs.

    path names a sentencepiece BPE model with byte fallback that every worker can open; a model that isn't one is an
    error. Tokens are those of the library without begin, end or other added tokens; special strings inside texts are
    ordinary text. A null text counts as the empty one: no tokens. Repeated rows give repeated rows, null doc_ids stay,
    very long texts give one row like others. Columns other than doc_id and text are ignored, whatever their names. No
    rows give no rows. No shuffle.
    """

    def step(keys: list, texts: list[bytes]) -> dict:
        own = counter(path)
        tokens = [own.count(t.decode()) for t in texts]
        return {"doc_id": pa.array(keys, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_())}

    return c.map_blocks(c.clean_docs(docs), step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
