import random
from collections import Counter

import pytest

from codecorpus.llm import token_counts as op

from . import cases

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def test_counts_as_the_library(spark):
    model = op.counter(PATH).model
    rows = cases.ROWS + [(400 + i, t, *[None] * 7) for i, t in enumerate(["<s> a </s><unk>", "<0x0A>\n\n\n", "▁▁a ▁ b", "x   y    z ", " \t ", "a" * 4096 + "b", cases.prose(9, 9000)])]
    got = op.count_documents(cases.table(spark, rows), PATH, 4096).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 4096) for r in rows for n in [len(model.encode(r[1] or ""))]]
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.over_limit for r in got} == {True, False}
    assert op.count_documents(cases.table(spark, []), PATH, 4096).count() == 0


def test_the_limit_itself_is_not_over(spark):
    (row,) = op.count_documents(cases.table(spark, [cases.ROWS[5]]), PATH, 10**6).collect()
    at = [op.count_documents(cases.table(spark, [cases.ROWS[5]]), PATH, row.n_tokens + d).first().over_limit for d in (-1, 0)]
    assert at == [True, False]


def test_random_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(op, "MEMO", 50)
    own, r = op.Counter(PATH), random.Random(4)
    for _ in range(6000):
        text = "".join(r.choice("aabcdeé́日 '’\n\t.!1² st▁<s>  \x00﷽in") for _ in range(r.randint(0, 60)))
        assert own.count(text) == len(own.model.encode(text)), text
    assert len(own.memo) <= 50
    long = "".join(r.choice("abcde") for _ in range(50_000))
    assert own.count(long) == len(own.model.encode(long)) and own.count(" " * 9999) == len(own.model.encode(" " * 9999))


def test_the_heap_merges_least_rank_then_leftmost():
    ranks = {"a": 9, "b": 9, "ab": 1, "ba": 0}
    assert op.merged_count("ab", ranks) == 1
    assert op.merged_count("aba", ranks) == 2  # a, ba
    assert op.merged_count("abab", ranks) == 3  # a, ba, b
    assert op.merged_count("aaa", {"a": 2, "aa": 1}) == 2
    assert op.merged_count("é", {"a": 1}) == 2 and op.merged_count("", {}) == 0


def test_a_model_whose_words_depend_on_each_other_is_refused(monkeypatch):
    monkeypatch.setattr(op, "merged_count", lambda symbols, ranks: len(symbols))
    with pytest.raises(ValueError, match="no BPE model"):
        op.Counter(PATH)
