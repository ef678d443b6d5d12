import base64
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import bpe, elias_fano
from codecorpus.llm import common as c

from . import cases

P = pytest.importorskip("public_tokenizers")


def encoder():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 9), (1000, 50), (1000, 10**12)])
def test_elias_fano_holds_any_sequence(n, top):
    r = random.Random(n + top)
    values = sorted(r.randrange(top) for _ in range(n))
    import io

    found = elias_fano.EliasFano.load(io.BytesIO(elias_fano.EliasFano.of(np.array(values, np.uint64)).dump()))
    assert found.all().tolist() == values
    assert [found.select(i) for i in range(n)] == values
    for _ in range(20):
        a = r.randint(0, n)
        b = r.randint(a, n)
        assert found.select_range(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        found.select(n)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(elias_fano.EliasFano.of(ends).dump()) < 10_000 * 2


def test_files_hold_what_the_tokenizer_gives(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(elias_fano, "SHARD_IDS", 2000)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [r for r in cases.ROWS if r[0] is not None]
    rows += [(900 + i, t, *[None] * 7) for i, t in enumerate(["aa <|endoftext|> bb", "<|endoftext|><|endoftext|>", "x<|endoftext", "<|endoftext|>  y  <|endoftext|>"])]
    shards = elias_fano.write(cases.table(spark, rows), c.new_folder(spark, "ids"), P.path("byte_bpe_50k.json"), P.PATTERN, n=3)
    got = elias_fano.read(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    want, start = Counter(), 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[r[0], len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for s in shards.collect():
        assert elias_fano.offset(s.path, s.n_docs - 1) < s.n_tokens


def test_null_ids_and_no_rows(spark):
    shards = elias_fano.write(cases.table(spark), c.new_folder(spark, "ids"), P.path("byte_bpe_50k.json"), P.PATTERN)
    got = elias_fano.read(shards).orderBy("start").collect()
    assert [r.doc_id for r in got[:2]] == [None, None] and len(got) == len(cases.ROWS)
    none = elias_fano.write(cases.table(spark, []), c.new_folder(spark, "ids"), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert elias_fano.read(none).count() == 0


def test_rank_queue_merges_as_tiktoken(spark):
    enc = encoder()
    got = bpe.encode_documents(cases.table(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == Counter((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in ((r[0], r[1]) for r in cases.ROWS) for ids in [enc.encode_ordinary(t or "")])
    assert bpe.encode_documents(cases.table(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_random_pieces_merge_as_tiktoken():
    enc, own, r = encoder(), bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(3)
    for k in range(1500):
        text = "".join(r.choice("aabcdeé́日 '’\n\t.!1² st") for _ in range(r.randint(1, 60)))
        assert own.encode(text) == np.array(enc.encode_ordinary(text), "<u4").tobytes(), text
    long = "".join(r.choice("abcde") for _ in range(20_000))
    assert own.encode(long) == np.array(enc.encode_ordinary(long), "<u4").tobytes()


def test_queue_gives_least_rank_then_least_position():
    q, r = bpe.RankQueue(50_000), random.Random(5)
    items = [(r.randrange(50_000), r.randrange(100)) for _ in range(500)]
    for x in items:
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_pre_tokens_are_those_of_the_pattern_given():
    import regex

    for pattern in (P.PATTERN, r"\p{L}|\s+|.", r" ?\p{L}{1,3}|[^\p{L}]"):
        for text in [t for t in cases.TEXTS if t]:
            assert bpe.pre_tokens(text[:5000], pattern) == regex.findall(pattern, text[:5000])
    assert P.PATTERN == bpe.QUICK_PATTERN


def test_merging_calls_nothing_for_each_push_and_leaves_the_queue_empty():
    import sys

    own, calls = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), []
    piece = "".join(random.Random(7).choice("abcde") for _ in range(300)).encode()
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        ids = bpe.merge(piece, own.ranks, own.queue)
    finally:
        sys.setprofile(None)
    assert calls == ["merge"] and b"".join(own.vocabulary[i] for i in ids) == piece
    assert own.queue.pop() is None and not own.queue.buckets and not any(own.queue.words)
