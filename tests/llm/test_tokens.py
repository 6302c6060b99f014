"""Token counts and token files against the tokenizers library itself."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoplane.llm import dac
from shoplane.llm.token_count import UnitCounter, byte_groups, count_tokens
from shoplane.llm.token_file import WordEncoder, read_documents, read_tokens, write_token_files
from shoplane.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", " ", "\u0085", " ", "'s", "'LL", "don't", "Été", "é",
       "a", "the.", "12", "<|endoftext|>", "<|startoftext|>", "日本", "ΑΣ", "İ", "K", "...", "***", "_", "\U0001F600", "ǅ", "ﬁ",
       "J\u030c", "j\u030c", "E\u0301", "K\u0338", "<|EndOfText|>", "ÀB", "İ", "The", "THE'S"]


@pytest.mark.parametrize("seed", range(3))
def test_units_count_like_the_library(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD + [" "] * 8) for _ in range(rng.randrange(30))) for _ in range(400)]
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    assert UnitCounter(BYTE, 1000).counts(texts) == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(WORD, 1 << 20)
    for _ in range(2):  # learned, then known
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t.encode() for t in texts])]
        assert got == [e.ids for e in word.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("max_bytes", [0, 300_000, 1 << 24])
def test_words_come_back_from_any_generation(max_bytes):
    """Batches of new, recent and long unused words, with a table too small for them all."""
    rng = random.Random(max_bytes)
    word = Tokenizer.from_file(WORD)
    encoder, flips = WordEncoder(WORD, max_bytes), 0
    for batch in range(40):
        texts = [" ".join(rng.choice(["", "The ", "İ", "K9, "]) + rng.choice(ODD) + f"word{rng.randrange(batch * 20 + 1)}" + rng.choice(["", ".", "!?", "été"])
                          + "abcdefghij"[rng.randrange(10):] for _ in range(rng.randrange(30))) for _ in range(20)] + ["", "   "]
        young = encoder.young
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t.encode() for t in texts])]
        assert got == [e.ids for e in word.encode_batch(texts, add_special_tokens=False)]
        flips += encoder.young is not young
        assert max_bytes > 300_000 or encoder.young.held < max_bytes + 500_000
    assert (flips > 3) == (max_bytes <= 300_000)


@pytest.mark.parametrize("max_units", [0, 300, 10**6])
def test_units_come_back_from_any_generation(max_units):
    rng, byte = random.Random(max_units), Tokenizer.from_file(BYTE)
    counter = UnitCounter(BYTE, max_units)
    for batch in range(30):
        texts = [" ".join(rng.choice(ODD) + f"word{rng.randrange(batch * 20 + 1)}" for _ in range(rng.randrange(30))) for _ in range(20)] + [""]
        assert counter.counts(texts) == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]
    assert bool(counter.old) == (max_units <= 300)


def test_byte_groups_cover_all_rows():
    assert list(byte_groups([5, 5, 100, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(byte_groups([], 10)) == []


def _texts(spark, path):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def test_count_tokens(spark, awkward, none):
    byte = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in AWKWARD)
    got = count_tokens(awkward, "byte_bpe_50k.json", limit=20).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert count_tokens(none, BYTE).count() == 0
    docs = _texts(spark, SF_SMALL)
    got = count_tokens(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), BYTE).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in docs}


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 32), (513, 256), (5000, 70000), (4096, 1 << 32)])
def test_dac_round_trip_and_random_access(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    segment = dac.Segment(dac.encode(ids))
    assert (segment.all() == ids).all() and segment.n == n
    for i in sorted({0, n // 2, n - 1, *range(0, n, 97)} & set(range(n))):
        assert segment.token(i) == ids[i]
    with pytest.raises(IndexError):
        segment.token(n)


def _expect(docs):
    word, at, out = Tokenizer.from_file(WORD), 0, []
    for i, t in docs:
        ids = [*word.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, awkward, none):
    docs = sorted(_texts(spark, SF_SMALL))
    path = scratch_path(spark, "t")
    write_token_files(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), path, WORD, segment_tokens=5000)
    got = sorted(tuple(r) for r in read_documents(spark, path).collect())
    assert got == _expect(docs)
    # random access: the first and last id of each document
    word = Tokenizer.from_file(WORD)
    places = [(p,) for _, s, n, _ in got for p in (s, s + n - 1)] + [(got[-1][1] + got[-1][2],), (-1,), (0,)]
    read = {r.position: r.token for r in read_tokens(spark, path, spark.createDataFrame(places, "position bigint"), bucket=4096).collect()}
    assert len(read) == len({p for p, in places if 0 <= p < got[-1][1] + got[-1][2]})
    for (i, t), (_, s, n, _) in zip(docs, got):
        ids = [*word.encode(t, add_special_tokens=False).ids, 1]
        assert (read[s], read[s + n - 1]) == (ids[0], 1)
    # awkward rows: null ids first, equal ids by any fixed order
    path = scratch_path(spark, "t")
    write_token_files(awkward, path, WORD)
    got = read_documents(spark, path).collect()
    assert len(got) == len(AWKWARD)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i))
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((n, c) for _, _, n, c in _expect([r[:2] for r in AWKWARD]))
    path = scratch_path(spark, "t")
    write_token_files(none, path, WORD)
    assert read_documents(spark, path).count() == 0
    assert os.path.basename(path)
