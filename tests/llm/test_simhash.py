"""SimHash links against all pairs on small inputs."""

import hashlib
import random

import pytest

import xxhash

from shoplane.llm import simhash
from shoplane.llm.simhash import (block_masks, drop_near_duplicates, fingerprint, fingerprints, link_fingerprints,
                                  simhash_duplicates)
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD


def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    low = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted((str(i), f"{f:016x}", str(low.get(c))) for (i, _), f, c in zip(rows, fps, comp))


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("a b c",), ("ü 日",)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h % (1 << 64) == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in got)


def test_fingerprint_matches_definition():
    for _, t, *_ in AWKWARD:
        assert fingerprint(t.encode() if t is not None else None, 3, 42, xxhash.xxh64_intdigest) == brute_fingerprint(t)


def test_awkward_rows(spark, awkward, none):
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_duplicates(awkward).collect())
    assert got == brute([r[:2] for r in AWKWARD])
    assert simhash_duplicates(none).count() == 0


def test_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_duplicates(df).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("cell", [1, 5, 256])
def test_all_links_of_dense_balls_are_found(spark, monkeypatch, cell):
    """Chains and balls of close fingerprints, in which many members share keys."""
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        ball = [centre]
        for _ in range(60):
            f = rng.choice(ball)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
            ball.append(f)
        fps |= set(ball)
    fps = sorted(fps)
    comp = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, rng.randrange(1, 5)) for f in signed], "fp bigint, n bigint")
    monkeypatch.setattr(simhash, "CELL", cell)
    roots = {r.node: r.root for r in link_fingerprints(nodes).collect()}
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(got, comp))) == len(set(got)) == len(set(comp))


def test_masks_agree_by_pigeonhole():
    masks = [m % (1 << 64) for m in block_masks(6, 3)]
    assert len(masks) == 20
    rng = random.Random(2)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(diff & m == 0 for m in masks)


def test_survivors(spark, awkward, none):
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [3, 7, 8, 9, 12, 13, 14, 15]
    assert [r.text for r in rows if r.doc_id is None] == ["un deux trois"]
    assert drop_near_duplicates(none).count() == 0
    assert fingerprints(none).count() == 0


def test_survivors_of_an_id_with_several_texts(spark):
    """Ids shared by texts of different components, hot and null ids among them."""
    a, b = "un deux trois quatre cinq six sept huit", "The quick brown fox jumps over the lazy dog and then it runs away home"
    rows = [(7, a), (7, "other words stand here now"), (3, b), (5, b.upper()), (5, "five has one text of its own"), (5, "and a second one too"),
            (None, b.lower()), (None, "no id at all"), (None, "no id AT all"), (None, "nor has this one any"), (8, None), (8, ""), (8, "eight")]
    rows += [(1, f"text {i} of the hot id {i * i} and {i % 7}") for i in range(40)] * 2
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, row_key string")
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    want = {}
    for (i, t), c in zip(rows, comp):
        rank = (i is None, i or 0, t is not None, hashlib.md5((t or "").encode()).hexdigest())
        want[c] = min(want.get(c, (rank, i, t)), (rank, i, t), key=lambda x: x[0])
    for parts in (1, 5):
        got = drop_near_duplicates(docs.repartition(parts))
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for _, i, t in want.values())
    assert len(want) > 45
