"""Decontamination against a word-by-word search."""

import collections
import hashlib
import random
import re

from shoplane.llm.decontaminate import Benchmark, PostingIndex, contamination, proximity_matches
from tests.conftest import SF_SMALL

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in SEP.split(low) if w]


def brute(docs, bench, n=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if found := windows.get(tuple(w[s:s + size])):
                    hit |= set(range(s, s + size))
                    items |= found
        out.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = rows(contamination(docs, bench))
    assert got == want and any(r[5] for r in got) and not all(r[5] for r in got)


def test_awkward_rows(spark, awkward, none):
    items = [(1, "The quick brown fox jumps over the lazy dog and then"), (2, "quick BROWN fox"), (3, None), (4, ""), (5, "same-row"),
             (6, "the the the the the the the the the the the"), (None, "un deux"), (8, "quick brown fox"), (9, "b b"),
             (10, "word5 the word6 the word7 the word8 the word9 the"), (11, "ÀÉ ẞß")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, term int")
    plain = [(r.doc_id, r.text) for r in awkward.collect()] + [(77, "The " * 25), (78, "b b b")]
    more = spark.createDataFrame([(i, t) for i, t in plain[-2:]], "doc_id bigint, text string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    # a null item id can't be named; its windows still count as hits
    want = brute(plain, [("", t) if i is None else (i, t) for i, t in items if t is not None])
    got = rows(contamination(docs, bench))
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    named = [r for r in got if r[0] != "None"]
    assert named == [r for r in want if r[0] != "None"]
    assert contamination(none, bench).count() == 0
    assert not any(r[5] for r in rows(contamination(docs, bench.limit(0))))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha beta"), (3, "alpha q q q q q q q beta"), (4, "beta")], "doc_id bigint, text string")
    bench = Benchmark(spark.createDataFrame([(1, "alpha beta")], "item_id int, text string"), window=2)
    found = proximity_matches(bench, PostingIndex(docs, bench), slack=2)
    assert sorted((r.doc.id, r.item, r["at"]) for r in found.collect()) == [(1, "1", 0), (2, "1", 0)]


def near_brute(docs, bench, n, slack):
    """Windows with every word within ``slack`` of its place beside an occurrence of the rarest one (ties: the first)."""
    texts = [words(t) for _, t in docs]
    freq = collections.Counter(w for t in texts for w in t)
    windows = {}
    for _, text in bench:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows[tuple(w), i] = w[i:i + n]
    out = []
    for t in texts:
        near = 0
        for win in windows.values():
            if all(freq[x] for x in win):
                a = min(range(len(win)), key=lambda j: (freq[win[j]], j))
                near += any(x == win[a] and all(y in t[max(p - a + j - slack, 0):max(p - a + j + slack + 1, 0)] for j, y in enumerate(win))
                            for p, x in enumerate(t))
        out.append(near)
    return out


def test_proximity_counts(spark):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "d", "e", "f1", "g", "h", "rare"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, "")]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9)))) for i in range(12)] + [(50, "rare"), (51, "nowhere a b c"), (52, None)]
    planted = bench[0][1].split()
    docs += [(70, " ".join(["z", *planted[:2], "z", *planted[2:], "z"])), (71, " ".join(planted))]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(bench, "item_id int, text string")
    for n, slack in ((4, 0), (4, 1), (5, 3)):
        got = {r.doc_id: r.n_proximity for r in contamination(*frames, window=n, slack=slack).collect()}
        assert got == dict(zip([i for i, _ in docs], near_brute(docs, bench, n, slack))), (n, slack)
    assert sum(got.values()) > 20
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows_ = contamination(docs, bench).collect()
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10, 2)
    assert sorted(r.n_proximity for r in rows_) == sorted(want) and all((r.n_hit == 0) or r.n_proximity for r in rows_)
