"""Ranked lexical search against a direct reading of the scoring rule and the SQL twin."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from shoplane.llm import lexical
from shoplane.llm.lexical import rank_documents
from shoplane.llm.queries import QUERIES, SQL
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in words if bag[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dense", [2, 512])
def test_whole_tables(spark, monkeypatch, dense):
    monkeypatch.setattr(lexical, "_DENSE_TERMS", dense)
    got = QUERIES["op12_lexical_search"](spark, SF_SMALL)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    got = rows(got)
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 10)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert got == sorted(db.execute(SQL["op12_lexical_search"]).fetchall(), key=str)


def test_odd_rows_and_blocks(spark, awkward, none):
    rng = random.Random(4)
    words = ["the", "fox", "Été", "日本", "k9", "b", "x" * 300, "away"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(30)]
    items += [(None, "fox fox jumps!"), (40, None), (41, "..."), (42, "nowhere"), (3, "home"), (7, items[7][1]), (43, "the " * 3000)]
    frame = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS term", "'a' AS count", "2 AS doc_id")
    extra = [(100 + i, "fox home " * (i % 3 + 1)) for i in range(60)] + [(50, "the fox"), (50, "the fox"), (None, "the fox")]
    docs = awkward.select("doc_id", "text", "id", "Key", "start").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "1 AS n", "2 AS vec", "3 AS score")
    want = brute([(r[0], r[1]) for r in AWKWARD] + extra, items, 4)
    assert rows(rank_documents(docs, frame, k=4)) == want
    assert rows(rank_documents(docs, frame, k=4, block_items=7)) == want
    assert rows(rank_documents(docs.repartition(40), frame, k=4, block_pairs=20)) == want
    assert rank_documents(docs.limit(0), frame).count() == rank_documents(docs, frame.limit(0)).count() == rank_documents(none, frame).count() == 0


def test_sums_beyond_doubles_use_integers():
    df = np.array([1, 5])
    weights = np.array([4 * 10**9, 7])
    vectors = [np.array([0, 3, 1, 2], "<u4").tobytes(), np.array([1, 9], "<u4").tobytes()]
    scorer = lexical._Scorer(2, 2, [(0, 0, 3), (1, 1, 2)], weights, df, 2)
    assert scorer.kind is np.int64
    impact = lambda tf, m: (10**9 * tf) // (1000 * tf + 8 * m)
    assert scorer.scores(np.array([100, 30]), vectors).tolist() == [[12 * 10**9 * impact(3, 100), 14 * impact(2, 100)], [0, 14 * impact(9, 30)]]
