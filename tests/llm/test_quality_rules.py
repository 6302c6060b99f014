"""Base statistics against plain Python; the learned list on planted rules and held-out rows."""

import collections
import random
import re

from pyspark.sql import functions as F

from shoplane.llm.quality_rules import FEATURES, base_features, learn_rules, quality_report, verdict
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import AWKWARD


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed


def test_documents_and_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_report(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0)).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])
        assert not (r.kept and r.base_failed)
    import zlib
    held = [r for r in rows if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 4 == 0 and not r.base_failed]
    assert sum(r.kept == bool(quality[r.doc_id]) for r in held) / len(held) > 0.9
    assert any(r.rule for r in rows)


def test_repeats_on_small_alphabets(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(300)]
    got = {r.id: r.n_repeat_words for r in base_features(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: brute(t)[4] for i, t in docs}


def test_planted_rule_is_found(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        f = [rng.random() for _ in FEATURES]
        bad = f[2] >= 0.8 and f[5] < 0.5
        rows.append((*f, bad, i % 3 == 0))
    df = spark.createDataFrame(rows, ", ".join(f"f_{f} double" for f in FEATURES) + ", bad boolean, prune boolean")
    rules = learn_rules(df)
    assert {c.feature for r in rules for c in r} <= {FEATURES[2], FEATURES[5]} | set(FEATURES) and rules
    got = df.withColumn("rejected", verdict(rules).isNotNull()).where("rejected = bad").count()
    assert got > 0.95 * len(rows)
    assert learn_rules(df.where("not bad")) == [] and learn_rules(df.limit(0)) == []


def test_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(7, 0, 1), (3, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id bigint, quality int, id int")
    rows = quality_report(awkward, labels).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows))) \
        == sorted(map(key, ((i, *brute(t)) for i, t, *_ in AWKWARD)))
    assert quality_report(none, labels).count() == 0
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert all(r.kept != r.base_failed for r in quality_report(docs, labels.limit(0)).collect())
