"""The CRF against enumeration of all labellings; held-out quality; awkward rows."""

import itertools

import numpy as np

from shoplane.llm.line_crf import classify, forward_backward, line_features, padded, train, with_neighbours
from tests.conftest import SF_ORACLE


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    start, move = rng.normal(size=2), rng.normal(size=(2, 2))
    seqs = [rng.normal(size=n) for n in (1, 2, 3, 5, 6)]
    for idx, value, mask in padded(seqs):
        good, log_z, moves = forward_backward(value, mask, start, move)
        for k, i in enumerate(idx):
            u, n = seqs[i], len(seqs[i])
            paths = list(itertools.product((0, 1), repeat=n))
            scores = np.array([start[p[0]] + sum(u[t] * p[t] for t in range(n)) + sum(move[p[t - 1], p[t]] for t in range(1, n)) for p in paths])
            z = np.log(np.exp(scores).sum())
            prob = np.exp(scores - z)
            assert np.isclose(z, log_z[k])
            assert np.allclose(good[k, :n], [sum(q for q, p in zip(prob, paths) if p[t]) for t in range(n)])
            want = np.zeros((2, 2))
            for q, p in zip(prob, paths):
                for a, b in zip(p, p[1:]):
                    want[a, b] += q
            assert np.allclose(moves[k], want)


def test_training_separates_planted_lines():
    rng = np.random.default_rng(1)
    docs = [(b"\n".join(b"Plain words stand here in a line." if y else b"AAA!! BBB!! CCC!!" for _ in range(1 + rng.integers(5))), y) for y in [0, 1] * 40]
    model = train([with_neighbours(line_features(t)[0]) for t, _ in docs], [y for _, y in docs])
    from shoplane.llm.line_crf import score_texts
    scores = score_texts([t for t, _ in docs], model)
    assert all((s > 0.9) == bool(y) and (s < 0.1) != bool(y) for s, (_, y) in zip(scores, docs))


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    good = [r.score for r in held if quality[r.doc_id]]
    bad = [r.score for r in held if not quality[r.doc_id]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.93


def test_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(7, 0), (3, 1), (None, 0), (9, None), (12, 1), (15, 0)], "doc_id bigint, quality int")
    rows = classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (9, 10, 11)] == [0, 0, 0]
    assert classify(none, labels).count() == 0
    assert {r.score for r in classify(awkward, labels.limit(0)).collect()} == {0.0, 0.5}
