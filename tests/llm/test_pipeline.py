"""Each stage on its own input, and the chain, against plain Python."""

import collections

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute as brute_groups


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontaminate", "mix", "token_output"]
    kept = _rows(docs)
    chain = docs
    for name in list(stages)[:-1]:
        before, out = kept, stages[name](spark, chain, SF_SMALL)
        assert out.columns == docs.columns
        kept = _rows(out)
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r[1] or "")]
        elif name == "near_duplicates":
            low = {i: c for i, _, c in brute_groups([(r[0], r[1]) for r in before])}
            want = [r for r in before if low[str(r[0])] == str(r[0])]
            assert len(want) < len(before)
        elif name == "decontaminate":
            hit = {r[0] for r in brute_hits([(r[0], r[1]) for r in before], bench) if r[5]}
            want = [r for r in before if str(r[0]) not in hit]
            assert len(want) < len(before)
        else:
            assert set(kept) <= set(before)
            copies = collections.Counter(kept)
            assert max(copies.values()) > 1 and len(copies) < len(before)
            want = kept
        assert kept == want, name
        chain = spark.createDataFrame(kept, docs.schema)
    last = stages["token_output"](spark, chain, SF_SMALL).collect()
    assert sorted(r.doc_id for r in last) == sorted(r[0] for r in kept)
    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last)


def test_awkward_rows(spark, awkward, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, none):
            out = stage(spark, docs, SF_SMALL)
            n = out.count()
            assert n <= docs.count() or name == "mix"  # a tiny source is repeated until it has its share
            if name != "token_output":
                assert out.columns == docs.columns
