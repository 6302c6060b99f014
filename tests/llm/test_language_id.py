"""Language ID: the encoding against a letter-by-letter one, held-out accuracy, awkward rows."""

import zlib

import numpy as np

from shoplane.llm.language_id import Hypervectors, identify_languages, reject_undetermined
from tests.conftest import SF_ORACLE


def brute_vector(hv, text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    seq = " " + " ".join(letters.split()) + " " if letters.split() else " "
    out = np.zeros(hv.dim, np.int64)
    hv._rows(np.array([ord(c) for c in set(seq)]))
    rows = {c: hv.table[hv.row[ord(c)]].astype(np.int64) for c in set(seq)}
    for i in range(len(seq) - 2):
        a, b, c = seq[i:i + 3]
        out += rows[a] * np.roll(rows[b], 1) * np.roll(rows[c], 2)
    return out


def test_vectors_match_definition():
    texts = ["The cat, the CAT!", "ab", "", "12 !", "日本語 の ÉÀ", "x" * 50, " a  b "]
    hv = Hypervectors(64, 3, 7)
    got, has = hv.vectors(texts)
    assert has.tolist() == [True, True, False, False, True, True, True]
    for t, v in zip(texts, got):
        assert np.array_equal(v, brute_vector(hv, t)), t


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert held and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.99


def test_awkward_rows(spark, awkward, none):
    rows = {(r.doc_id): r for r in identify_languages(awkward).collect()}
    assert awkward.count() == identify_languages(awkward).count()
    assert [rows[i].lang_pred for i in (9, 10, 11)] == ["und"] * 3 and rows[9].score == 0
    assert rows[13].lang_pred in ("en", "fr", "de")
    assert identify_languages(none).count() == 0
    unlabelled = awkward.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


def test_no_learned_language_drops_only_texts_without_a_letter(spark):
    rows = [(i, t, None) for i, t in enumerate(("a few words", "", None, "12 34", "日本語"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in reject_undetermined(docs, per_language=5, dim=64, ngram=3).collect()) == [0, 4]


def test_texts_that_no_profile_knows_are_rejected(spark):
    """An unknown script and random letters go; every text of the learned languages and short texts stay."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text", "lang")
    strange = ["日本語のテキストはここにあります。言語を判定するための文章です。これは長い文章です。", "Это русский текст для проверки определения языка документа и он довольно длинный",
               "ეს არის ქართული ტექსტი ენის ამოცნობის შესამოწმებლად", "Това е", "日本"]
    odd = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in reject_undetermined(docs.unionByName(odd), per_language=800, dim=1024, ngram=3).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {-4, -5}
