"""Spans against Python's re with the plain patterns."""

import hashlib
import random
import re

import pytest

from shoplane.llm.pii import pii_report
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text, spans = text or "", []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) \
                    or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind))
    spans.sort()
    joined = ",".join(s[2] for s in spans)
    return *(sum(s[3] == k for s in spans) for k in PLAIN), hashlib.sha256(joined.encode()).hexdigest(), joined


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii_report(df).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        r, want = got[i], brute(t)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5], (t, r.spans, want)
        assert set(filter(None, want[5].split(","))) <= set(r.spans.split(","))
        assert (r.n_method > 0) or r.spans == want[5]
    return got


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(spark, docs)


@pytest.mark.parametrize("seed", range(2))
def test_random_strings(spark, seed):
    rng = random.Random(seed)
    bits = ["a", "b_", "@", ".", "-", " ", "+", "1", "25", "300", "192.168.0.1", "4111 1111 1111 1111", "x@y.zz", "(", ")", "+1 (555) 010-2030",
            "\U0001F600", "é", "%", "\n", "0", "79927398713", "00"]
    check(spark, [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(1500)])


def test_long_runs_do_not_blow_the_stack(spark):
    check(spark, [(1, "1 " * 50000), (2, "a." * 2000 + "@" + "b." * 8000 + "c"), (3, "1.2.3.4." * 20000), (4, "a@b.c " * 3000), (5, "9" * 20000), (6, "+1" + "()" * 30000 + "2")])


def test_method_spans_and_context(spark):
    docs = [(1, "IBAN DE89 3704 0044 0532 0130 00 IS mine"), (2, "GB82WEST12345698765432"), (3, "GB82WEST12345698765433"),
            (4, "ssn 123-45-6789"), (5, "part 123-45-6789"), (6, "666-45-6789 ssn"), (7, "card 4111 1111 1111 1111")]
    got = check(spark, docs)
    assert [got[i].n_method for i in range(1, 8)] == [1, 1, 0, 1, 0, 0, 0]
    assert "iban:5:32" in got[1].spans and got[4].spans == "ssn:4:15"
    assert got[7].max_score == 1.0


def test_awkward_rows(spark, awkward, none):
    got = sorted((str(r.doc_id), r.base_sha256) for r in pii_report(awkward).collect())
    assert got == sorted((str(i), brute(t)[4]) for i, t, *_ in AWKWARD)
    assert pii_report(none).count() == 0
