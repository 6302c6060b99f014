"""Personal data: regular expressions propose spans, checksums confirm them,
context words adjust a score (DataFrame operations only).

A kind's matches and the gaps between them come from one pattern
(``regexp_extract_all`` and ``split``); prefix sums of their lengths are the code
point offsets, and the gaps' ends next to a match are its context. Patterns are
written so that the regex engine neither backtracks over a run twice nor recurses
with its length (possessive groups, starts only where a run starts).

Base kinds keep every span that passes their check. The method's own kinds
need a valid checksum or form and a score of at least ``THRESHOLD``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplane.llm.common import text_or_empty

#: Code points beside a match that are searched for context words.
CONTEXT_CHARS = 40
THRESHOLD = 0.6
CONTEXT_BONUS = 0.3
_CHUNK = 64


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a string of digits: every second one from the right is doubled."""
    doubled = "0246813579"  # digit sums of twice 0 to 9
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", doubled)).otherwise(c)),
        F.lit(0), lambda acc, c: acc + F.coalesce(c.try_cast("int"), F.lit(0)))
    return total % 10 == 0


def mod97_valid(code: Column) -> Column:
    """ISO 7064 mod 97-10 check of an account number: the first four characters
    go last, letters count 10 to 35, the remainder is 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.transform(F.split(turned, ""), lambda c: F.ascii(c)), F.lit(0),
        lambda acc, a: F.when(a.between(48, 57), (acc * 10 + a - 48) % 97).when(a.between(65, 90), (acc * 100 + a - 55) % 97).otherwise(acc))
    return rest == 1


@dataclass(frozen=True)
class Kind:
    """pattern: proposes spans. valid: Column test of a match. trim: shortens a
    match (None: leaves it). score: without context. words: context words."""
    name: str
    pattern: str
    hint: str
    valid: object
    score: float
    words: str
    trim: object = None


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.9, "e-?mail|mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]",
         lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]",
         lambda m: F.length(_digits(m)).between(12, 19) & luhn_valid(_digits(m)), 0.8, "card|visa|master|credit|debit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+",
         lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile|fax"),
)


def _iban(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _iban_form(m: Column) -> Column:
    return F.length(_iban(m)).between(15, 34) & mod97_valid(_iban(m))


#: An account number in groups may be followed by a short capitalised word that the pattern takes for its last group.
METHOD_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}",
         _iban_form, 0.9, "iban|account|bank|konto|compte|cuenta",
         lambda m: F.when(_iban_form(m), m).otherwise(F.regexp_replace(m, " [A-Z0-9]{1,4}$", ""))),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-[0-9]{2}-",
         lambda m: F.lit(True), 0.4, "ssn|social security|taxpayer"),
)


def _prefix_sums(sizes: str) -> Column:
    """Exclusive prefix sums of an array column of longs: sums within chunks of
    64, chunks added in turn, so the work stays near linear."""
    empty = F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(_CHUNK)).cast("int")),
                         lambda b: F.slice(sizes, b * _CHUNK + 1, F.lit(_CHUNK)))

    def inside(total, chunk):
        return F.aggregate(chunk, F.struct(total.alias("t"), empty.alias("a")),
                           lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["a"], s["t"]).alias("a")))

    zero = F.lit(0).cast("bigint")
    sums = F.aggregate(chunks, F.struct(zero.alias("t"), F.array().cast("array<array<bigint>>").alias("o")),
                       lambda acc, c: F.struct((acc["t"] + F.aggregate(c, zero, lambda a, x: a + x)).alias("t"),
                                               F.array_append(acc["o"], inside(acc["t"], c)["a"]).alias("o")),
                       lambda acc: F.flatten(acc["o"]))
    return F.when(F.size(sizes) > 0, sums).otherwise(empty)


def find_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", kinds=BASE_KINDS + METHOD_KINDS,
               base: int = len(BASE_KINDS)) -> DataFrame:
    """(id, spans): every row's spans as an array of (start, rank, end, kind,
    score), code points, end exclusive, by start and then by kind as listed.

    Null and empty texts have none; repeated rows each get theirs; extra columns
    are ignored; matches of one kind never overlap, those of several may."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    none = F.array().cast("array<string>")
    has = [F.col("t").rlike(k.hint) for k in kinds]
    df = df.select("id", "t", *[h.alias(f"has{i}") for i, h in enumerate(has)])
    df = df.select("id", *[F.when(F.col(f"has{i}"), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(kinds)],
                   *[F.when(F.col(f"has{i}"), F.split("t", k.pattern, -1)).otherwise(none).alias(f"g{i}") for i, k in enumerate(kinds)])

    def piece(i):
        gap = f"g{i}"
        return F.transform(f"m{i}", lambda m, j: F.struct(
            F.length(F.get(gap, j)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("n"), m.alias("m"),
            F.right(F.get(gap, j), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(gap, j + 1), F.lit(CONTEXT_CHARS)).alias("after")))

    ranks = range(len(kinds))
    df = df.select("id", *[piece(i).alias(f"p{i}") for i in ranks])
    df = df.select("id", *[f"p{i}" for i in ranks], *[F.transform(f"p{i}", lambda p: p["gap"] + p["n"]).alias(f"l{i}") for i in ranks])
    df = df.select("id", *[f"p{i}" for i in ranks], *[_prefix_sums(f"l{i}").alias(f"s{i}") for i in ranks])

    def found(i, kind):
        context = rf"(?i)(?<!\p{{L}})(?:{kind.words})(?!\p{{L}})"

        def span(p, s):
            kept = p["m"] if kind.trim is None else kind.trim(p["m"])
            near = p["before"].rlike(context) | p["after"].rlike(context)
            start = s + p["gap"]
            return F.struct(start.alias("start"), F.lit(i).alias("rank"), (start + F.length(kept)).alias("end"), F.lit(kind.name).alias("kind"),
                            F.least(F.lit(kind.score) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)), F.lit(1.0)).alias("score"),
                            kept.alias("m"))

        spans = F.filter(F.zip_with(f"p{i}", f"s{i}", span),
                         lambda x: kind.valid(x["m"]) & (F.lit(i < base) | (x["score"] >= THRESHOLD)))
        return F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["score"]))

    return df.select(F.col("id").alias(id_col), F.sort_array(F.concat(*[found(i, k) for i, k in enumerate(kinds)])).alias("spans"))


def pii_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_method,
    max_score) for every row of ``docs``; texts without spans have the hash of
    the empty string, an empty ``spans`` and score 0."""
    found = find_spans(docs, text_col, id_col).withColumnRenamed("spans", "found")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    n_base = len(BASE_KINDS)

    def count(rank):
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("bigint")

    counts = [count(rank).alias(f"n_{k.name}") for rank, k in enumerate(BASE_KINDS)]
    return found.select(
        id_col, *counts, F.sha2(listed(F.filter("found", lambda s: s["rank"] < n_base)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["rank"] >= n_base)).cast("bigint").alias("n_method"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
