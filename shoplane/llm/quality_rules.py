"""Quality rules: base text statistics and a learned decision list (DataFrame
operations only).

Sequential covering on labelled documents: conditions ``feature >= t`` or
``feature < t`` are added to a rule by FOIL gain on two thirds of the rows, the
rule is pruned on the other third, rows it covers are taken away, and the next
rule is grown. All that learning needs are counts of labelled rows by feature,
threshold bin and class, which Spark aggregates; the list becomes one ordered
``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplane.llm.common import materialize, text_or_empty

WHITE = r"[\x20\x09-\x0D]"
#: Thresholds tried per feature and class.
CUTS = 12
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "letters", "distinct", "exclaimed", "piped", "stopped")


def _repeat_windows(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a frame with the word array ``w``: words inside any
    3-word window whose words occur at least twice in a row's text.

    Windows are hashed; only rows whose hashes are not all different sort them
    (with their places) to find equal neighbours, so the work is near linear."""
    hashes = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
                         lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumn("h", F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(none)).drop("h")
    twice = F.filter("s", lambda x, k: (F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)))
                     | (F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))),
                          F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return df.withColumn("n_repeat_words", covered).drop("at")


def base_features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, counts, ratios of ``FEATURES``) for every row; null texts are empty,
    whose counts and ratios are 0. Extra columns are ignored."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    has_word = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("id", "t", F.filter(F.split("t", WHITE + "+"), lambda x: x != "").alias("w"), has_word.alias("lines"))
    df = df.select(
        "id", "w", F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count("t", F.lit(r"\p{L}")).alias("n_letters"),
        F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"), F.regexp_count("t", F.lit("!")).alias("n_marks"),
        F.regexp_count("t", F.lit(r"\|")).alias("n_pipes"), F.regexp_count("t", F.lit(r"[.?](?=[\x20\x09-\x0D]|$)")).alias("n_stops"))
    df = _repeat_windows(df).drop("w")

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")

    ratios = {"words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
              "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "n_letters"),
              "digits": per("n_digits", "word_chars"), "letters": per("n_letters", "word_chars"), "distinct": per("n_distinct", "n_words"),
              "exclaimed": per("n_marks", "n_words"), "piped": per("n_pipes", "n_words"), "stopped": per("n_stops", "n_words")}
    return df.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[ratios[f].alias(f"f_{f}") for f in FEATURES])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f, t = F.col(f"f_{self.feature}"), F.lit(self.threshold)
        return f >= t if self.above else f < t

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate cut points: quantiles of each feature within each class."""
    at = [(k + 0.5) / CUTS for k in range(CUTS)]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(f"f_{f}", at, 10_000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(v) for r in got for v in r[f] or []}) for f in FEATURES}


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if p <= 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, min_covered: int = 8,
                min_precision: float = 0.75) -> list[Rule]:
    """Ordered rules that reject. ``labelled`` has the feature columns, ``bad``
    (boolean) and ``prune`` (boolean: held for pruning); it is read many times and
    should be a stored table. Without rows of both classes no rule is learned."""
    cuts = _thresholds(labelled)
    bins = F.array(*[F.struct(F.lit(k).alias("f"), _bin(f, cuts[f]).alias("bin")) for k, f in enumerate(FEATURES)])
    rows = materialize(labelled.withColumn("bins", bins), "rule-rows")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        total = _classes(rows.where(left & ~F.col("prune")))
        if total[0] < min_covered:
            break
        now = total
        while len(rule) < max_conditions and now[1] > 0:
            counts = (rows.where(left & ~F.col("prune") & _holds(rule)).select("bad", F.explode("bins").alias("b"))
                      .groupBy("b.f", "b.bin", "bad").count().collect())
            best = _best_condition(counts, cuts, now, min_covered)
            if best is None:
                break
            rule, now = (*rule, best[0]), best[1]
        rule = _prune(rows.where(left & F.col("prune")), rule)
        p, n = _classes(rows.where(left & _holds(rule))) if rule else (0, 0)
        if not rule or p < min_covered or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left = left & ~_holds(rule)
    return rules


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cut points that the feature reaches."""
    if not cuts:
        return F.lit(0)
    return sum(((F.col(f"f_{feature}") >= F.lit(t)).cast("int") for t in cuts[1:]), (F.col(f"f_{feature}") >= F.lit(cuts[0])).cast("int"))


def _classes(rows: DataFrame) -> tuple[int, int]:
    got = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
    return got.get(True, 0), got.get(False, 0)


def _best_condition(counts, cuts, now, min_covered):
    """The condition of largest gain, with the (bad, good) rows it leaves."""
    best = None
    for k, feature in enumerate(FEATURES):
        table = {(r["bin"], r["bad"]): r["count"] for r in counts if r["f"] == k}
        for place, threshold in enumerate(cuts[feature], 1):
            above = tuple(sum(v for (b, bad), v in table.items() if b >= place and bad is cls) for cls in (True, False))
            below = (now[0] - above[0], now[1] - above[1])
            for is_above, (p, n) in ((True, above), (False, below)):
                if p >= min_covered and n < now[1]:
                    gain = _gain(p, n, *now)
                    if gain > 0 and (best is None or gain > best[2]):
                        best = (Condition(feature, is_above, threshold), (p, n), gain)
    return best and best[:2]


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The shortest prefix of the rule with the best (bad - good) / covered on held rows."""
    if not rule:
        return rule
    sums = [F.sum(F.when(_holds(rule[:k]), F.when(F.col("bad") == b, 1).otherwise(0)).otherwise(0)).alias(f"c{k}{int(b)}")
            for k in range(1, len(rule) + 1) for b in (True, False)]
    got = rows.agg(*sums).first()

    def value(k):
        p, n = got[f"c{k}1"] or 0, got[f"c{k}0"] or 0
        return (p - n) / (p + n) if p + n else -1.0

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (value(k), -k))]


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that a row meets; NULL if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_holds(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   quality_col: str = "quality", fit_rows: int = 20_000) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule) for every row of ``docs``.

    The list is learned from at most ``fit_rows`` labelled documents (lowest id
    hash first); null labels and ids teach nothing, nor do ids with contradictory labels. Repeated rows each get a row.
    Without labels only the base rule decides."""
    stored = materialize(base_features(docs, text_col, id_col), "quality-features")
    chosen = (labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("l_id")).agg(F.min(F.col(quality_col) == 0).alias("bad"), F.max(F.col(quality_col) == 0).alias("other"))
              .where("bad = other").select("l_id", "bad")
              .orderBy(F.xxhash64("l_id"), "l_id").limit(fit_rows))
    # repeated rows of an id are one example each time their features differ
    labelled = stored.join(chosen, F.col("id") == F.col("l_id")).distinct().withColumn("prune", F.abs(F.hash("l_id")) % 3 == 0)
    rules = learn_rules(materialize(labelled.drop("l_id"), "quality-labelled"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & verdict(rules).isNull()).alias("kept"), verdict(rules).alias("rule"))
