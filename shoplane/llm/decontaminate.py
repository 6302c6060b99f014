"""Benchmark decontamination by a positional inverted index (DataFrame operations only).

The corpus is tokenised once into postings (term, doc, position) for the terms
of the benchmark, stored as index segments sorted by term. Each benchmark window
is looked up from its rarest terms: the postings of an anchor at item position p
become alignments ``position - p`` of the item on a document, and the lists of an
item's anchors are intersected by grouping equal alignments. Windows whose two
rarest terms meet there are candidates; the documents that have any are read
again and compared word by word, so what is returned is exact.

``near_windows`` uses the same alignments with a slack between anchors, and then looks up every term of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplane.llm.common import fresh, materialize, text_or_empty

#: Word separators of the lower-cased text: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rows made from the benchmark (about 100 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000
#: Hash buckets of documents (16 MB as longs) by which texts without a candidate are set aside before a shuffle.
BUCKETS = 1 << 21


def words(text) -> Column:
    """Array of the words of a text (A-Z lowered); empty for null."""
    return F.filter(F.split(F.translate(text_or_empty(text), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a count; what is passed here is made from the benchmark alone."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Benchmark:
    """The benchmark's words and windows. Items without words have none."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10):
        items = benchmark.select(F.col(item_col).cast("string").alias("item_name"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
        # equal word sequences are one phrase; their item names are put back at the end
        phrases = items.select("w", F.xxhash64(F.array_join("w", " ")).alias("phrase"))
        self.names = materialize(items.select("item_name", F.xxhash64(F.array_join("w", " ")).alias("phrase")).distinct(), "bench-names")
        phrases = materialize(phrases.dropDuplicates(["w"]), "bench-phrases")
        self.terms = materialize(phrases.select("phrase", F.posexplode("w").alias("at", "term")), "bench-terms")
        self.windows = materialize(phrases.select(
            "phrase", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(window), F.lit(0)))).alias("at"), "w")
            .select("phrase", "at", F.least(F.size("w"), F.lit(window)).alias("n"),
                    F.array_join(F.slice("w", F.col("at") + 1, F.lit(window)), " ").alias("words")), "bench-windows")


def document_key(id_col: str, text_col: str) -> Column:
    """Id and text hash: rows equal in both are one document to the index (and
    have one result), so repeated and null ids need no row numbers."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


class PostingIndex:
    """Postings of the benchmark's terms over all documents. A posting of the
    empty term after each document's last word carries its number of words."""

    def __init__(self, docs: DataFrame, bench: Benchmark, id_col: str = "doc_id", text_col: str = "text"):
        self.texts = docs.select(document_key(id_col, text_col).alias("doc"), F.col(text_col).alias("t")).withColumn("bucket", _bucket("doc"))
        end = docs.sparkSession.createDataFrame([("",)], "term string")
        vocabulary = bench.terms.select("term").distinct().unionByName(end)
        tokens = (docs.select(document_key(id_col, text_col).alias("doc"), words(F.col(text_col)).alias("w"))
                  .select("doc", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term")))
        stored = tokens.join(_small(vocabulary), "term").select("term", "doc", "pos").sortWithinPartitions("term")
        stored = materialize(stored, "postings")
        self.postings = stored.where("term <> ''")
        self.sizes = stored.where("term = ''").select("doc", F.col("pos").cast("bigint").alias("n_words"))
        self.frequency = materialize(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "term-frequency")


def anchors(bench: Benchmark, index: PostingIndex) -> DataFrame:
    """(phrase, at, n, words, a, b): each window that the corpus has all terms
    of, with the item positions of its rarest and second rarest term."""
    known = bench.terms.join(index.frequency, "term").select("phrase", F.col("at").alias("i"), "freq")
    placed = bench.windows.withColumn("i", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    hits = (placed.join(known, ["phrase", "i"]).groupBy("phrase", "at", "n", "words")
            .agg(F.sort_array(F.collect_list(F.struct("freq", "i"))).alias("r")).where("size(r) = n"))
    return hits.select("phrase", "at", "n", "words", F.col("r")[0]["i"].alias("a"), F.get("r", F.lit(1))["i"].alias("b"))


def alignments(bench: Benchmark, index: PostingIndex, chosen: DataFrame) -> DataFrame:
    """(doc, phrase, i, delta): the occurrences of the windows' rarest terms; the term of item position ``i`` stands ``delta`` words
    later in the document than in the item."""
    wanted = (chosen.select("phrase", F.explode(F.array_compact(F.array("a", "b"))).alias("i")).distinct()
              .join(bench.terms.withColumnRenamed("at", "i"), ["phrase", "i"]))
    meet = index.postings.join(_small(wanted), "term")
    return meet.select("doc", "phrase", "i", (F.col("pos") - F.col("i")).alias("delta"))


def read_candidates(index: PostingIndex, candidates: DataFrame, name: str) -> DataFrame:
    """(doc, w, cs): the words of every document that has ``candidates`` (doc, c), with them."""
    per_doc = materialize(candidates.groupBy("doc").agg(F.collect_list("c").alias("cs")), name)
    texts = index.texts.join(candidate_buckets(per_doc, "doc"), "bucket", "left_semi")
    return texts.join(per_doc.hint("merge"), "doc").select("doc", words(F.col("t")).alias("w"), "cs")


def aligned(bench: Benchmark, index: PostingIndex) -> tuple[DataFrame, DataFrame]:
    """(``anchors``, ``alignments``), stored: exact and near matches both start from them."""
    chosen = materialize(anchors(bench, index), "bench-anchors")
    return chosen, materialize(alignments(bench, index, chosen), "alignments")


def phrase_matches(bench: Benchmark, index: PostingIndex, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc, spans, phrases): for each document with an occurring window, the
    (start, n) word spans of all occurrences and the phrases they come from."""
    chosen, placed = found or aligned(bench, index)
    # of each offset, the item positions whose terms meet there (at most the item's length)
    met = (placed.groupBy("doc", "phrase", "delta").agg(F.sort_array(F.collect_set("i")).alias("hits"))
           .withColumn("a", F.explode("hits")))
    near = (met.join(_small(chosen), ["phrase", "a"]).where(F.col("b").isNull() | F.array_contains("hits", F.col("b")))
            .select("doc", (F.col("delta") + F.col("at")).alias("start"), "n", "words", "phrase").where("start >= 0"))
    read = read_candidates(index, near.select("doc", F.struct("start", "n", "words", "phrase").alias("c")), "candidates")
    exact = F.filter("cs", lambda c: (c["start"] + c["n"] <= F.size("w"))
                     & (F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ") == c["words"]))
    # exploded, not filtered: a filter on the matches would be pushed below ``w`` and split the text per candidate
    matches = read.select("doc", F.explode(exact).alias("c"))
    return matches.groupBy("doc").agg(F.collect_set(F.struct("c.start", "c.n")).alias("spans"), F.collect_set("c.phrase").alias("phrases"))


def _bucket(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS))


def candidate_buckets(found: DataFrame, doc: str) -> DataFrame:
    """The hash buckets that hold a document of ``found``, to be broadcast: at
    most ``BUCKETS`` longs at any input size. Rows outside them need no shuffle."""
    return F.broadcast(found.select(_bucket(doc).alias("bucket")).distinct())


def near_windows(bench: Benchmark, index: PostingIndex, slack: int, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc, phrase, at): windows of which a document has an occurrence of the rarest term with every other term within
    ``slack`` words of its place beside it (exact occurrences included).

    The postings of the two rarest terms are intersected first, with offsets dealt to bands of ``slack + 1``, so only neighbours meet; the
    documents that pass are read again and all terms of the window are looked up around their places."""
    chosen, placed = found or aligned(bench, index)
    pairs, band = chosen.select("phrase", "a", "b").distinct(), F.lit(slack + 1)
    by_a = placed.join(_small(pairs), (placed["phrase"] == pairs["phrase"]) & (placed["i"] == pairs["a"])).select(
        "doc", pairs["phrase"], "a", "b", F.col("delta").alias("da"))
    by_b = placed.join(_small(pairs.where("b IS NOT NULL")), (placed["phrase"] == pairs["phrase"]) & (placed["i"] == pairs["b"])).select(
        "doc", pairs["phrase"], "a", "b", F.col("delta").alias("db"), F.floor(F.col("delta") / band).alias("band"))
    around = by_a.withColumn("band", F.explode(F.array(*[F.floor(F.col("da") / band) + F.lit(k) for k in (-1, 0, 1)])))
    both = (around.where("b IS NOT NULL").join(by_b, ["doc", "phrase", "a", "b", "band"]).where(F.abs(F.col("da") - F.col("db")) <= slack)
            .select("doc", "phrase", "a", "b", "da").distinct())
    met = (both.join(_small(chosen), ["phrase", "a", "b"]).select("doc", "phrase", "at", "n", "words", "da")
           .unionByName(by_a.where("b IS NULL").join(_small(chosen.where("b IS NULL")), ["phrase", "a"]).select("doc", "phrase", "at", "n", "words", "da")))
    read = read_candidates(index, met.select("doc", F.struct("phrase", "at", "n", "words", "da").alias("c")), "near-candidates")

    def has_all(c: Column) -> Column:
        def has(j: Column) -> Column:
            first = F.greatest(c["da"] + c["at"] + j - slack, F.lit(0))
            size = F.greatest(c["da"] + c["at"] + j + slack + 1 - first, F.lit(0))
            return F.array_contains(F.slice("w", first + 1, size), F.element_at(F.split(c["words"], " "), j + 1))
        return F.forall(F.sequence(F.lit(0), c["n"] - 1), has)

    # exploded, not filtered: a filter on the matches would be pushed below ``w`` and split the text per candidate
    return read.select("doc", F.explode(F.filter("cs", has_all)).alias("c")).select("doc", "c.phrase", "c.at").distinct()


def proximity_matches(bench: Benchmark, index: PostingIndex, slack: int = 5) -> DataFrame:
    """(doc, item, at): ``near_windows`` with the names of their items."""
    return near_windows(bench, index, slack).join(bench.names, "phrase").select("doc", F.col("item_name").alias("item"), "at")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10, slack: int = 2) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_proximity) for every row. ``n_proximity`` counts the different windows
    that stand in the document exactly or with their words up to ``slack`` places off (``near_windows``).

    Null and empty texts have no words; items with fewer words than ``window``
    are one window, items without words none. Rows are matched by id and text
    hash, so repeated and null ids are all reported; extra columns of either
    table are ignored; an empty benchmark hits nothing."""
    bench = Benchmark(benchmark, text_col="text", window=window)
    index = PostingIndex(docs, bench, id_col, text_col)
    places = aligned(bench, index)
    found = phrase_matches(bench, index, places)
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    per_phrase = bench.names.groupBy("phrase").agg(F.collect_set("item_name").alias("items"))
    hits = found.select("doc", covered.cast("bigint").alias("n_hit"), F.explode("phrases").alias("phrase"))
    items = (hits.join(_small(per_phrase), "phrase").groupBy("doc")
             .agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
             .select(F.col("doc").alias("hit_doc"), "n_hit", F.size("items").cast("bigint").alias("n_items"),
                     F.array_join("items", ",").alias("list")))
    near = near_windows(bench, index, slack, places).groupBy(F.col("doc").alias("near_doc")).agg(F.count(F.lit(1)).alias("near"))
    return (index.sizes.join(items, F.col("doc") == F.col("hit_doc"), "left").join(near, F.col("doc") == F.col("near_doc"), "left")
            .select(F.col("doc.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("near", F.lit(0)).cast("bigint").alias("n_proximity")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    key = fresh(docs, "document_key")
    bench = Benchmark(benchmark, text_col="text", window=window)
    index = PostingIndex(docs, bench, id_col, text_col)
    hit = materialize(phrase_matches(bench, index).select(F.col("doc").alias(key)), "contaminated")
    bucket = fresh(docs, "bucket")
    held = candidate_buckets(hit, key).withColumnRenamed("bucket", bucket)
    keyed = docs.withColumn(key, document_key(id_col, text_col)).withColumn(bucket, _bucket(key))
    sure = keyed.join(held, bucket, "left_anti")
    unsure = keyed.join(held, bucket, "left_semi").join(hit, key, "left_anti")
    return sure.select(*docs.columns).unionByName(unsure.select(*docs.columns))
