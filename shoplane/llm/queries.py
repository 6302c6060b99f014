"""Registered queries of the training-data operators, with production parameters,
and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplane.llm.common import table
from shoplane.session import ensure_checkpoint_dir, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _docs(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return table(spark, d, "documents")


@query("op1_pii")
def op1_pii(spark, d):
    from shoplane.llm.pii import pii_report
    return pii_report(_docs(spark, d))


@query("op2_token_file")
def op2_token_file(spark, d):
    from shoplane.llm.token_file import read_documents, write_token_files
    path = scratch_path(spark, "token-files")
    write_token_files(_docs(spark, d), path, "word_bpe_49k.json", end_id=1)
    return read_documents(spark, path)


@query("op3_html_extract")
def op3_html_extract(spark, d):
    from shoplane.llm.html_extract import extract_text
    ensure_checkpoint_dir(spark)
    return extract_text(table(spark, d, "pages"), fit_pages=300)


@query("op4_language_id")
def op4_language_id(spark, d):
    from shoplane.llm.language_id import identify_languages
    return identify_languages(_docs(spark, d), folds=3, held=1, per_language=800, dim=1024, ngram=3)


@query("op5_quality_rules")
def op5_quality_rules(spark, d):
    from shoplane.llm.quality_rules import quality_report
    return quality_report(_docs(spark, d), table(spark, d, "labels"), fit_rows=20_000)


@query("op6_simhash")
def op6_simhash(spark, d):
    from shoplane.llm.simhash import simhash_duplicates
    return simhash_duplicates(_docs(spark, d), ngram=3, seed=42, max_bits=3)


@query("op7_decontaminate")
def op7_decontaminate(spark, d):
    from shoplane.llm.decontaminate import contamination
    return contamination(_docs(spark, d), table(spark, d, "benchmark"), window=10)


@query("op8_line_crf")
def op8_line_crf(spark, d):
    from shoplane.llm.line_crf import classify
    return classify(_docs(spark, d), table(spark, d, "labels"), folds=4, held=2, threshold=0.7, fit_docs=2500)


@query("op9_token_count")
def op9_token_count(spark, d):
    from shoplane.llm.token_count import count_tokens
    return count_tokens(_docs(spark, d), "byte_bpe_50k.json", limit=1024)


#: Every source gets an equal share of the characters; the mix has as many characters as the corpus, on average.
SQL_MIX = """
WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
t AS (SELECT sum(chars) AS c, sum(CASE WHEN chars > 0 THEN 1.0 ELSE 0.0 END) AS w FROM s),
r AS (SELECT source, CASE WHEN chars > 0 THEN 1.0 / t.w * t.c / chars ELSE 1.0 END AS rate FROM s, t),
p AS (SELECT source, greatest(CAST(ceil(rate / 8.0) AS INT), 1) AS parts, rate FROM r),
k AS (SELECT source, parts, i, exp(-(rate / parts) + i * ln(rate / parts) - lgamma(i + 1)) AS prob
      FROM p, unnest(range(0, 80)) AS x(i)),
c AS (SELECT source, parts, i, sum(prob) OVER (PARTITION BY source ORDER BY i) AS cum FROM k),
d AS (SELECT row_number() OVER () AS row, doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') AS key FROM documents),
u AS (SELECT d.*, j, p.parts,
             CAST(CAST('0x' || substr(md5('42:' || j || ':' || d.key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS v
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS x(j)),
n AS (SELECT u.row, any_value(u.doc_id) AS doc_id, any_value(u.source) AS source, any_value(u.text) AS text, any_value(u.key) AS key, count(c.i) AS n
      FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cum <= u.v GROUP BY u.row)
SELECT doc_id, source, CAST(copy_no AS BIGINT) AS copy_no, md5('42>' || key || ':' || copy_no) AS shuffle_key,
       md5(coalesce(text, '')) AS text_md5
FROM n, unnest(range(1, n + 1)) AS x(copy_no)
"""


@query("op10_mix_sources", SQL_MIX)
def op10_mix_sources(spark, d):
    from shoplane.llm.mix import mix_sources
    docs = _docs(spark, d).select("doc_id", "source", "text")  # whatever else the table has
    mixed = mix_sources(docs, weights=None, seed=42, by_text=True)
    return mixed.select("doc_id", "source", "copy_no", "shuffle_key",
                        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, d):
    from shoplane.llm.conversations import conversation_digest, damage, repair_conversations
    ensure_checkpoint_dir(spark)
    return conversation_digest(repair_conversations(damage(table(spark, d, "conversations"))))


SQL_RANK = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
a AS (SELECT doc_id, r, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT doc_id, r, term, count(*) AS tf FROM a WHERE term <> '' GROUP BY ALL),
dn AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dn),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, nd),
i AS (SELECT item_id, term, count(*) AS c FROM
      (SELECT item_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY ALL),
p AS (SELECT item_id, tf.doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN dn USING (r), s GROUP BY item_id, tf.doc_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


@query("op12_lexical_search", SQL_RANK)
def op12_lexical_search(spark, d):
    from shoplane.llm.lexical import rank_documents
    return rank_documents(_docs(spark, d), table(spark, d, "benchmark"), k=10)


SQL_TOP = """
WITH e AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v, embedding FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
      FROM q JOIN e ON q.vec_id IS DISTINCT FROM e.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query("op13_vector_search", SQL_TOP)
def op13_vector_search(spark, d):
    from shoplane.llm.vector_search import top_k
    ensure_checkpoint_dir(spark)
    return top_k(table(spark, d, "embeddings"), "vec_id % 50 = 0", k=5)


def register(queries: dict, oracles: dict) -> None:
    queries.update(QUERIES)
    oracles.update(SQL)
