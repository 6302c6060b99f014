"""Registered queries over the driver's test tables, one per operator ID of

Stand-ins (FIXTURES.md): lineitem = work-order lines, orders = work orders,
``o_orderdate`` = Date In, ``l_shipdate`` = Date, documents = notes,
part = brand/model text, events = sub-day timestamps and JSON text.
Integers are cast to BIGINT and doubles rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.functions import coerce as C
from shoplane.functions import dates as D
from shoplane.functions import text as X
from shoplane.functions import wordlists as W
from shoplane.operators import filters as FL
from shoplane.operators import metrics as M
from shoplane.operators import schema as S
from shoplane.operators.joins import merge_on
from shoplane.session import scratch_path

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_T: Callable = None  # table reader, set by register_all


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _T(spark, d, name)


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ helpers

def notes_frame(spark, d) -> DataFrame:
    """Work-order notes derived from the tables: each document's text with an
    author/date header from the order of the same key; urgent/high orders get
    the header first, the others last; documents without an order keep the
    bare text."""
    docs = t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = docs.join(orders, docs.doc_id == orders.o_orderkey, "left")

    def cap(c):
        return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))
    header = F.concat(cap(F.col("lang")), F.lit(" "), cap(F.col("source")), F.lit(" ("),
                      F.date_format("o_orderdate", "d/M/yyyy HH:mm:ss"), F.lit(")"))
    note = (F.when(F.col("o_orderdate").isNull(), F.col("text"))
            .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
                  F.concat(header, F.lit("\n"), F.col("text")))
            .otherwise(F.concat(F.col("text"), F.lit("\n"), header)))
    return j.select("doc_id", note.alias("note"))


SQL_NOTES = r"""
notes AS (
  SELECT d.doc_id,
    CASE WHEN o.o_orderdate IS NULL THEN d.text
         WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH')
           THEN upper(substr(d.lang,1,1)) || substr(d.lang,2) || ' ' || upper(substr(d.source,1,1)) || substr(d.source,2)
                || ' (' || strftime(o.o_orderdate, '%-d/%-m/%Y %H:%M:%S') || ')' || chr(10) || d.text
         ELSE d.text || chr(10) || upper(substr(d.lang,1,1)) || substr(d.lang,2) || ' ' || upper(substr(d.source,1,1)) || substr(d.source,2)
                || ' (' || strftime(o.o_orderdate, '%-d/%-m/%Y %H:%M:%S') || ')'
    END AS note
  FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey)
"""


def brand_text_frame(spark, d) -> DataFrame:
    """Brand-and-model text derived from part: a stock prefix by part type,
    the part name and the brand with '#' as a blank."""
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    prefix = (F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.lit("ES-"))
              .when(F.col("p_type") == "SMALL", F.lit("EBK "))
              .otherwise(F.lit("")))
    txt = F.concat(prefix, F.col("p_name"), F.lit(" "), F.regexp_replace("p_brand", "#", " "))
    return p.select("p_partkey", txt.alias("brand_text"), "p_brand", "p_type")


SQL_BRAND_TEXT = r"""
bt AS (
  SELECT p_partkey,
    (CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'ES-' WHEN p_type = 'SMALL' THEN 'EBK ' ELSE '' END)
      || p_name || ' ' || replace(p_brand, '#', ' ') AS brand_text,
    p_brand, p_type
  FROM part)
"""


def _sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


# ------------------------------------------------------------ 2.1 sources

@query("s1_parquet_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority
FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P'
""")
def q_s1(spark, d):
    o = t(spark, d, "orders")
    return (o.filter((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "P"))
            .select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"),
                    "o_orderpriority"))


@query("s2_sheet_roundtrip", """
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS date_in, o_orderpriority
FROM orders
""")
def q_s2(spark, d):
    from shoplane.sources import read_sheet, write_sheet
    o = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("Status"),
        F.col("o_totalprice").alias("Total"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Date In"),
        F.col("o_orderpriority").alias("Type"))
    path = scratch_path(spark, "sheet")
    write_sheet(o, path)
    sheet = read_sheet(spark, path, columns=["ID", "Status", "Total", "Date In", "Type"])
    typed = S.coerce_types(sheet, dates=["Date In"], quantities=[], dollars=["Total"])
    return typed.select(F.col("ID").cast("long").alias("o_orderkey"), F.col("Status").alias("o_orderstatus"),
                        F.round("Total", 2).alias("o_totalprice"),
                        F.date_format("`Date In`", "yyyy-MM-dd").alias("date_in"),
                        F.col("Type").alias("o_orderpriority"))


@query("s3_brand_dictionary", """
SELECT DISTINCT p_brand AS brand, p_type AS section, lower(p_brand) AS norm FROM part
""")
def q_s3(spark, d):
    from shoplane.sources import read_brand_dictionary, write_brand_dictionary
    p = t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("section"))
    path = scratch_path(spark, "brands")
    write_brand_dictionary(p, path)
    return read_brand_dictionary(spark, path).select("brand", "section", "norm")


@query("s5_partitioned_parquet_roundtrip", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag
FROM lineitem WHERE l_returnflag = 'R'
""")
def q_s5(spark, d):
    from shoplane.sources import read_table, write_table
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_quantity",
                                        "l_returnflag")
    path = scratch_path(spark, "lines")
    write_table(li, path, partition_by=["l_returnflag"])
    back = read_table(spark, path)
    return back.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity",
                                                            "l_returnflag")


# --------------------------------------------------- 2.2 schema / coercion

@query("p1_trim_column_names", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_p1(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias(" o_orderkey "),
                                     F.col("o_orderstatus").alias("o_orderstatus  "))
    return S.trim_column_names(o)


@query("p3_build_text", """
SELECT d.doc_id, coalesce(d.source, '') || ' ' || coalesce(CAST(l.quality AS VARCHAR), '') AS repair_description
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_p3(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    lab = t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    j = docs.join(lab, "doc_id", "left")
    return S.build_text(j, "repair_description", "source", "quality").select("doc_id", "repair_description")


@query("p4_fill_unknown", """
SELECT d.doc_id, coalesce(CAST(l.toxic AS VARCHAR), 'Unknown') AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_p4(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    lab = t(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return S.fill_unknown(docs.join(lab, "doc_id", "left"), ["toxic"])


@query("p5_strict_timestamp", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_in FROM orders
""")
def q_p5(spark, d):
    o = t(spark, d, "orders").select("o_orderkey",
                                     F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("txt"))
    parsed = C.to_ts(F.col("txt"), strict=True)
    return o.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("date_in"))


@query("p6_lenient_timestamp", """
SELECT event_id,
  strftime(TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP),
           '%Y-%m-%d %H:%M:%S.%f') AS ts_parsed
FROM events
""")
def q_p6(spark, d):
    e = t(spark, d, "events")
    txt = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string"))
    parsed = C.to_ts(txt, strict=False)
    return e.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_parsed"))


@query("p7_quantity_coercion", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(trunc(l_quantity) AS BIGINT) AS qty, CAST(0 AS BIGINT) AS qty_from_flag,
       CAST(0 AS BIGINT) AS qty_from_suffixed
FROM lineitem
""")
def q_p7(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"),
                     C.to_quantity(F.col("l_quantity").cast("string")).alias("qty"),
                     C.to_quantity(F.col("l_returnflag")).alias("qty_from_flag"),
                     C.to_quantity(F.concat(F.col("l_quantity").cast("string"), F.lit("d"))).alias("qty_from_suffixed"))


@query("p8_dollar_coercion", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 2) AS dollars,
       0.0 AS dollars_from_flag
FROM lineitem
""")
def q_p8(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"),
                     F.round(C.to_dollars(F.col("l_extendedprice").cast("string")), 2).alias("dollars"),
                     C.to_dollars(F.col("l_returnflag")).alias("dollars_from_flag"))


@query("x5_money_text", r"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE round(l_extendedprice, 2) END AS amount
FROM lineitem
""")
def q_x5(spark, d):
    li = t(spark, d, "lineitem")
    shown = F.format_number("l_extendedprice", 2)
    txt = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), shown, F.lit(")")))
           .otherwise(F.concat(F.lit("$"), shown)))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"),
                     F.round(C.money_to_double(txt), 2).alias("amount"))


@query("p9_stringify", """
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line_text, l_returnflag AS flag_text FROM lineitem
""")
def q_p9(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", C.to_text(F.col("l_linenumber")).alias("line_text"),
                     C.to_text(F.col("l_returnflag")).alias("flag_text"))


@query("p10_coerce_types", """
SELECT CAST(l.l_orderkey AS VARCHAR) AS wo, strftime(o.o_orderdate, '%Y-%m-%d') AS date_in,
       strftime(l.l_shipdate, '%Y-%m-%d') AS date_out, CAST(trunc(l.l_quantity) AS BIGINT) AS qty,
       round(l.l_extendedprice, 2) AS total, o.o_orderstatus AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def q_p10(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("WO#"),
                                        F.col("l_quantity").cast("string").alias("Qty"),
                                        F.col("l_extendedprice").cast("string").alias("Total"),
                                        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"))
    od = t(spark, d, "orders").select(F.col("o_orderkey").alias("ID"),
                                      F.date_format("o_orderdate", "M/d/yyyy").alias("Date In"),
                                      F.col("o_orderstatus").alias("Status"))
    m = merge_on(li, od, "WO#", "ID")
    typed = S.coerce_types(m, dates=["Date In", "Date"], quantities=["Qty"], dollars=["Total"])
    return typed.select(F.col("`WO#`").cast("string").alias("wo"),
                        F.date_format("`Date In`", "yyyy-MM-dd").alias("date_in"),
                        F.date_format("Date", "yyyy-MM-dd").alias("date_out"),
                        F.col("Qty").alias("qty"), F.round("Total", 2).alias("total"),
                        F.col("Status").alias("status"))


@query("p11_struct_to_columns", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def q_p11(spark, d):
    e = t(spark, d, "events").select("event_id", "props")
    schema = T.StructType([T.StructField("k", T.LongType())])
    e = e.withColumn("parsed", C.parse_json_struct(F.col("props"), schema))
    return S.struct_to_columns(e, "parsed", {"k": "k"}).select("event_id", "k")


@query("p12_p14_select_cast", """
SELECT l_orderkey, CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_discount AS FLOAT) AS l_discount
FROM lineitem
""")
def q_p12(spark, d):
    li = t(spark, d, "lineitem")
    li = S.drop_if_present(li, ["l_comment", "l_tax", "Processed_Repair_Description"])
    sel = S.select_features(li, ["l_orderkey", "l_quantity", "l_discount"])
    return S.cast_float32(sel, ["l_quantity", "l_discount"])


# ------------------------------------------------------------ 2.3 filters

@query("f1_usable_notes", "WITH " + SQL_NOTES + r"""
SELECT doc_id FROM notes
WHERE note IS NOT NULL AND note <> '' AND regexp_matches(note, '\d{1,2}/\d{1,2}/\d{4}')
""")
def q_f1(spark, d):
    return FL.usable_notes(notes_frame(spark, d), "note").select("doc_id")


@query("f2_drop_nulls", """
SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL
""")
def q_f2(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    lab = t(spark, d, "labels").select("doc_id", F.col("quality").cast("long"))
    return FL.drop_nulls(docs.join(lab, "doc_id", "left"), ["quality"])


@query("f3_remove_outliers", """
WITH s AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem, s WHERE abs((l_extendedprice - mu) / sd) < 3
""")
def q_f3(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_extendedprice")
    return FL.remove_outliers(li, "l_extendedprice", 3.0).select("l_orderkey", "l_linenumber")


@query("f3_remove_outliers_by_group", """
WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sd
           FROM lineitem GROUP BY l_returnflag)
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_returnflag
FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag
WHERE abs((l.l_quantity - s.mu) / s.sd) < 1.5
""")
def q_f3b(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_returnflag",
                                        "l_quantity")
    return FL.remove_outliers(li, "l_quantity", 1.5, by=["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_returnflag")


@query("f4_removed_counts", """
WITH s AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS rows_in,
       CAST(count(*) FILTER (WHERE abs((l_extendedprice - mu) / sd) < 3) AS BIGINT) AS rows_kept,
       CAST(count(*) - count(*) FILTER (WHERE abs((l_extendedprice - mu) / sd) < 3) AS BIGINT) AS rows_removed
FROM lineitem, s
""")
def q_f4(spark, d):
    li = t(spark, d, "lineitem").select("l_extendedprice")
    return FL.removed_counts(li, "l_extendedprice", 3.0)


@query("f8_weekend", """
SELECT o_orderkey, CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend FROM orders
""")
def q_f8(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", D.is_weekend("o_orderdate").alias("is_weekend"))


# -------------------------------------------------------------- 2.4 joins

@query("j1_merge_on", """
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, round(l.l_extendedprice, 2) AS Total_x,
       o.o_orderkey, round(o.o_totalprice, 2) AS Total_y, o.o_orderstatus
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def q_j1(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"),
                                        F.round("l_extendedprice", 2).alias("Total"))
    od = t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("Total"), "o_orderstatus")
    return merge_on(li, od, "l_orderkey", "o_orderkey")


# -------------------------------------------------------- 2.5 aggregates

@query("a1_row_counts", """
SELECT 'lines' AS "table", CAST(count(*) AS BIGINT) AS rows FROM lineitem
UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT) FROM orders
UNION ALL SELECT 'merged', CAST(count(*) AS BIGINT) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def q_a1(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey")
    od = t(spark, d, "orders").select("o_orderkey")
    return M.row_counts({"lines": li, "orders": od, "merged": merge_on(li, od, "l_orderkey", "o_orderkey")})


@query("a2_mean_std", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std_pop,
       CAST(count(l_extendedprice) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag
""")
def q_a2(spark, d):
    li = t(spark, d, "lineitem")
    r = M.mean_std(li, "l_extendedprice", by=["l_returnflag"])
    return r.select("l_returnflag", r6("mean").alias("mean"), r6("std_pop").alias("std_pop"), "n")


@query("a3_distinct_categories", "SELECT DISTINCT o_orderpriority FROM orders")
def q_a3(spark, d):
    return M.distinct_values(t(spark, d, "orders"), "o_orderpriority")


SQL_PRED = "l_quantity AS y, l_extendedprice / 2000.0 AS p, l_returnflag AS grp"


@query("a10_regression_metrics", f"""
WITH e AS (SELECT {SQL_PRED} FROM lineitem)
SELECT grp AS l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae,
  round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(CASE WHEN var_pop(y) = 0 THEN (CASE WHEN sum((y-p)*(y-p)) = 0 THEN 1.0 ELSE 0.0 END)
             ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END, 6) AS r2,
  round(CASE WHEN var_pop(y) = 0 THEN (CASE WHEN var_pop(y - p) = 0 THEN 1.0 ELSE 0.0 END)
             ELSE 1 - var_pop(y - p) / var_pop(y) END, 6) AS explained_variance,
  round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100, 6) AS mape,
  round(median(abs(y - p)), 6) AS median_ae
FROM e GROUP BY grp
""")
def q_a10(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_quantity").alias("y"),
                                        (F.col("l_extendedprice") / 2000.0).alias("p"), "l_returnflag")
    r = M.regression_metrics(li, "y", "p", by=["l_returnflag"])
    return r.select("l_returnflag", "n", *[r6(c).alias(c) for c in
                                           ["mae", "mse", "rmse", "r2", "explained_variance", "mape", "median_ae"]])


@query("a5_exact_median", """
SELECT round((SELECT median(l_extendedprice) FROM lineitem), 6) AS median_price,
       round((SELECT median(o_totalprice) FROM orders), 6) AS median_total
""")
def q_a5(spark, d):
    li = t(spark, d, "lineitem")
    od = t(spark, d, "orders")
    a = M.exact_median(li, "l_extendedprice", out="median_price")
    b = M.exact_median(od, "o_totalprice", out="median_total")
    total = b.first()["median_total"]
    return a.select(r6("median_price").alias("median_price"), F.round(F.lit(total), 6).alias("median_total"))


@query("a11_residual_histogram", f"""
WITH e AS (SELECT y - p AS r FROM (SELECT {SQL_PRED} FROM lineitem)),
mm AS (SELECT CASE WHEN min(r) = max(r) THEN min(r) - 0.5 ELSE min(r) END AS lo,
              CASE WHEN min(r) = max(r) THEN max(r) + 0.5 ELSE max(r) END AS hi FROM e),
c AS (SELECT CAST(least(floor((r - lo) * (50.0 / (hi - lo))), 49) AS BIGINT) AS bin, count(*) AS n FROM e, mm GROUP BY 1),
g AS (SELECT range AS bin FROM range(50))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin
""")
def q_a11(spark, d):
    li = t(spark, d, "lineitem").select((F.col("l_quantity") - F.col("l_extendedprice") / 2000.0).alias("r"))
    h = M.residual_histogram(li, "r", 50)
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "count")


@query("a14_scatter_bins", f"""
WITH e AS (SELECT {SQL_PRED} FROM lineitem),
mm AS (SELECT min(y) AS a, max(y) AS b, min(p) AS c, max(p) AS d FROM e)
SELECT CAST(least(floor((y - a) * (50.0 / CASE WHEN b = a THEN 1.0 ELSE b - a END)), 49) AS BIGINT) AS x_bin,
       CAST(least(floor((p - c) * (50.0 / CASE WHEN d = c THEN 1.0 ELSE d - c END)), 49) AS BIGINT) AS y_bin,
       CAST(count(*) AS BIGINT) AS count
FROM e, mm GROUP BY 1, 2
""")
def q_a14(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_quantity").alias("y"),
                                        (F.col("l_extendedprice") / 2000.0).alias("p"))
    return M.scatter_bins(li, "y", "p", 50)


@query("a12_density_curve", f"""
WITH e AS (SELECT y - p AS r FROM (SELECT {SQL_PRED} FROM lineitem)),
st AS (SELECT count(*) AS n, stddev_samp(r) AS s, min(r) AS lo, max(r) AS hi FROM e),
pr AS (SELECT n, s, lo, hi, s * pow(n, -1.0 / 5.0) AS bw FROM st),
v AS (SELECT r, count(*) AS c FROM e GROUP BY r),
g AS (SELECT CASE WHEN i = 199 THEN hi + 3 * bw
                  ELSE (lo - 3 * bw) + i * (((hi + 3 * bw) - (lo - 3 * bw)) / 199) END AS x
      FROM pr, (SELECT range AS i FROM range(200)))
SELECT round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - r) / bw) * ((x - r) / bw)) * c) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM g, v, pr GROUP BY x, n, bw
""")
def q_a12(spark, d):
    li = t(spark, d, "lineitem").select((F.col("l_quantity") - F.col("l_extendedprice") / 2000.0).alias("r"))
    k = M.density_curve(li, "r")
    return k.select(F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


# ------------------------------------------------------- 2.9 scalar text

@query("x1_strip_note_header", "WITH " + SQL_NOTES + r""",
x AS (SELECT doc_id, regexp_replace(note,
  '(?m)^(?:\(\d{4}-\d{2}-\d{2}\)\s+\w+|\w+\s+\w+\s+\(\d{1,2}/\d{1,2}/\d{4}\s+\d{2}:\d{2}:\d{2}\))\s*', '', 'g') AS c
  FROM notes)
SELECT doc_id, """ + _sql_strip("c") + """ AS cleaned FROM x
""")
def q_x1(spark, d):
    n = notes_frame(spark, d)
    return n.select("doc_id", X.strip_note_header(F.col("note")).alias("cleaned"))


def _sql_prefix_case(e: str) -> str:
    parts = []
    for p in W.BRAND_PREFIXES:
        parts.append(f"WHEN starts_with(lower({e}), '{p.lower()}') THEN "
                     + _sql_strip(f"substr({e}, {len(p) + 1})"))
    return "CASE " + " ".join(parts) + f" ELSE {e} END"


def _sql_descriptors(e: str) -> str:
    pat = X.descriptor_pattern(W.BRAND_DESCRIPTORS)
    no_desc = f"regexp_replace({e}, '(?i){pat}', '', 'g')"
    seps = f"regexp_replace({no_desc}, '[\\-_]', ' ', 'g')"
    return _sql_strip(f"regexp_replace({seps}, '\\s+', ' ', 'g')")


@query("x2_strip_prefix", "WITH " + SQL_BRAND_TEXT + f"""
SELECT p_partkey, {_sql_prefix_case('brand_text')} AS stripped FROM bt
""")
def q_x2(spark, d):
    b = brand_text_frame(spark, d)
    return b.select("p_partkey", X.strip_prefix(F.col("brand_text")).alias("stripped"))


@query("x3_x4_remove_descriptors", "WITH " + SQL_BRAND_TEXT + f"""
SELECT p_partkey, {_sql_descriptors('brand_text')} AS cleaned FROM bt
""")
def q_x3(spark, d):
    b = brand_text_frame(spark, d)
    return b.select("p_partkey", X.remove_descriptors(F.col("brand_text")).alias("cleaned"))


@query("x12_x14_calendar", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS Year, CAST(month(o_orderdate) AS BIGINT) AS Month,
  CAST(weekofyear(o_orderdate) AS BIGINT) AS WeekOfYear, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS DayOfWeek,
  CAST(quarter(o_orderdate) AS BIGINT) AS Quarter,
  CAST(CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS IsWeekend
FROM orders
""")
def q_x12(spark, d):
    o = t(spark, d, "orders")
    feats = D.calendar_features(F.col("o_orderdate"))
    return o.select("o_orderkey", *[c.cast("long").alias(k) for k, c in feats.items()])


@query("x15_x16_whole_days", """
SELECT user_id,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS span_days,
  CAST(floor((epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 86400000000.0) AS BIGINT) AS id_span_days,
  CAST(CASE WHEN floor((epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 86400000000.0) < 0 THEN 0
       ELSE floor((epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 86400000000.0) END AS BIGINT) AS clipped_days
FROM events GROUP BY user_id
""")
def q_x15(spark, d):
    e = t(spark, d, "events")
    g = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"),
                                 F.min_by("ts", "event_id").alias("first_ts"),
                                 F.max_by("ts", "event_id").alias("last_ts"))
    return g.select("user_id", D.whole_days_between("a", "b").alias("span_days"),
                    D.whole_days_between("first_ts", "last_ts").alias("id_span_days"),
                    D.repair_duration("first_ts", "last_ts").alias("clipped_days"))


@query("x18_json_struct", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing
FROM events
""")
def q_x18(spark, d):
    e = t(spark, d, "events")
    ok = C.parse_json_struct(F.col("props"), T.StructType([T.StructField("k", T.LongType())]))
    bad = C.parse_json_struct(F.col("props"), T.StructType([T.StructField("missing", T.StringType())]))
    return e.select("event_id", ok["k"].alias("k"), bad["missing"].alias("missing"))


# ------------------------------------------------- 2.6/2.7 ordered ops
# Orders in intake order (o_orderdate, o_orderkey). A small bucket size makes
# the test-scale tables span several range buckets, as large tables do.
ROWS_PER_BUCKET = 2000
ORDER = ["o_orderdate", "o_orderkey"]
SQL_W = "OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey)"
SQL_V = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END"


def _orders_v(spark, d):
    o = t(spark, d, "orders")
    return o.withColumn("v", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
                        .otherwise(F.col("o_totalprice")))


@query("w5_row_index", f"""
SELECT o_orderkey, CAST(row_number() {SQL_W} - 1 AS BIGINT) AS row_idx FROM orders
""")
def q_w5(spark, d):
    from shoplane.operators.ordered import ordered_index
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordered_index(o, ORDER, rows_per_bucket=ROWS_PER_BUCKET).select("o_orderkey", "row_idx")


@query("w1_w2_lag_rolling", f"""
SELECT o_orderkey, round(lag(v, 1) {SQL_W}, 6) AS lag_1, round(lag(v, 2) {SQL_W}, 6) AS lag_2,
  round(CASE WHEN count(v) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
             THEN avg(v) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6)
    AS rolling_mean_3
FROM (SELECT o_orderkey, o_orderdate, {SQL_V} AS v FROM orders)
""")
def q_w1(spark, d):
    from shoplane.operators.ordered import lag_features
    o = _orders_v(spark, d).select("o_orderkey", "o_orderdate", "v")
    r = lag_features(o, "v", ORDER, rows_per_bucket=ROWS_PER_BUCKET)
    return r.select("o_orderkey", r6("lag_1").alias("lag_1"), r6("lag_2").alias("lag_2"),
                    r6("rolling_mean_3").alias("rolling_mean_3"))


@query("w3_w4_fill", f"""
SELECT o_orderkey, round(coalesce(v,
    first_value(v IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(v IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS v
FROM (SELECT o_orderkey, o_orderdate, {SQL_V} AS v FROM orders)
""")
def q_w3(spark, d):
    from shoplane.operators.ordered import fill_gaps
    o = _orders_v(spark, d).select("o_orderkey", "o_orderdate", "v")
    return fill_gaps(o, ORDER, ["v"], rows_per_bucket=ROWS_PER_BUCKET).select("o_orderkey", r6("v").alias("v"))


@query("w_by_group_features", f"""
SELECT o_orderkey, o_orderstatus,
  CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS row_idx,
  round(lag(o_totalprice, 1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), 6) AS lag_1
FROM orders
""")
def q_wby(spark, d):
    from shoplane.operators.ordered import ordered_features
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    r = ordered_features(o, ORDER, ["o_orderstatus"], index_col="row_idx", lag_col="o_totalprice",
                         lags=(1,), rows_per_bucket=ROWS_PER_BUCKET)
    return r.select("o_orderkey", "o_orderstatus", "row_idx", r6("lag_1").alias("lag_1"))


@query("o1_sort", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_in FROM orders
""")
def q_o1(spark, d):
    from shoplane.operators.ordered import sort_by
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return sort_by(o, ORDER).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_in"))


@query("o2_time_split", f"""
SELECT o_orderkey, CASE WHEN row_number() {SQL_W} - 1 < floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part
FROM orders
""")
def q_o2(spark, d):
    from shoplane.operators.ordered import time_split
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    train, test = time_split(o, ORDER, 0.9)
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part")))


@query("o3_time_folds", f"""
WITH ix AS (SELECT o_orderkey, row_number() {SQL_W} - 1 AS i, count(*) OVER () AS n FROM orders),
f AS (SELECT range AS fold FROM range(5)),
b AS (SELECT fold, n - (5 - fold) * (n // 6) AS s, n - (4 - fold) * (n // 6) AS e
      FROM f, (SELECT max(n) AS n FROM ix))
SELECT CAST(b.fold AS BIGINT) AS fold, CAST(count(*) FILTER (WHERE i < s) AS BIGINT) AS train_rows,
       CAST(count(*) FILTER (WHERE i >= s AND i < e) AS BIGINT) AS test_rows,
       CAST(min(o_orderkey) FILTER (WHERE i >= s AND i < e) AS BIGINT) AS test_min_key,
       CAST(sum(o_orderkey) FILTER (WHERE i >= s AND i < e) AS BIGINT) AS test_key_sum
FROM b, ix GROUP BY b.fold
""")
def q_o3(spark, d):
    from shoplane.operators.ordered import time_segments
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    seg, n = time_segments(o, ORDER, 5)
    k = F.col("o_orderkey")
    parts = seg.groupBy("segment").agg(F.count(k).alias("rows"), F.min(k).alias("test_min_key"), F.sum(k).alias("test_key_sum"))
    # expanding folds: all segments before the test segment are training rows; six rows, so one task is enough
    earlier = F.sum("rows").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return (parts.withColumn("train_rows", earlier).where("segment > 0")
            .select((F.col("segment") - 1).cast("long").alias("fold"), "train_rows", F.col("rows").alias("test_rows"), "test_min_key", "test_key_sum"))


# ------------------------------------------- 2.4 J4, 2.10 E1-E4 (text)

def brand_dictionary_frame(spark, d) -> DataFrame:
    """Brand dictionary derived from part: brand names (with '#' as a blank),
    one section per part type (a brand sits in several sections)."""
    from shoplane.sources import brand_norm
    p = t(spark, d, "part")
    b = F.regexp_replace("p_brand", "#", " ")
    return p.select(b.alias("brand"), F.col("p_type").alias("section"), brand_norm(b).alias("norm")).distinct()


def model_text_frame(spark, d) -> DataFrame:
    """Model text from part: name and brand; MEDIUM parts carry no brand."""
    p = t(spark, d, "part")
    txt = F.concat(F.col("p_name"), F.when(F.col("p_type") == "MEDIUM", F.lit(""))
                   .otherwise(F.concat(F.lit(" "), F.regexp_replace("p_brand", "#", " "))))
    return p.select("p_partkey", txt.alias("model_text"))


def _sql_match(src_cte: str) -> str:
    """SQL twin of the dictionary match over CTE ``src(p_partkey, t)``."""
    return src_cte + r""",
dict AS (SELECT lower(replace(p_brand, '#', ' ')) AS norm, min(replace(p_brand, '#', ' ')) AS brand
         FROM part GROUP BY 1),
tok AS (SELECT DISTINCT t, string_split(t, ' ') AS toks FROM src WHERE t IS NOT NULL AND t <> ''),
pos AS (SELECT t, toks, unnest(range(1, len(toks) + 1)) AS s FROM tok),
ng AS (SELECT t, toks, s, k, lower(array_to_string(toks[s:s + k - 1], ' ')) AS g
       FROM pos, (SELECT unnest([1, 2]) AS k) kk WHERE s + k - 1 <= len(toks)),
m AS (SELECT t, arg_max(brand, k * 1000000 - s) AS brand, arg_max(s, k * 1000000 - s) AS s,
             arg_max(k, k * 1000000 - s) AS k
      FROM ng JOIN dict ON dict.norm = ng.g GROUP BY t)
SELECT src.p_partkey,
  CASE WHEN src.t IS NULL OR src.t = '' THEN '' ELSE coalesce(m.brand, 'Unknown') END AS brand,
  CASE WHEN src.t IS NULL OR src.t = '' THEN ''
       WHEN m.t IS NULL THEN array_to_string(tok.toks, ' ')
       ELSE array_to_string(list_concat(tok.toks[1:m.s - 1], tok.toks[m.s + m.k:]), ' ') END AS model
FROM src LEFT JOIN tok ON src.t = tok.t LEFT JOIN m ON src.t = m.t
"""


@query("j4_match_brand", _sql_match(r"""WITH src AS (
  SELECT p_partkey, p_name || CASE WHEN p_type = 'MEDIUM' THEN '' ELSE ' ' || replace(p_brand, '#', ' ') END AS t
  FROM part)"""))
def q_j4(spark, d):
    from shoplane.operators.brands import match_brand
    m = match_brand(model_text_frame(spark, d), "model_text", brand_dictionary_frame(spark, d), out="bm")
    return m.select("p_partkey", F.col("bm.brand").alias("brand"), F.col("bm.model").alias("model"))


@query("e2_clean_brand_model", _sql_match("WITH " + SQL_BRAND_TEXT + ", src AS (SELECT p_partkey, "
                                          + _sql_descriptors(_sql_prefix_case("brand_text")) + " AS t FROM bt)"))
def q_e2(spark, d):
    from shoplane.operators.brands import clean_brand_model
    b = brand_text_frame(spark, d)
    r = clean_brand_model(b, "brand_text", brand_dictionary_frame(spark, d), faithful=True)
    return r.select("p_partkey", F.col("Cleaned Brand").alias("brand"), F.col("Cleaned Model").alias("model"))


@query("e2_clean_brand_model_boundaries", f"""
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN 'Es' || lower(p_type) WHEN 1 THEN 'Green ' || p_type
       WHEN 2 THEN 'Unknown' ELSE 'Time' END AS brand,
  CASE p_partkey % 4 WHEN 2 THEN 'old part time ' || {_sql_descriptors("p_name")}
       ELSE {_sql_descriptors("p_name")} END AS model
FROM part
""")
def q_e2_boundaries(spark, d):
    """Brand names that look like a stock prefix, hold a descriptor or are an
    ordinary word, derived from the part types."""
    from shoplane.operators.brands import clean_brand_model
    from shoplane.sources import brand_norm
    p = t(spark, d, "part")
    b = p.select("p_type", F.explode(F.array(
        F.concat(F.lit("Es"), F.lower("p_type")), F.concat(F.lit("Green "), F.col("p_type")), F.lit("Time"))).alias("brand"))
    dictionary = b.select("brand", F.col("p_type").alias("section"), brand_norm(F.col("brand")).alias("norm"))
    k = F.col("p_partkey") % 4
    txt = (F.when(k == 0, F.concat(F.lit("Es"), F.lower("p_type"), F.lit(" "), F.col("p_name"), F.lit(" black")))
           .when(k == 1, F.concat(F.lit("BK-Green "), F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" Pro non-motor")))
           .when(k == 2, F.concat(F.lit("old part time "), F.col("p_name")))
           .otherwise(F.concat(F.lit("EBK Time "), F.col("p_name"), F.lit(" black edition"))))
    r = clean_brand_model(p.select("p_partkey", txt.alias("brand_text")), "brand_text", dictionary)
    return r.select("p_partkey", F.col("Cleaned Brand").alias("brand"), F.col("Cleaned Model").alias("model"))


@query("plan_evaluate_prepare", """
WITH m AS (
  SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_extendedprice AS DOUBLE) AS labor,
         CASE WHEN l.l_linenumber = 7 THEN NULL
              WHEN l.l_quantity >= 50 THEN CAST(l.l_extendedprice AS DOUBLE) * 10
              ELSE CAST(l.l_extendedprice AS DOUBLE) END AS total,
         greatest(0, CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0) AS BIGINT))
           + CASE WHEN l.l_quantity = 49 AND l.l_linenumber = 1 THEN 1000 ELSE 0 END AS dur
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
a AS (SELECT * FROM m WHERE dur IS NOT NULL AND total IS NOT NULL),
b AS (SELECT a.* FROM a, (SELECT avg(dur) AS mu, stddev_pop(dur) AS sd FROM a) s WHERE abs((dur - mu) / sd) < 3),
c AS (SELECT b.* FROM b, (SELECT avg(total) AS mu, stddev_pop(total) AS sd FROM b) s WHERE abs((total - mu) / sd) < 3)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(dur AS BIGINT) AS duration,
       round(labor, 2) AS labor, round(total, 2) AS total,
       (SELECT count(*) FROM a) - (SELECT count(*) FROM b) > 0 AS duration_removes,
       (SELECT count(*) FROM b) - (SELECT count(*) FROM c) > 0 AS total_removes
FROM c
""")
def q_evaluate_prepare(spark, d):
    """Lines as evaluation rows: money as text, some totals not a number, some
    durations and totals far out, so that both outlier steps remove rows."""
    from shoplane.plans.workflow import prepare_evaluation
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("Date In"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    late = F.when((F.col("l_quantity") == 49) & (F.col("l_linenumber") == 1), 1000).otherwise(0)
    base = F.greatest(F.col("l_shipdate").cast("timestamp_ntz"), F.col("Date In").cast("timestamp_ntz"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "Date In",
        (base + F.make_dt_interval(late)).alias("Date"),
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("Labor"),
        F.when(F.col("l_linenumber") == 7, F.lit("(n/a)"))
        .when(F.col("l_quantity") >= 50, F.concat(F.lit("$"), F.format_number(price * 10, 2)))
        .otherwise(F.concat(F.lit("$"), F.format_number(price, 2))).alias("Total_y "))
    counts: dict[str, int] = {}
    done = prepare_evaluation(rows, counts=counts)
    kept = done.select("l_orderkey", "l_linenumber", F.col("Repair Duration").cast("long").alias("duration"),
                       F.round("Labor", 2).alias("labor"), F.round("Total_y", 2).alias("total"))
    a, b, c = counts["Repair Duration"], counts["Total_y"], done.count()
    return kept.withColumn("duration_removes", F.lit(a > b)).withColumn("total_removes", F.lit(b > c))


SQL_LEAD = r"(?s)\A\s*(\w+\s+\w+)\s+\((\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\)[ \t]*(?:\r?\n|\z)(.*)\z"
SQL_TRAIL = r"(?s)\A(.*?)(?:\r?\n|\A)[ \t]*(\w+\s+\w+)\s+\((\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\)\s*\z"


@query("e3_split_note", "WITH " + SQL_NOTES + f""",
x AS (SELECT doc_id, note, regexp_matches(note, '{SQL_LEAD}') AS lead, regexp_matches(note, '{SQL_TRAIL}') AS trail FROM notes)
SELECT doc_id,
  {_sql_strip(f"CASE WHEN lead THEN regexp_extract(note, '{SQL_LEAD}', 3) WHEN trail THEN regexp_extract(note, '{SQL_TRAIL}', 1) ELSE note END")} AS cleaned_text,
  regexp_replace(CASE WHEN lead THEN regexp_extract(note, '{SQL_LEAD}', 1) WHEN trail THEN regexp_extract(note, '{SQL_TRAIL}', 2) ELSE '' END, '\\s+', ' ', 'g') AS author,
  CASE WHEN lead THEN regexp_extract(note, '{SQL_LEAD}', 2) WHEN trail THEN regexp_extract(note, '{SQL_TRAIL}', 3) ELSE '' END AS date
FROM x
""")
def q_e3(spark, d):
    from shoplane.operators.notes import split_note
    n = notes_frame(spark, d).select("doc_id", split_note(F.col("note")).alias("s"))
    return n.select("doc_id", "s.cleaned_text", "s.author", "s.date")


@query("e4_note_fallback", "WITH " + SQL_NOTES + r""",
x AS (SELECT doc_id, regexp_replace(note,
  '(?m)^(?:\(\d{4}-\d{2}-\d{2}\)\s+\w+|\w+\s+\w+\s+\(\d{1,2}/\d{1,2}/\d{4}\s+\d{2}:\d{2}:\d{2}\))\s*', '', 'g') AS c
  FROM notes)
SELECT doc_id, """ + _sql_strip("c") + """ AS cleaned_text, '' AS author, '' AS date FROM x
""")
def q_e4(spark, d):
    from shoplane.operators.notes import note_fallback
    n = notes_frame(spark, d).select("doc_id", note_fallback(F.col("note")).alias("s"))
    return n.select("doc_id", "s.cleaned_text", "s.author", "s.date")


def rule_extractor(texts: list[str]) -> list:
    """Deterministic stand-in for a model-backed extractor: first word is the
    brand, the rest the model; answers malformed JSON for texts starting with
    'small' and fails outright on texts starting with 'hot'."""
    out = []
    for x in texts:
        if x.startswith("hot "):
            raise RuntimeError("extractor failure")
        if x.startswith("small "):
            out.append("{not json")
            continue
        first, _, rest = x.partition(" ")
        out.append({"brand": first, "model": rest})
    return out


@query("e1_extract_struct", r"""
WITH src AS (SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', ' ') AS t FROM part)
SELECT p_partkey,
  CASE WHEN starts_with(t, 'small ') OR starts_with(t, 'hot ') THEN '' ELSE split_part(t, ' ', 1) END AS brand,
  CASE WHEN starts_with(t, 'small ') OR starts_with(t, 'hot ') THEN '' ELSE substr(t, strpos(t, ' ') + 1) END AS model
FROM src
""")
def q_e1(spark, d):
    from shoplane.operators.brands import BRAND_MODEL
    from shoplane.operators.extract import extract_struct
    p = t(spark, d, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", " ")).alias("t"))
    r = extract_struct(p, "t", BRAND_MODEL, rule_extractor, out="bm")
    return r.select("p_partkey", F.col("bm.brand").alias("brand"), F.col("bm.model").alias("model"))


# ---------------------------------------------- 2.10 E8, 2.11 M1-M19

def _sql_lemma(w: str) -> str:
    parts = [f"WHEN {w} = '{k}' THEN '{v}'" for k, v in W.NOUN_LEMMAS.items()]
    for suffix, repl in W.NOUN_SUFFIX_RULES:
        cond = f"ends_with({w}, '{suffix}') AND length({w}) - {len(suffix)} >= 2"
        if suffix == "s":
            cond += "".join(f" AND NOT ends_with({w}, '{k}')" for k in W.NOUN_KEEP_ENDINGS)
        parts.append(f"WHEN {cond} THEN substr({w}, 1, length({w}) - {len(suffix)}) || '{repl}'")
    return "CASE " + " ".join(parts) + f" ELSE {w} END"


def sql_preprocess(src: str, id_col: str, text_col: str) -> str:
    """SQL twin of TextPreprocessor over ``src``: CTE pre(id, processed)."""
    t = f"regexp_replace(lower(coalesce({text_col}, '')), '[^a-zA-Z\\s]', '', 'g')"
    for a, b in W.TOKEN_CONTRACTIONS:
        t = f"regexp_replace({t}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in W.ENGLISH_STOP_WORDS) + "]"
    return f"""pre0 AS (SELECT {id_col} AS id, {t} AS t FROM {src}),
pre1 AS (SELECT id, list_filter(regexp_split_to_array(t, '\\s+'),
                 lambda x: x <> '' AND NOT list_contains({stop}, x)) AS toks FROM pre0),
pre AS (SELECT id, array_to_string(list_transform(toks, lambda w: {_sql_lemma('w')}), ' ') AS processed FROM pre1)"""


@query("x6_x11_preprocess_text", "WITH " + sql_preprocess("documents", "doc_id", "text") + """
SELECT id AS doc_id, processed FROM pre
""")
def q_x6(spark, d):
    from shoplane.operators.features import TextPreprocessor
    docs = S.spread(t(spark, d, "documents").select("doc_id", "text"))
    tp = TextPreprocessor(inputCol="text", outputCol="processed")
    return tp.transform(docs).select("doc_id", "processed")


# A lexicon out of the texts themselves: words of three and more letters that end in no plural "s" and that several documents hold.
SQL_LEXICON = """
w AS (SELECT id, unnest(toks) AS word FROM pre1),
lex AS (SELECT word AS lemma FROM w WHERE length(word) >= 3 AND word NOT LIKE '%s' GROUP BY word HAVING count(DISTINCT id) >= 3),
ex AS (SELECT 'thes' AS form, 'thesis' AS lemma UNION ALL SELECT 'ones', 'one' UNION ALL SELECT 'men', 'man')"""


@query("x10_lexicon_lemmas", "WITH " + sql_preprocess("documents", "doc_id", "text") + "," + SQL_LEXICON + """,
r AS (SELECT unnest(['s', 'ses', 'ves', 'xes', 'zes', 'ches', 'shes', 'men', 'ies']) AS suffix, unnest(['', 's', 'f', 'x', 'z', 'ch', 'sh', 'man', 'y']) AS ending),
t AS (SELECT word, left(word, length(word) - length(suffix)) || ending AS stem, length(suffix) AS n
      FROM (SELECT DISTINCT word FROM w), r WHERE ends_with(word, suffix) AND length(word) > length(suffix)),
ruled AS (SELECT word, arg_max(stem, n) AS lemma FROM t JOIN lex ON lex.lemma = t.stem GROUP BY word),
p AS (SELECT id, i, coalesce(ex.lemma, ruled.lemma, x.word) AS word
      FROM (SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) AS i FROM pre1) x
      LEFT JOIN ex ON ex.form = x.word LEFT JOIN ruled ON ruled.word = x.word)
SELECT pre1.id AS doc_id, coalesce(string_agg(p.word, ' ' ORDER BY i), '') AS processed FROM pre1 LEFT JOIN p ON p.id = pre1.id GROUP BY pre1.id
""")
def q_x10(spark, d):
    from shoplane.operators.lemmas import cleaned_tokens, held_words, preprocess_with_lexicon
    # tokenized once: the lexicon, the distinct words and the rows read the stored tokens
    path = scratch_path(spark, "tokens")
    S.spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", cleaned_tokens(F.col("text")).alias("tokens")).write.parquet(path)
    docs = spark.read.parquet(path)
    lexicon = (held_words(docs, "tokens", "doc_id").where((F.length("word") >= 3) & ~F.col("word").endswith("s") & (F.col("n") >= 3))
               .select(F.col("word").alias("lemma")))
    forms = spark.createDataFrame([("thes", "thesis"), ("ones", "one"), ("men", "man")], "form string, lemma string")
    return preprocess_with_lexicon(docs, "tokens", "processed", "doc_id", lexicon, forms).select("doc_id", "processed")


@query("m1_tfidf", "WITH " + sql_preprocess("documents", "doc_id", "text") + r""",
tk AS (SELECT id AS doc_id, unnest(regexp_extract_all(processed, '\b\w\w+\b')) AS term FROM pre),
nd AS (SELECT count(*) AS n FROM pre),
st AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tk GROUP BY term),
v AS (SELECT term, df FROM st ORDER BY tf DESC, term ASC LIMIT 100),
wt AS (SELECT tk.doc_id, tk.term, count(*) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w
       FROM tk JOIN v ON tk.term = v.term CROSS JOIN nd GROUP BY tk.doc_id, tk.term, v.df, nd.n),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY doc_id)
SELECT wt.doc_id, wt.term, round(wt.w / nr.norm, 6) AS weight FROM wt JOIN nr ON wt.doc_id = nr.doc_id
""")
def q_m1(spark, d):
    from shoplane.operators.features import TextPreprocessor, TfidfTop
    # fitted and transformed on the same derived text: materialise it once
    docs = TextPreprocessor(inputCol="text", outputCol="processed").transform(
        S.spread(t(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "processed").checkpoint(eager=True)
    model = TfidfTop(inputCol="processed", outputCol="tfidf", maxFeatures=100).fit(docs)
    vocab = F.array(*[F.lit(w) for w in model.getOrDefault("vocabulary")])
    v = F.unwrap_udt(F.col("tfidf"))  # sparse: the terms that a document has
    out = model.transform(docs).select("doc_id", v.alias("v")).select("doc_id", F.inline(F.arrays_zip("v.indices", "v.values")).alias("i", "w"))
    return out.select("doc_id", F.element_at(vocab, F.col("i") + 1).alias("term"), r6("w").alias("weight"))


@query("m2_mean_impute", """
SELECT d.doc_id, round(coalesce(CAST(l.quality AS DOUBLE), avg(CAST(l.quality AS DOUBLE)) OVER ()), 6) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_m2(spark, d):
    from pyspark.ml.feature import Imputer
    docs = t(spark, d, "documents").select("doc_id")
    lab = t(spark, d, "labels").select("doc_id", F.col("quality").cast("double"))
    j = docs.join(lab, "doc_id", "left")
    m = Imputer(strategy="mean", inputCols=["quality"], outputCols=["q"]).fit(j)
    return m.transform(j).select("doc_id", r6("q").alias("quality"))


@query("m3_population_scaler", """
WITH s AS (SELECT avg(l_quantity) AS a1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS a2,
                  stddev_pop(l_extendedprice) AS s2, avg(l_discount) AS a3, stddev_pop(l_discount) AS s3 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_quantity - a1) / s1, 6) AS z_quantity, round((l_extendedprice - a2) / s2, 6) AS z_price,
  round((l_discount - a3) / s3, 6) AS z_discount
FROM lineitem, s
""")
def q_m3(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from shoplane.operators.features import PopStandardScaler
    li = t(spark, d, "lineitem")
    v = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount"], outputCol="x").transform(li)
    z = PopStandardScaler(inputCol="x", outputCol="z").fit(v).transform(v)
    a = vector_to_array("z")
    return z.select("l_orderkey", F.col("l_linenumber").cast("long"), r6(a[0]).alias("z_quantity"),
                    r6(a[1]).alias("z_price"), r6(a[2]).alias("z_discount"))


@query("m4_mode_impute", """
WITH j AS (SELECT d.doc_id, CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT toxic FROM j WHERE toxic IS NOT NULL GROUP BY toxic ORDER BY count(*) DESC, toxic ASC LIMIT 1)
SELECT doc_id, coalesce(j.toxic, m.toxic) AS toxic FROM j, m
""")
def q_m4(spark, d):
    from shoplane.operators.features import ModeImputer
    docs = t(spark, d, "documents").select("doc_id")
    lab = t(spark, d, "labels").select("doc_id", F.col("toxic").cast("string"))
    j = docs.join(lab, "doc_id", "left")
    return ModeImputer(inputCols=["toxic"]).fit(j).transform(j).select("doc_id", "toxic")


@query("m5_one_hot", """
WITH c AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS cats FROM orders)
SELECT o_orderkey, array_to_string(list_transform(cats, lambda x: CASE WHEN x = o_orderpriority THEN 1 ELSE 0 END), ',') AS onehot
FROM orders, c
""")
def q_m5(spark, d):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    si = StringIndexer(inputCol="o_orderpriority", outputCol="i", handleInvalid="keep",
                       stringOrderType="alphabetAsc").fit(o)
    x = si.transform(o)
    oh = OneHotEncoder(inputCol="i", outputCol="v", dropLast=True, handleInvalid="error").fit(x).transform(x)
    return oh.select("o_orderkey", F.array_join(F.transform(vector_to_array("v"), lambda e: e.cast("int")),
                                                ",").alias("onehot"))


@query("m5_wide_categories", """
WITH v AS (SELECT column_no, value, row_number() OVER (PARTITION BY column_no ORDER BY value) - 1 AS code
           FROM (SELECT DISTINCT 0 AS column_no, CAST(o_custkey AS VARCHAR) AS value FROM orders
                 UNION ALL SELECT DISTINCT 1, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')),
n AS (SELECT column_no, count(*) AS n FROM v GROUP BY column_no)
SELECT o_orderkey, CAST(c.code AS BIGINT) AS customer_slot, CAST(coalesce(p.code, (SELECT n FROM n WHERE column_no = 1)) AS BIGINT) AS priority_code,
       CAST((SELECT n FROM n WHERE column_no = 0) AS BIGINT) AS width
FROM orders JOIN v c ON c.column_no = 0 AND c.value = CAST(o_custkey AS VARCHAR)
LEFT JOIN v p ON p.column_no = 1 AND p.value = o_orderpriority
""")
def q_m5_wide(spark, d):
    """Customers as categories, through a saved and reloaded dictionary; one priority is unseen (null) in the fit."""
    from pyspark.ml.feature import OneHotEncoder
    from shoplane.operators.categories import CategoryIndexer, CategoryIndexerModel
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    seen = o.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    path = scratch_path(spark, "indexer")
    CategoryIndexer(inputCols=["customer", "o_orderpriority"], outputCols=["c", "p"], rowsPerBucket=ROWS_PER_BUCKET).fit(seen).save(path)
    x = CategoryIndexerModel.load(path).transform(o)
    v = F.unwrap_udt(F.col("v"))
    hot = OneHotEncoder(inputCols=["c"], outputCols=["v"], dropLast=True, handleInvalid="error").fit(x).transform(x)
    return hot.select("o_orderkey", F.element_at(v["indices"], 1).cast("long").alias("customer_slot"), F.col("p").cast("long").alias("priority_code"),
                      v["size"].cast("long").alias("width"))


@query("m6_m7_assembled_features", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, avg(l_discount) AS md, stddev_pop(l_discount) AS sdd FROM lineitem),
c AS (SELECT list(DISTINCT l_returnflag ORDER BY l_returnflag) AS cats FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / sd, 6) AS quantity, round((l_discount - md) / sdd, 6) AS discount,
       array_to_string(list_transform(cats, lambda x: CASE WHEN x = l_returnflag THEN 1 ELSE 0 END), ',') AS onehot
FROM lineitem, s, c
""")
def q_m6(spark, d):
    """M7 pipeline of M3, M4, M5, M6 and E9, fitted, saved, loaded and applied; the slots of the assembled vector."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from shoplane.operators.categories import CategoryIndexer
    from shoplane.operators.features import FeatureCounter, ModeImputer, PopStandardScaler
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="raw"), PopStandardScaler(inputCol="raw", outputCol="scaled"),
        ModeImputer(inputCols=["l_returnflag"], outputCols=["flag"]), CategoryIndexer(inputCols=["flag"], outputCols=["code"]),
        OneHotEncoder(inputCols=["code"], outputCols=["hot"], dropLast=True), VectorAssembler(inputCols=["scaled", "hot"], outputCol="features"),
        FeatureCounter(inputCol="features")])
    path = scratch_path(spark, "features")
    pipeline.fit(li).save(path)
    v = vector_to_array("features")
    rows = PipelineModel.load(path).transform(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("v")[0]).alias("quantity"), r6(F.col("v")[1]).alias("discount"),
                       F.array_join(F.transform(F.slice("v", 3, 100), lambda e: e.cast("int")), ",").alias("onehot"))


@query("e9_float32", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 4) AS price,
       CAST(CAST(l_partkey AS FLOAT) AS DOUBLE) AS part FROM lineitem
""")
def q_e9(spark, d):
    from shoplane.operators.features import CastToFloat32
    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey",
                                        F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"))
    r = CastToFloat32(inputCols=["price", "part"]).transform(li)
    return r.withColumn("price", F.round(F.col("price").cast("double"), 4)).withColumn("part", F.col("part").cast("double"))


@query("m8_linear_regression", """
SELECT round(regr_slope(l_quantity, l_extendedprice), 10) AS slope,
       round(regr_intercept(l_quantity, l_extendedprice), 6) AS intercept
FROM lineitem
""")
def q_m8(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from shoplane.operators.models import REGISTRY
    li = t(spark, d, "lineitem")
    x = VectorAssembler(inputCols=["l_extendedprice"], outputCol="features").transform(
        li.select("l_extendedprice", F.col("l_quantity").alias("label")))
    m = REGISTRY["Linear Regression"].build({}, {}).fit(x)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 10), round(float(m.intercept), 6))],
                                 "slope double, intercept double")


def work_orders_frame(spark, d) -> DataFrame:
    """Work orders for model training: lines joined to orders (J1), part name
    as brand/model, document text as description."""
    lines = S.spread(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("WO#"), F.col("l_linenumber").alias("Item"),
                                                    "l_partkey", F.col("l_shipdate").alias("Date")))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderdate").alias("Date In"),
                                          F.col("o_orderpriority").alias("Type"), F.col("o_orderstatus").alias("Shop"))
    part = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("Brand and model"))
    docs = t(spark, d, "documents").select(F.col("doc_id"), F.col("text").alias("Description"))
    m = merge_on(lines, orders, "WO#", "ID")
    m = m.join(part, m["l_partkey"] == part["p_partkey"], "left").drop("p_partkey", "l_partkey")
    m = m.join(docs, m["`WO#`"] == docs["doc_id"], "left").drop("doc_id")
    return m.withColumn("Cleaned Work Order Internal Note", F.lit(None).cast("string"))


WO_ORDER = ["Date In", "WO#", "Item"]


@query("m19_model_comparison")
def q_m19(spark, d):
    from shoplane.plans.workflow import train_duration_models
    table, _ = train_duration_models(work_orders_frame(spark, d), WO_ORDER,
                                     models=("Linear Regression", "Ridge Regression"))
    return table


@query("m17_m18_score_and_coefficients")
def q_m17(spark, d):
    from shoplane.plans.workflow import evaluate_model, train_duration_models
    from shoplane.sources import load_model, save_model
    wo = work_orders_frame(spark, d)
    _, models = train_duration_models(wo, WO_ORDER, models=("Linear Regression",))
    path = save_model(models["Linear Regression"], scratch_path(spark, "model"))
    model = load_model(path)
    from shoplane.plans.workflow import prepare_training
    metrics, hist, coefs = evaluate_model(model, prepare_training(wo))
    return coefs


# The whole train -> save -> load -> score chain with a closed form: only the brand differs between the rows (one text, one
# intake day, one type), so a ridge fit has one slot a brand and its solution is a weighted mean of the brands' means.
CHAIN_ORDER = ["WO#", "Item", "Part", "Supplier"]
SQL_CHAIN = """
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus AS g,
             greatest(floor((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-01')) / 86400000000.0), 0)
             * CASE l_returnflag WHEN 'R' THEN 1.0 ELSE 0.5 END AS y0 FROM lineitem WHERE l_shipdate IS NOT NULL),
d1 AS (SELECT *, floor(y0) AS y FROM d),
z AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM d1),
r AS (SELECT g, y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER () AS n, l_orderkey, l_linenumber,
             l_partkey, l_suppkey FROM d1, z WHERE abs((y - mu) / sd) < 3),
c AS (SELECT CAST(floor(CAST(0.9 AS DOUBLE) * max(n)) AS BIGINT) AS cut FROM r),
a AS (SELECT unnest([10.0, 1000.0]) AS alpha),
f AS (SELECT k, cut - (5 - k) * (cut // 6) AS s, cut // 6 AS ts FROM c, range(0, 5) AS x(k) UNION ALL SELECT 5, cut, (SELECT max(n) FROM r) - cut FROM c),
m AS (SELECT k, g, count(*) AS n, avg(y) AS m FROM r JOIN f ON r.i < f.s GROUP BY k, g),
b AS (SELECT k, alpha, sum(n * alpha / (n + alpha) * m) / sum(n * alpha / (n + alpha)) AS b FROM m, a GROUP BY k, alpha),
w AS (SELECT b.k, b.alpha, m.g, b.b, m.n * (m.m - b.b) / (m.n + b.alpha) AS w FROM m JOIN b ON m.k = b.k),
p AS (SELECT f.k, w.alpha, r.*, w.b + w.w AS p FROM r JOIN f ON r.i >= f.s AND r.i < f.s + f.ts JOIN w ON w.k = f.k AND w.g = r.g)"""


def chain_frame(spark, d) -> DataFrame:
    li = S.spread(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
                  .where(F.col("l_shipdate").isNotNull()))
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    share = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.5)
    days = F.floor(F.greatest(D.repair_duration(start, F.col("l_shipdate").cast("timestamp_ntz")), F.lit(0)) * share)
    return li.select(F.col("l_orderkey").alias("WO#"), F.col("l_linenumber").alias("Item"), F.col("l_partkey").alias("Part"), F.col("l_suppkey").alias("Supplier"),
                     start.alias("Date In"), (start + F.make_dt_interval(days.cast("int"))).alias("Date"),
                     F.concat("l_returnflag", "l_linestatus").alias("Brand and model"), F.lit("E-Scooter").alias("Type"), F.lit("Shop 1").alias("Shop"),
                     F.lit("Brake pads replaced").alias("Description"), F.lit(None).cast("string").alias("Cleaned Work Order Internal Note"))


def _chain_models(spark, d, *alphas):
    from dataclasses import replace
    from shoplane.operators.models import REGISTRY
    from shoplane.plans.workflow import train_duration_models
    registry = {f"Ridge {int(a)}": replace(REGISTRY["Ridge Regression"], grid=[{"alpha": a}]) for a in alphas}
    return train_duration_models(chain_frame(spark, d), CHAIN_ORDER, models=list(registry), registry=registry, max_features=5)


@query("m19_ranked_models", f"""
WITH {SQL_CHAIN},
e AS (SELECT alpha, k, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, median(abs(y - p)) AS med, count(*) AS n FROM p GROUP BY alpha, k),
t AS (SELECT alpha, avg(mae) FILTER (WHERE k < 5) AS cv, max(n) FILTER (WHERE k = 5) AS n, max(mae) FILTER (WHERE k = 5) AS mae,
             max(rmse) FILTER (WHERE k = 5) AS rmse, max(med) FILTER (WHERE k = 5) AS med FROM e GROUP BY alpha)
SELECT 'Ridge ' || CAST(CAST(alpha AS BIGINT) AS VARCHAR) AS model, round(cv, 3) AS cv_mae, CAST(n AS BIGINT) AS n, round(mae, 3) AS mae, round(rmse, 3) AS rmse,
       round(med, 3) AS median_ae, CAST(row_number() OVER (ORDER BY mae) AS BIGINT) AS place FROM t
""")
def q_m19_ranked(spark, d):
    """Two models, hold-out metrics and cross-validated error, ranked."""
    table, _ = _chain_models(spark, d, 10.0, 1000.0)
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # two rows, in the order that rank_models gives them
    return table.coalesce(1).select("model", *[F.round(c, 3).alias(c) for c in ("cv_mae", "mae", "rmse", "median_ae")], "n", place.cast("long").alias("place"))


@query("m17_saved_model_scores", f"""
WITH {SQL_CHAIN}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(b.b + w.w, 3) AS prediction
FROM lineitem JOIN w ON w.g = l_returnflag || l_linestatus AND w.k = 5 AND w.alpha = 10.0 JOIN b ON b.k = 5 AND b.alpha = 10.0 WHERE l_shipdate IS NOT NULL
""")
def q_m17_scores(spark, d):
    """Every raw row scored by the saved and reloaded pipeline."""
    from shoplane.operators import schema as SC
    from shoplane.plans.workflow import _score
    from shoplane.sources import load_model, save_model
    _, models = _chain_models(spark, d, 10.0)
    model = load_model(save_model(models["Ridge 10"], scratch_path(spark, "model")))
    scored = _score(model, chain_frame(spark, d))
    return scored.select(SC.col("WO#").alias("l_orderkey"), F.col("Item").cast("long").alias("l_linenumber"), F.col("Part").alias("l_partkey"),
                         F.col("Supplier").alias("l_suppkey"), F.round("prediction", 3).alias("prediction"))


@query("m18_saved_model_coefficients", f"""
WITH {SQL_CHAIN}
SELECT 'Brand and model__ohe_' || g AS feature, round(w, 2) AS coefficient, round(abs(w), 2) AS abs_coefficient FROM w WHERE k = 5 AND alpha = 10.0
""")
def q_m18_coefficients(spark, d):
    """The brands' coefficients of the reloaded model, named by its dictionary."""
    from shoplane.operators.models import coefficients, top_coefficients
    from shoplane.plans.workflow import prepare_training
    from shoplane.sources import load_model, save_model
    _, models = _chain_models(spark, d, 10.0)
    model = load_model(save_model(models["Ridge 10"], scratch_path(spark, "model")))
    top = top_coefficients(coefficients(model, model.transform(prepare_training(chain_frame(spark, d)))), 1000)
    return top.where(F.col("feature").startswith("Brand and model")).select("feature", *[F.round(c, 2).alias(c) for c in ("coefficient", "abs_coefficient")])


# A tree of one split on the line number, and two boosting rounds of such trees, by trying every split.
def _sql_split(src: str, y: str, name: str) -> str:
    return f"""{name}_s AS (SELECT t, avg({y}) FILTER (WHERE x <= t) AS l, avg({y}) FILTER (WHERE x > t) AS r,
    count(*) FILTER (WHERE x <= t) * 1.0 * count(*) FILTER (WHERE x > t) * power(avg({y}) FILTER (WHERE x <= t) - avg({y}) FILTER (WHERE x > t), 2) AS gain
  FROM {src}, range(1, 7) AS s(t) GROUP BY t),
{name} AS (SELECT arg_max(t, gain) AS t, arg_max(l, gain) AS l, arg_max(r, gain) AS r FROM {name}_s)"""


SQL_TREE_XY = "xy AS (SELECT l_linenumber AS x, l_extendedprice / 1000.0 + 3.0 * (l_linenumber % 5) * (l_linenumber % 5) AS y FROM lineitem)"


def _tree_rows(spark, d, model, params) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from shoplane.operators.models import REGISTRY
    x = F.col("l_linenumber").cast("double")
    xy = t(spark, d, "lineitem").select(x.alias("x"), (F.col("l_extendedprice") / 1000 + 3.0 * (x % 5) * (x % 5)).alias("label"))
    xy = VectorAssembler(inputCols=["x"], outputCol="features").transform(xy)
    scored = REGISTRY[model].build(params, {"n": 1, "std_y_pop": 1.0, "std_y_samp": 1.0}).fit(xy).transform(xy)
    return scored.groupBy(F.col("x").cast("long").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("prediction"), 5).alias("prediction"))


for _name, _model, _params in (("m12_tree_of_one_split", "Decision Tree", {"max_depth": 1, "min_samples_split": 2}),
                               ("m13_forest_of_one_tree", "Random Forest", {"n_estimators": 1, "max_depth": 1, "min_samples_split": 2, "bootstrap": False})):
    query(_name, f"""
WITH {SQL_TREE_XY}, {_sql_split("xy", "y", "one")}
SELECT CAST(x AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS rows, round(max(CASE WHEN x <= t THEN l ELSE r END), 5) AS prediction FROM xy, one GROUP BY x
""")(lambda spark, d, m=_model, p=_params: _tree_rows(spark, d, m, p))


@query("m14_two_boosted_trees", f"""
WITH {SQL_TREE_XY}, {_sql_split("xy", "y", "one")},
res AS (SELECT x, y, CASE WHEN x <= t THEN l ELSE r END AS p1, 2 * (y - CASE WHEN x <= t THEN l ELSE r END) AS e FROM xy, one),
{_sql_split("res", "e", "two")}
SELECT CAST(x AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS rows, round(max(p1 + 0.1 * CASE WHEN x <= t THEN l ELSE r END), 5) AS prediction
FROM res, two GROUP BY x
""")
def q_m14(spark, d):
    return _tree_rows(spark, d, "Gradient Boosting", {"n_estimators": 2, "learning_rate": 0.1, "max_depth": 1})


# Filters on inputs where rows go.
@query("f1_notes_without_a_date", "WITH " + SQL_NOTES + r"""
, n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN note WHEN 1 THEN regexp_replace(note, '\d{1,2}/\d{1,2}/', '', 'g') WHEN 2 THEN '' END AS note FROM notes)
SELECT doc_id FROM n WHERE note IS NOT NULL AND note <> '' AND regexp_matches(note, '\d{1,2}/\d{1,2}/\d{4}')
""")
def q_f1_bites(spark, d):
    k = F.col("doc_id") % 4
    n = notes_frame(spark, d)
    note = F.when(k == 0, F.col("note")).when(k == 1, F.regexp_replace("note", r"\d{1,2}/\d{1,2}/", "")).when(k == 2, F.lit(""))
    return FL.usable_notes(n.withColumn("note", note), "note").select("doc_id")


SQL_SPIKES = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * CASE WHEN l_partkey % 101 = 7 THEN 9 ELSE 1 END AS v FROM lineitem"


def _spikes(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
                                          (F.col("l_extendedprice") * F.when(F.col("l_partkey") % 101 == 7, 9).otherwise(1)).alias("v"))


@query("f3_spikes_removed", f"""
WITH v AS ({SQL_SPIKES}), s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM v)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM v, s WHERE abs((v - mu) / sd) < 3
""")
def q_f3_bites(spark, d):
    return FL.remove_outliers(_spikes(spark, d), "v", 3.0).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f4_spikes_counted", f"""
WITH v AS ({SQL_SPIKES}), s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM v)
SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) FILTER (WHERE abs((v - mu) / sd) < 3) AS BIGINT) AS rows_kept,
       CAST(count(*) FILTER (WHERE NOT abs((v - mu) / sd) < 3) AS BIGINT) AS rows_removed FROM v, s
""")
def q_f4_bites(spark, d):
    return FL.removed_counts(_spikes(spark, d), "v", 3.0)


@query("u1_union_by_name", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier
""")
def q_u1(spark, d):
    from shoplane.operators.joins import union_by_name
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                                       F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return union_by_name([c, s])


@query("x19_blank_texts", """
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN '' ELSE 'kept' END AS brand, CASE WHEN coalesce(t, '') = '' THEN '' ELSE t END AS model
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(10) ELSE left(text, 20) END AS t FROM documents)
""")
def q_x19(spark, d):
    k, kind = F.col("doc_id") % 5, T.StructType([T.StructField("brand", T.StringType()), T.StructField("model", T.StringType())])
    text = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("")).when(k == 2, F.lit("\n")).otherwise(F.substring("text", 1, 20))
    docs = t(spark, d, "documents").select("doc_id", text.alias("t"))
    made = F.struct(F.lit("kept").alias("brand"), F.col("t").alias("model"))
    return docs.select("doc_id", C.blank_to_empty_struct(F.col("t"), made, kind).alias("s")).select("doc_id", "s.brand", "s.model")


# ------------------------------------------------------ more coverage

@query("s6_metrics_csv", f"""
WITH e AS (SELECT {SQL_PRED} FROM lineitem)
SELECT grp AS l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse
FROM e GROUP BY grp
""")
def q_s6(spark, d):
    from shoplane.sources import write_csv
    li = t(spark, d, "lineitem").select(F.col("l_quantity").alias("y"),
                                        (F.col("l_extendedprice") / 2000.0).alias("p"), "l_returnflag")
    m = M.regression_metrics(li, "y", "p", by=["l_returnflag"], with_median=False)
    path = scratch_path(spark, "metrics")
    write_csv(m.select("l_returnflag", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse")), path)
    back = spark.read.option("header", True).schema("l_returnflag string, n long, mae double, rmse double").csv(path)
    return back


@query("f5_f6_drop_nan", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice / 2000.0, 6) AS prediction
FROM lineitem WHERE l_returnflag <> 'R'
""")
def q_f56(spark, d):
    li = t(spark, d, "lineitem")
    pred = F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / 2000.0)
    x = li.select("l_orderkey", F.col("l_linenumber").cast("long"), pred.alias("prediction"))
    return FL.drop_nan(x, ["prediction"]).select("l_orderkey", "l_linenumber", r6("prediction").alias("prediction"))


@query("o4_top_k_abs", """
WITH c AS (SELECT 'line_' || l_orderkey || '_' || l_linenumber AS feature,
                  l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS coefficient FROM lineitem)
SELECT feature, round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS abs_coefficient
FROM c ORDER BY abs(coefficient) DESC, feature ASC LIMIT 20
""")
def q_o4(spark, d):
    from shoplane.operators.models import top_coefficients
    li = t(spark, d, "lineitem")
    mean = li.agg(F.avg("l_extendedprice")).scalar()
    c = li.select(F.concat(F.lit("line_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                           F.col("l_linenumber").cast("string")).alias("feature"),
                  (F.col("l_extendedprice") - mean).alias("coefficient"))
    c = c.withColumn("abs_coefficient", F.abs("coefficient"))
    return top_coefficients(c, 20).select("feature", r6("coefficient").alias("coefficient"),
                                          r6("abs_coefficient").alias("abs_coefficient"))


@query("e7_feature_engineer", f"""
WITH b AS (SELECT o_orderkey, o_orderdate, o_totalprice AS v,
    lag(o_totalprice, 1) {SQL_W} AS l1, lag(o_totalprice, 2) {SQL_W} AS l2,
    CASE WHEN count(o_totalprice) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
         THEN avg(o_totalprice) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS r3
  FROM orders)
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS Year, CAST(weekofyear(o_orderdate) AS BIGINT) AS WeekOfYear,
  CAST(isodow(o_orderdate) - 1 AS BIGINT) AS DayOfWeek,
  round(coalesce(l1, first_value(l1 IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS lag_1,
  round(coalesce(l2, first_value(l2 IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS lag_2,
  round(coalesce(r3, first_value(r3 IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS rolling_mean_3
FROM b
""")
def q_e7(spark, d):
    from shoplane.operators.features import FeatureEngineer
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    fe = FeatureEngineer(dateCol="o_orderdate", valueCol="o_totalprice", orderCols=ORDER, withLags=True,
                         rowsPerBucket=ROWS_PER_BUCKET)
    r = fe.transform(o)
    return r.select("o_orderkey", F.col("Year").cast("long"), F.col("WeekOfYear").cast("long"),
                    F.col("DayOfWeek").cast("long"), r6("lag_1").alias("lag_1"), r6("lag_2").alias("lag_2"),
                    r6("rolling_mean_3").alias("rolling_mean_3"))


def _sql_filled(c: str) -> str:
    return (f"coalesce({c}, first_value({c} IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
            f"last_value({c} IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")


@query("e7_fill_every_column", f"""
WITH o AS (SELECT o_orderkey, o_orderdate, {SQL_V} AS v, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS status,
                  CASE WHEN o_custkey % 11 < 3 AND o_orderdate > TIMESTAMP '1993-01-01' THEN o_custkey END AS custkey FROM orders),
b AS (SELECT *, lag(v, 1) {SQL_W} AS l1, lag(v, 2) {SQL_W} AS l2,
    CASE WHEN count(v) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
         THEN avg(v) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS r3 FROM o)
SELECT o_orderkey, round({_sql_filled("v")}, 6) AS v, {_sql_filled("status")} AS status, CAST({_sql_filled("custkey")} AS BIGINT) AS custkey,
       round({_sql_filled("l1")}, 6) AS lag_1, round({_sql_filled("l2")}, 6) AS lag_2, round({_sql_filled("r3")}, 6) AS rolling_mean_3 FROM b
""")
def q_e7_all(spark, d):
    from shoplane.operators.features import FeatureEngineer
    k = F.col("o_orderkey")
    o = _orders_v(spark, d).select(
        "o_orderkey", "o_orderdate", "v", F.when(k % 5 == 0, F.col("o_orderstatus")).alias("status"),
        F.when((F.col("o_custkey") % 11 < 3) & (F.col("o_orderdate") > F.lit("1993-01-01").cast("timestamp_ntz")), F.col("o_custkey")).alias("custkey"))
    fe = FeatureEngineer(dateCol="o_orderdate", valueCol="v", orderCols=ORDER, withLags=True, rowsPerBucket=ROWS_PER_BUCKET)
    r = fe.transform(o)
    return r.select("o_orderkey", r6("v").alias("v"), "status", F.col("custkey").cast("long").alias("custkey"),
                    *[r6(c).alias(c) for c in ("lag_1", "lag_2", "rolling_mean_3")])


@query("w1_event_gaps_by_user", """
SELECT event_id, user_id,
  CAST(floor((epoch_us(ts) - epoch_us(lag(ts, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0) AS DOUBLE) AS gap_days,
  CAST(epoch_us(ts) - epoch_us(lag(ts, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) AS gap_us,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS nth_event
FROM events
""")
def q_w1_events(spark, d):
    from shoplane.operators.ordered import ordered_features
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    r = ordered_features(e, ["ts", "event_id"], ["user_id"], index_col="nth_event", lag_col="ts", lags=(1,),
                         rows_per_bucket=ROWS_PER_BUCKET)
    # nullable (first event of a user): doubles, so nulls read back alike everywhere
    return r.select("event_id", "user_id", D.whole_days_between("lag_1", "ts").cast("double").alias("gap_days"),
                    (D.wall_clock_micros("ts") - D.wall_clock_micros("lag_1")).cast("double").alias("gap_us"),
                    "nth_event")


# ------------------------------------------------ 3.2 clean job

SQL_CLEAN_JOB = ("SELECT n.doc_id, bm.brand AS cleaned_brand, bm.model AS cleaned_model, "
                 "sn.author AS note_author, sn.date AS note_date "
                 "FROM (WITH " + SQL_NOTES + " SELECT doc_id, note FROM notes) n "
                 "JOIN (" + SQL["e2_clean_brand_model"] + ") bm ON bm.p_partkey = n.doc_id "
                 "JOIN (" + SQL["e3_split_note"] + ") sn ON sn.doc_id = n.doc_id "
                 r"WHERE n.note IS NOT NULL AND n.note <> '' AND regexp_matches(n.note, '\d{1,2}/\d{1,2}/\d{4}')")


@query("plan_clean_work_orders", SQL_CLEAN_JOB)
def q_clean_job(spark, d):
    from shoplane.plans.workflow import clean_work_orders
    notes = notes_frame(spark, d).select("doc_id", F.col("note").alias("Work Order Internal Note"))
    bt = brand_text_frame(spark, d).select("p_partkey", F.col("brand_text").alias("Brand and model "))
    wo = notes.join(bt, notes["doc_id"] == bt["p_partkey"]).drop("p_partkey")
    out = clean_work_orders(wo, brand_dictionary_frame(spark, d), split_notes=True, faithful=True)
    return out.select("doc_id", F.col("Cleaned Brand").alias("cleaned_brand"),
                      F.col("Cleaned Model").alias("cleaned_model"), F.col("Note Author").alias("note_author"),
                      F.col("Note Date").alias("note_date"))


# ------------------------------------- awkward inputs: wide nullable keys, dirty pairs, mixed date forms

SQL_WIDE = """
FROM (SELECT o_orderkey, o_totalprice AS v,
             CASE WHEN o_orderkey % 7 <> 0 THEN 1152921504606846976 + (o_orderkey * 7919) % 1000003 END AS k FROM orders)
"""
SQL_WIDE_W = "OVER (ORDER BY k NULLS LAST, o_orderkey)"


def wide_key_frame(spark, d) -> DataFrame:
    """Orders with a nullable key above 2**53, where doubles can't tell neighbours apart."""
    k = F.lit(1152921504606846976) + (F.col("o_orderkey") * 7919) % 1000003
    return t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"),
                                        F.when(F.col("o_orderkey") % 7 != 0, k).alias("k"))


@query("w5_nullable_bigint_key", f"""
SELECT o_orderkey, CAST(row_number() {SQL_WIDE_W} - 1 AS BIGINT) AS row_idx {SQL_WIDE}
""")
def q_w5_wide(spark, d):
    from shoplane.operators.ordered import ordered_index
    return ordered_index(wide_key_frame(spark, d), ["k", "o_orderkey"], rows_per_bucket=ROWS_PER_BUCKET).select("o_orderkey", "row_idx")


@query("w1_lag_nullable_bigint_key", f"""
SELECT o_orderkey, round(lag(v, 1) {SQL_WIDE_W}, 6) AS lag_1 {SQL_WIDE}
""")
def q_w1_wide(spark, d):
    from shoplane.operators.ordered import ordered_features
    out = ordered_features(wide_key_frame(spark, d), ["k", "o_orderkey"], lag_col="v", lags=(1,), rows_per_bucket=ROWS_PER_BUCKET)
    return out.select("o_orderkey", F.round("lag_1", 6).alias("lag_1"))


@query("a10_metrics_dirty_pairs", """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2, round(median(abs(y - p)), 6) AS median_ae
FROM (SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice / 1000 END AS y,
             CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity * 1.5 END AS p FROM lineitem)
WHERE y IS NOT NULL AND p IS NOT NULL
""")
def q_a10_dirty(spark, d):
    k = F.col("l_orderkey")
    pairs = t(spark, d, "lineitem").select(F.when(k % 5 != 0, F.col("l_extendedprice") / 1000).alias("y"),
                                           F.when(k % 7 != 0, F.col("l_quantity") * 1.5).otherwise(F.lit(float("nan"))).alias("p"))
    m = M.regression_metrics(pairs, "y", "p")
    return m.select("n", F.round("mae", 6).alias("mae"), F.round("r2", 8).alias("r2"), F.round("median_ae", 6).alias("median_ae"))


SQL_WIDE = "CAST(CAST(o_orderkey % 97 AS DECIMAL(32,0)) * 100000000000000000000 + o_orderkey % 1009 - CAST(o_custkey AS DECIMAL(32,0)) * 7 AS DECIMAL(32,0))"


def _wide_orders(spark, d) -> DataFrame:
    """Orders with a decimal key of 22 digits, whose neighbours no double tells apart."""
    key = ((F.col("o_orderkey") % 97).cast("decimal(11,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")
           + (F.col("o_orderkey") % 1009).cast("decimal(20,0)") - F.col("o_custkey").cast("decimal(19,0)") * F.lit(7).cast("decimal(1,0)"))
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", key.cast("decimal(32,0)").alias("wide"), (-F.col("o_orderkey")).alias("tie"))


@query("w5_wide_decimal_key", f"""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {SQL_WIDE}, -o_orderkey) - 1 AS BIGINT) AS row_idx FROM orders
""")
def q_w5_wide(spark, d):
    from shoplane.operators.ordered import ordered_index
    return ordered_index(_wide_orders(spark, d), ["wide", "tie"], rows_per_bucket=ROWS_PER_BUCKET).select("o_orderkey", "row_idx")


@query("w1_lag_wide_decimal_key", f"""
SELECT o_orderkey, round(lag(o_totalprice, 1) OVER w, 6) AS lag_1, round(lag(o_totalprice, 2) OVER w, 6) AS lag_2
FROM orders WINDOW w AS (ORDER BY {SQL_WIDE}, -o_orderkey)
""")
def q_w1_wide(spark, d):
    from shoplane.operators.ordered import lag_features
    r = lag_features(_wide_orders(spark, d), "o_totalprice", ["wide", "tie"], rows_per_bucket=ROWS_PER_BUCKET)
    return r.select("o_orderkey", r6("lag_1").alias("lag_1"), r6("lag_2").alias("lag_2"))


@query("a10_null_group", """
SELECT g, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae, round(median(abs(y - p)), 6) AS median_ae
FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 'hot' ELSE l_returnflag END AS g,
             l_extendedprice / 1000 AS y, CASE WHEN l_quantity > 25 THEN l_extendedprice / 1000 ELSE l_quantity * 1.5 END AS p FROM lineitem)
GROUP BY g
""")
def q_a10_null_group(spark, d):
    """A third of the rows in the null group, a third in one other; half of all errors are zero."""
    k, y = F.col("l_orderkey") % 3, F.col("l_extendedprice") / 1000
    pairs = t(spark, d, "lineitem").select(
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("hot")).otherwise(F.col("l_returnflag")).alias("g"),
        y.alias("y"), F.when(F.col("l_quantity") > 25, y).otherwise(F.col("l_quantity") * 1.5).alias("p"))
    m = M.regression_metrics(pairs, "y", "p", ["g"])
    return m.select("g", "n", r6("mae").alias("mae"), r6("median_ae").alias("median_ae"))


@query("p6_day_first_and_iso_forms", """
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 6 IN (2, 4) THEN date_trunc('minute', CAST(o_orderdate AS TIMESTAMP))
                                 ELSE CAST(o_orderdate AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS date_in FROM orders
""")
def q_p6_forms(spark, d):
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy h:mm a",
             "yyyy-MM-dd'T'HH:mm:ss.SSS"]
    text = F.date_format(o, forms[0])
    for i, f in enumerate(forms[1:], 1):
        text = F.when(k == i, F.date_format(o, f)).otherwise(text)
    parsed = C.to_ts(F.col("txt"), strict=False, day_first=True)
    return (t(spark, d, "orders").select("o_orderkey", text.alias("txt"))
            .select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("date_in")))


@query("p7_exact_integers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 9007199254740993 + o_orderkey END AS qty FROM orders
""")
def q_p7_exact(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit("n/a")).otherwise((F.lit(9007199254740993) + k).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", C.to_quantity(text).alias("qty"))


# ------------------------------------- penalised models with one feature: closed forms

SQL_XY = "SELECT l_orderkey, l_linenumber, l_quantity / 100.0 AS x, l_extendedprice / 1000.0 AS y FROM lineitem"


def one_feature_frame(spark, d) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("x"),
                                        (F.col("l_extendedprice") / 1000).alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(li)


def _line(spark, d, model, params) -> DataFrame:
    from shoplane.operators.models import REGISTRY, label_stats
    xy = one_feature_frame(spark, d)
    m = REGISTRY[model].build(params, label_stats(xy)).fit(xy)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))], "slope double, intercept double")


@query("m9_ridge_one_feature", f"""
WITH s AS (SELECT covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 100.0) AS b, avg(y) AS my, avg(x) AS mx FROM ({SQL_XY}))
SELECT round(b, 6) AS slope, round(my - b * mx, 6) AS intercept FROM s
""")
def q_m9(spark, d):
    return _line(spark, d, "Ridge Regression", {"alpha": 100.0})


@query("m10_lasso_one_feature", f"""
WITH s AS (SELECT sign(covar_pop(y, x)) * greatest(abs(covar_pop(y, x)) - 0.1, 0) / var_pop(x) AS b, avg(y) AS my, avg(x) AS mx FROM ({SQL_XY}))
SELECT round(b, 6) AS slope, round(my - b * mx, 6) AS intercept FROM s
""")
def q_m10(spark, d):
    return _line(spark, d, "Lasso Regression", {"alpha": 0.1})


@query("m16_ridge_cv_mae", f"""
WITH r AS (SELECT x, y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, x, y) - 1 AS i, count(*) OVER () AS n FROM ({SQL_XY})),
f AS (SELECT k, max(n) - (5 - k) * (max(n) // 6) AS s, max(n) // 6 AS ts FROM r, range(0, 5) AS g(k) GROUP BY k),
a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha),
m AS (SELECT k, alpha, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + alpha) AS b, avg(y) AS my, avg(x) AS mx
      FROM r JOIN f ON r.i < f.s, a GROUP BY k, alpha),
e AS (SELECT m.k, alpha, avg(abs(y - (my + b * (x - mx)))) AS mae
      FROM m JOIN f ON m.k = f.k JOIN r ON r.i >= f.s AND r.i < f.s + f.ts GROUP BY m.k, alpha)
SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(mae), 5) AS cv_mae FROM e GROUP BY alpha
""")
def q_m16(spark, d):
    return _cv(spark, one_feature_frame(spark, d), "Ridge Regression", ["alpha"])


def _cv(spark, xy, model, names) -> DataFrame:
    """Mean absolute error of a registry model's whole grid over five expanding folds."""
    from pyspark.ml import Pipeline
    from shoplane.operators.models import REGISTRY, time_series_grid_search
    from shoplane.operators.ordered import time_segments
    xy, n = time_segments(xy.select("l_orderkey", "l_linenumber", "x", "features", "label"), ["l_orderkey", "l_linenumber", "x", "label"], 5)
    _, _, _, results = time_series_grid_search(xy, n, lambda est: Pipeline(stages=[est]), REGISTRY[model], segment_col="segment")
    return spark.createDataFrame([(*(r["params"][k] for k in names), round(r["cv_mae"], 5)) for r in results],
                                 ", ".join(f"{k} double" for k in names) + ", cv_mae double")


def _sql_folds(xy: str) -> str:
    """Rows of ``xy`` with their index, and the folds' bounds."""
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, x, y) - 1 AS i, count(*) OVER () AS n FROM ({xy})),
f AS (SELECT k, max(n) - (5 - k) * (max(n) // 6) AS s, max(n) // 6 AS ts FROM r, range(0, 5) AS g(k) GROUP BY k)"""


@query("m11_elastic_net_one_feature", f"""
WITH s AS (SELECT sign(covar_pop(y, x)) * greatest(abs(covar_pop(y, x)) - 0.1 * 0.2, 0) / (var_pop(x) + 0.1 * 0.8) AS b,
                  avg(y) AS my, avg(x) AS mx FROM ({SQL_XY}))
SELECT round(b, 6) AS slope, round(my - b * mx, 6) AS intercept FROM s
""")
def q_m11(spark, d):
    from shoplane.operators.gram import segment_moments, solve
    from shoplane.operators.models import REGISTRY
    m = segment_moments(one_feature_frame(spark, d).withColumn("segment", F.lit(0)))[0]
    w, b = solve(m, *REGISTRY["Elastic Net"].penalty({"alpha": 0.1, "l1_ratio": 0.2}, m.n))
    return spark.createDataFrame([(round(float(w[0]), 6), round(float(b), 6))], "slope double, intercept double")


@query("m11_elastic_net_cv_mae", f"""
WITH {_sql_folds(SQL_XY)},
a AS (SELECT alpha, l1_ratio FROM (SELECT unnest([0.1, 1.0, 10.0]) AS alpha), (SELECT unnest([0.2, 0.5, 0.8]) AS l1_ratio)),
m AS (SELECT k, alpha, l1_ratio, sign(covar_pop(y, x)) * greatest(abs(covar_pop(y, x)) - alpha * l1_ratio, 0)
             / (var_pop(x) + alpha * (1 - l1_ratio)) AS b, avg(y) AS my, avg(x) AS mx
      FROM r JOIN f ON r.i < f.s, a GROUP BY k, alpha, l1_ratio),
e AS (SELECT m.k, alpha, l1_ratio, avg(abs(y - (my + b * (x - mx)))) AS mae
      FROM m JOIN f ON m.k = f.k JOIN r ON r.i >= f.s AND r.i < f.s + f.ts GROUP BY m.k, alpha, l1_ratio)
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(l1_ratio AS DOUBLE) AS l1_ratio, round(avg(mae), 5) AS cv_mae FROM e GROUP BY alpha, l1_ratio
""")
def q_m11_cv(spark, d):
    return _cv(spark, one_feature_frame(spark, d), "Elastic Net", ["alpha", "l1_ratio"])


SQL_XXY = "SELECT l_orderkey, l_linenumber, l_quantity / 100.0 AS x, l_discount * l_quantity AS z, l_extendedprice / 1000.0 AS y FROM lineitem"


@query("m16_ridge_cv_mae_two_features", f"""
WITH {_sql_folds(SQL_XXY)},
a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha),
c AS (SELECT k, alpha, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) + alpha AS xx, var_pop(z) * count(*) + alpha AS zz,
             covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy
      FROM r JOIN f ON r.i < f.s, a GROUP BY k, alpha),
m AS (SELECT k, alpha, mx, mz, my, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM c),
e AS (SELECT m.k, alpha, avg(abs(y - (my + bx * (x - mx) + bz * (z - mz)))) AS mae
      FROM m JOIN f ON m.k = f.k JOIN r ON r.i >= f.s AND r.i < f.s + f.ts GROUP BY m.k, alpha)
SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(mae), 5) AS cv_mae FROM e GROUP BY alpha
""")
def q_m16_two(spark, d):
    from pyspark.ml.feature import VectorAssembler
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("x"), (F.col("l_discount") * F.col("l_quantity")).alias("z"),
                                        (F.col("l_extendedprice") / 1000).alias("label"))
    return _cv(spark, VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(li), "Ridge Regression", ["alpha"])


# ------------------------------------------------------------ registration

def register_all(queries: dict, oracles: dict, table_reader: Callable) -> None:
    global _T
    _T = table_reader
    queries.update(Q)
    oracles.update(SQL)

