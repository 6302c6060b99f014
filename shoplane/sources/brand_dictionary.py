"""Brand dictionary source (S3).

File format: plain text, one brand per line, grouped under heading lines
``Known <section> brands:``; blank lines are ignored. A brand can be listed in
several sections.

A dictionary file is one record of the scan (files below 2 GB; a dictionary may
be many files), so line order within it is exact whatever the split size. A
line belongs to the last heading before it in its file, found by a window over
the file; headings are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplane.functions.text import collapse_ws, normalize_separators
from shoplane.functions import wordlists as W

# Generic words that may trail a brand name; the name without them is added as
# an alias so "Fuji Bikes" also matches plain "Fuji".
GENERIC_BRAND_TAILS = ["bikes", "bike", "bicycles", "bicycle", "bicycle company",
                       "cycles", "cycle", "cycling", "scooters", "scooter", "ebikes"]


def brand_norm(c) -> F.Column:
    """Normal form used for matching: drop a parenthesised tail such as
    ``(defunct)``, separators to blanks, collapse blanks, lower-case."""
    no_tail = F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")
    return F.lower(normalize_separators(no_tail))


def read_brand_dictionary(spark: SparkSession, path: str, with_aliases: bool = True) -> DataFrame:
    """S3: ``(brand, section, norm)`` rows, duplicates removed."""
    lines = (spark.read.text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "raw"))
             .select("file", "pos", collapse_ws(F.col("raw")).alias("line"))
             .filter(F.col("line") != ""))
    heading = F.regexp_extract("line", W.BRAND_SECTION_HEADING, 1)
    above = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = (lines.withColumn("heading", F.when(heading != "", heading))
             .withColumn("section", F.last("heading", ignorenulls=True).over(above)))
    brands = lines.filter(F.col("heading").isNull()).select(F.col("line").alias("brand"), "section")
    out = brands.withColumn("norm", brand_norm(F.col("brand")))
    if with_aliases:
        tails = "|".join(GENERIC_BRAND_TAILS)
        alias = F.regexp_replace("norm", rf"\s+({tails})$", "")
        # a bare descriptor or ordinary word ("Green Bike" -> "green") is no alias
        plain = [*W.BRAND_DESCRIPTORS, *W.COMMON_WORD_BRANDS]
        extra = out.withColumn("norm", alias).filter((F.col("norm") != "") & ~F.col("norm").isin(*plain))
        out = out.unionByName(extra)  # rows without a tail repeat; duplicates go below
    return out.dropDuplicates(["brand", "section", "norm"])


def write_brand_dictionary(df: DataFrame, path: str, brand: str = "brand",
                           section: str = "section") -> None:
    """Write ``(brand, section)`` rows in the dictionary text format. Sections
    are hash-partitioned so each file holds whole sections, heading first."""
    heads = df.select(F.col(section).alias("s")).distinct().select(
        "s", F.lit(0).alias("k"), F.concat(F.lit("Known "), F.col("s"), F.lit(" brands:")).alias("value"))
    body = df.select(F.col(section).alias("s"), F.lit(1).alias("k"), F.col(brand).alias("value")).distinct()
    (heads.unionByName(body).repartition("s").sortWithinPartitions("s", "k", "value")
     .select("value").write.mode("overwrite").text(path))
