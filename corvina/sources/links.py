"""Links of HTML pages, categories of their addresses, and lists of expected files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of an address by which files are kept and told apart.
KEPT = r"(?i)enem|prova|gabarito|questoes"
KEY_FILE = r"(?i)gabarito|_gb_"
COLOURS = ["azul", "amarelo", "branco", "rosa", "verde", "cinza"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_links(pages: DataFrame, url: str, html: str, suffix: str = ".pdf", kept: str = KEPT) -> DataFrame:
    """(page_url, link): distinct absolute links with the suffix whose address has one of the kept words.

    Links with a scheme stay, those from the root get the page's host, others the page's folder.
    """
    hrefs = F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    found = pages.select(_col(url).alias("page_url"), F.explode(hrefs).alias("href"))
    root = F.regexp_extract("page_url", r"^(\w+://[^/]+)", 1)
    folder = F.regexp_replace("page_url", r"[^/]*$", "")
    link = (
        F.when(F.col("href").rlike(r"^\w+://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract("page_url", r"^(\w+:)", 1), "href"))
        .when(F.col("href").startswith("/"), F.concat(root, "href"))
        .otherwise(F.concat(folder, "href"))
    )
    return found.select("page_url", link.alias("link")).where(F.lower("link").endswith(suffix) & F.col("link").rlike(kept)).distinct()


def link_category(c: str | Column, first_year: int = 2020, last_year: int = 2024) -> Column:
    """Struct (year, kind, colour) of an address; the year only within the given ones, 'key' or 'booklet', the first colour named."""
    link = F.lower(_col(c))
    years = F.transform(F.regexp_extract_all(link, F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    colour: Column = F.lit(None).cast("string")
    for name in reversed(COLOURS):
        colour = F.when(link.contains(name), name).otherwise(colour)
    return F.struct(
        F.get(F.filter(years, lambda y: y.between(first_year, last_year)), F.lit(0)).alias("year"),
        F.when(link.rlike(KEY_FILE), "key").otherwise("booklet").alias("kind"),
        colour.alias("colour"),
    )


def expected_files(spark: SparkSession, years: Sequence[int], days: Sequence[int] = (1, 2), booklets: int = 4) -> DataFrame:
    """(year, day, booklet, kind, file_name) of every file that a year should have, from nested sequences."""
    one = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    out = spark.range(1).select(one(years, "year"))
    out = out.select("year", one(days, "day")).select("year", "day", one(range(1, booklets + 1), "booklet")).select("year", "day", "booklet", one(("PV", "GB"), "kind"))
    return out.withColumn("file_name", F.format_string("%d_%s_impresso_D%d_CD%d.pdf", "year", "kind", "day", "booklet"))


def file_status(expected: DataFrame, there: DataFrame, name: str = "file_name", valid: str = "is_pdf") -> DataFrame:
    """Per year: expected files, those there, and those there but invalid."""
    joined = expected.join(there.select(name, F.col(valid).alias("_ok")), name, "left")
    return joined.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("_ok")).alias("n_valid"), F.count_if(~F.col("_ok")).alias("n_invalid")
    )
