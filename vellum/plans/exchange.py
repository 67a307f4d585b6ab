"""Scans, sinks and streams over the tables: what is written and read again must be what the tables have."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.session import shared_folder
from vellum.sources import importers, sinks, xlsx
from vellum.sources.tables import table
from vellum.streaming import snapshots

SQL: dict[str, str] = {}
_ALIASES = {"school": ["university", "name"], "page": ["directory url"], "domain": ["official domain", "official_domain"], "nothing": ["none"]}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _schools(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "schools")
    return rows.select(F.trim("name").alias("University"), F.col("directory_url").alias("Directory URL"), F.col("official_domain").alias("Official Domain"))


def _by_domain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("school").alias("first_school"), F.max("page").alias("last_page"), F.max("nothing").alias("nothing"))


_SCHOOLS_SQL = "SELECT trim(official_domain) AS domain, count(*) AS n, min(trim(name)) AS first_school, max(trim(directory_url)) AS last_page, '' AS nothing FROM schools GROUP BY ALL"


def q_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Schools written as CSV and scanned again, their headers resolved by aliases."""
    path = _place(spark, "csv")
    sinks.write_csv(_schools(spark, folder), path)
    return _by_domain(importers.resolved(importers.csv_rows(spark, path), _ALIASES))


def q_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same by way of a JSON list."""
    path = _place(spark, "json")
    rows = _schools(spark, folder).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))  # one file, so one list: for imports typed by people
    rows.coalesce(1).write.text(path)
    return _by_domain(importers.resolved(importers.json_rows(spark, path, ["University", "Directory URL", "Official Domain"]), _ALIASES))


def q_xlsx_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same by way of a workbook."""
    path = _place(spark, "book") + ".xlsx"
    xlsx.write_workbook(_schools(spark, folder), path.removeprefix("file:"))
    return _by_domain(importers.resolved(xlsx.xlsx_rows(spark, path, ["University", "Directory URL", "Official Domain"]), _ALIASES))


def q_text_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of page texts written and scanned again: how often each stands there, blanks around it aside."""
    path = _place(spark, "text")
    table(spark, folder, "fetched_pages").where("text != ''").select("text").write.text(path)
    return importers.text_rows(spark, path).groupBy("value").agg(F.count("*").alias("n"))


SQL["q_csv_scan"] = SQL["q_json_scan"] = SQL["q_xlsx_scan"] = _SCHOOLS_SQL
SQL["q_text_scan"] = "SELECT trim(l) AS value, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS l FROM fetched_pages WHERE text <> '') WHERE trim(l) <> '' GROUP BY ALL"


def q_pasted_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of pages pasted by school, each line's addresses valid at their first place and duplicates after it."""
    pasted = table(spark, folder, "fetched_pages").select(F.concat(F.lit("see "), F.col("requested_url"), F.lit(", "), F.col("final_url")).alias("raw"))
    return importers.url_lines(pasted).groupBy("state").agg(F.count("*").alias("n"))


_KEY = "lower(regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1)) || regexp_replace(regexp_replace(regexp_replace(trim({0}), '^\\s*(?i)https?://[^/?#\\s]+', ''), '#.*$', ''), '/+$', '')"
SQL["q_pasted_addresses"] = f"""
WITH u AS (SELECT requested_url AS u FROM fetched_pages UNION ALL SELECT final_url FROM fetched_pages), f AS (SELECT u FROM u WHERE u IS NOT NULL AND regexp_matches(u, '^https?://'))
SELECT 'valid' AS state, count(DISTINCT {_KEY.format('u')}) AS n FROM f UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT {_KEY.format('u')}) FROM f"""


def q_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Markup written under its digest and read back: the digest of what was read, and its length."""
    path = _place(spark, "snapshots")
    pages = table(spark, folder, "fetched_pages").select("html")
    sinks.write_snapshots(pages, path.removeprefix("file:")).write.format("noop").mode("overwrite").save()
    return sinks.page_snapshots(spark, path).select(F.sha2("html", 256).alias("digest"), F.length("html").alias("n_chars"))


SQL["q_snapshots"] = "SELECT DISTINCT sha256(html) AS digest, length(html)::int AS n_chars FROM fetched_pages WHERE html <> ''"


def q_watched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that each further fetch of a school brings, as a stream with state per school, until two fetches bring nothing."""
    rows = table(spark, folder, "fetched_pages").select(F.col("school_id").cast("string").alias("page"), F.col("page_id"), F.array(F.coalesce("title", F.lit(""))).alias("keys"))
    rounds = rows.withColumn("round", F.row_number().over(Window.partitionBy("page").orderBy("page_id"))).select("page", "round", "keys")
    source, target = _place(spark, "watched-in"), _place(spark, "watched-out")
    rounds.write.parquet(source)
    stream = snapshots.watch(spark.readStream.schema(rounds.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


SQL["q_watched_pages"] = """
WITH r AS (SELECT school_id::varchar AS page, row_number() OVER (PARTITION BY school_id ORDER BY page_id) AS round, coalesce(title, '') AS k FROM fetched_pages),
f AS (SELECT page, round, (row_number() OVER (PARTITION BY page, k ORDER BY round) = 1)::int AS n_new FROM r),
z AS (SELECT *, n_new = 0 AND coalesce(lag(n_new) OVER (PARTITION BY page ORDER BY round), 1) = 0 AS quiet FROM f),
s AS (SELECT *, bool_or(quiet) OVER (PARTITION BY page ORDER BY round ROWS UNBOUNDED PRECEDING) AS stopped FROM z)
SELECT page, round::int AS round, CASE WHEN stopped THEN 0 ELSE n_new END AS n_new, stopped FROM s"""


def all_queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_") and callable(f)}
