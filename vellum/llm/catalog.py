"""The training-data queries, one group per problem, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.canonical_titles import OTHER_NAMES, entries_of_values
from vellum.llm.containers import CAPACITY, contained
from vellum.llm.format_duplicates import format_duplicates
from vellum.llm.leakage import leaked_items
from vellum.llm.lookalikes import stored_differently
from vellum.llm.main_content import main_lines, main_text
from vellum.llm.mojibake import garbled_distinct, garbled_values
from vellum.llm.name_variants import people, same_person_pairs
from vellum.llm.residue import residue_kinds
from vellum.llm.sentences import sentences
from vellum.operators.skew import spread_join
from vellum.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "fetched_pages").select("page_id", "html", "text")
    return main_lines(pages).distinct()


def p1_body_text(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each page as one text, its lines in order."""
    pages = table(spark, folder, "fetched_pages").select("page_id", "html", "text")
    return main_text(pages)


def _typed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """``src, row_id, value`` of the three typed fields."""
    faculty, candidates = table(spark, folder, "faculty_records"), table(spark, folder, "candidates")
    return (
        faculty.select(F.lit("faculty_records.title").alias("src"), F.col("record_id").alias("row_id"), F.col("title").alias("value"))
        .unionByName(candidates.select(F.lit("candidates.title_raw").alias("src"), F.col("candidate_id").alias("row_id"), F.col("title_raw").alias("value")))
        .unionByName(candidates.select(F.lit("candidates.normalized_title").alias("src"), F.col("candidate_id").alias("row_id"), F.col("normalized_title").alias("value")))
    )


def _mapped_titles(spark: SparkSession, folder: str, typed: DataFrame) -> DataFrame:
    further = spark.createDataFrame([(title, name) for title, names in OTHER_NAMES.items() for name in names.split("|")], "title string, name string")
    return entries_of_values(typed, table(spark, folder, "canonical_titles"), further=further)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = _typed_titles(spark, folder)
    mapped = _mapped_titles(spark, folder, typed)
    return spread_join(typed, mapped.select("value", "title_id", "n_rows"), ["value"], "row_id", count="n_rows").select("src", "row_id", "title_id").distinct()


def p2_misses(spark: SparkSession, folder: str) -> DataFrame:
    """The values that match no entry, with how many rows have them."""
    typed = _typed_titles(spark, folder)
    mapped = _mapped_titles(spark, folder, typed).where("title_id = 0")
    return mapped.select("value", "n_rows")


def _named_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["unit_id", "record_id", "name"]
    return table(spark, folder, "faculty_records").select(*columns).unionByName(table(spark, folder, "directory_records").select(*columns))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_person_pairs(_named_rows(spark, folder)).distinct()


def p3_people(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with its person, without the pairs."""
    return people(_named_rows(spark, folder)).select("record_id", "person")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The pages with residue in place of content, and of which kinds."""
    pages = table(spark, folder, "fetched_pages").select("page_id", "title", "text")
    return residue_kinds(pages).where(F.size("residue") > 0).select("page_id", "residue")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_kinds(spark, folder).select("page_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates(table(spark, folder, "faculty_records")).select("keep_id", "record_id")


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per set of copies with its size, counted from the verified rows."""
    found = format_duplicates(table(spark, folder, "faculty_records"))
    return found.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))


def p6_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Names and titles stored with other characters than they show, with their one consistent form."""
    rows = table(spark, folder, "faculty_records")
    garbled = garbled_distinct(rows, "title", short=True).select(F.lit("title").alias("field_name"), F.col("_text").alias("value"))
    return stored_differently(rows, "record_id", ["name", "title"], garbled)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_canonical(spark, folder).select("record_id", "field_name").distinct()


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled page text and faculty title with its restored form, and whether characters are lost for good."""
    pages = garbled_values(table(spark, folder, "fetched_pages"), "page_id", "text")
    titles = garbled_values(table(spark, folder, "faculty_records"), "record_id", "title", short=True)
    return pages.withColumn("src", F.lit("fetched_pages")).unionByName(titles.withColumn("src", F.lit("faculty_records")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_restored(spark, folder).select("src", "row_id").distinct()


def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """A container and a slot for every part of every non-blank document."""
    return contained(table(spark, folder, "documents").select("doc_id", "text"))


def p8_bucket_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same with batches that each take texts of one length bucket only."""
    return contained(table(spark, folder, "documents").select("doc_id", "text"), mixed=False)


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, tokens in them and the share of room used, by both ways of forming batches."""
    found = [p8_assignment(spark, folder).withColumn("batches", F.lit("mixed")), p8_bucket_batches(spark, folder).withColumn("batches", F.lit("one bucket"))]
    sums = found[0].unionByName(found[1]).groupBy("batches").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return sums.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 4))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """How far each container is filled."""
    return p8_assignment(spark, folder).groupBy("container_id").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked test item got into."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_sentences(spark, folder).select("doc_id", "sent_end").distinct()


def queries() -> dict[str, QueryFn]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


_BLANK_SQL = "[\\s\\p{Z}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{00ad}]+"
_AROUND_SQL = r"""[.,;:!?''"`()<>\[\]{}|/\\#&\x{00b4}\x{00ab}\x{00bb}\x{2018}-\x{201f}\x{2026}\x{3001}\x{3002}\x{ff0c}\x{ff1b}\x{ff1a}\x{ff01}\x{ff1f}\x{ff08}\x{ff09}]+"""
_COPIES_SQL = f"""
WITH r AS (SELECT record_id, lower(regexp_replace(coalesce(profile_url, ''), '{_BLANK_SQL}', '', 'g')) AS u, lower(regexp_replace(coalesce(email, ''), '{_BLANK_SQL}', '', 'g')) AS m FROM faculty_records),
s AS (SELECT record_id, regexp_replace(regexp_replace(u, '^{_AROUND_SQL}', ''), '{_AROUND_SQL}$', '') AS u, regexp_replace(regexp_replace(m, '^{_AROUND_SQL}', ''), '{_AROUND_SQL}$', '') AS m FROM r),
k AS (SELECT record_id, m, u, regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^?]*)', 1), '/+', '/', 'g'), '^(https?:)/', '\\1//'), '/+$', '') AS base,
list_sort(list_filter(string_split_regex(regexp_extract(u, '\\?(.*)$', 1), '[&;]'), lambda x: x <> '')) AS fields FROM s WHERE u <> '' OR m <> ''),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY base, fields, m) AS keep_id FROM k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _COPIES_SQL + "SELECT DISTINCT keep_id, record_id FROM g WHERE keep_id <> record_id",
        "p5_copies": _COPIES_SQL + "SELECT keep_id, count(*) AS n_copies FROM g GROUP BY ALL HAVING count(*) > 1",
    }
