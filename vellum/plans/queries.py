"""The engine's operators over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import emails, text, urls
from vellum.operators import dedup, graph, html, matching, page_people, reports
from vellum.operators.skew import spread_join
from vellum.sources.tables import table

SQL: dict[str, str] = {}


def q_page_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct pages by address, the first fetch of each, counted by host and language."""
    pages = table(spark, folder, "fetched_pages").select("page_id", "final_url", F.regexp_extract("html", r"<html[^>]*\slang=[\"']?([A-Za-z]+)", 1).alias("lang"))
    first = dedup.first_per_key(pages, urls.page_key(F.col("final_url")), F.col("page_id"))
    return first.groupBy(urls.host(F.col("final_url")).alias("host"), "lang").agg(F.count("*").alias("n_pages"))


_PAGE_KEY = """CASE WHEN regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1) = '' THEN '' ELSE lower(regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1)) || regexp_replace(regexp_replace(regexp_replace(trim({0}), '^\\s*(?i)https?://[^/?#\\s]+', ''), '#.*$', ''), '/+$', '') END"""
_HOST = """regexp_extract(lower(regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1)), '^https?://(?:[^@/]*@)?([^:/]+)', 1)"""
SQL["q_page_inventory"] = f"""
WITH p AS (SELECT page_id, final_url, regexp_extract(html, '<html[^>]*\\slang=["'']?([A-Za-z]+)', 1) AS lang, {_PAGE_KEY.format('final_url')} AS k FROM fetched_pages),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS rn FROM p WHERE k <> '')
SELECT {_HOST.format('final_url')} AS host, lang, count(*) AS n_pages FROM f WHERE rn = 1 GROUP BY ALL"""


def q_href_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The eight most frequent link patterns, numbers left out, ties by pattern."""
    links = table(spark, folder, "fetched_pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    counts = links.groupBy(urls.href_pattern(F.col("href")).alias("pattern")).agg(F.count("*").alias("n_links"))
    return counts.orderBy(F.desc("n_links"), "pattern").limit(8)


SQL["q_href_patterns"] = """
WITH l AS (SELECT unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM fetched_pages)
SELECT regexp_extract(regexp_replace(regexp_replace(href, '[?#].*$', ''), '\\d+', '<id>', 'g'), '^((?:https?://[^/]+)?(?:/[^/]*){0,4})', 1) AS pattern, count(*) AS n_links
FROM l GROUP BY ALL ORDER BY n_links DESC, pattern LIMIT 8"""


def q_page_states(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by what the response and the amount of text tell about them."""
    pages = table(spark, folder, "fetched_pages").select("http_status", F.length(F.trim("text")).alias("n"))
    state = (
        F.when(F.coalesce("http_status", F.lit(0)) == 0, "no_response")
        .when(F.col("http_status") == 429, "rate_limited")
        .when(F.col("http_status").isin(401, 403), "forbidden")
        .when(F.col("http_status") >= 500, "server_error")
        .when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("n") < 100, "short")
        .otherwise("content")
    )
    return pages.groupBy(state.alias("state")).agg(F.count("*").alias("n_pages"))


SQL["q_page_states"] = """
SELECT CASE WHEN coalesce(http_status, 0) = 0 THEN 'no_response' WHEN http_status = 429 THEN 'rate_limited' WHEN http_status IN (401, 403) THEN 'forbidden'
WHEN http_status >= 500 THEN 'server_error' WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty' WHEN length(trim(text)) < 100 THEN 'short' ELSE 'content' END AS state, count(*) AS n_pages
FROM fetched_pages GROUP BY ALL"""


def q_headings_in_effect(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of page text stand under each second-level heading, the heading carried down to the next one."""
    pages = table(spark, folder, "fetched_pages").where(F.col("html").rlike(r"<h2[\s>]"))
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(h2|li|p)\b[^>]*>([^<]+)"), 0)).alias("pos", "part"))
    parts = parts.withColumn("heading", F.when(F.col("part").startswith("<h2"), F.regexp_extract("part", ">([^<]+)$", 1)))
    under = reports.carried(parts, "page_id", "pos", F.col("heading"), "in_effect").where("heading is null and in_effect is not null")
    return under.groupBy(F.col("in_effect").alias("heading")).agg(F.count("*").alias("n_blocks"))


SQL["q_headings_in_effect"] = """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<(?:h2|li|p)\\b[^>]*>[^<]+', 0) AS xs FROM fetched_pages WHERE regexp_matches(html, '<h2[\\s>]')),
p AS (SELECT page_id, generate_subscripts(xs, 1) AS pos, unnest(xs) AS part FROM a),
h AS (SELECT *, CASE WHEN starts_with(part, '<h2') THEN regexp_extract(part, '>([^<]+)$', 1) END AS heading FROM p),
c AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_effect FROM h)
SELECT in_effect AS heading, count(*) AS n_blocks FROM c WHERE heading IS NULL AND in_effect IS NOT NULL GROUP BY ALL"""


def q_table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of tables per page that has any."""
    pages = table(spark, folder, "fetched_pages").where(F.col("html").rlike(r"<td[\s>]"))
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"<td\b[^>]*>([^<]*)"), 1)).alias("n_cells"))


SQL["q_table_cells"] = "SELECT page_id, len(regexp_extract_all(html, '<td\\b[^>]*>([^<]*)', 1)) AS n_cells FROM fetched_pages WHERE regexp_matches(html, '<td[\\s>]')"


def q_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of visible text and links of each page, from the parsed tree."""
    return html.page_facts(table(spark, folder, "fetched_pages").where("html != ''")).select("page_id", "n_links", F.length("visible").alias("n_chars"))


def q_listed_people(spark: SparkSession, folder: str) -> DataFrame:
    """People listed on pages as "name, title", one row each, from the parsed tree."""
    return html.listed_people(table(spark, folder, "fetched_pages").where("html != ''"))


def q_mail_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct mail addresses in document and page texts by domain."""
    docs = table(spark, folder, "documents").select("text").unionByName(table(spark, folder, "fetched_pages").select("text"))
    found = docs.select(F.explode(emails.addresses(emails.spelled_out(F.col("text")))).alias("mail")).distinct()
    return found.groupBy(F.regexp_extract("mail", "@(.+)$", 1).alias("domain")).agg(F.count("*").alias("n_addresses"))


SQL["q_mail_domains"] = """
WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM fetched_pages),
m AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\\\u0040|\\\\x40|&#0*64;|&#x0*40;|&commat;|%40', '@', 'g'), '(?i)([\\w.-])\\s*[\\[({]\\s*(?:at|@|arroba)\\s*[\\])}]\\s*([\\w-])', '\\1@\\2', 'g'), '(?i)([\\w-])\\s*[\\[({]\\s*(?:dot|punkt|punto|point|\\.)\\s*[\\])}]\\s*([\\w-])', '\\1.\\2', 'g')), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')) AS mail FROM t)
SELECT regexp_extract(mail, '@(.+)$', 1) AS domain, count(*) AS n_addresses FROM m GROUP BY ALL"""


def q_redacted_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Profile addresses made safe to show, counted."""
    rows = table(spark, folder, "faculty_records").where("profile_url like '%?%'")
    return rows.groupBy(urls.redacted(F.regexp_replace("profile_url", r"\s+", "")).alias("shown")).agg(F.count("*").alias("n"))


SQL["q_redacted_urls"] = f"""
WITH u AS (SELECT regexp_replace(regexp_replace(regexp_replace(profile_url, '\\s+', '', 'g'), '#.*$', ''), '^((?i)https?://)[^@/]*@', '\\1') AS u FROM faculty_records WHERE profile_url LIKE '%?%'),
i AS (SELECT u, string_split(regexp_extract(u, '\\?(.*)$', 1), '&') AS xs FROM u),
s AS (SELECT CASE WHEN contains(u, '?') THEN regexp_extract(u, '^([^?]*)', 1) || '?' || array_to_string(list_transform(xs, lambda x: CASE WHEN lower(regexp_extract(x, '^([^=]*)', 1)) IN ({', '.join(f"'{x}'" for x in urls.SHOWN)}) OR NOT contains(x, '=') THEN x ELSE regexp_extract(x, '^([^=]*)', 1) || '=<redacted>' END), '&') ELSE u END AS shown FROM i)
SELECT shown, count(*) AS n FROM s GROUP BY ALL"""


def q_profile_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct profile addresses per school."""
    rows = table(spark, folder, "faculty_records").select("school_id", urls.page_key(F.col("profile_url")).alias("k")).where("k != ''")
    return rows.groupBy("school_id").agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("n_profiles"))


SQL["q_profile_keys"] = f"""
WITH k AS (SELECT school_id, {_PAGE_KEY.format('profile_url')} AS k FROM faculty_records)
SELECT school_id, count(*) AS n_rows, count(DISTINCT k) AS n_profiles FROM k WHERE k <> '' GROUP BY ALL"""


def q_party_keys(spark: SparkSession, folder: str) -> DataFrame:
    """ASCII keys of customers, suppliers and nations, with how many sources have each."""
    one = lambda name, column: table(spark, folder, name).select(F.lit(name).alias("source"), text.ascii_key(F.col(column)).alias("k"))
    both = one("customer", "c_name").unionByName(one("supplier", "s_name")).unionByName(one("nation", "n_name"))
    return both.where("k != ''").groupBy("k").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_rows"))


SQL["q_party_keys"] = """
WITH b AS (SELECT 'customer' AS source, c_name AS v FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'nation', n_name FROM nation),
k AS (SELECT source, regexp_replace(lower(strip_accents(v)), '[^a-z0-9]', '', 'g') AS k FROM b)
SELECT k, count(DISTINCT source) AS n_sources, count(*) AS n_rows FROM k WHERE k <> '' GROUP BY ALL"""


def q_first_filled(spark: SparkSession, folder: str) -> DataFrame:
    """The first filled of several columns, as a scan resolves header aliases."""
    rows = table(spark, folder, "candidates")
    return rows.select(text.first_filled(F.col("normalized_title"), F.col("title_translated"), F.col("title_raw")).alias("title")).groupBy("title").agg(F.count("*").alias("n"))


SQL["q_first_filled"] = """
SELECT coalesce(nullif(trim(normalized_title, ' '), ''), nullif(trim(title_translated, ' '), ''), nullif(trim(title_raw, ' '), ''), '') AS title, count(*) AS n FROM candidates GROUP BY ALL"""


def q_title_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Faculty titles by the first phrase that stands in them as whole words."""
    titles = table(spark, folder, "faculty_records").groupBy("title").agg(F.count("*").alias("c"))
    return titles.groupBy(reports.first_rule(F.coalesce("title", F.lit("")), TITLE_RULES, "none").alias("rule")).agg(F.sum("c").alias("n"))


#: Phrases, first match first.
TITLE_RULES = [("emeritus", "emeritus|emerita"), ("assistant professor", "assistant professor"), ("associate professor", "associate professor"), ("professor", "professor|catedrático"), ("lecturer", "lecturer"), ("research", "research(?:er)?")]
SQL["q_title_rules"] = (
    "SELECT CASE "
    + " ".join(f"WHEN regexp_matches(coalesce(title, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({phrase})($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') THEN '{name}'" for name, phrase in TITLE_RULES)
    + " ELSE 'none' END AS rule, count(*) AS n FROM faculty_records GROUP BY ALL"
)


def q_order_status(spark: SparkSession, folder: str) -> DataFrame:
    return reports.rollup_by(table(spark, folder, "orders"), "o_orderstatus")


SQL["q_order_status"] = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL"


def q_usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, those of one kind, and amounts in whole cents, zero where there are none."""
    events = table(spark, folder, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return events.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.countDistinct("user_id").alias("users"), F.coalesce(cents, F.lit(0)).alias("cents"))


SQL["q_usage_summary"] = "SELECT count(*) AS calls, count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT user_id) AS users, coalesce(sum(round(value * 100)::BIGINT), 0)::BIGINT AS cents FROM events"


def q_month_to_date(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last month by kind."""
    events = table(spark, folder, "events")
    last = events.agg(F.date_trunc("month", F.max("ts")).alias("start"))
    return events.join(F.broadcast(last), F.col("ts") >= F.col("start")).groupBy("event_type").agg(F.count("*").alias("n"))


SQL["q_month_to_date"] = "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT date_trunc('month', max(ts)) FROM events) GROUP BY ALL"


def q_budget_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The event with which each user's running total reaches half of it all."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).alias("cents"))
    run = reports.running_total(events, "user_id", ["ts", "event_id"], F.col("cents"))
    run = run.withColumn("whole", F.max("total").over(Window.partitionBy("user_id"))).where(F.col("total") * 2 >= F.col("whole"))
    return run.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


SQL["q_budget_replay"] = """
WITH e AS (SELECT event_id, user_id, ts, round(value * 100) AS cents FROM events),
r AS (SELECT *, sum(greatest(cents, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
w AS (SELECT *, max(total) OVER (PARTITION BY user_id) AS whole FROM r)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM w WHERE total * 2 >= whole GROUP BY ALL"""


def q_newest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty newest events."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


SQL["q_newest_events"] = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"


def q_latest_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's latest order."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


SQL["q_latest_order"] = "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL"


def q_failure_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return reports.exploded_counts(table(spark, folder, "candidates"), "failure_reasons", "reason")


SQL["q_failure_reasons"] = "SELECT reason, count(*) AS n FROM (SELECT unnest(failure_reasons) AS reason FROM candidates) GROUP BY ALL"


def q_evidence_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence rows of candidates, one per item, by field, method and status."""
    rows = table(spark, folder, "candidates").select("candidate_id", F.explode("evidence").alias("e"))
    return rows.groupBy("e.field", "e.extraction_method", "e.status").agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("n_candidates"))


SQL["q_evidence_fields"] = """
SELECT e.field AS field, e.extraction_method AS extraction_method, e.status AS status, count(*) AS n, count(DISTINCT candidate_id) AS n_candidates
FROM (SELECT candidate_id, unnest(evidence) AS e FROM candidates) GROUP BY ALL"""


def q_fetch_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches, time and retries per host."""
    pages = table(spark, folder, "fetched_pages").select(urls.host(F.col("final_url")).alias("host"), "fetch_duration_ms", "fetch_attempts")
    retries = F.sum(F.greatest(F.coalesce("fetch_attempts", F.lit(0)) - 1, F.lit(0)))
    return pages.groupBy("host").agg(F.count("*").alias("n_fetches"), F.sum("fetch_duration_ms").alias("fetch_ms"), retries.alias("retries"))


SQL["q_fetch_performance"] = f"""
SELECT {_HOST.format('final_url')} AS host, count(*) AS n_fetches, sum(fetch_duration_ms)::BIGINT AS fetch_ms, sum(greatest(coalesce(fetch_attempts, 0) - 1, 0))::BIGINT AS retries
FROM fetched_pages GROUP BY ALL"""


def q_dynamic_actions(spark: SparkSession, folder: str) -> DataFrame:
    return reports.exploded_counts(table(spark, folder, "fetched_pages"), "dynamic_actions", "action")


SQL["q_dynamic_actions"] = "SELECT action, count(*) AS n FROM (SELECT unnest(dynamic_actions) AS action FROM fetched_pages) GROUP BY ALL"


def q_coverage_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per school its records, distinct identities (mail, else address, else name) and repeats; schools without any too."""
    rows = table(spark, folder, "faculty_records")
    identity = text.first_filled(F.lower("email"), F.lower("profile_url"), F.lower("name"))
    per = rows.select("school_id", identity.alias("i")).groupBy("school_id").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"))
    schools = table(spark, folder, "schools").select("school_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return schools.join(per, "school_id", "left").select("school_id", zero("n").alias("n_records"), zero("d").alias("n_identities"), (zero("n") - zero("d")).alias("n_repeats"))


SQL["q_coverage_audit"] = """
WITH r AS (SELECT school_id, coalesce(nullif(trim(lower(email), ' '), ''), nullif(trim(lower(profile_url), ' '), ''), nullif(trim(lower(name), ' '), ''), '') AS i FROM faculty_records),
p AS (SELECT school_id, count(*) AS n, count(DISTINCT i) AS d FROM r GROUP BY ALL)
SELECT school_id, coalesce(n, 0) AS n_records, coalesce(d, 0) AS n_identities, coalesce(n, 0) - coalesce(d, 0) AS n_repeats FROM schools LEFT JOIN p USING (school_id)"""


def q_known_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Which candidates share a mail address, a homepage, or name and school with faculty records."""
    rows = table(spark, folder, "candidates").select("candidate_id", "school_id", F.lower(F.trim("email")).alias("m"), urls.page_key(F.col("homepage")).alias("u"), F.lower("name").alias("nm")).dropDuplicates(["candidate_id"])
    known = table(spark, folder, "faculty_records").select("school_id", F.lower(F.trim("email")).alias("m"), urls.page_key(F.col("profile_url")).alias("u"), F.lower("name").alias("nm"))
    flag = lambda keys, name: known.select(*keys).where(" and ".join(f"{k} != ''" if k != "school_id" else "school_id is not null" for k in keys)).distinct().withColumn(name, F.lit(True))
    base = rows
    for keys, name in ((["m"], "by_mail"), (["u"], "by_page"), (["school_id", "nm"], "by_name")):
        rows = spread_join(rows, flag(keys, name), keys, "candidate_id", how="left", base=base, shuffled=False)
    return rows.select("candidate_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("by_mail", "by_page", "by_name")))


SQL["q_known_candidates"] = f"""
WITH f AS (SELECT school_id, lower(trim(email, ' ')) AS m, {_PAGE_KEY.format('profile_url')} AS u, lower(name) AS nm FROM faculty_records),
c AS (SELECT DISTINCT candidate_id, school_id, lower(trim(email, ' ')) AS m, {_PAGE_KEY.format('homepage')} AS u, lower(name) AS nm FROM candidates)
SELECT candidate_id, coalesce(m <> '' AND m IN (SELECT m FROM f WHERE m IS NOT NULL), false) AS by_mail, coalesce(u <> '' AND u IN (SELECT u FROM f WHERE u IS NOT NULL), false) AS by_page,
coalesce(nm <> '' AND EXISTS (SELECT 1 FROM f WHERE f.school_id = c.school_id AND f.nm = c.nm), false) AS by_name FROM c"""


def q_directory_only(spark: SparkSession, folder: str) -> DataFrame:
    """Directory records whose profile address no faculty record has."""
    directory = table(spark, folder, "directory_records").select("record_id", urls.page_key(F.col("profile_url")).alias("u")).where("u != ''")
    known = table(spark, folder, "faculty_records").select(urls.page_key(F.col("profile_url")).alias("u")).distinct()
    return directory.join(known, "u", "left_anti").select("record_id")


SQL["q_directory_only"] = f"""
SELECT record_id FROM (SELECT record_id, {_PAGE_KEY.format('profile_url')} AS u FROM directory_records) d
WHERE u <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT {_PAGE_KEY.format('profile_url')} AS u FROM faculty_records) f WHERE f.u = d.u)"""


def q_most_complete(spark: SparkSession, folder: str) -> DataFrame:
    """For each profile address the most complete faculty record, at the place of the first."""
    rows = table(spark, folder, "faculty_records").select("record_id", "name", "title", "email", urls.page_key(F.col("profile_url")).alias("u")).where("u != ''")
    return dedup.most_complete_per_key(rows, F.col("u"), F.col("record_id"), ["name", "title", "email"]).select("record_id", "first_at", "n_rows")


_FILLED = " + ".join(f"CASE WHEN coalesce(trim({c}, ' '), '') <> '' THEN 1 ELSE 0 END" for c in ("name", "title", "email"))
SQL["q_most_complete"] = f"""
WITH r AS (SELECT record_id, {_PAGE_KEY.format('profile_url')} AS u, {_FILLED} AS s FROM faculty_records)
SELECT arg_max(record_id, (s, -record_id)) AS record_id, min(record_id) AS first_at, count(*) AS n_rows FROM r WHERE u <> '' GROUP BY u"""


def q_greedy_records(spark: SparkSession, folder: str) -> DataFrame:
    """Faculty records kept by the scan in order over mail, address, and name in the school."""
    rows = table(spark, folder, "faculty_records").select(
        "record_id", F.lower(F.trim("email")).alias("mail"), urls.page_key(F.col("profile_url")).alias("page"), F.when(F.trim("name") != "", F.concat_ws("|", "school_id", F.lower("name"))).alias("who")
    )
    return dedup.greedy_first(rows, "record_id", ["mail", "page", "who"], "record_id").where("kept").select(F.col("id").alias("record_id"))


SQL["q_greedy_records"] = f"""
WITH r AS (SELECT record_id, list_filter(['m|' || nullif(lower(trim(email)), ''), 'p|' || nullif({_PAGE_KEY.format("profile_url")}, ''), CASE WHEN trim(name) <> '' THEN 'w|' || school_id || '|' || lower(name) END], lambda x: x IS NOT NULL) AS ks FROM faculty_records),
l AS (SELECT list({{'kept': [record_id], 'taken': ks}} ORDER BY record_id) AS xs FROM r),
z AS (SELECT list_reduce(xs, lambda a, x: CASE WHEN list_has_any(a.taken, x.taken) THEN a ELSE {{'kept': a.kept || x.kept, 'taken': a.taken || x.taken}} END) AS w FROM l)
SELECT unnest(w.kept) AS record_id FROM z"""


def q_reachable_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units and schools within two steps of school 17, over the links that shared records make."""
    rows = table(spark, folder, "faculty_records").where("school_id is not null and unit_id is not null").select("school_id", "unit_id").distinct()
    school, unit = F.concat(F.lit("s"), "school_id"), F.concat(F.lit("u"), "unit_id")
    links = rows.select(school.alias("src"), unit.alias("dst")).unionByName(rows.select(unit.alias("src"), school.alias("dst")))
    starts = spark.createDataFrame([("s17",)], "node string")
    return graph.reachable(links, starts, depth=2)


SQL["q_reachable_units"] = """
WITH RECURSIVE r AS (SELECT DISTINCT 's' || school_id AS s, 'u' || unit_id AS u FROM faculty_records WHERE school_id IS NOT NULL AND unit_id IS NOT NULL),
l AS (SELECT s AS src, u AS dst FROM r UNION ALL SELECT u, s FROM r),
w AS (SELECT 's17' AS node, 0 AS depth UNION SELECT l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.node WHERE w.depth < 2)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY ALL"""


def q_merged_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page address: the last state, the most attempts, the first filled title."""
    pages = table(spark, folder, "fetched_pages").select("page_id", "http_status", "fetch_attempts", F.nullif("title", F.lit("")).alias("t"), urls.page_key(F.col("requested_url")).alias("u"))
    return pages.where("u != ''").groupBy("u").agg(
        F.coalesce(F.max_by("http_status", "page_id"), F.lit(0)).alias("last_status"), F.max("fetch_attempts").alias("most_attempts"), F.min_by("t", F.when(F.col("t").isNotNull(), F.col("page_id"))).alias("first_title"), F.count("*").alias("n")
    )


SQL["q_merged_fetches"] = f"""
WITH p AS (SELECT page_id, http_status, fetch_attempts, nullif(title, '') AS t, {_PAGE_KEY.format('requested_url')} AS u FROM fetched_pages)
SELECT u, coalesce(last(http_status ORDER BY page_id), 0) AS last_status, max(fetch_attempts) AS most_attempts, arg_min(t, page_id) FILTER (t IS NOT NULL) AS first_title, count(*) AS n FROM p WHERE u <> '' GROUP BY ALL"""


def q_due_for_removal(spark: SparkSession, folder: str) -> DataFrame:
    """Events seven days or more before the newest, counted by kind."""
    events = table(spark, folder, "events")
    newest = F.broadcast(events.agg(F.max("ts").alias("now")))
    return events.join(newest, F.col("ts") <= F.col("now") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))


SQL["q_due_for_removal"] = "SELECT event_type, count(*) AS n FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY ALL"


def q_new_names_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """How many names of a school are seen for the first time on each day it was scraped."""
    rows = table(spark, folder, "faculty_records").where("name != '' and scraped_at is not null")
    first = rows.groupBy("school_id", "name").agg(F.min("scraped_at").alias("at"))
    return first.groupBy("school_id", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_new"))


SQL["q_new_names_by_day"] = """
WITH f AS (SELECT school_id, name, min(scraped_at) AS first_at FROM faculty_records WHERE name <> '' AND scraped_at IS NOT NULL GROUP BY ALL)
SELECT school_id, strftime(first_at, '%Y-%m-%d') AS day, count(*) AS n_new FROM f GROUP BY ALL"""


def q_same_school_names(spark: SparkSession, folder: str) -> DataFrame:
    """Schools by the key of their name, those sharing one together."""
    rows = table(spark, folder, "schools").select("school_id", text.unicode_key(F.col("name")).alias("k"))
    return rows.groupBy("k").agg(F.min("school_id").alias("first_id"), F.count("*").alias("n"))


SQL["q_same_school_names"] = "SELECT regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS k, min(school_id) AS first_id, count(*) AS n FROM schools GROUP BY ALL"


def q_event_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events by a field of their JSON properties, declared types only."""
    rows = table(spark, folder, "events").select(F.from_json("props", "k int").alias("p"))
    return rows.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


SQL["q_event_props"] = "SELECT (props->>'k')::INT AS k, count(*) AS n FROM events GROUP BY ALL"


def q_search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Schools whose row, written as one text, has a word in it, in any letter case."""
    rows = table(spark, folder, "schools")
    whole = F.lower(F.concat_ws(" ", "name", "official_domain", "directory_url", "status"))
    return rows.where(whole.contains("university")).select("school_id", "status")


SQL["q_search_rows"] = "SELECT school_id, status FROM schools WHERE contains(lower(concat_ws(' ', name, official_domain, directory_url, status)), 'university')"


def q_content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts that were fetched more than once unchanged."""
    pages = table(spark, folder, "fetched_pages").where("text != ''").select("page_id", F.sha2("text", 256).alias("digest"))
    return pages.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


SQL["q_content_hashes"] = "SELECT sha256(text) AS digest, count(*) AS n, min(page_id) AS first_page FROM fetched_pages WHERE text <> '' GROUP BY ALL HAVING count(*) > 1"


def q_longest_title(spark: SparkSession, folder: str) -> DataFrame:
    """Faculty titles by the longest canonical title they contain. The list is a fixed one of 66 entries."""
    listed = [r[0] for r in table(spark, folder, "canonical_titles").select("title").distinct().collect()]
    titles = table(spark, folder, "faculty_records").where("title is not null").groupBy("title").agg(F.count("*").alias("c"))
    return titles.groupBy(matching.longest_phrase(F.col("title"), listed).alias("phrase")).agg(F.sum("c").alias("n"))


SQL["q_longest_title"] = """
WITH t AS (SELECT title, count(*) AS c FROM faculty_records WHERE title IS NOT NULL GROUP BY ALL),
m AS (SELECT t.title, t.c, k.title AS phrase, row_number() OVER (PARTITION BY t.title ORDER BY length(k.title) DESC, k.title) AS rn
FROM t LEFT JOIN (SELECT DISTINCT title FROM canonical_titles) k ON contains(lower(t.title), lower(k.title)))
SELECT coalesce(phrase, '') AS phrase, sum(c)::BIGINT AS n FROM m WHERE rn = 1 GROUP BY ALL"""


def q_best_unit_mail(spark: SparkSession, folder: str) -> DataFrame:
    """For records without a mail address the one of their unit whose local part shares most with the name."""
    rows = table(spark, folder, "faculty_records").select("record_id", "unit_id", "name", F.lower(F.trim("email")).alias("m"))
    people = rows.where("coalesce(m, '') = '' and unit_id is not null").select(F.col("record_id").alias("id"), "unit_id", F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), 1).alias("words"))
    mails = rows.where("m like '%@%' and unit_id is not null").select(F.col("m").alias("item"), "unit_id", F.regexp_extract_all(F.regexp_extract("m", "^([^@]*)@", 1), F.lit("([a-z]+)"), 1).alias("words")).distinct()
    return matching.best_by_shared_words(people, mails, "unit_id").select(F.col("id").alias("record_id"), F.col("item").alias("mail"), "score")


SQL["q_best_unit_mail"] = """
WITH r AS (SELECT record_id, unit_id, name, lower(trim(email, ' ')) AS m FROM faculty_records WHERE unit_id IS NOT NULL),
p AS (SELECT DISTINCT record_id, unit_id, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS w FROM r WHERE coalesce(m, '') = ''),
i AS (SELECT DISTINCT m, unit_id, unnest(regexp_extract_all(regexp_extract(m, '^([^@]*)@', 1), '[a-z]+')) AS w FROM r WHERE m LIKE '%@%'),
s AS (SELECT record_id, m, sum(length(w))::BIGINT AS score FROM p JOIN i USING (unit_id, w) WHERE length(w) >= 4 GROUP BY ALL)
SELECT record_id, m AS mail, score FROM s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, m) = 1"""


def q_directory_links(spark: SparkSession, folder: str) -> DataFrame:
    """Directory records linked to faculty records by address, else by a name that is the only one of its unit."""
    side = lambda name: table(spark, folder, name).select(F.col("record_id").alias("id"), "unit_id", F.coalesce(urls.page_key(F.col("profile_url")), F.lit("")).alias("url"), F.coalesce("name", F.lit("")).alias("name"))
    return matching.linked_rows(side("directory_records"), side("faculty_records"), "unit_id")


SQL["q_directory_links"] = f"""
WITH d AS (SELECT record_id AS id, unit_id, coalesce({_PAGE_KEY.format('profile_url')}, '') AS url, regexp_replace(lower(coalesce(name, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM directory_records),
f AS (SELECT record_id AS id, unit_id, coalesce({_PAGE_KEY.format('profile_url')}, '') AS url, regexp_replace(lower(coalesce(name, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM faculty_records),
u AS (SELECT url, min(id) AS right_id FROM f WHERE url <> '' GROUP BY ALL),
n AS (SELECT unit_id, k, min(id) AS right_id FROM f WHERE k <> '' GROUP BY ALL HAVING count(*) = 1)
SELECT d.id AS left_id, u.right_id, 'url' AS how FROM d JOIN u USING (url)
UNION ALL SELECT d.id, n.right_id, 'name' FROM d JOIN n USING (unit_id, k) WHERE d.url NOT IN (SELECT url FROM u)"""


def q_grounded_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence quotes by whether the page they name has them."""
    rows = table(spark, folder, "candidates").dropDuplicates(["candidate_id"]).select(F.col("candidate_id").alias("id"), F.posexplode("evidence").alias("pos", "e"))
    quotes = rows.select("id", "pos", urls.page_key(F.col("e.source_url")).alias("url"), F.coalesce("e.quote", F.lit("")).alias("quote"))
    pages = table(spark, folder, "fetched_pages").select(urls.page_key(F.col("final_url")).alias("url"), "page_id", "text").where("url != ''")
    pages = pages.groupBy("url").agg(F.max_by("text", "page_id").alias("text"))
    return matching.grounded(quotes, pages).groupBy(F.coalesce(F.col("found").cast("string"), F.lit("no page")).alias("found")).agg(F.count("*").alias("n"))


SQL["q_grounded_evidence"] = f"""
WITH c AS (SELECT DISTINCT candidate_id, evidence FROM candidates),
e AS (SELECT unnest(evidence) AS e FROM c),
q AS (SELECT {_PAGE_KEY.format('e.source_url')} AS url, coalesce(e.quote, '') AS quote FROM e),
p AS (SELECT {_PAGE_KEY.format('final_url')} AS url, last(text ORDER BY page_id) AS text FROM fetched_pages GROUP BY ALL)
SELECT coalesce(CASE WHEN p.text IS NOT NULL THEN contains(lower(regexp_replace(p.text, '\\s+', ' ', 'g')), lower(regexp_replace(trim(quote, ' '), '\\s+', ' ', 'g')))::VARCHAR END, 'no page') AS found, count(*) AS n
FROM q LEFT JOIN p ON p.url = q.url AND p.url <> '' GROUP BY ALL"""


def q_longest_link_text(spark: SparkSession, folder: str) -> DataFrame:
    """For each link target the longest text it is linked with, the first by the alphabet among equal lengths."""
    links = table(spark, folder, "fetched_pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\shref="([^"]*)"[^>]*>([^<]*)</a>'), 0)).alias("a"))
    both = links.select(F.regexp_extract("a", r'\shref="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label"))
    return both.groupBy("href").agg(F.min(F.struct((-F.length("label")).alias("n"), "label")).alias("m"), F.count("*").alias("n_links")).select("href", "m.label", "n_links")


SQL["q_longest_link_text"] = """
WITH a AS (SELECT unnest(regexp_extract_all(html, '<a\\b[^>]*\\shref="[^"]*"[^>]*>[^<]*</a>')) AS a FROM fetched_pages),
b AS (SELECT regexp_extract(a, '\\shref="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM a)
SELECT href, arg_min(label, (-length(label), label)) AS label, count(*) AS n_links FROM b GROUP BY ALL"""


def q_script_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by the number that an embedded script setting holds."""
    pages = table(spark, folder, "fetched_pages").select(F.regexp_extract("html", r"var cfg=\{[^}]*page:(\d+)", 1).alias("n"))
    return pages.where("n != ''").groupBy(F.col("n").cast("int").alias("setting")).agg(F.count("*").alias("n_pages"))


SQL["q_script_settings"] = """
SELECT n::INT AS setting, count(*) AS n_pages FROM (SELECT regexp_extract(html, 'var cfg=\\{[^}]*page:(\\d+)', 1) AS n FROM fetched_pages) WHERE n <> '' GROUP BY ALL"""


def q_rule_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """How many faculty records break each rule a clean export must keep."""
    rows = table(spark, folder, "faculty_records")
    mail = F.lower(F.regexp_replace("email", r"\s+", ""))
    breaks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name"),
            F.when(F.coalesce(mail, F.lit("")) == "", "no mail").when(~mail.rlike(rf"^{emails.ADDRESS}$"), "mail malformed"),
            F.when((urls.host(F.col("profile_url")) != "") & mail.contains("@") & ~urls.within(F.regexp_extract(mail, "@(.*)$", 1), urls.host(F.col("profile_url"))), "mail of another host"),
        )
    )
    return reports.exploded_counts(rows.select(breaks.alias("b")), "b", "rule")


SQL["q_rule_breaks"] = f"""
WITH r AS (SELECT name, lower(regexp_replace(email, '\\s+', '', 'g')) AS m, {_HOST.format('profile_url')} AS h FROM faculty_records),
b AS (SELECT CASE WHEN coalesce(trim(name, ' '), '') = '' THEN 'no name' END AS rule FROM r
UNION ALL SELECT CASE WHEN coalesce(m, '') = '' THEN 'no mail' WHEN NOT regexp_full_match(m, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}') THEN 'mail malformed' END FROM r
UNION ALL SELECT CASE WHEN h <> '' AND contains(m, '@') AND NOT (regexp_extract(m, '@(.*)$', 1) = regexp_replace(h, '^www\\.', '') OR ends_with(regexp_extract(m, '@(.*)$', 1), '.' || regexp_replace(h, '^www\\.', ''))) THEN 'mail of another host' END FROM r)
SELECT rule, count(*) AS n FROM b WHERE rule IS NOT NULL GROUP BY ALL"""


def q_page_people(spark: SparkSession, folder: str) -> DataFrame:
    """People on pages, of the strategy that fits each page."""
    return page_people.chosen_people(page_people.page_people(table(spark, folder, "fetched_pages").where("html != ''")))


def q_daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind, as the stream of the same name counts them."""
    rows = table(spark, folder, "events")
    return rows.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


SQL["q_daily_events"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def all_queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_") and callable(f)}
