"""More of the engine's operators over whole tables: keys and names, joins with schools, imports, and reports by school."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import limits, names, privacy, text, urls
from vellum.operators import dedup, page_cards, page_people
from vellum.sources.tables import table

SQL: dict[str, str] = {}

_PARTS = """
WITH w AS (SELECT DISTINCT profile_url AS url, regexp_replace(profile_url, '[\\s\\p{Z}\\x{85}]+', '', 'g') AS one FROM faculty_records),
o AS (SELECT url, one, lower(regexp_extract(one, '^((?i)https?://[^/?#\\s]+)', 1)) AS origin, regexp_replace(one, '#.*$', '') AS bare FROM w),
q AS (SELECT url, one, origin, lower(regexp_replace(regexp_replace(regexp_replace(bare, '^\\s*(?i)https?://[^/?#\\s]+', ''), '\\?.*$', ''), '/+$', '')) AS path,
list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND trim(regexp_extract(x, '=(.*)$', 1)) <> ''
AND NOT starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_') AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ('fbclid', 'gclid')) AS pairs FROM o)"""


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def q_record_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Profile addresses by the key of the person's record, with how many spellings and rows each has."""
    rows = table(spark, folder, "faculty_records").select("profile_url")
    keyed = rows.where("profile_url != ''").groupBy("profile_url").agg(F.count("*").alias("n"))
    return keyed.where(urls.record_key(F.col("profile_url")) != "").groupBy(urls.record_key(F.col("profile_url")).alias("record_key")).agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"))


SQL["q_record_keys"] = f"""{_PARTS},
k AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS last, list_filter(pairs, lambda x: lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ({_quoted(urls.NAVIGATION)})) AS kept FROM q WHERE origin <> ''),
n AS (SELECT *, last IN ({_quoted(urls.ENDPOINTS)}) OR contains(lower(one), 'person-detail') OR contains(lower(one), '/persons/')
OR len(list_filter(kept, lambda x: lower(regexp_extract(x, '^([^=]*)', 1)) IN ({_quoted(urls.IDENTITY)}))) > 0
OR (len(list_filter(kept, lambda x: regexp_matches(x, '=[0-9]+$'))) > 0 AND regexp_matches(path, '{"|".join(urls.PROFILE_PATHS)}'))
OR (len(list_filter(kept, lambda x: lower(regexp_extract(x, '^([^=]*)', 1)) = 'id')) > 0 AND regexp_matches(last, '\\.html?$') AND last NOT IN ('index.html', 'index.htm')) AS named FROM k),
r AS (SELECT url, origin || path || CASE WHEN named AND len(kept) > 0 THEN '?' || array_to_string(list_sort(list_transform(kept, lambda x: lower(x))), '&') ELSE '' END AS record_key FROM n)
SELECT record_key, count(DISTINCT url) AS n_spellings, count(*) AS n_rows FROM r JOIN faculty_records f ON f.profile_url = r.url GROUP BY ALL"""


def q_opaque_keys(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys the profile addresses have when the whole query counts, and when everything but the fragment does, by host."""
    url = F.regexp_replace("profile_url", r"(?U)\s+", "")
    rows = table(spark, folder, "faculty_records").where(urls.origin(url) != "").select("profile_url").distinct()
    keyed = rows.select(urls.host(url).alias("host"), urls.opaque_key(url).alias("o"), urls.visit_key(url).alias("v"))
    return keyed.groupBy("host").agg(F.countDistinct("o").alias("n_opaque"), F.countDistinct("v").alias("n_visits"), F.min("o").alias("first_key"))


SQL["q_opaque_keys"] = f"""{_PARTS}
SELECT regexp_extract(origin, '^https?://(?:[^@/]*@)?([^:/]+)', 1) AS host, count(DISTINCT origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform(pairs, lambda x: lower(x))), '&') ELSE '' END) AS n_opaque,
count(DISTINCT lower(regexp_replace(one, '#.*$', ''))) AS n_visits,
min(origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform(pairs, lambda x: lower(x))), '&') ELSE '' END) AS first_key FROM q WHERE origin <> '' GROUP BY ALL"""


def q_coalesced_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per profile key, or per name and title where there is no address: the most complete one, with a mail address
    taken over from the others."""
    rows = table(spark, folder, "faculty_records").select("record_id", "name", "title", "profile_url", "email")
    low = lambda c: F.lower(text.space(F.coalesce(F.col(c), F.lit(""))))
    key = F.when(F.coalesce("profile_url", F.lit("")) != "", F.concat(F.lit("u|"), urls.record_key(F.col("profile_url")))).otherwise(F.concat(F.lit("n|"), low("name"), F.lit("|"), low("title")))
    kept = dedup.coalesced_per_key(rows, key, "record_id", ["name", "title", "profile_url"], "email")
    return kept.select("record_id", "email", "first_at")


_RECORD_KEY_OF_URL = SQL["q_record_keys"].rsplit("SELECT record_key", 1)[0]
SQL["q_coalesced_records"] = f"""{_RECORD_KEY_OF_URL},
b AS (SELECT f.record_id, CASE WHEN coalesce(f.profile_url, '') <> '' THEN 'u|' || coalesce(r.record_key, '') ELSE 'n|' || lower(trim(regexp_replace(coalesce(name, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce(title, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))) END AS k,
(trim(coalesce(name, '')) <> '')::int + (trim(coalesce(title, '')) <> '')::int + (trim(coalesce(f.profile_url, '')) <> '')::int AS n, CASE WHEN trim(coalesce(email, '')) <> '' THEN email ELSE '' END AS m
FROM faculty_records f LEFT JOIN r ON r.url = f.profile_url),
g AS (SELECT k, list({{'o': record_id, 'n': n, 'm': m}} ORDER BY record_id) AS xs, min(record_id) AS first_at FROM b GROUP BY k),
z AS (SELECT first_at, list_reduce(xs, lambda a, x: CASE WHEN x.n + (x.m <> '')::int > a.n + (a.m <> '')::int THEN {{'o': x.o, 'n': x.n, 'm': CASE WHEN x.m <> '' THEN x.m ELSE a.m END}} ELSE {{'o': a.o, 'n': a.n, 'm': CASE WHEN a.m <> '' THEN a.m ELSE x.m END}} END) AS w FROM g)
SELECT w.o AS record_id, w.m AS email, first_at FROM z"""


def q_clean_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names cleaned, with the last name, and whether they look like a person's name or like something else."""
    rows = table(spark, folder, "directory_records").select("name").where(F.length(F.trim("name")) > 0).distinct()
    clean = names.cleaned_name(F.col("name"))
    return rows.select("name", clean.alias("cleaned"), names.last_name(clean).alias("last_name"), names.looks_like_name(clean).alias("is_name"), names.is_non_person(clean).alias("is_other"))


SQL["q_clean_names"] = f"""
WITH a AS (SELECT DISTINCT name, regexp_replace(trim(regexp_replace(name, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')), '\\s+,', ',', 'g') AS one FROM directory_records WHERE length(trim(name)) > 0),
b AS (SELECT name, regexp_replace(regexp_replace(one, '(?i)\\s+(?:Ph\\.?D\\.?|MD|M\\.D\\.|Sc\\.?D\\.?)$', ''), '^[ |,;-]+|[ |,;-]+$', '', 'g') AS cleaned FROM a),
c AS (SELECT *, string_split_regex(trim(cleaned), '\\s+') AS words FROM b)
SELECT name, cleaned, CASE WHEN contains(cleaned, ',') THEN trim(split_part(cleaned, ',', 1)) WHEN len(words) >= 2 THEN words[-1] ELSE '' END AS last_name,
length(cleaned) <= 80 AND len(words) BETWEEN 2 AND 6 AND regexp_matches(cleaned, '[A-Z][a-zA-Z''.-]+') AND NOT list_has_any(list_transform(words, lambda w: regexp_replace(lower(w), '^[.,]+|[.,]+$', '', 'g')), [{_quoted(names.NON_NAME_WORDS)}]) AS is_name,
regexp_matches(lower(cleaned), '\\?|{"|".join(names.NON_PERSON_MARKERS)}') AS is_other FROM c"""


def q_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """Pages against their school's domain by three tests of hosts: the same institution, within, and either within the other."""
    pages = table(spark, folder, "fetched_pages").select("school_id", urls.host(F.col("final_url")).alias("h"))
    schools = table(spark, folder, "schools").select("school_id", urls.without_www(F.col("official_domain")).alias("d"))
    tested = pages.groupBy("school_id", "h").agg(F.count("*").alias("n")).join(schools, "school_id").where("d != '' and h != ''")
    root = urls.institution(F.col("h"))
    return tested.groupBy(root.alias("institution"), (root == urls.institution(F.col("d"))).alias("same"), urls.within(F.col("h"), F.col("d")).alias("within"), urls.related(F.col("h"), F.col("d")).alias("related")).agg(F.sum("n").alias("n_pages"))


def _institution_sql(host: str) -> str:
    labels = f"list_filter(string_split(regexp_replace(lower({host}), ':.*$', ''), '.'), lambda x: x <> '')"
    return f"array_to_string({labels}[(CASE WHEN len({labels}) >= 3 AND length({labels}[-1]) = 2 AND {labels}[-2] IN ({_quoted(urls.SECOND_LEVEL)}) THEN -3 ELSE -2 END):], '.')"


SQL["q_institutions"] = f"""
WITH t AS (SELECT regexp_extract(lower(regexp_extract(final_url, '^\\s*((?i)https?://[^/?#\\s]+)', 1)), '^https?://(?:[^@/]*@)?([^:/]+)', 1) AS h,
regexp_replace(regexp_replace(regexp_replace(lower(trim(official_domain)), '^\\.+', ''), '\\.+$', ''), '^www\\.', '') AS d FROM fetched_pages JOIN schools USING (school_id)),
u AS (SELECT *, {_institution_sql("h")} AS institution, {_institution_sql("d")} AS other, h = d OR ends_with(h, '.' || d) AS within FROM t WHERE h <> '' AND d <> '')
SELECT institution, institution = other AS same, within, within OR regexp_replace(h, '^www\\.', '') = d OR ends_with(d, '.' || regexp_replace(h, '^www\\.', '')) AS related, count(*) AS n_pages FROM u GROUP BY ALL"""


def q_url_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses by whether they may be fetched: not those with credentials, secrets in the query, or no host."""
    rows = table(spark, folder, "faculty_records").select(F.col("profile_url").alias("u")).where(F.coalesce("u", F.lit("")) != "").groupBy("u").agg(F.count("*").alias("n"))
    keys = F.transform(urls.query_pairs(F.col("u")), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    state = F.when(urls.origin(F.col("u")) == "", "invalid").when(F.col("u").rlike("^\\s*(?i)https?://[^/?#\\s]*@"), "credentials").when(F.exists(keys, privacy.is_sensitive_key), "secret").otherwise("valid")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n_addresses"), F.sum("n").alias("n_rows"))


_SENSITIVE = f"""list_has_any(string_split(regexp_replace(regexp_replace(lower(regexp_replace({{0}}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '_'), [{_quoted(privacy.SENSITIVE_SEGMENTS)}]) OR regexp_matches(regexp_replace(lower({{0}}), '[^a-z0-9]+', '_', 'g'), '(?:api|private)_?key_*$')"""
SQL["q_url_prefilter"] = f"""
WITH u AS (SELECT profile_url AS u, count(*) AS n FROM faculty_records WHERE coalesce(profile_url, '') <> '' GROUP BY ALL),
k AS (SELECT *, list_transform(list_filter(string_split(regexp_extract(regexp_replace(u, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> ''), lambda x: regexp_extract(x, '^([^=]*)', 1)) AS keys FROM u),
s AS (SELECT n, CASE WHEN regexp_extract(u, '^\\s*((?i)https?://[^/?#\\s]+)', 1) = '' THEN 'invalid' WHEN regexp_matches(u, '^\\s*(?i)https?://[^/?#\\s]*@') THEN 'credentials'
WHEN len(list_filter(keys, lambda x: {_SENSITIVE.format("x")})) > 0 THEN 'secret' ELSE 'valid' END AS state FROM k)
SELECT state, count(*) AS n_addresses, sum(n)::bigint AS n_rows FROM s GROUP BY ALL"""


def q_direct_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses to fetch, each once under its key at its first row, with the school named after the host."""
    rows = table(spark, folder, "fetched_pages").select("page_id", "requested_url")
    key = urls.page_key(F.col("requested_url"))
    first = dedup.first_per_key(rows, key, F.col("page_id"))
    return first.select("page_id", key.alias("url"), F.regexp_replace(urls.host(F.col("requested_url")), r"^www\.", "").alias("school"))


SQL["q_direct_tasks"] = """
WITH k AS (SELECT page_id, requested_url AS u, lower(regexp_extract(requested_url, '^\\s*((?i)https?://[^/?#\\s]+)', 1)) AS o FROM fetched_pages),
p AS (SELECT page_id, o, CASE WHEN o = '' THEN '' ELSE o || regexp_replace(regexp_replace(regexp_replace(trim(u), '^\\s*(?i)https?://[^/?#\\s]+', ''), '#.*$', ''), '/+$', '') END AS url FROM k)
SELECT min(page_id) AS page_id, url, regexp_replace(regexp_extract(any_value(o), '^https?://(?:[^@/]*@)?([^:/]+)', 1), '^www\\.', '') AS school FROM p WHERE url <> '' GROUP BY url"""


def q_imported_history(spark: SparkSession, folder: str) -> DataFrame:
    """Directory people as a history import leaves them: the first row for five keys, without those already on record."""
    key = lambda c: F.lower(text.space(F.coalesce(F.col(c), F.lit(""))))
    five = lambda df: df.select("record_id", "school_id", "unit_id", key("name").alias("name"), text.mail_key(F.coalesce("email", F.lit(""))).alias("email"), urls.page_key(F.coalesce("profile_url", F.lit(""))).alias("homepage"))
    keys = ["school_id", "unit_id", "name", "email", "homepage"]
    new = five(table(spark, folder, "directory_records")).groupBy(*keys).agg(F.min("record_id").alias("record_id"))
    known = five(table(spark, folder, "faculty_records")).select(*keys).distinct()
    return new.join(known, keys, "left_anti").groupBy("school_id").agg(F.count("*").alias("n_new"), F.min("record_id").alias("first_id"))


_FIVE = """SELECT record_id, school_id, unit_id, lower(trim(regexp_replace(coalesce(name, ''), '[\\s\\p{Z}\\x{85}]+', ' ', 'g'))) AS name, lower(trim(coalesce(email, ''))) AS email, %s AS homepage FROM %s"""
_PAGE_KEY = """CASE WHEN regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1) = '' THEN '' ELSE lower(regexp_extract({0}, '^\\s*((?i)https?://[^/?#\\s]+)', 1)) || regexp_replace(regexp_replace(regexp_replace(trim({0}), '^\\s*(?i)https?://[^/?#\\s]+', ''), '#.*$', ''), '/+$', '') END""".format("coalesce(profile_url, '')")
SQL["q_imported_history"] = f"""
WITH d AS ({_FIVE % (_PAGE_KEY, "directory_records")}), f AS ({_FIVE % (_PAGE_KEY, "faculty_records")}),
n AS (SELECT school_id, unit_id, name, email, homepage, min(record_id) AS record_id FROM d GROUP BY ALL)
SELECT school_id, count(*) AS n_new, min(record_id) AS first_id FROM n ANTI JOIN f USING (school_id, unit_id, name, email, homepage) GROUP BY ALL"""


def q_imported_schools(spark: SparkSession, folder: str) -> DataFrame:
    """Schools as an import of processed ones leaves them: under each normalized name the last row."""
    rows = table(spark, folder, "schools").select("school_id", F.lower(text.space(F.col("name"))).alias("school"), "status")
    return rows.groupBy("school").agg(F.max_by("status", "school_id").alias("status"), F.max("school_id").alias("school_id"))


SQL["q_imported_schools"] = """
SELECT lower(trim(regexp_replace(name, '[\\s\\p{Z}]+', ' ', 'g'))) AS school, arg_max(status, school_id) AS status, max(school_id) AS school_id FROM schools GROUP BY 1"""


def q_candidate_schools(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with their school's name, counted by the official domain's use: an inner join on the school."""
    schools = table(spark, folder, "schools").select("school_id", F.trim("name").alias("school"), "official_domain")
    rows = table(spark, folder, "candidates").select("school_id", "candidate_id", F.lower(F.trim("email")).alias("email")).join(schools, "school_id")
    official = urls.within(F.substring_index("email", "@", -1), urls.without_www(F.col("official_domain")))
    return rows.groupBy("school_id", "school").agg(F.countDistinct("candidate_id").alias("n_candidates"), F.countDistinct(F.when(official, F.col("candidate_id"))).alias("n_official"))


SQL["q_candidate_schools"] = """
WITH r AS (SELECT school_id, trim(s.name) AS school, candidate_id, regexp_extract(lower(trim(email)), '([^@]*)$', 1) AS h, regexp_replace(regexp_replace(regexp_replace(lower(trim(official_domain)), '^\\.+', ''), '\\.+$', ''), '^www\\.', '') AS d FROM candidates JOIN schools s USING (school_id))
SELECT school_id, school, count(DISTINCT candidate_id) AS n_candidates, count(DISTINCT CASE WHEN d <> '' AND (h = d OR ends_with(h, '.' || d)) THEN candidate_id END) AS n_official FROM r GROUP BY ALL"""


def q_source_states(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by school, status of the response, attempts, whether there is text, and whether anything was clicked."""
    schools = table(spark, folder, "schools").select("school_id", F.trim("name").alias("school"))
    pages = table(spark, folder, "fetched_pages").select("school_id", "http_status", "fetch_attempts", (F.length("text") > 0).alias("has_text"), (F.size("dynamic_actions") > 0).alias("was_dynamic"))
    counted = pages.groupBy(*pages.columns).agg(F.count("*").alias("n_pages"))
    return counted.join(schools, "school_id").select("school", "http_status", "fetch_attempts", "has_text", "was_dynamic", "n_pages").groupBy("school", "http_status", "fetch_attempts", "has_text", "was_dynamic").agg(F.sum("n_pages").alias("n_pages"))


SQL["q_source_states"] = """
SELECT trim(s.name) AS school, http_status, fetch_attempts, length(text) > 0 AS has_text, len(dynamic_actions) > 0 AS was_dynamic, count(*) AS n_pages FROM fetched_pages JOIN schools s USING (school_id) GROUP BY ALL"""


def q_review_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why candidates need a review, by school, with the place of each reason among the school's: more first, then by name."""
    rows = table(spark, folder, "candidates").select("school_id", F.explode("failure_reasons").alias("reason"))
    counted = rows.groupBy("school_id", "reason").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("school_id").orderBy(F.desc("n"), "reason")))


SQL["q_review_reasons"] = """
WITH r AS (SELECT school_id, unnest(failure_reasons) AS reason FROM candidates), c AS (SELECT school_id, reason, count(*) AS n FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY n DESC, reason) AS place FROM c"""


def q_processed_schools(spark: SparkSession, folder: str) -> DataFrame:
    """Schools, and whether a completed one of the same normalized name says that they needn't be visited again."""
    rows = table(spark, folder, "schools").select("school_id", "status", F.lower(text.space(F.col("name"))).alias("k"))
    done = rows.where("status = 'completed'").groupBy("k").agg(F.min("school_id").alias("done_by"))
    out = rows.join(done, "k", "left")
    return out.select("school_id", F.when(F.col("done_by").isNotNull(), "skipped_processed").otherwise(F.col("status")).alias("state"), "done_by")


SQL["q_processed_schools"] = """
WITH r AS (SELECT school_id, status, lower(trim(regexp_replace(name, '[\\s\\p{Z}]+', ' ', 'g'))) AS k FROM schools), d AS (SELECT k, min(school_id) AS done_by FROM r WHERE status = 'completed' GROUP BY k)
SELECT school_id, CASE WHEN done_by IS NOT NULL THEN 'skipped_processed' ELSE status END AS state, done_by FROM r LEFT JOIN d USING (k)"""


def q_added_records(spark: SparkSession, folder: str) -> DataFrame:
    """Directory records, and those faculty records whose address the directory hasn't got: an anti-join and a union."""
    directory, faculty = (table(spark, folder, n).select("school_id", "record_id", urls.page_key(F.coalesce("profile_url", F.lit(""))).alias("k")) for n in ("directory_records", "faculty_records"))
    added = faculty.join(directory.select("k").where("k != ''").distinct(), "k", "left_anti")
    both = directory.withColumn("src", F.lit("directory")).unionByName(added.withColumn("src", F.lit("added")))
    return both.groupBy("school_id", "src").agg(F.count("*").alias("n_records"))


SQL["q_added_records"] = f"""
WITH d AS (SELECT school_id, {_PAGE_KEY} AS k FROM directory_records), f AS (SELECT school_id, {_PAGE_KEY} AS k FROM faculty_records)
SELECT school_id, 'directory' AS src, count(*) AS n_records FROM d GROUP BY ALL UNION ALL
SELECT school_id, 'added', count(*) FROM f WHERE k = '' OR k NOT IN (SELECT k FROM d) GROUP BY ALL"""


def q_unchanged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Faculty records that the directory has in the same five columns, by school: a semi-join on a fingerprint."""
    five = ["school_id", "unit_id", "name", "title", "profile_url"]
    known = table(spark, folder, "directory_records").select(*five).distinct()
    return table(spark, folder, "faculty_records").join(known, five, "left_semi").groupBy("school_id").agg(F.count("*").alias("n_unchanged"))


SQL["q_unchanged_records"] = """
SELECT school_id, count(*) AS n_unchanged FROM faculty_records SEMI JOIN directory_records USING (school_id, unit_id, name, title, profile_url) GROUP BY ALL"""


def q_repeated_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose pattern occurs at least twice on their page, by pattern: a semi-join with what the page repeats."""
    links = table(spark, folder, "fetched_pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\shref="([^"]*)"'), 1)).alias("href")).withColumn("pattern", urls.href_pattern(F.col("href")))
    repeated = links.groupBy("page_id", "pattern").agg(F.count("*").alias("n")).where("n >= 2")
    return repeated.groupBy("pattern").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_links"))


SQL["q_repeated_patterns"] = """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*\\shref="([^"]*)"', 1)) AS href FROM fetched_pages),
p AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(href, '[?#].*$', ''), '\\d+', '<id>', 'g'), '^((?:https?://[^/]+)?(?:/[^/]*){0,4})', 1) AS pattern, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 2)
SELECT pattern, count(*) AS n_pages, sum(n)::bigint AS n_links FROM p GROUP BY ALL"""


def q_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Per school: whether a missing mail address is the commonest reason, whether most fetches failed, and both counts."""
    reasons = table(spark, folder, "candidates").select("school_id", F.explode("failure_reasons").alias("reason")).groupBy("school_id", "reason").agg(F.count("*").alias("n"))
    top = reasons.groupBy("school_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "reason")).alias("t")).select("school_id", F.col("t.reason").alias("top_reason"))
    failed = (F.coalesce("http_status", F.lit(0)) == 0) | (F.col("http_status") >= 400)
    pages = table(spark, folder, "fetched_pages").groupBy("school_id").agg(F.count_if(failed).alias("n_failed"), F.count("*").alias("n_pages"))
    out = pages.join(top, "school_id", "left")
    return out.select("school_id", "top_reason", "n_failed", "n_pages", (F.col("n_failed") * 2 >= F.col("n_pages")).alias("mostly_failed"), F.coalesce(F.col("top_reason").contains("email"), F.lit(False)).alias("mail_missing"))


SQL["q_signals"] = """
WITH r AS (SELECT school_id, unnest(failure_reasons) AS reason FROM candidates), c AS (SELECT school_id, reason, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT school_id, arg_min(reason, (-n, reason)) AS top_reason FROM c GROUP BY ALL),
p AS (SELECT school_id, count(*) FILTER (coalesce(http_status, 0) = 0 OR http_status >= 400) AS n_failed, count(*) AS n_pages FROM fetched_pages GROUP BY ALL)
SELECT school_id, top_reason, n_failed, n_pages, n_failed * 2 >= n_pages AS mostly_failed, coalesce(contains(top_reason, 'email'), false) AS mail_missing FROM p LEFT JOIN t USING (school_id)"""


def q_linked_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct profile addresses of each school, with the first twenty as samples; the rest of them only count."""
    rows = table(spark, folder, "faculty_records").select("school_id", urls.record_key(F.coalesce("profile_url", F.lit(""))).alias("k")).where("k != ''").distinct()
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("school_id").orderBy("k")))
    sample = F.array_join(F.array_sort(F.collect_list(F.when(F.col("at") <= 20, F.col("k")))), "\n")
    return numbered.groupBy("school_id").agg(F.count("*").alias("n_profiles"), sample.alias("samples"))


SQL["q_linked_sources"] = f"""{_RECORD_KEY_OF_URL},
d AS (SELECT DISTINCT school_id, record_key AS k FROM r JOIN faculty_records f ON f.profile_url = r.url WHERE record_key <> ''), m AS (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY k) AS pos FROM d)
SELECT school_id, count(*) AS n_profiles, string_agg(k, chr(10) ORDER BY k) FILTER (pos <= 20) AS samples FROM m GROUP BY ALL"""


def q_pending_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred newest candidates with an open reason, by time and then by id."""
    rows = table(spark, folder, "candidates").where(F.size("failure_reasons") > 0).groupBy("candidate_id", "school_id", "created_at").agg(F.first(F.array_join("failure_reasons", ";")).alias("reasons"))
    return rows.orderBy(F.desc("created_at"), F.desc("candidate_id")).limit(100).select("candidate_id", "school_id", "reasons")


SQL["q_pending_reviews"] = """
SELECT candidate_id, school_id, reasons FROM (SELECT DISTINCT candidate_id, school_id, created_at, array_to_string(failure_reasons, ';') AS reasons FROM candidates WHERE len(failure_reasons) > 0) ORDER BY created_at DESC, candidate_id DESC LIMIT 100"""


def q_schools_in_review(spark: SparkSession, folder: str) -> DataFrame:
    """Schools with an open candidate, once each, with their status where it is one of those asked for."""
    open_ = table(spark, folder, "candidates").where(F.size("failure_reasons") > 0).select("school_id").distinct()
    return table(spark, folder, "schools").where(F.col("status").isin("review", "crawling", "failed")).join(open_, "school_id", "left_semi").select("school_id", "status")


SQL["q_schools_in_review"] = "SELECT school_id, status FROM schools WHERE status IN ('review', 'crawling', 'failed') AND school_id IN (SELECT school_id FROM candidates WHERE len(failure_reasons) > 0)"


def q_run_view(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their schools by status, how many want attention, and the time of the last change, numbered newest first."""
    rows = table(spark, folder, "schools")
    runs = rows.groupBy("task_id").agg(
        F.count("*").alias("n_schools"),
        F.count_if(F.col("status") == "completed").alias("n_completed"),
        F.count_if(F.col("status").isin("review", "failed", "pending")).alias("n_attention"),
        F.countDistinct("status").alias("n_states"),
        F.max("updated_at").alias("last"),
    )
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last"), "task_id"))).drop("last")


SQL["q_run_view"] = """
SELECT task_id, count(*) AS n_schools, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status IN ('review', 'failed', 'pending')) AS n_attention, count(DISTINCT status) AS n_states, row_number() OVER (ORDER BY max(updated_at) DESC, task_id) AS place FROM schools GROUP BY task_id"""


def q_retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches that may be tried again: how long to wait, twice as long each time and at least as long as the fetch took."""
    pages = table(spark, folder, "fetched_pages").where("coalesce(http_status, 0) = 0 or http_status = 429 or http_status >= 500")
    asked = F.when(F.col("http_status") == 429, F.format_string("%d", F.ceil(F.col("fetch_duration_ms") / 1000)))
    delay = limits.retry_delay(F.col("fetch_attempts"), asked)
    return pages.groupBy("fetch_attempts", F.coalesce(delay.cast("bigint"), F.lit(-1)).alias("delay")).agg(F.count("*").alias("n_pages"))


SQL["q_retry_delays"] = """
SELECT fetch_attempts, coalesce(CASE WHEN fetch_attempts < 3 THEN greatest(pow(2, fetch_attempts), CASE WHEN http_status = 429 THEN ceil(fetch_duration_ms / 1000.0) ELSE 0 END)::bigint END, -1) AS delay, count(*) AS n_pages
FROM fetched_pages WHERE coalesce(http_status, 0) = 0 OR http_status = 429 OR http_status >= 500 GROUP BY ALL"""


def q_request_costs(spark: SparkSession, folder: str) -> DataFrame:
    """What a request for each document may cost, by source, in millionths of the price's unit."""
    rows = table(spark, folder, "documents").select("source", limits.request_cost(F.length("text"), 5, 30, 4000).cast("bigint").alias("c"))
    return rows.groupBy("source").agg(F.sum("c").alias("cost"), F.max("c").alias("dearest"))


SQL["q_request_costs"] = "SELECT source, sum((greatest(1, length(text) // 4) * 5 + 120000))::bigint AS cost, max(greatest(1, length(text) // 4) * 5 + 120000)::bigint AS dearest FROM documents GROUP BY ALL"


def q_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Where the excerpt of 600 characters of each document starts that has the first mention of a professor near its beginning."""
    rows = table(spark, folder, "documents").where("text != ''")
    return rows.select("doc_id", limits.excerpt_start(F.col("text"), F.lit("Professor"), 600, 100).cast("bigint").alias("start_at"), F.length(F.col("text").substr(limits.excerpt_start(F.col("text"), F.lit("Professor"), 600, 100) + 1, F.lit(600))).alias("n_chars"))


SQL["q_excerpts"] = """
WITH a AS (SELECT doc_id, length(text) AS n, strpos(lower(text), 'professor') - 1 AS pos FROM documents WHERE text <> ''),
b AS (SELECT doc_id, n, CASE WHEN n <= 600 OR pos < 0 THEN 0 ELSE greatest(least(n, greatest(pos - 100, 0) + 600) - 600, 0) END AS start_at FROM a)
SELECT doc_id, start_at::bigint AS start_at, least(600, n - start_at)::int AS n_chars FROM b"""


def q_evidence_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct valid addresses of each candidate's evidence in their order, one per line."""
    rows = table(spark, folder, "candidates").select("candidate_id", F.transform("evidence", lambda e: urls.page_key(e["source_url"])).alias("us")).distinct()
    return rows.select("candidate_id", F.array_join(F.array_distinct(F.filter("us", lambda u: u != "")), "\n").alias("addresses"))


SQL["q_evidence_addresses"] = f"""
WITH c AS (SELECT DISTINCT candidate_id, list_transform(evidence, lambda e: e.source_url) AS us FROM candidates),
e AS (SELECT candidate_id, unnest(us) AS profile_url, generate_subscripts(us, 1) AS pos FROM c),
k AS (SELECT candidate_id, {_PAGE_KEY} AS u, min(pos) AS pos FROM e GROUP BY ALL)
SELECT c.candidate_id, coalesce(string_agg(u, chr(10) ORDER BY pos) FILTER (u <> ''), '') AS addresses FROM c LEFT JOIN k USING (candidate_id) GROUP BY ALL"""


def q_first_seen_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent titles; of equally frequent ones the one seen first."""
    rows = table(spark, folder, "faculty_records").where("title != ''")
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(20)


SQL["q_first_seen_titles"] = "SELECT title, count(*) AS n, min(record_id) AS first_id FROM faculty_records WHERE title <> '' GROUP BY ALL ORDER BY n DESC, first_id LIMIT 20"


def q_host_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of pages under a digest that doesn't show them."""
    rows = table(spark, folder, "fetched_pages").select(urls.host(F.col("final_url")).alias("h")).where("h != ''")
    return rows.groupBy(F.sha2(F.concat_ws("|", F.lit("host"), "h"), 256).alias("digest")).agg(F.count("*").alias("n_pages"))


SQL["q_host_digests"] = """
SELECT sha256('host|' || h) AS digest, count(*) AS n_pages FROM (SELECT regexp_extract(lower(regexp_extract(final_url, '^\\s*((?i)https?://[^/?#\\s]+)', 1)), '^https?://(?:[^@/]*@)?([^:/]+)', 1) AS h FROM fetched_pages) WHERE h <> '' GROUP BY ALL"""


def q_card_people(spark: SparkSession, folder: str) -> DataFrame:
    """People on pages by the way they are found: the most certain of cards, accordions and the like, and each of the plain ones."""
    pages = table(spark, folder, "fetched_pages").select("page_id", "final_url", "html").where("html != ''")
    others = page_people.page_people(pages).select("page_id", F.concat(F.lit("plain "), "strategy").alias("way"), F.col("ordinal").alias("place"), "name", "title", "profile_url", "email", F.lit("").alias("section"))
    return page_cards.best_way(page_cards.card_people(pages)).unionByName(others).groupBy("way").agg(F.countDistinct("page_id").alias("n_pages"), F.count("*").alias("n_people"))


def all_queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_") and callable(f)}
