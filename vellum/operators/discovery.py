"""Finding further pages: links that are labelled as directories, walks with bounds, and links worth following for a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.names import name_tokens
from vellum.functions.text import ascii_key, space
from vellum.functions.urls import host, institution, page_key, record_key, within
from vellum.session import cut_lineage

# What labels and paths of directories and of research units contain, and labels of lists that aren't meant.
DIRECTORY_LABELS = ("academic staff", "faculty", "mitarbeiter", "mitarbeiterseiten", "people", "personale docente", "personal docente", "professors", "researchers", "scientific staff", "staff", "team", "wissenschaftliches personal")
DIRECTORY_PATHS = ("/academic", "/directory", "/faculty", "/mitarbeiter", "/people", "/personal", "/professor", "/researcher", "/staff", "/team")
UNIT_LABELS = ("arbeitsgruppe", "center for", "centre for", "forschungszentrum", "institute for", "laboratory", "research center", "research centre", "research group")
UNIT_PATHS = ("/center", "/centre", "/group", "/institut", "/lab", "/research", "/zentrum")
LEFT_OUT = ("administrative", "administration", "emerit", "retired", "support", "technical")
# Labels and paths of pages that may have a person's address.
FOLLOW_LABELS = ("contact", "contacts", "email", "e-mail", "homepage", "person", "personal page", "profile", "publications", "publication", "research portal", "staff page", "web page")
FOLLOW_PATHS = ("/people/", "/person/", "/profile/", "/profiles/", "/staff/", "/team/", "/research/", "/researchers/", "/publications/", "/publication/", "/repository/")
_FILES = r"\.(?:jpg|jpeg|png|gif|zip|doc|docx|xlsx)$"


def _any(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike("|".join(w.replace(".", r"\.") for w in words))


def _path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))


def linked_sources(links: DataFrame, most: int = 12) -> DataFrame:
    """``page, url, kind, place``: the first ``most`` links of each page that are labelled as a directory or research unit.

    ``links`` has ``page, pos, url, label, domain``: absolute addresses in page order with their text, and the official domain.
    A link counts if it stays with the institution, is another page, doesn't cross into another department's part of the
    site, and its label and path both say what it is; of several links to one address the first counts. Null labels are empty.
    """
    label = F.lower(space(F.coalesce("label", F.lit(""))))
    path = _path(F.col("url"))
    department = lambda p: F.regexp_extract(p, r"/departments/([^/]+)", 1)
    here, there = department(_path(F.col("page"))), department(path)
    unit = (_any(label, UNIT_LABELS) & _any(path, UNIT_PATHS)) | label.startswith("ag ")
    fit = ~_any(label, LEFT_OUT)
    kind = F.when(label.contains("research portal") | label.contains("forschungsportal"), "research_portal").when(unit, F.when(fit, "research_unit")).when(fit & _any(label, DIRECTORY_LABELS) & _any(path, DIRECTORY_PATHS), "faculty_directory")
    same = institution(host(F.col("url"))) == institution(F.col("domain"))
    kept = links.where(same & (record_key(F.col("url")) != record_key(F.col("page"))) & ((here == "") | (there == "") | (here == there)))
    kept = kept.select("page", "pos", "url", record_key(F.col("url")).alias("k"), kind.alias("kind")).where("kind is not null and k != ''")
    first = kept.groupBy("page", "k").agg(F.min(F.struct("pos", "url", "kind")).alias("x"))
    ranked = first.select("page", "x.url", "x.kind", F.row_number().over(Window.partitionBy("page").orderBy("x.pos")).alias("place"))
    return ranked.where(F.col("place") <= most)


def bounded_walk(links: DataFrame, starts: DataFrame, domain: str, depth: int = 2, most_pages: int = 50) -> tuple[DataFrame, str]:
    """Pages within ``depth`` steps of the starts on the domain, at most ``most_pages``, and why the walk ended.

    ``links`` has ``src, pos, dst``, ``starts`` has ``url, pos``. Pages come in the order in which a queue would find them:
    by level, then by the page they were found on, then by their place there. The result has ``url, depth, place``; the
    reason is empty, ``depth_limit_reached``, or ``page_budget_reached``, which goes before the other. The walk is one join
    a level over at most ``most_pages`` pages, whatever the size of the link table.
    """
    key = lambda c: page_key(F.col(c))
    on_domain = lambda c: within(host(F.col(c)), F.lit(domain))
    edges = links.where(on_domain("dst")).select(key("src").alias("src"), "pos", key("dst").alias("url")).where("url != ''")
    found = starts.where(on_domain("url")).select(key("url").alias("url"), F.lit(0).alias("from"), "pos").where("url != ''")
    seen, reason, n = None, "", 0
    for level in range(depth + 2):
        new = found.groupBy("url").agg(F.min(F.struct("from", "pos")).alias("x"))
        if seen is not None:
            new = new.join(F.broadcast(seen.select("url")), "url", "left_anti")  # at most ``most_pages`` rows
        if level > depth:
            if not reason and not new.isEmpty():
                reason = "depth_limit_reached"
            break
        ranked = cut_lineage(new.orderBy("x.from", "x.pos", "url").limit(most_pages - n + 1).select("url", (F.row_number().over(Window.orderBy("x.from", "x.pos", "url")) + n).alias("place")))
        if ranked.where(F.col("place") > most_pages).count():
            reason = "page_budget_reached"
        front = ranked.where(F.col("place") <= most_pages).withColumn("depth", F.lit(level))
        added = front.count()
        seen = front if seen is None else cut_lineage(seen.unionByName(front))
        n += added
        if not added or reason:
            break
        found = edges.join(F.broadcast(front.select(F.col("url").alias("src"), F.col("place").alias("from"))), "src").select("url", "from", "pos")
    return seen.select("url", "depth", "place"), reason


def ranked_followups(links: DataFrame, people: DataFrame, most: int = 3) -> DataFrame:
    """``id, url, score, place``: for each person the links of their page most likely to lead to a page about them.

    ``links`` has ``page, url, label``, ``people`` has ``id, page, name, domain``. A word of the name in label or path counts
    six, the whole name eight, a word of such links three, a path of such pages two, a document one. Only links on the
    domain count, not the page itself, files, or links with neither a name nor both words. Ties go by the address.
    """
    told = people.select("id", "page", "domain", name_tokens(F.col("name")).alias("_t"), ascii_key(F.col("name")).alias("_n"))
    both = links.withColumn("url", F.regexp_replace("url", "#.*$", "")).where("url is not null").join(told, "page")
    path, label = _path(F.col("url")), F.lower(space(F.coalesce("label", F.lit(""))))
    both = both.where(within(host(F.col("url")), F.col("domain")) & (page_key(F.col("url")) != page_key(F.col("page"))) & ~path.rlike(_FILES))
    hay = ascii_key(F.concat_ws(" ", F.coalesce("label", F.lit("")), path))
    both = both.select("id", "url", label.alias("_l"), path.alias("_p"), hay.alias("_h"), "_t", "_n")
    hits = F.size(F.filter("_t", lambda forms: F.exists(forms, lambda w: F.col("_h").contains(w))))
    whole = (F.col("_n") != "") & F.col("_h").contains(F.col("_n"))
    word, place = _any(F.col("_l"), FOLLOW_LABELS), _any(F.col("_p"), FOLLOW_PATHS)
    score = hits * 6 + F.when(whole, 8).otherwise(0) + F.when(word, 3).otherwise(0) + F.when(place, 2).otherwise(0) + F.when(F.col("_p").endswith(".pdf"), 1).otherwise(0)
    best = both.where((hits > 0) | whole | (word & place)).groupBy("id", "url").agg(F.max(score).alias("score"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "url")))
    return ranked.where(F.col("place") <= most)


def only_official_mail(found: DataFrame) -> DataFrame:
    """``id, mail``: the one eligible address of a person's own page, for names that a Latin address can't be compared with.

    ``found`` has ``id, name, mail, on_own_page``: eligible addresses of pages, and whether the page is about the person.
    """
    one = found.where("mail is not null").groupBy("id").agg(F.countDistinct("mail").alias("n"), F.min("mail").alias("mail"), F.first("name").alias("name"), F.min("on_own_page").alias("own"))
    return one.where((F.col("n") == 1) & F.col("own") & F.col("name").rlike(r"[^\x00-\x7f]") & ~F.substring_index("mail", "@", 1).rlike(r"[^\x00-\x7f]")).select("id", "mail")
