import os

import pytest

from vellum.operators import discovery
from vellum.sources import sinks

PAGE = "https://www.uni.example/departments/law/staff"


def test_linked_sources(spark):
    rows = [
        (1, "https://www.uni.example/departments/law/people", "Our People"), (2, "https://www.uni.example/departments/law/people#b", "People again"), (3, "https://www.uni.example/departments/art/people", "People"),
        (4, "https://www.uni.example/support/staff", "Support staff"), (5, "https://lab.uni.example/research/x", "Research group X"), (6, "https://other.example/people", "People"), (7, PAGE + "/", "Staff"), (8, "https://www.uni.example/news", "Staff"),
        (9, "https://portal.uni.example/", "Research portal"), (10, "https://www.uni.example/team", None),
    ]
    links = spark.createDataFrame([(PAGE, *r, "uni.example") for r in rows], "page string, pos int, url string, label string, domain string")
    got = [tuple(r) for r in discovery.linked_sources(links).orderBy("place").select("url", "kind").collect()]
    assert got == [(rows[0][1], "faculty_directory"), (rows[4][1], "research_unit"), (rows[8][1], "research_portal")]
    assert discovery.linked_sources(links, 1).count() == 1 and discovery.linked_sources(links.limit(0)).count() == 0


def test_bounded_walk(spark):
    u = lambda x: f"https://uni.example/{x}"
    edges = [(u("a"), 1, u("b")), (u("a"), 2, u("c")), (u("b"), 1, u("d")), (u("c"), 1, u("a")), (u("d"), 1, u("e")), (u("a"), 3, "https://else.example/x")]
    links = spark.createDataFrame(edges, "src string, pos int, dst string")
    starts = spark.createDataFrame([(u("a"), 1), (u("a") + "/#x", 2)], "url string, pos int")
    got, reason = discovery.bounded_walk(links, starts, "uni.example")
    assert [(r["url"][-1], r["depth"]) for r in got.orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and reason == "depth_limit_reached"
    got, reason = discovery.bounded_walk(links, starts, "uni.example", 5, 2)
    assert [r["url"][-1] for r in got.orderBy("place").collect()] == ["a", "b"] and reason == "page_budget_reached"
    assert discovery.bounded_walk(links, starts, "uni.example", 5)[1] == ""


def test_followups_and_the_only_mail(spark):
    links = spark.createDataFrame([(PAGE, "https://uni.example/people/ada-lovelace", "Ada Lovelace"), (PAGE, "https://uni.example/x#y", "Contact"), (PAGE, "https://uni.example/profile/77", "Profile"), (PAGE, "https://uni.example/ada.jpg", "Ada"), (PAGE, "https://else.example/ada", "Ada Lovelace"), (PAGE, None, None)], "page string, url string, label string")
    people = spark.createDataFrame([(1, PAGE, "Ada Lovelace", "uni.example")], "id int, page string, name string, domain string")
    assert [(r["url"], r["score"]) for r in discovery.ranked_followups(links, people).orderBy("place").collect()] == [("https://uni.example/people/ada-lovelace", 22), ("https://uni.example/profile/77", 5)]
    found = spark.createDataFrame([(1, "Ада Кинг", "aking@uni.example", True), (2, "Ada King", "ak@uni.example", True), (3, "Ада", "a@x", True), (3, "Ада", "b@x", True), (4, "Ада", None, True)], "id int, name string, mail string, on_own_page boolean")
    assert [tuple(r) for r in discovery.only_official_mail(found).collect()] == [(1, "aking@uni.example")]


def test_snapshots_names_and_stale_reports(spark, tmp_path):
    pages = spark.createDataFrame([("<p>a</p>",), ("<p>a</p>",), (None,), ("",), ("<p>ü</p>",)], "html string")
    for _ in range(2):
        written = {r["digest"] for r in sinks.write_snapshots(pages, str(tmp_path / "s")).collect()}
    assert written == {sinks.digest_of("<p>a</p>"), sinks.digest_of("<p>ü</p>")} == {f[:64] for f in os.listdir(tmp_path / "s")}
    assert {r["html"] for r in sinks.page_snapshots(spark, str(tmp_path / "s")).collect()} == {"<p>a</p>", "<p>ü</p>"}
    with pytest.raises(Exception, match="more than 3"):
        sinks.write_snapshots(pages, str(tmp_path / "t"), most_bytes=3).collect()
    assert sinks.report_names(["https://www.a.example/x/People", "https://a.example/people", "https://a.example", "no"]) == ["a.example_People.xlsx", "a.example_people_2.xlsx", "a.example_result.xlsx", "result_no.xlsx"]
    assert sinks.file_name("con.txt") == "_con.txt" and sinks.file_name(' a<b>:c. ') == "a_b_c" and sinks.file_name("...") == "result"
    path = str(tmp_path / "r" / "x.csv")
    assert sinks.write_or_remove(pages, path, lambda rows, p: sinks.write_text(p, str(rows.count()))) == path and open(path).read() == "5"
    assert sinks.write_or_remove(pages.limit(0), path, None) is None and not os.path.exists(path)
