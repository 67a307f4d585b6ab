import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import matching, page_people
from vellum.sources import sinks


def test_longest_phrase(spark):
    df = spark.createDataFrame([("Senior Lecturer in X",), ("lecturer",), ("none of it",), (None,)], "t string")
    assert [r[0] for r in df.select(matching.longest_phrase(F.col("t"), ["Lecturer", "Senior Lecturer"])).collect()] == ["Senior Lecturer", "Lecturer", "", ""]


def test_best_by_shared_words(spark):
    people = spark.createDataFrame([(1, 9, ["ada", "lovelace"]), (2, 9, ["bob"]), (3, 8, ["lovelace"]), (4, 9, None)], "id int, u int, words array<string>")
    items = spark.createDataFrame([("lovelace@x", 9, ["lovelace"]), ("ada.lovelace@x", 9, ["ada", "lovelace"]), ("z@x", 9, [])], "item string, u int, words array<string>")
    assert [tuple(r) for r in matching.best_by_shared_words(people, items, "u", least=3).collect()] == [(1, "ada.lovelace@x", 11)]


def test_linked_rows(spark):
    left = spark.createDataFrame([(1, 5, "u1", "A"), (2, 5, "", "B b"), (3, 5, "", "C"), (4, 6, "", "B b")], "id int, g int, url string, name string")
    right = spark.createDataFrame([(10, 5, "u1", "Z"), (11, 5, "u2", "b B".upper()[::-1]), (12, 5, "", "C"), (13, 5, "", "c"), (14, 5, "u1", "Q")], "id int, g int, url string, name string")
    assert {tuple(r) for r in matching.linked_rows(left, right, "g").collect()} == {(1, 10, "url"), (2, 11, "name")}


def test_grounded(spark):
    quotes = spark.createDataFrame([(1, 0, "u", "Ada  Lovelace"), (1, 1, "u", "Bob"), (2, 0, "v", "x")], "id int, pos int, url string, quote string")
    pages = spark.createDataFrame([("u", "Here is ADA\nLovelace.")], "url string, text string")
    assert {(r["id"], r["pos"]): r["found"] for r in matching.grounded(quotes, pages).collect()} == {(1, 0): True, (1, 1): False, (2, 0): None}


PAGE = """<html><body><nav><ul><li>Home, Reader</li></ul></nav>
<table><tr><th>Name</th><th>Position</th><th>E-mail</th></tr><tr><td><a href="/p/ada">Ada Lovelace</a></td><td>Professor</td><td>ada@x.example</td></tr><tr><td>Bob Stone</td><td>Lecturer</td><td></td></tr></table>
<h3>Cleo Frank</h3><p>Senior Researcher</p><p><a href="mailto:cleo@x.example?x=1">mail</a></p><ul><li>Dan Marsh, Reader</li></ul></body></html>"""


def test_page_people(spark):
    df = spark.createDataFrame([(1, PAGE, "https://x.example/staff"), (2, None, None), (3, "", "u")], "page_id int, html string, final_url string")
    found = page_people.page_people(df)
    got = {(r["strategy"], r["name"], r["title"], r["profile_url"], r["email"]) for r in found.collect()}
    assert got == {
        ("table", "Ada Lovelace", "Professor", "https://x.example/p/ada", "ada@x.example"), ("table", "Bob Stone", "Lecturer", "", ""),
        ("card", "Cleo Frank", "Senior Researcher", "", "cleo@x.example"), ("listed", "Dan Marsh", "Reader", "", ""),
    }
    assert {r["name"] for r in page_people.chosen_people(found).collect()} == {"Ada Lovelace", "Bob Stone"}
    assert page_people.next_page('<a class="x" href="?page=2">Next</a>', "https://x.example/staff") == "https://x.example/staff?page=2"
    assert page_people.next_page('<a href="/other">Next</a>', "https://x.example/staff") == "" and page_people.next_page(None, "") == ""


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, b int")
    sinks.write_csv(empty, str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("part*")).strip() == "a,b"
    sinks.write_csv(spark.createDataFrame([("x", 1)], "a string, b int"), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first()["a"] == "x"
    assert json.loads(sinks.summary_json(n=spark.createDataFrame([("é", 1)], "a string, b int"))) == {"n": [{"a": "é", "b": 1}]}
    import gzip

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.html.gz").write_bytes(gzip.compress("<p>ä</p>".encode()))
    (tmp_path / "s" / "b.html").write_bytes(b"<p>x</p>")
    assert {r["html"] for r in sinks.page_snapshots(spark, str(tmp_path / "s")).collect()} == {"<p>ä</p>", "<p>x</p>"}
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"run": "r", "n": 3}')
    assert [tuple(r) for r in sinks.strict_json(spark, str(tmp_path / "j"), schema).collect()] == [("r", 3)]
    (tmp_path / "j" / "2.json").write_text('{"run": "r", "n": 3, "more": 1}')
    with pytest.raises(Exception, match="unexpected fields"):
        sinks.strict_json(spark, str(tmp_path / "j"), schema).collect()


def test_language_is_found_behind_a_long_comment(spark, tmp_path):
    from vellum.plans.queries import q_page_inventory

    pages = spark.read.parquet("/root/testdata/sf0.001/fetched_pages.parquet").where("final_url like 'http%'").limit(1)
    late = F.lit("<!-- " + "x" * 5000 + ' --><html class="a" lang="pt"><body></body></html>')
    pages.withColumn("html", late).write.parquet(str(tmp_path / "fetched_pages.parquet"))
    assert [(r["lang"], r["n_pages"]) for r in q_page_inventory(spark, str(tmp_path)).collect()] == [("pt", 1)]
