import random

from pyspark.sql import functions as F

from vellum.operators import dedup, graph, html, reports
from vellum.operators.components import connected_components
from vellum.operators.skew import spread_join


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_scan_is_not_first_per_key(spark):
    rows = [(1, "e1", "n1"), (2, "e1", "n2"), (3, "e2", "n2"), (4, None, ""), (5, "", None)]
    got = {r[0]: r[1] for r in dedup.greedy_first(spark.createDataFrame(rows, "id long, e string, n string"), "id", ["e", "n"], "id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_greedy_scan_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["", None, *"abcdefgh"]), rnd.choice(["", *"uvwxyz"])) for i in range(60)]
    taken, want = set(), {}
    for i, a, b in rows:
        ks = {(c, v) for c, v in (("a", a), ("b", b)) if v}
        want[i] = not (ks & taken)
        if want[i]:
            taken |= ks
    got = {r[0]: r[1] for r in dedup.greedy_first(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"], "id").collect()}
    assert got == want


def test_first_and_most_complete(spark):
    rows = spark.createDataFrame([(1, "k", "", None), (2, "k", "n", "t"), (3, "k", "m", "t"), (4, "", "x", "y"), (5, None, "x", "y")], "id long, k string, n string, t string")
    assert [r["id"] for r in dedup.first_per_key(rows, F.col("k"), F.col("id")).collect()] == [1]
    best = dedup.most_complete_per_key(rows.where("k != ''"), F.col("k"), F.col("id"), ["n", "t"]).first()
    assert (best["id"], best["first_at"], best["n_rows"]) == (2, 1, 3)


def test_spread_join(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 990, F.col("id").cast("string")).alias("k"))
    few = spark.createDataFrame([("hot", 1), ("705", 2), ("nobody", 3)], "k string, v int")
    assert spread_join(rows, few, ["k"], "id").count() == 701
    assert spread_join(rows, few, ["k"], "id", how="left").count() == 1000
    assert spread_join(rows, few.select("k"), ["k"], "id", how="left_anti").count() == 299


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("b", None)], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.reachable(links, start, depth=2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.reachable(links, start.limit(0)).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("u", 1, 5.0, None), ("u", 2, -3.0, "h"), ("u", 3, 2.0, None)], "g string, o int, v double, h string")
    assert [r["total"] for r in reports.running_total(rows, "g", ["o"], F.col("v")).orderBy("o").collect()] == [5.0, 5.0, 7.0]
    assert [r["in_effect"] for r in reports.carried(rows, "g", "o", F.col("h"), "in_effect").orderBy("o").collect()] == [None, "h", "h"]
    titles = spark.createDataFrame([("éprofessor",), ("Full Professor",), ("Emeritus professor",), ("",)], "t string")
    got = [r[0] for r in titles.select(reports.first_rule(F.col("t"), [("e", "emeritus"), ("p", "professor")], "none")).collect()]
    assert got == ["none", "p", "e", "none"]


def test_html(spark):
    page = "<html><head><title>T &amp; x</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/a'>A</a></nav><p>Ada <b>Lovelace</b></p><ul><li>Ada Lovelace, Professor</li><li>Søren van der Berg, Reader</li></ul><table><tr><td>x</td></tr></table></body></html>"
    facts = html.page_facts(spark.createDataFrame([(1, page), (2, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert facts[0]["page_title"] == "T & x" and facts[0]["n_links"] == 1 and facts[0]["n_rows"] == 1
    assert facts[0]["visible"].split("\n")[:2] == ["A", "Ada Lovelace"] and facts[1]["visible"] == ""
    people = html.listed_people(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(p["name"], p["title"]) for p in people] == [("Ada Lovelace", "Professor"), ("Søren van der Berg", "Reader")]


def test_components_of_a_star_are_spread(spark):
    from vellum.operators.components import connected_components

    edges = spark.range(1, 400).selectExpr("'hub' as a", "concat('n', id) as b").unionByName(spark.createDataFrame([("x", "y"), ("y", "z"), ("n7", "m")], "a string, b string"))
    for hot in (50, 10_000):
        got = {r["node"]: r["component"] for r in connected_components(edges, hot_rows=hot).collect()}
        assert len(got) == 404 and len(set(got.values())) == 2 and got["hub"] == got["m"] == got["n399"] and got["x"] == got["z"] == "x"


def test_joins_spread_hot_keys_only(spark):
    from vellum.operators.skew import spread_join

    rows = spark.range(1000).selectExpr("id", "case when id < 900 then 'hot' when id < 990 then concat('k', id) end as k", "1 as _salts")
    few = spark.createDataFrame([("hot", 1, 900), ("k950", 2, 1), ("none", 3, 0)], "k string, v int, n long")
    for count in (None, "n"):
        for how, n in (("inner", 901), ("left", 1000), ("left_semi", 901), ("left_anti", 99)):
            got = spread_join(rows.drop("_salts"), few, ["k"], "id", how=how, count=count, hot_rows=100)
            assert got.count() == n and got.select("id").distinct().count() == n
