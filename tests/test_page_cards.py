from vellum.operators.page_cards import best_way, card_people, people_in

URL = "https://www.uni.example/staff/"


def found(html, way):
    return [p[2:6] for p in people_in(html, URL) if p[0] == way]


def test_cards():
    html = """<div class='team'><h2>Chemistry</h2>
    <div class='person-card'><h3><a href='/people/ada'>Ada Lovelace</a></h3><p>Professor of Engines</p><a href='mailto:Ada@uni.example?x'>write</a></div>
    <div class='person-card'><h3>Charles Babbage</h3><p class='pos'>Senior Lecturer</p><p>charles@uni.example</p></div>
    <div class='person-card'><h3>Latest news</h3><p>Nothing</p></div><nav class='member-menu'><h3>Dora Menu</h3><p>Professor</p></nav></div>"""
    assert found(html, "cards") == [("Ada Lovelace", "Professor of Engines", "https://www.uni.example/people/ada", "ada@uni.example"), ("Charles Babbage", "Senior Lecturer", "", "charles@uni.example")]
    assert {p[6] for p in people_in(html, URL) if p[0] == "cards"} == {"Chemistry"}


def test_accordion_and_details():
    html = "<button aria-controls='p1'>Ada Lovelace</button><div id='p1'><p>Reader in Logic</p><a href='/profile/ada'>more</a></div><details><summary>Charles Babbage</summary><p>Lecturer</p></details><button aria-controls='p9'>No Panel</button>"
    assert found(html, "accordion") == [("Ada Lovelace", "Reader in Logic", "https://www.uni.example/profile/ada", ""), ("Charles Babbage", "Lecturer", "", "")]


def test_teasers_split_names_and_cells():
    assert found("<a href='/p/1'><h3>Ada Lovelace</h3><p>Professor</p></a><a href='/p/2'>Plain Link</a>", "teasers") == [("Ada Lovelace", "Professor", "https://www.uni.example/p/1", "")]
    table = "<table><tr><th>Last name</th><th>First name</th><th>Position</th></tr><tr><td>Lovelace</td><td>Ada</td><td>Professor</td></tr><tr><td></td><td></td><td></td></tr></table>"
    assert found(table, "split") == [("Ada Lovelace", "Professor", "", "")]
    assert found("<table><tr><td>Ada Lovelace, Professor of Logic, +44 20 555 01 ada@uni.example</td></tr></table>", "cell") == [("Ada Lovelace", "Professor of Logic", "", "ada@uni.example")]


def test_data_in_scripts():
    html = """<script>var staff = [{"name": "Ada Lovelace", "jobTitle": "Professor", "url": "/people/ada", "email": "ADA@uni.example"}, {"name": "x"}]; bad = {"a": </script>
    <script type='application/ld+json'>{"@graph": [{"@type": "Person", "name": "Charles Babbage", "jobTitle": "Lecturer"}]}</script>"""
    assert found(html, "script") == [("Ada Lovelace", "Professor", "https://www.uni.example/people/ada", "ada@uni.example"), ("Charles Babbage", "Lecturer", "", "")]


def test_links_to_people():
    html = "<ul><li><a href='/people/ada'>Ada Lovelace</a> Professor</li><li><a href='/people/charles'>Charles Babbage, Lecturer</a></li></ul><p><a href='/faculty/x/mary'>Mary Somerville</a></p><a href='/people/'>All people</a>"
    assert [p[0] for p in found(html, "repeated")] == ["Ada Lovelace", "Charles Babbage"]
    assert [p[:2] for p in found(html, "links")] == [("Ada Lovelace", "Professor"), ("Charles Babbage", "Lecturer"), ("Mary Somerville", "")]


def test_card_people_and_the_best_way(spark):
    cards = "".join(f"<div class='card'><h3>{n}</h3><p>Professor</p></div>" for n in ("Ada Lovelace", "Mary Somerville"))
    links = "<a href='/people/ada'>Ada Lovelace</a>"
    rows = spark.createDataFrame([(1, cards + links, URL, "x"), (2, links, URL, "x"), (3, None, URL, "x"), (4, "", None, "x"), (5, "<div>" * 3000 + links, URL, "x")], "page_id long, html string, final_url string, way string")
    got = card_people(rows)
    best = {(r["page_id"], r["way"], r["name"]) for r in best_way(got).collect()}
    assert best == {(1, "cards", "Ada Lovelace"), (1, "cards", "Mary Somerville"), (2, "links", "Ada Lovelace"), (5, "links", "Ada Lovelace")}
    assert card_people(rows.limit(0)).count() == 0
