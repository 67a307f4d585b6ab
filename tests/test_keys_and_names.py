from pyspark.sql import functions as F

from vellum.functions import limits, names, privacy, urls
from vellum.operators import dedup


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(column(F.col("x"))).collect()]


def test_record_keys(spark):
    same = ["https://example.edu/person/?member=AAA&utm_source=news&fbclid=one", "https://example.edu/person/?gclid=two&member=AAA", " https://example.edu/person?member=aaa#top"]
    assert set(values(spark, urls.record_key, same)) == {"https://example.edu/person?member=aaa"}
    cases = {
        "https://example.edu/person/?page=2&department=psychology": "https://example.edu/person", "https://example.edu/people/ada-lovelace": "https://example.edu/people/ada-lovelace",
        "https://example.edu/news?item=x": "https://example.edu/news", "https://example.edu/staff/view.php?no=17": "https://example.edu/staff/view.php?no=17",
        "https://example.edu/x.html?id=ab": "https://example.edu/x.html?id=ab", "https://example.edu/index.html?id=ab": "https://example.edu/index.html", "mailto:x": "", None: None,
    }
    got = values(spark, urls.record_key, cases)
    assert [g or None for g in got] == [c or None for c in cases.values()]
    assert values(spark, urls.opaque_key, ["https://A.edu/X/?b=2&a=&utm_x=1&C=3", "https://a.edu"]) == ["https://a.edu/x?b=2&c=3", "https://a.edu/"]


def test_hosts(spark):
    assert values(spark, urls.institution, ["www.cs.example.edu", "a.b.example.ac.uk:80", "example.edu", "x"]) == ["example.edu", "example.ac.uk", "example.edu", "x"]
    assert values(spark, urls.without_www, [" .WWW.Example.edu. ", "https://www.example.edu/a"]) == ["example.edu", "example.edu"]


def test_names(spark):
    assert values(spark, names.cleaned_name, ["  Ada   Lovelace , Grace Ph.D.", "Ada Lovelace MD", "- Ada |"]) == ["Ada Lovelace, Grace", "Ada Lovelace", "Ada"]
    assert values(spark, names.last_name, ["Lovelace, Ada", "Ada King Lovelace", "Ada"]) == ["Lovelace", "Lovelace", ""]
    assert values(spark, lambda c: names.without_roles(c, ["Professor", "University Lecturer"]), ["Ada Professor Lovelace, University Lecturer Professor", "Ada"]) == ["Ada Professor Lovelace", "Ada"]
    assert values(spark, names.looks_like_name, ["Ada Lovelace", "Contact us", "ada lovelace", "Ada", None]) == [True, False, False, False, False]
    assert values(spark, names.normal_title, ["Full  Professor", "Ｐｒｏｆ", "a  b", None]) == ["Full Professor", "Prof", "a b", None]
    assert values(spark, names.name_tokens, ["Prof. Jürgen Müller"]) == [[["juergen", "jurgen"], ["mueller", "muller"]]]
    assert values(spark, lambda c: names.eligible_mail(c, F.lit("www.uni.example")), ["ada@cs.uni.example", "info@uni.example", "ada@other.example"]) == [True, False, False]


def test_sensitive_keys_and_limits(spark):
    assert values(spark, privacy.is_sensitive_key, ["accessToken", "session-id", "apiKey", "page", "design", "X-Auth"]) == [True, True, True, False, False, True]
    rows = spark.createDataFrame([(1, None), (1, "10"), (2, "1"), (3, "5"), (1, "soon")], "n int, after string")
    assert [r[0] for r in rows.select(limits.retry_delay(F.col("n"), F.col("after"))).collect()] == [2.0, 10.0, 4.0, None, 2.0]
    text = "x" * 50 + " Ada " + "y" * 50
    assert values(spark, lambda c: limits.excerpt(c, F.lit("ada"), 20, 5), [text, "short"]) == [text[46:66], "short"]


def test_coalesced_rows_equal_a_scan(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.choice("abcd"), rnd.choice(["N", "", None]), rnd.choice(["T", " "]), rnd.choice(["u", None]), rnd.choice([f"m{i}", "", None])) for i in range(200)]
    filled = lambda x: bool((x or "").strip())
    kept = {}
    for r in rows:
        old = kept.get(r[1])
        if old is None:
            kept[r[1]] = [r, r[5] if filled(r[5]) else ""]
            continue
        score = lambda row, mail: sum(map(filled, row[2:5])) + filled(mail)
        new = r if score(r, r[5]) > score(old[0], old[1]) else old[0]
        mail = (r[5] if new is r and filled(r[5]) else "") or old[1] or (r[5] if filled(r[5]) else "")
        kept[r[1]] = [new, mail]
    df = spark.createDataFrame(rows, "id int, k string, name string, title string, url string, mail string")
    got = {r["k"]: (r["id"], r["mail"]) for r in dedup.coalesced_per_key(df, F.col("k"), "id", ["name", "title", "url"], "mail").collect()}
    assert got == {k: (r[0], m) for k, (r, m) in kept.items()}
