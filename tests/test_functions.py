from pyspark.sql import functions as F

from vellum.functions import emails, privacy, text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()[0]


def test_text_keys(spark):
    assert one(spark, "Müller, José", text.ascii_key) == "mullerjose"
    assert one(spark, "Straße", text.ascii_key) == "strasse"
    assert one(spark, "北京大学", text.ascii_key) == ""
    assert one(spark, None, text.ascii_key) is None
    assert one(spark, "O'Brien 2", text.ascii_key) == "obrien2"
    assert one(spark, "  Ada\u00a0 Lovelace\n", text.space) == "Ada Lovelace"
    assert one(spark, "Größe Ü", text.umlaut_key) == "groesseue"
    assert one(spark, None, text.unicode_key) is None
    df = spark.createDataFrame([(None, " ", "x")], "a string, b string, c string")
    assert df.select(text.first_filled(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "x"


def test_url_keys(spark):
    assert one(spark, "HTTPS://Example.EDU/People/Ada/?x=1#top", urls.page_key) == "https://example.edu/People/Ada/?x=1"
    assert one(spark, "https://example.edu/a//", urls.page_key) == "https://example.edu/a"
    assert one(spark, "mailto:a@b.c", urls.page_key) == ""
    assert one(spark, None, urls.page_key) is None
    assert one(spark, "https://example.edu/people/ada?utm_source=t&b=2&a=1&fbclid=x", urls.identity_key) == "https://example.edu/people/ada?a=1&b=2"
    assert one(spark, "https://u:p@Example.edu:8080/x", urls.host) == "example.edu"
    assert one(spark, "https://u:p@h.example/a?token=s&lang=de&flag#f", urls.redacted) == "https://h.example/a?token=<redacted>&lang=de&flag"
    assert one(spark, "/people/123/a/b/c?x=1", urls.href_pattern) == "/people/<id>/a/b"
    df = spark.createDataFrame([("a.b.edu", "b.edu", True), ("xb.edu", "b.edu", False), ("b.edu", "www.b.edu", True), ("b.edu", "", False)], "h string, d string, want boolean")
    assert df.where(urls.within(F.col("h"), F.col("d")) != F.col("want")).count() == 0


def test_mail(spark):
    assert one(spark, "write to Ada [at] phys.uni [dot] example or b@c.example", lambda c: emails.addresses(emails.spelled_out(c))) == ["ada@phys.uni.example", "b@c.example"]
    code = "2a" + "".join(f"{ord(c) ^ 0x2A:02x}" for c in "a@b.example")
    assert emails.unprotected_of(code) == "a@b.example"
    assert emails.unprotected_of("zz") is None and emails.unprotected_of("2a") is None and emails.unprotected_of(None) is None
    parts = one(spark, '<a data-user="ada" class="x" data-domain="u.example">mail</a>', emails.joined_parts)
    assert [tuple(p) for p in parts] == [("ada", "u.example")]


def test_redaction(spark):
    got = one(spark, r"Bearer abc.def token=xyz C:\Users\me\x.txt mail a@b.example", privacy.redacted_text)
    assert got == "Bearer <redacted> token=<redacted> <path> mail <mail>"
    assert one(spark, "\n\n first line <b>x</b>\nsecond", privacy.message) == "first line"
    assert one(spark, None, privacy.redacted_text) is None
