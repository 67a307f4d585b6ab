import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from vellum.llm.canonical_titles import deletes, entries_of_values, weighted_distance
from vellum.llm.format_duplicates import format_duplicates
from vellum.llm.name_variants import Trie, people, same_person_pairs

ENTRIES = [(1, "Professor"), (2, "Associate Professor"), (4, "Senior Lecturer"), (5, "Lecturer"), (7, "Reader"), (11, "Professor of Practice"), (12, "Research Professor"), (37, "Außerplanmäßiger Professor"), (42, "Maître de conférences"), (56, "教授"), (57, "副教授"), (52, "Доцент")]


def brute_key(url, mail):
    def bare(v):
        v = re.sub(r"\s+", "", (v or "").lower())
        return re.sub(r"""^[.,;:!?'"`()<>\[\]{}|/\\#&]+|[.,;:!?'"`()<>\[\]{}|/\\#&]+$""", "", v)

    url, mail = bare(url), bare(mail)
    base, _, query = url.partition("?")
    base = re.sub(r"(?<!:)/{2,}", "/", base).rstrip("/")
    return base, tuple(sorted(x for x in query.split("&") if x)), mail


def test_format_duplicates_against_brute_force(spark):
    rnd = random.Random(1)
    urls = ["https://a.example/p?id=1&v=2", "https://A.example//p/?v=2&id=1&", " <https://a.example/p?v=2&id=1>", "https://a.example/p?id=1&v=3", "https://a.example/q/.", "https://a.example/q", "", None]
    mails = ["x@a.example", "X@a.example ;", "(x @ a.example)", "y@a.example", "", None]
    rows = [(i, rnd.choice(urls), rnd.choice(mails), "extra") for i in range(1, 300)] + [(7, "https://a.example/q", "x@a.example", "extra")]
    want = {}
    for i, u, m, _ in rows:
        k = brute_key(u, m)
        if k != ("", (), ""):
            want.setdefault(k, set()).add(i)
    pairs = {(min(s), i) for s in want.values() for i in s if i != min(s)}
    df = spark.createDataFrame(rows, "record_id long, profile_url string, email string, _fp string")
    got = {(r["keep_id"], r["record_id"]) for r in format_duplicates(df).collect()}
    assert {p for p in got if 7 not in p} == {p for p in pairs if 7 not in p}
    assert format_duplicates(df.limit(0)).count() == 0


def test_hot_group_of_copies(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("record_id"), F.lit("https://a.example/x?b=1&a=2").alias("profile_url"), F.lit(None).cast("string").alias("email"))
    got = format_duplicates(df, hot_rows=700)  # spread over eight tasks
    assert got.count() == 4999 and got.select("keep_id").distinct().count() == 1


def test_records_under_one_fingerprint_stay_apart(spark, monkeypatch):
    from vellum.llm import format_duplicates as module

    one = F.struct(*(F.lit(0).cast("bigint").alias(h) for h in module.FINGERPRINT))
    monkeypatch.setattr(module, "multiset_fingerprint", lambda pairs: one)
    rows = [(i, f"https://a.example/{i % 3}", None) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "record_id long, profile_url string, email string")
    got = {tuple(r) for r in module.format_duplicates(df, hot_rows=4).collect()}
    assert got == {(next(k for k in (1, 2, 3) if k % 3 == i % 3), i) for i in range(4, 31)}


def test_symmetric_deletes_find_every_near_string():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(120)]

    def distance(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    trie = Trie(sorted(set(words)))
    for a in words[:40]:
        near = dict(trie.near(a, 2))
        for b in set(words):
            n = distance(a, b)
            if n <= 2:
                assert deletes(a, 2) & deletes(b, 2)
            if b != a:
                assert (b in near) == (n <= 2) and (b not in near or near[b] == n)
    assert weighted_distance("abc", "abc") == 0 and weighted_distance("abc", "acb") == 0.8 and weighted_distance("xbc", "abc") == 1.5


def test_entries_of_values(spark):
    want = {
        "Assoc. Prof.": 2, "PROFESSOR, ASSOCIATE OF NUMISMATICS": 2, "snr lecturer / Hydrology": 4, "Lecturer (full time)": 5, "Lecturrer": 5, "Professor & Programme Lead": 1, "Prof. Services Partner": 0, "Reader Services Clerk": 0,
        "Assistant to the Professor": 0, "Professor (Research)": 12, "Practice Professor": 11, "Au?erplanm??iger Professor": 37, "apl. Prof.": 37, "MCF": 42, "MaÃ®tre de confÃ©rences": 42, "副 教授(博导)": 57, "教授": 56, "доц.": 52, "Prоfеssor": 1, "n/a": 0, "---": 0, "Professor_of_Practice": 11,
    }
    values = spark.createDataFrame([(v,) for v in [*want, "", "  ", None, "MCF"]], "value string")
    entries = spark.createDataFrame(ENTRIES, "title_id long, title string")
    further = spark.createDataFrame([("Außerplanmäßiger Professor", "apl prof"), ("Maître de conférences", "mcf"), ("Professor of Practice", "practice professor"), ("Доцент", "доц"), ("nobody", "x")], "title string, name string")
    got = {r["value"]: r["title_id"] for r in entries_of_values(values, entries, further=further).collect()}
    assert got == want
    assert entries_of_values(values.limit(0), entries).count() == 0


def test_any_reference_list_and_long_names(spark):
    long = "International Institute for the Advancement of Comparative Hydrology and Applied Lacustrine Archaeology of Norrhaven"
    entries = spark.createDataFrame([(1, long), (2, "Saint Petersburg"), (3, "Newhaven")], "title_id long, title string")
    values = spark.createDataFrame([(long.replace("Lacustrine", "Lacustrin"),), ("Sankt-Peterburg",), ("saint petersbrug",), ("Nwehaven",), ("Oldhaven",)], "value string")
    further = spark.createDataFrame([("Saint Petersburg", "Sankt Peterburg")], "title string, name string")
    got = {r["value"]: r["title_id"] for r in entries_of_values(values, entries, further=further).collect()}
    assert list(got.values()).count(0) == 1 and got["Oldhaven"] == 0 and got["saint petersbrug"] == got["Sankt-Peterburg"] == 2 and got["Nwehaven"] == 3


def test_people(spark):
    names = ["Rebecca Hurverberger", "HURVERBERGER Becky", "Hurverberger, R.", "Prof. Dr. Rebeca Hurverbreger", "Petra Hurverberger", "Рита Холданзин", "Rita Kholdanzin", "Samuel van der Mosk", "S. Mosk", "Ｒｅｂｅｃｃａ　Ｈｕｒｖｅｒｂｅｒｇｅｒ", "", None]
    filler = [(9, 1000 + i, f"{g} Other{c}son") for i, (g, c) in enumerate((g, c) for g in ("Rebecca", "Petra", "Rita", "Samuel") for c in "abcdefgh")]
    filler += [(u, 2000 + u * 10 + i, f"{g} Elsewhere") for u in (10, 11, 12) for i, g in enumerate(("Rebecca", "Petra", "Rita", "Samuel"))]
    rows = [(1, i + 1, n) for i, n in enumerate(names)] + filler + [(2, 500, "Rebecca Hurverberger")]
    df = spark.createDataFrame(rows, "unit_id long, record_id long, name string")
    groups = {}
    for r in people(df).where("unit_id = 1").collect():
        groups.setdefault(r["person"], set()).add(r["record_id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 10], [5], [6, 7], [8, 9]]
    pairs = {tuple(r) for r in same_person_pairs(df).where("id_a < 100").collect()}
    assert pairs == set(combinations([1, 2, 3, 4, 10], 2)) | {(6, 7), (8, 9)}
    assert people(df.limit(0)).count() == 0


def people_of_unit(spark, names):
    rows = [(1, i, n) for i, n in enumerate(names)]
    groups = {}
    for r in people(spark.createDataFrame(rows, "unit_id long, record_id long, name string")).collect():
        groups.setdefault(r["person"], set()).add(names[r["record_id"]])
    return sorted(map(sorted, groups.values()))


def test_token_orders_and_short_surnames(spark):
    # no token is a common given name: the permuted order is a reading, checked by both written-out names
    assert people_of_unit(spark, ["Zorvath Quillume", "Quillume Zorvath", "Quillume Zorvat", "Quillume Brandis"]) == [["Quillume Brandis"], ["Quillume Zorvat", "Quillume Zorvath", "Zorvath Quillume"]]
    assert people_of_unit(spark, ["Lin Wang", "Lin Wagn", "Lara Wong"]) == [["Lara Wong"], ["Lin Wagn", "Lin Wang"]]
    # both ends of a long surname differ
    assert people_of_unit(spark, ["A. Holvermand", "A. Bolvermann"]) == [["A. Bolvermann", "A. Holvermand"]]


def test_large_shards_are_walked_in_blocks(monkeypatch):
    from vellum.llm.name_variants import shard_links

    names = ["".join(x) for x in __import__("itertools").product("ab", "cd", "ef", "gh", "ij")]
    whole = {frozenset(x) for x in shard_links([(n, n, False, "", True) for n in names])}
    parts = {frozenset(x) for k in range(3) for x in shard_links([(n, n, False, "", hash(n) % 3 == k) for n in names])}
    assert whole == parts and len(whole) == 32 * 5 // 2


def test_every_neighbour_is_linked(spark):
    # both typing errors are one edit from a reading that no row has, and two from each other
    assert people_of_unit(spark, ["A. Voskar-Branik", "A. Voskor", "A. Voksar"]) == [["A. Voksar", "A. Voskar-Branik", "A. Voskor"]]
    # a typing error as near to a namesake with more rows as to its own person stays with both
    assert people_of_unit(spark, ["A. Tolmarek", "A. Tolmerik", "A. Tolmarik", "A. Tolmirik", "B. Tolmarek"]) == [["A. Tolmarek", "A. Tolmarik", "A. Tolmerik", "A. Tolmirik"], ["B. Tolmarek"]]
