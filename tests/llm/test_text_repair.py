import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.llm.lookalikes import canonical_forms, stored_differently
from vellum.llm.mojibake import garbled_values, restore, suspicious

WORDS = ["Maître de conférences", "Außerplanmäßiger Professor", "Öğretim görevlisi", "教授助理研究员", "リサーチフェロー", "Старший преподаватель", "أستاذ مشارك", "Lecturer – Epigraphy"]


@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp850"])
@pytest.mark.parametrize("text", WORDS)
def test_utf8_read_otherwise_comes_back(text, reader):
    from vellum.llm.mojibake import _byte_table

    garbled = "".join(_byte_table(reader)[b] for b in text.encode())
    bad, back, lost = restore(garbled, True)
    assert bad
    if reader in ("cp1252", "latin-1", "mac_roman"):
        assert back == text and not lost


@pytest.mark.parametrize("text", ["שלום לכולם", "हिन्दी विभाग", "ქართული", "Հայերեն", "fine 😀 day", "𠀀𠀁", "Ελληνικά", "Кафедра"])
@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "cp866", "koi8_r", "mac_roman"])
def test_other_scripts_and_four_byte_characters(text, reader):
    from vellum.llm.mojibake import _byte_table

    garbled = "".join(_byte_table(reader)[b] for b in text.encode())
    assert restore(garbled)[:2] == (True, text)


def test_many_layers_and_other_single_byte_readers():
    text = "Catedrático"
    for _ in range(5):
        text = text.encode().decode("latin-1")
    assert restore(text)[1] == "Catedrático"
    assert [restore("conférences".encode("cp1252").decode(r))[:2] for r in ("cp1251", "mac_roman", "cp850")] == [(True, "conférences")] * 3
    assert [restore(t, True)[0] for t in ("Дoцeнт", "Prоfessоr", "McÉwan 3D-модель", "Gestionnaire de scolarit?", "IT-отдел")] == [False, False, False, True, False]
    assert restore("ภาควิชา".encode("cp874").decode("latin-1"), True)[:2] == (True, "ภาควิชา")
    assert restore("國立臺灣大學".encode("big5").decode("latin-1"), True)[:2] == (True, "國立臺灣大學")


def test_legacy_encodings_and_losses():
    assert restore("副教授".encode("gbk").decode("latin-1"), True)[:2] == (True, "副教授")
    assert restore("Доцент".encode("cp1251").decode("latin-1"), True)[:2] == (True, "Доцент")
    assert restore("Catedr�tico", True)[2] and restore("Ma?tre de conf?rences", True)[0]
    assert restore("CatedrÃƒÂ¡tico", True)[1] == "Catedrático"


@pytest.mark.parametrize("text", ["Straße, Müller & Söhne", "« Qui ? » demanda-t-elle", "¿Quién? «Nada.»", "Привет, мир — «да»", "你好，世界。", "See index.php?id=4 now", "Why now?!", "AGREGAÇÃO", "L’été — naïve", "", None])
def test_right_text_stays(text):
    assert restore(text) == (False, text, False)


def test_mixed_text_only_loses_the_garbled_span():
    assert restore("Müller and SchÃ¶n – “ok”")[1] == "Müller and Schön – “ok”"


def test_prefilter_lets_every_case_through(spark):
    cases = [w.encode().decode(r, "ignore") for w in WORDS for r in ("cp1252", "latin-1", "mac_roman", "cp1251")] + ["Catedr�tico", "conf?rences"]
    bad = [c for c in cases if restore(c, True)[0]]
    df = spark.createDataFrame([(c,) for c in bad], "t string")
    assert df.where(suspicious(F.col("t"))).count() == len(bad)
    rows = spark.createDataFrame([(1, "CatedrÃ¡tico", "x"), (1, "CatedrÃ¡tico", "x"), (2, None, "y"), (3, "", "z"), (4, "fine", "row_id")], "id long, t string, row_id string")
    assert [tuple(r) for r in garbled_values(rows, "id", "t", True).distinct().collect()] == [(1, "Catedrático", False)]
    assert garbled_values(rows.limit(0), "id", "t").count() == 0


def test_prefilter_passes_each_garbled_form_of_each_title(spark):
    from vellum.llm.mojibake import LEGACY_WRITERS, WRONG_READERS, _byte_table

    titles = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/canonical_titles.parquet").select("title").collect()] + WORDS
    cases = {"璁插笀", "涓撲换璁插笀", "鞐瓣惮甑愳垬", "MaĂ®tre de confĂ©rences", "CatedrĂˇtico", "Professor??"}
    for t in titles:
        cases |= {"".join(_byte_table(r)[b] for b in t.encode()) for r in WRONG_READERS}
        cases |= {"".join(_byte_table(r)[b] for b in t.encode(w, "ignore")) for w in LEGACY_WRITERS for r in ("latin-1", "cp1252")}
        cases |= {t.encode().decode("gb18030", "ignore")}
        cases |= {t.encode(w, "ignore").decode(r, "ignore") for w, r in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"))}
    bad = {c for c in cases if restore(c, True)[0]}
    assert {"璁插笀", "涓撲换璁插笀", "鞐瓣惮甑愳垬", "MaĂ®tre de confĂ©rences", "CatedrĂˇtico", "Professor??"} <= bad
    df = spark.createDataFrame([(c,) for c in bad], "t string")
    assert bad - {r[0] for r in df.where(suspicious(F.col("t"))).collect()} == set()


def test_canonical_forms(spark):
    pairs = {
        "Ｐｒｏｆ．": "Prof.", "𝐃ean": "Dean", "ﬁeld": "field", "José": "José", "Pro​fessor": "Professor", "Senior Fellow": "Senior Fellow",
        "Jun.‐Prof": "Jun.-Prof", "Prоfеssor": "Professor", "Ρrofessor": "Professor", "q̣̇": "q̣̇", "ạ̇": "ạ̇", "ﾘｻｰﾁ": "リサーチ",
    }
    same = ["Müller", "Доцент", "Prof. Глеб Ярмалин", "Staff – Room", "教授", "Ελλάδα"]
    df = spark.createDataFrame([(x,) for x in [*pairs, *same, "plain", "", None]], "value string")
    got = {r["value"]: r["canonical"] for r in canonical_forms(df).collect()}
    assert {k: got[k] for k in pairs} == pairs
    assert {k: got[k] for k in same} == {k: k for k in same}
    assert "plain" not in got and all(unicodedata.normalize("NFC", v) == v for v in got.values())


def test_stored_differently(spark):
    rows = spark.createDataFrame([(1, "Dean​", None), (2, "Dean", "ﬁne"), (2, "Dean", "ﬁne"), (3, "x y", "")], "record_id long, name string, title string")
    leave = spark.createDataFrame([("name", "x y")], "field_name string, value string")
    got = {(r["record_id"], r["field_name"]) for r in stored_differently(rows, "record_id", ["name", "title"], leave).collect()}
    assert got == {(1, "name"), (2, "title")}
