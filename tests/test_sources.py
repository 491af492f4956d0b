"""File sources, sinks and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import files
from tidewater.streaming.prices import daily_prices


def test_csv_by_schema(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1.5,x\nNaN,y\nzz,z\n")
    df = files.required_csv(spark, str(tmp_path / "p.csv"), "a double, b string", "a test")
    assert [(r.a, r.b) for r in df.orderBy("b").collect()] == [(1.5, "x"), (None, "y"), (None, "z")]
    with pytest.raises(files.MissingInput, match="a test"):
        files.required_csv(spark, str(tmp_path / "none.csv"), "a double", "a test")
    assert files.optional(spark, str(tmp_path / "none.csv"), "a double").count() == 0
    text = files.string_csv(spark, str(tmp_path / "p.csv"))
    assert dict(text.dtypes) == {"a": "string", "b": "string"}


def test_schema_report(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    path = str(tmp_path / "p.csv")
    out = files.schema_report(spark, {"x": (path, {"a"}), "y": (path, {"a", "c"}), "z": (path + ".none", {"a"})})
    assert sorted(map(tuple, out.collect())) == [("x", "OK", ""), ("y", "INVALID", "c"), ("z", "MISSING", "")]


@pytest.mark.parametrize("wrap", [True, False])
def test_field_specs(spark, tmp_path, wrap):
    specs = {"cash_cap": {"required": True, "keywords": ["cap", "cash cap"]}, "deadline": {"required": False}}
    (tmp_path / "s.json").write_text(json.dumps({"fields": specs} if wrap else specs, indent=1))
    out = {r.field_name: r for r in files.field_specs(spark, str(tmp_path / "s.json")).collect()}
    assert out["cash_cap"].keywords == ["cap", "cash cap"] and out["deadline"].required is False


def test_sinks(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") > 3).alias("bad"))
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json_lines(df, str(tmp_path / "j"))
    files.split_sink(df, "bad", str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    assert files.json_lines(spark, str(tmp_path / "j"), "id long, bad boolean").where("bad").count() == 1
    assert spark.read.parquet(str(tmp_path / "s/needs_review")).count() == 1


def test_stream_equals_batch(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = daily_prices(spark, str(tmp_path / "in"), "60 days").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    got = {tuple(r) for r in spark.sql("SELECT event_id, side, price_date, volume FROM daily").collect()}
    q.stop()
    from tidewater.sources.derived import Tables

    want = {(r.event_id, r.side, r.price_date, r.volume) for r in Tables(spark, small).prices.collect()}
    assert got == want


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_loaders_assert_key_and_resolve(spark, tmp_path):
    from tidewater.sources import loaders as L
    from tidewater.sources.files import MissingInput

    deals = write(tmp_path / "deals.csv", "Announce Date,Target Name,Acquirer Name,Deal Status,Code\n2020-02-03,Foo Inc.,Bar & Co,Completed,007\n2020-02-04,Baz,Qux,Pending,\n")
    rows = L.deal_export(spark, deals).orderBy("row_idx").collect()
    assert [(r.match_key, r.outcome_label, r.Code) for r in rows] == [("20200203|foo inc|bar co", "completed", "007"), ("20200204|baz|qux", "", "")]
    with pytest.raises(L.MissingColumns):
        L.deal_export(spark, write(tmp_path / "bad.csv", "Announce Date,Target Name\n"))
    with pytest.raises(MissingInput):
        L.deal_export(spark, str(tmp_path / "none.csv"))
    frame = write(tmp_path / "frame.csv", "event_id,Announce Date,Target Name,Acquirer Name,payment_type\nE1,2020-02-03,Foo,Bar,Cash\nE1,2020-02-03,Later,Bar,Stock\nE2,,X,Y,\n")
    got = {r.event_id: r for r in L.event_frame(spark, frame).collect()}
    assert got["E1"]["Target Name"] == "Foo" and got["E1"].deal_status == "" and got["E1"].payment_type == "Cash" and got["E2"].match_key == "x|y"
    assert L.probability_table(spark, None).count() == 0
    p = L.probability_table(spark, write(tmp_path / "p.csv", "event_id,deal_completed_probability,p_break\n E1 ,0.9,x\nE2,,0.2\n")).orderBy("event_id").collect()
    assert [(r.event_id, r.p_completed, r.p_terminated, r.p_break) for r in p] == [("E1", 0.9, None, None), ("E2", None, None, 0.2)]
    with pytest.raises(L.MissingColumns):
        L.probability_table(spark, write(tmp_path / "q.csv", "id,p_break\n1,0.1\n"))
    with pytest.raises(MissingInput):
        L.probability_table(spark, str(tmp_path / "none.csv"))


def test_tables_of_identifiers(spark, tmp_path):
    from tidewater.sources import loaders as L

    t = L.ticker_table(spark, write(tmp_path / "t.csv", "cik,ticker,matched,score\n12,AAA,true,90\n12,BBB US,yes,91\n13,CCC,true,10\n14,,true,99\n15,DDD,false,99\n"), 84)
    assert {(r.cik, r.ticker) for r in t.collect()} == {("0000000012", "BBB")}
    o = L.cik_overrides(spark, write(tmp_path / "o.csv", "target_name,cik,note\nFoo Inc.,CIK 77,x\nBar,,y\n"))
    assert [tuple(r) for r in o.collect()] == [("foo inc", "0000000077")]
    assert L.cik_overrides(spark, str(tmp_path / "none.csv")).count() == 0
    for i, text in enumerate(('[{"cik_str": 5, "ticker": "A", "title": "Aa"}]', '{"0": {"cik_str": 5, "ticker": "A", "title": "Aa"}, "1": {"cik_str": 6, "ticker": "B", "title": "Bb"}}')):
        assert ("0000000005", "A", "Aa") in {tuple(r) for r in L.company_tickers(spark, write(tmp_path / f"c{i}.json", text)).collect()}
    n = L.name_history(spark, write(tmp_path / "n.csv", "permno,ticker,comnam,ncusip,cusip,namedt,nameenddt\n1,A,Aa,x,y,2000-01-01,\n")).first()
    assert str(n.nameenddt) == "9999-12-31"


def test_exports(spark, tmp_path):
    import json

    from tidewater.sources import exports as E

    df = spark.sql("SELECT 1 AS n, double('NaN') AS x, named_struct('a', double('Infinity'), 'b', array(1.5D, NULL)) AS s, DATE '2020-01-02' AS d")
    E.write_summary(df, str(tmp_path / "summary.json"))
    assert json.loads((tmp_path / "summary.json").read_text()) == {"n": 1, "x": None, "s": {"a": None, "b": [1.5, None]}, "d": "2020-01-02"}
    assert (tmp_path / "summary.csv").read_text().splitlines()[0] == '"n","x","s.a","s.b","d"'
    E.write_markdown(spark, "Results", {"Rows": spark.range(60).selectExpr("id", "id / 3 AS third"), "One": {"k": "a|b"}}, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "| 49 | 16.3333 |" in text and "| 50 |" not in text and "and more" in text and "a\\|b" in text
    assert E.safely(spark, str(tmp_path), "good", lambda: None)["status"] == "ok" and E.safely(spark, str(tmp_path), "bad", lambda: 1 / 0)["status"] == "error"
    assert json.loads((tmp_path / "errors.jsonl").read_text())["layer"] == "bad"
    assert [x["file"] for x in E.write_manifest(spark, str(tmp_path), [("signals", "what to trade")])] == ["errors.jsonl", "r.md", "summary.csv", "summary.json"]
    assert "signals: what to trade" in (tmp_path / "manifest.md").read_text()
