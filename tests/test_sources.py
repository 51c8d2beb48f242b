"""Landing-file readers, sinks, text functions and keyed stream writes on small files."""

import json

from pyspark.sql import functions as F

from vegaflow.functions import text
from vegaflow.plans.text import chunks
from vegaflow.sources import landing, sinks
from vegaflow.streaming.bars import completeness, drain, latest_rows, upsert_batches


def contract(ticker, kind, strike, iv=0.2, exp="2024-01-19", **more):
    return {"details": {"ticker": ticker, "contract_type": kind, "expiration_date": exp, "strike_price": strike}, "greeks": {"delta": 0.5}, "implied_volatility": iv, **more}


def test_chain_pages(spark, tmp_path):
    a, b = [contract("O:SPXW240119C", "call", 100.0, open_interest=5), contract("O:SPX240119C", "call", 100.0)], [contract("O:SPXW240119C", "call", 100.0, iv=0.9), contract("O:AAPL240119P", "put", 90.0, exp="broken", last_quote={"bid": 1.0, "ask": 2.0})]
    (tmp_path / "p0.json").write_text(json.dumps({"results": a, "page": 0}))
    (tmp_path / "p1.json").write_text(json.dumps({"results": b, "page": 1, "partial": True}))
    c = landing.chain_pages(spark, str(tmp_path))
    rows = {(r.root_symbol, r.strike): r for r in c.collect()}
    assert len(rows) == 3 and all(r.partial for r in rows.values())
    assert rows[("SPXW", 100.0)].implied_volatility == 0.2 and rows[("SPXW", 100.0)].open_interest == 5 and rows[("SPX", 100.0)].volume == 0
    assert rows[("AAPL", 90.0)].expiration_date is None and rows[("AAPL", 90.0)].mark == 1.5
    assert {r.root_symbol for r in landing.prefer_root(c).collect()} == {"SPXW", "AAPL"}


def test_bars_lines_and_roster(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "X", "results": [{"t": 1705615200000, "o": 1, "h": 2, "l": 1, "c": 2}, {"t": 1705615200000, "o": 0, "h": 2, "l": 1, "c": 2}]}))
    r = landing.daily_bars(spark, str(tmp_path / "b.json")).collect()
    assert len(r) == 1 and str(r[0].trading_date) == "2024-01-18"
    (tmp_path / "n.ndjson").write_text('{"d":"1","v":1}\nbroken\n{"d":"2","v":2}\n{"d":"1","v":3}\n')
    assert sorted((x.d, x.v) for x in landing.last_lines(spark, str(tmp_path / "n.ndjson"), "d string, v int", "d").collect()) == [("1", 3), ("2", 2)]
    (tmp_path / "r.csv").write_text('symbol,name,sector,volume\nA,"Alpha, Inc",Tech,5\n')
    assert landing.roster(spark, str(tmp_path / "r.csv")).first().name == "Alpha, Inc"


def test_feeds_and_embedded_json(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><item><title><![CDATA[Fed &amp; rates]]></title><date>d1</date></item>\n<item><title>CPI</title></item></rss>")
    r = landing.feed_items(spark, str(tmp_path / "f.xml"), "item", {"title": "title", "day": "date"}).orderBy("place").collect()
    assert [(x.title, x.day) for x in r] == [("Fed & rates", "d1"), ("CPI", None)]
    (tmp_path / "p.html").write_text('<script>x = {days: [{"date": "2024-01-02", "events": [{"title": "a]b", "impact": "high"}]}, {"date": "2024-01-03", "events": []}], other: [1]}</script>')
    d = landing.embedded_days(spark, str(tmp_path / "p.html")).collect()
    assert [x.date for x in d] == ["2024-01-02", "2024-01-03"] and d[0].events[0].title == "a]b"
    s = landing.seeded(spark.createDataFrame([("A",), ("B",)], "symbol string"))
    assert s.collect() == s.collect() and s.where("seed between 0 and 1 and mode = 'seed'").count() == 2


def test_text_functions(spark):
    d = spark.createDataFrame([('```json\n{"headline": "Up — again", "body": "b", "severity": 7}\n```',), ("no json",)], "s string")
    r = [x[0] for x in d.select(text.narrative(F.col("s"))).collect()]
    assert r[0].headline == "Up - again" and r[0].severity == 3 and r[1] is None
    n = spark.createDataFrame([(1234.0,), (-2.5e6,), (3.2e9,), (7.0,)], "x double").select(text.si_format(F.col("x"))).collect()
    assert [x[0] for x in n] == ["1.2K", "-2.5M", "3.2B", "7.0"]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.upsert(spark, p, one, ["k"], 0)
    two = sinks.upsert(spark, p, spark.createDataFrame([(2, "c"), (3, None)], "k int, v string"), ["k"], 1)
    assert sorted(map(tuple, two.fillna("-").collect())) == [(1, "a"), (2, "c"), (3, "-")]
    header = spark.createDataFrame([(1, "success"), (2, "partial")], "run_id int, status string")
    c = spark.createDataFrame([(1, "2024-01-02", 5), (2, "2024-01-02", 6)], "run_id int, trading_date string, strike int")
    sinks.write_run(header, c, header.select("run_id"), p)
    assert spark.read.parquet(f"{p}/contracts").count() == 1 and spark.read.parquet(f"{p}/runs").count() == 2
    d = spark.sql("SELECT date'2024-01-01' AS d UNION ALL SELECT date'2024-01-09'")
    assert sinks.expire(d, "d", "2024-01-10", 7).count() == 1 and sinks.expire(d, "d", "2024-01-10", 0).count() == 2


def test_keyed_stream_writes_and_completeness(spark, tmp_path, sf):
    src = tmp_path / "in"
    src.mkdir()
    schema = "k int, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.mode("append").parquet(str(src / "x"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src / "*"))
    upsert_batches(stream(), str(tmp_path / "out"), ["k"], ["v"], str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(2, "c")], schema).coalesce(1).write.mode("append").parquet(str(src / "y"))
    upsert_batches(stream(), str(tmp_path / "out"), ["k"], ["v"], str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, latest_rows(spark, str(tmp_path / "out"), ["k"]).collect())) == [(1, "a"), (2, "c")]
    from vegaflow.streaming.bars import event_stream

    assert {r.status for r in drain(spark, completeness(event_stream(spark, sf), 30)).collect()} <= {"pass", "warn", "fail"}


def test_chunks(spark):
    def chunks_of(text):
        return [r["content"] for r in chunks(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("chunk_index").collect()]

    assert chunks_of(None) == [] and chunks_of("short") == ["short"] and chunks_of(" \n ") == []
    paragraph = "Para one is here. " * 30
    c = chunks_of("## A\n" + "\n\n".join([paragraph] * 8) + "\n### B\nend")
    assert len(c) > 3 and all(x.startswith("## A\n\n") for x in c[:-1]) and c[-1] == "### B\n\nend" and max(map(len, c)) < 2500
    assert sum(x.count("Para") for x in c[:-1]) >= 240 and c[1].startswith("## A\n\n" + c[0][-200:])
    one = chunks_of("Sentence number one is long. " * 200)
    assert len(one) > 2 and "".join(one).count("Sentence") >= 200 and max(map(len, one)) < 2500


def test_spreadsheet_rows_and_earnings_days(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Al</t></r><r><t>pha</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>1.5</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c><c r="D3"/></row></sheetData></worksheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = landing.sheet_rows(spark, f"{tmp_path}/*.xlsx").orderBy("row").collect()
    assert [(r["row"], r["cells"]) for r in rows] == [(1, {"A": "Name"}), (3, {"A": "Alpha", "B": "1.5", "C": "x"})]
    days = tmp_path / "days"
    days.mkdir()
    (days / "20240105.json").write_text('[{"ticker": "abc", "releaseTime": 1, "q1RevEst": 2.5}, {"ticker": "d"}]')
    (days / "20240108.json").write_text("")
    got = landing.earnings_days(spark, str(days)).select(F.col("day").cast("string"), "place", "ticker", "releaseTime", "q1RevEst").orderBy("place").collect()
    assert list(map(tuple, got)) == [("2024-01-05", 0, "abc", 1, 2.5), ("2024-01-05", 1, "d", None, None)]
    assert landing.balanced('[1, "]", [2]] rest]') == '[1, "]", [2]]' and landing.balanced("[1") is None
