"""Paged sources, chunk sync, backfills, run streams, blocked search, window clusters, forward joins and model greeks against plain versions."""

import datetime as dt
import http.server
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.functions.numeric import bs_price, implied_volatility
from vegaflow.models import regimes, surface
from vegaflow.operators import search
from vegaflow.operators.clusters import window_clusters
from vegaflow.operators.series import as_of, first_on_or_after
from vegaflow.operators.stochastic import heston_greeks
from vegaflow.plans import daily, modelled
from vegaflow.session import shared_folder
from vegaflow.sources import sync
from vegaflow.sources.backfill import ledger, resolve_day, run_days
from vegaflow.sources.chain_source import ChainSource
from vegaflow.sources.fixtures import daily_bars, orders_of
from vegaflow.streaming.runs import complete_runs, liveness


# greeks under stochastic volatility


@pytest.mark.parametrize("days", [3, 33, 168, 730])
def test_heston_greeks_are_differences_of_prices(spark, days):
    p, s, t, k = (0.05, 2.5, 0.04, 0.5, -0.6), 5000.0, days / 365, np.linspace(4400, 5600, 13)
    slices = spark.createDataFrame([(1, t, *p)], "run_id int, tau double, v0 double, kappa double, theta double, xi double, rho double")
    quotes = spark.createDataFrame([(1, float(x), s, t) for x in k], "run_id int, strike double, spot double, tau double")
    got = heston_greeks(quotes, slices, ["run_id"], 0.045, 0.013).orderBy("strike").toPandas()
    price = lambda spot=s, v0=p[0]: surface.fourier_calls(surface.heston_cf, (v0, *p[1:]), spot, k, t, nodes=4001)
    h, v = 1.0, np.sqrt(p[0])
    assert np.allclose(got.price, price(), atol=1e-4)
    assert np.allclose(got.delta, (price(s + h) - price(s - h)) / (2 * h), atol=5e-5)
    assert np.allclose(got.gamma, (price(s + h) - 2 * price() + price(s - h)) / h**2, atol=2e-6)
    assert np.allclose(got.vega, (price(v0=(v + 0.01) ** 2) - price(v0=(v - 0.01) ** 2)) / 0.02, atol=0.05)


def test_implied_volatility_of_odd_prices(spark):
    rows = [(5000.0, 5000.0, 0.1, v, c) for v in (0.02, 0.2, 1.5, 4.5) for c in (True, False)] + [(5000.0, 3000.0, 0.5, 0.3, True), (5000.0, 8000.0, 0.5, 0.3, False)]
    x = spark.createDataFrame(rows, "s double, k double, t double, v double, c boolean")
    args = [F.col(n) for n in "skt"]
    x = x.withColumn("p", bs_price(*args, F.col("v"), F.col("c"))).withColumn("found", implied_volatility(F.col("p"), *args, F.col("c")))
    assert all(abs(r["v"] - r["found"]) < 1e-6 for r in x.collect())
    odd = x.withColumn("found", implied_volatility(F.lit(1e-9) * F.when(F.col("c"), 0.0).otherwise(-1.0), *args, F.col("c")))
    high = x.withColumn("found", implied_volatility(F.col("s") * 2, *args, F.col("c")))
    assert odd.where("found is not null").count() == high.where("found is not null").count() == 0


# the data source of chains


def page(*strikes, **more):
    return {"results": [{"details": {"ticker": "O:SPX", "contract_type": "call", "expiration_date": "2024-01-19", "strike_price": k}, "open_interest": 1} for k in strikes], **more}


@pytest.fixture
def vendor():
    """A server of pages: ``fails`` says how often a path answers with which status first."""
    pages: dict[str, dict] = {}
    fails: dict[str, list[int]] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            left = fails.get(self.path, [])
            status = left.pop(0) if left else 200 if self.path in pages else 404
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps(pages[self.path]).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", pages, fails
    server.shutdown()


def test_chains_behind_a_cursor(spark, vendor):
    at, pages, fails = vendor
    pages |= {"/a/1": page(1, 2, next_url="/a/2"), "/a/2": page(2, 3, next_url="3"), "/a/3": page(4), "/b/1": page(1, next_url="/b/2"), "/c/1": page(1, next_url="/c/2"), "/c/2": page(2), "/d/1": page()}
    fails |= {"/a/2": [503], "/c/2": [429, 500]}
    spark.dataSource.register(ChainSource)
    read = lambda **o: spark.read.format("option_chain").options(urls=json.dumps({c: f"{at}/{c}/1" for c in "abcd"}), retryAfter="0", **o).load()
    df = read()
    assert df.rdd.getNumPartitions() == 4
    r = {c: [(x["strike"], x["page"], x["partial"], x["partial_reason"]) for x in df.where(F.col("chain") == c).orderBy("page", "place").collect()] for c in "ab"}
    assert r["a"] == [(1.0, 1, False, None), (2.0, 1, False, None), (3.0, 2, False, None), (4.0, 3, False, None)]
    assert r["b"] == [(1.0, 1, True, "page 2: status 404")]
    fails["/c/2"] = [429, 500]
    assert [(x["strike"], x["partial_reason"]) for x in read().where("chain = 'c'").collect()] == [(1.0, "page 2: status 500")]
    assert {x["partial_reason"] for x in read(maxPages="2").where("chain = 'a'").collect()} == {"limit of 2 pages reached"}


def test_landed_pages_stream_from_an_offset(spark, tmp_path):
    spark.dataSource.register(ChainSource)
    land, out, state = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "state")

    def put(chain, number, what):
        os.makedirs(land / chain, exist_ok=True)
        (land / chain / f"{number}.json").write_text(json.dumps(what))

    def run():
        q = spark.readStream.format("option_chain").option("path", str(land)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start()
        q.awaitTermination()
        return sorted((r["chain"], r["page"], r["strike"]) for r in spark.read.parquet(out).collect())

    put("spx", 1, page(1, 2)), put("spx", 2, page(3)), put("ndx", 1, page(7))
    assert run() == [("ndx", 1, 7.0), ("spx", 1, 1.0), ("spx", 1, 2.0), ("spx", 2, 3.0)]
    (land / "spx" / "1.json").write_text("gone from here on")  # a page that was seen is not read again
    put("spx", 10, page(9)), put("vix", 1, page(5))
    assert run()[-3:] == [("spx", 2, 3.0), ("spx", 3, 9.0), ("vix", 1, 5.0)]
    assert len(run()) == 6


def test_a_broken_landed_page_makes_its_chain_partial(spark, tmp_path):
    spark.dataSource.register(ChainSource)
    os.makedirs(tmp_path / "spx"), os.makedirs(tmp_path / "ndx")
    (tmp_path / "spx" / "1.json").write_text(json.dumps(page(1)))
    (tmp_path / "spx" / "2.json").write_text('{"results": [')
    (tmp_path / "ndx" / "1.json").write_text(json.dumps(page(1, partial=True)))
    r = {x["chain"]: (x["partial"], x["partial_reason"]) for x in spark.read.format("option_chain").options(path=str(tmp_path), retryAfter="0").load().collect()}
    assert r == {"spx": (True, "page 2: a page that is not whole"), "ndx": (True, "a page says so")}


# chunk sync


def test_sync_writes_only_what_changed(spark, monkeypatch):
    path = shared_folder(spark, "sync")
    made = lambda **texts: spark.createDataFrame([(s, i, c) for s, cs in texts.items() for i, c in enumerate(cs)] or [("x", 0, "x")], "source string, chunk_index int, content string").where("true" if texts else "false")
    held = lambda: {(r["source"], r["chunk_index"]): r["content"] for r in sync.stored(spark, path).collect()}
    assert sync.sync_chunks(spark, path, made(a=["1", "2", "3"], b=["x"])) == sync.Report(1, 4, 0, 0, 0)
    before = sync.versions(spark, path)
    assert sync.sync_chunks(spark, path, made(a=["1", "2", "3"], b=["x"])) == sync.Report(1, 0, 4, 0, 0) and sync.versions(spark, path) == before
    assert sync.sync_chunks(spark, path, made(a=["1", "new"])) == sync.Report(2, 1, 1, 1, 0)
    assert held() == {("a", 0): "1", ("a", 1): "new", ("b", 0): "x"}  # b gave no chunk and keeps what it has
    only_a = spark.createDataFrame([("a",)], "source string")
    assert sync.sync_chunks(spark, path, made(a=["1", "new"]), only_a) == sync.Report(3, 0, 2, 0, 1) and held() == {("a", 0): "1", ("a", 1): "new"}
    assert sync.sync_chunks(spark, path, made(), only_a) == sync.Report(3, 0, 0, 0, 0)
    monkeypatch.setattr(sync, "MOST_DELTAS", 3)
    assert sync.sync_chunks(spark, path, made(a=["0", "new"], c=["not listed"]), only_a) == sync.Report(5, 1, 1, 0, 0)
    assert sync.versions(spark, path) == ["full-5"] and held() == {("a", 0): "0", ("a", 1): "new"}
    os.makedirs(f"{path}/delta-9")  # a run that failed left no mark of success
    assert sync.versions(spark, path) == ["full-5"]


def test_sync_joins_places_and_hashes_only(spark):
    path = shared_folder(spark, "sync")
    kind = "source string, chunk_index int, content string"
    first = spark.createDataFrame([("a", 0, "1"), ("a", 1, None), (None, 0, "x"), ("b", 0, "y")], kind)
    assert sync.sync_chunks(spark, path, first.where("false")) == sync.Report(0, 0, 0, 0, 0) and sync.versions(spark, path) == []
    assert sync.sync_chunks(spark, path, first) == sync.Report(1, 3, 0, 0, 0)
    assert sync.sync_chunks(spark, path, first) == sync.Report(2, 1, 2, 0, 0)  # a chunk without a source equals none that is stored
    assert sync.stored(spark, path, ()).count() == 3 and {(r["source"], r["content"]) for r in sync.stored(spark, path).collect()} == {("a", "1"), (None, "x"), ("b", "y")}
    new = first.withColumn("content_hash", F.sha2("content", 256))
    for df in (sync.stored(spark, path, ()), sync.changes(spark, path, new, None)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        reads = [line for line in plan.splitlines() if "ReadSchema" in line]
        assert reads and not any("content:" in line for line in reads)


# backfill


def test_phases_of_days_join_their_orders_only(spark, sf):
    days = [r[0] for r in daily_bars(spark, sf).orderBy(F.desc("trading_date")).limit(3).collect()][::2]
    mine = orders_of(spark, sf, days, shared_folder(spark, "orders"))
    assert {r[0].date() for r in mine.select("o_orderdate").distinct().collect()} == set(days)
    for query in (daily.daily_term_structure, daily.vol_stats):
        of = lambda df: sorted(map(str, df.where(F.col("trading_date").isin(days)).collect()))
        assert of(query(spark, sf, mine)) == of(query(spark, sf)) != []
    # beside the whole orders nothing may be broadcast here; beside those of the days no line item is shuffled
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in mine.inputFiles())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 * size))
    try:
        plan = lambda *a: daily.daily_term_structure(spark, sf, *a)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan() and "SortMergeJoin" not in plan(mine)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_are_replaced_and_failures_taken_up_alone(spark):
    root, days, ran, broken = shared_folder(spark, "days"), [dt.date(2024, 1, d) for d in (2, 3, 4)], [], [True]
    rows = lambda n: spark.createDataFrame([(d, i) for d in days for i in range(n)], "trading_date date, i int")

    def bars(left):
        ran.append(("bars", len(left)))
        return rows(2 + len(ran))

    def stats(left):
        ran.append(("stats", len(left)))
        if broken[0]:
            raise RuntimeError("the store is away")
        return rows(1).where(F.col("trading_date") != days[0])

    phases = {"bars": bars, "stats": stats}
    told = lambda r: {(x["day"].day, x["phase"]): (x["attempts"], x["status"], x["n_rows"]) for x in r.collect()}
    first = told(run_days(spark, root, phases, days[:2]))
    assert first == {(2, "bars"): (1, "success", 3), (3, "bars"): (1, "success", 3), (2, "stats"): (1, "error", None), (3, "stats"): (1, "error", None)}
    broken[0] = False
    second = told(run_days(spark, root, phases, days))
    assert ran[2:] == [("bars", 1), ("stats", 3)]
    assert second[3, "bars"] == (1, "success", 3) and second[4, "bars"][0] == 1 and second[2, "stats"] == (2, "success", 0) and second[4, "stats"] == (1, "success", 1)
    third = told(run_days(spark, root, phases, days[1:2], force=True))
    kept = {r[0].day: r[1] for r in spark.read.parquet(f"{root}/bars").groupBy("trading_date").count().collect()}
    assert third[3, "bars"] == (2, "success", 7) and kept == {2: 3, 3: 7, 4: 5}  # one copy of each day
    assert ledger(spark, root).where("phase = 'stats' and status = 'error'").count() == 2


def test_the_day_to_work_on(spark):
    runs = spark.createDataFrame([(dt.date(2024, 1, 5), "success"), (dt.date(2024, 1, 7), "partial"), (dt.date(2024, 1, 1), "success")], "trading_date date, status string")
    assert resolve_day(runs, dt.date(2024, 1, 8)) == dt.date(2024, 1, 5)
    assert resolve_day(runs, dt.date(2024, 1, 8), dt.date(2023, 6, 1)) == dt.date(2023, 6, 1)
    with pytest.raises(ValueError, match="no successful run"):
        resolve_day(runs, dt.date(2024, 1, 20))


# streams of runs



def test_contracts_of_partial_runs_stay_out_and_state_goes(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    heads = [[(1, t(1), "success"), (2, t(1), "partial"), (3, t(2), "success")], [(9, t(20), "success")], [(10, t(25), "success")]]
    rows = [[(1, t(1, 1), 1.0), (2, t(1, 1), 2.0), (3, t(1, 1), 3.0), (3, t(2, 5), 4.0)], [(9, t(20, 1), 6.0), (1, t(5), 5.0)], [(10, t(25, 1), 7.0)]]
    h, c = "run_id bigint, captured_at timestamp, status string", "run_id bigint, at timestamp, strike double"
    for i, (x, y) in enumerate(zip(heads, rows, strict=True)):
        spark.createDataFrame(x, h).coalesce(1).write.mode("append").parquet(str(tmp_path / f"h/head-{i}"))
        spark.createDataFrame(y, c).coalesce(1).write.mode("append").parquet(str(tmp_path / f"c/row-{i}"))
    read = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / folder))
    q = complete_runs(read("h", h), read("c", c), "2 days").writeStream.format("memory").queryName("whole_runs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["run_id"], r["strike"]) for r in spark.table("whole_runs").collect())
    assert got == [(1, 1.0), (3, 4.0), (9, 6.0), (10, 7.0)]  # 2 is partial; 3 at 1:00 came before its run, 5 too late
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_sources_go_stale_without_a_word(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, at = "event_type string, ts timestamp", lambda m: dt.datetime(2024, 1, 2, 10) + dt.timedelta(minutes=m)
    folder = tmp_path / "in"

    def arrive(i, rows):
        spark.createDataFrame([(k, at(m)) for k, m in rows], schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        s = own.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
        q = liveness(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["source"], int((r["told_at"] - at(0)).total_seconds() // 60), r["state"]) for r in spark.read.schema("source string, told_at timestamp, state string").parquet(str(tmp_path / "out")).collect())

    assert arrive(0, [("a", 0), ("b", 1), ("a", 5), ("a", 30)]) == [("a", 0, "LIVE"), ("a", 15, "STALE"), ("a", 30, "LIVE"), ("b", 1, "LIVE"), ("b", 11, "STALE")]  # b by its timer
    assert arrive(1, [("a", 38)]) == [("a", 0, "LIVE"), ("a", 15, "STALE"), ("a", 30, "LIVE"), ("b", 1, "LIVE"), ("b", 11, "STALE")]
    last = arrive(2, [("b", 60)])
    assert ("a", 48, "STALE") in last and ("b", 60, "LIVE") in last and len(last) == 7


# search, clusters, forward joins


@pytest.mark.parametrize("small", [False, True])
def test_nearest_rows_of_any_blocks(spark, monkeypatch, small):
    if small:
        for name, n in (("PACK", 8), ("QUERIES", 16), ("ROWS", 32), ("CHUNK", 5)):
            monkeypatch.setattr(search, name, n)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(90, 6)), 2, axis=0)  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id bigint, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    got = {(r["query_id"], r["place"]): r["id"] for r in search.nearest_rows(df, df.where("vec_id % 3 = 0"), 4, 0.3).collect()}
    want = {(q, n + 1): i for q in range(0, 180, 3) for n, i in enumerate(sorted((i for i in range(180) if i != q and sims[q, i] >= 0.3), key=lambda i: (-sims[q, i], i))[:4])}
    assert got == want


def test_window_clusters_equal_the_plain_ones(spark, sf):
    r = modelled.returns(spark, sf).toPandas()
    got = window_clusters(spark, modelled.returns(spark, sf), "symbol", "trading_date", "x", 20, regimes.DRAWS).toPandas()
    for symbol, g in r.groupby("symbol"):
        want, mine = regimes.wasserstein_clusters(g.sort_values("trading_date").x.to_numpy()), got[got.symbol == symbol].sort_values("cluster")
        assert np.allclose(mine.sd, want["sd"]) and np.allclose(mine.share, want["share"]) and set(mine.now) == {want["now"]}


def test_the_next_of_a_series(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("a", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 7, 70), ("b", 6, 60)], "k string, day int, v int")
    r = {(x["k"], x["at"]): x["v"] for x in as_of(left, right, "at", "day", ["v"], by=["k"], forward=True).collect()}
    assert r == {("a", 1): 50, ("a", 5): 50, ("b", 5): 60, ("a", 9): None}
    strict = {(x["k"], x["at"]): x["v"] for x in as_of(left, right, "at", "day", ["v"], by=["k"], strict=True, forward=True).collect()}
    assert strict == {("a", 1): 50, ("a", 5): 70, ("b", 5): 60, ("a", 9): None}
    d = lambda n: dt.date(2024, 1, n)
    days = spark.createDataFrame([(d(n),) for n in (1, 5, 6, 20, 28)], "at date")
    listed = spark.createDataFrame([(d(5), 1), (d(19), 2), (d(26), 3)], "day date, v int")
    got = {x["at"].day: x["v"] for x in first_on_or_after(days, F.col("at"), listed, "day", reach=6).collect()}
    assert got == {1: 1, 5: 1, 6: None, 20: 3, 28: None}
