"""Work that keeps tables going: paged sources, chunk sync, backfills, run streams, and search with its fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.calendar import market_holidays
from vegaflow.functions.numeric import js_round
from vegaflow.operators.search import nearest_rows
from vegaflow.operators.series import sign_segments
from vegaflow.plans import daily, surface
from vegaflow.plans.registry import SQL, query
from vegaflow.plans.text import keyword_search
from vegaflow.session import shared_folder
from vegaflow.sources.backfill import run_days
from vegaflow.sources.chain_source import ChainSource
from vegaflow.sources.fixtures import BARS_SQL, CONTRACTS_SQL, MACRO_SQL, TERM_SQL, VIX_SQL, contracts, daily_bars, macro_events, orders_of, sql_round, table, vol_indices
from vegaflow.sources.sync import stored, sync_chunks
from vegaflow.streaming.bars import completeness, drain, event_stream, ingest_gate
from vegaflow.streaming.runs import complete_runs, liveness

#: Contracts of a page; the first of the next page is its last, as on a listing that moves while it is read.
PAGE = 200


def landed_pages(c: DataFrame, path: str) -> None:
    """Write each run's contracts as a folder of JSON pages that overlap by one contract."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("dte", "strike", "contract_type")) - 1
    x = c.withColumn("n", n).withColumn("page", F.floor(F.col("n") / PAGE).cast("int"))
    again = (F.col("n") % PAGE == 0) & (F.col("page") > 0)
    x = x.withColumn("page", F.explode(F.when(again, F.array("page", F.col("page") - 1)).otherwise(F.array("page"))))
    details = F.struct(F.lit("O:SPX").alias("ticker"), "contract_type", F.col("expiration_date").cast("string").alias("expiration_date"), F.col("strike").alias("strike_price"))
    result = F.struct("n", details.alias("details"), F.col("iv").alias("implied_volatility"), F.struct("delta", "gamma").alias("greeks"), "open_interest", F.struct("volume").alias("day"))
    x.groupBy("run_id", "page").agg(F.array_sort(F.collect_list(result)).alias("results")).write.partitionBy("run_id", "page").json(path)


@query(f"""WITH {CONTRACTS_SQL} SELECT run_id, (count(*) - 1) // {PAGE} + 1 AS pages, count(*) AS contracts, CAST(sum(open_interest) AS BIGINT) AS open_interest, CAST(sum(volume) AS BIGINT) AS volume, {sql_round('sum(iv)', 6)} AS sum_iv, false AS partial FROM contracts GROUP BY 1""")
def paged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's chain read back from its pages by the data source, a task per chain, each contract once."""
    path = shared_folder(spark, "pages")
    landed_pages(contracts(spark, sf_dir), path)
    spark.dataSource.register(ChainSource)
    rows = spark.read.format("option_chain").option("path", path).load()
    g = rows.groupBy(F.regexp_extract("chain", r"(\d+)$", 1).cast("int").alias("run_id"))
    return g.agg((F.max("page")).cast("long").alias("pages"), F.count("*").alias("contracts"), F.sum("open_interest").alias("open_interest"), F.sum("volume").alias("volume"), js_round(F.sum("implied_volatility"), 6).alias("sum_iv"), F.bool_or("partial").alias("partial"))


#: Characters of a stored chunk, and of a text that was cut.
CHUNK_CHARS, CUT_CHARS = 500, 700


def fixed_chunks(texts: DataFrame) -> DataFrame:
    """source, chunk_index, content of texts (doc_id, text) in pieces of one size."""
    t = texts.where("text is not null and text <> ''")
    i = F.explode(F.sequence(F.lit(0), (F.ceil(F.length("text") / F.lit(CHUNK_CHARS)) - 1).cast("int")))
    return t.select(F.col("doc_id").cast("string").alias("source"), "text", i.alias("chunk_index")).select("source", "chunk_index", F.substring("text", F.col("chunk_index") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("content"))


CHUNK_OF = f"SELECT doc_id, i AS chunk_index, substring(text, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / {CHUNK_CHARS}e0) AS INTEGER) - 1)) AS i FROM {{}} WHERE text <> '')"


@query(f"""WITH edited AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' WHEN doc_id % 7 = 0 THEN substring(text, 1, {CUT_CHARS}) ELSE text END AS text FROM documents),
a AS ({CHUNK_OF.format('documents')}), b AS ({CHUNK_OF.format('edited')}), ends AS (SELECT doc_id, max(chunk_index) AS last FROM b GROUP BY 1),
x AS (SELECT coalesce(a.doc_id, b.doc_id) % 11 = 0 AS off, a.content AS old, b.content AS new, a.chunk_index > ends.last AS past FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index LEFT JOIN ends ON ends.doc_id = coalesce(a.doc_id, b.doc_id)),
n AS (SELECT count(old) AS stored, count(*) FILTER (NOT off AND new IS NOT NULL AND old IS DISTINCT FROM new) AS upserted, count(*) FILTER (NOT off AND old = new) AS same, count(*) FILTER (NOT off AND new IS NULL AND past) AS orphans, count(*) FILTER (off AND old IS NOT NULL) AS retired, count(*) FILTER (NOT off AND new IS NOT NULL) AS after FROM x)
SELECT 1 AS run, 1 AS version, stored AS upserted, 0 AS unchanged, 0 AS orphans, 0 AS retired, stored FROM n UNION ALL SELECT 2, 1, 0, stored, 0, 0, stored FROM n UNION ALL SELECT 3, 2, upserted, same, orphans, retired, after FROM n""")
def chunk_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the chunk sync over all documents: the first load, the same again (which writes nothing), and one after edits, cuts and retirements."""
    path = shared_folder(spark, "chunks")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).when(F.col("doc_id") % 7 == 0, F.substring("text", 1, CUT_CHARS)).otherwise(F.col("text"))
    edited, listed = d.select("doc_id", text.alias("text")), d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("source"))
    out = []
    for run, (texts, sources) in enumerate(((d, None), (d, None), (edited, listed)), 1):
        r = sync_chunks(spark, path, fixed_chunks(texts), sources)
        out.append((run, r.version, r.upserted, r.unchanged, r.orphans, r.retired, stored(spark, path, ()).count()))
    return spark.createDataFrame(out, "run int, version int, upserted bigint, unchanged bigint, orphans bigint, retired bigint, stored bigint")


#: Days that the backfill query works on.
BACK_DAYS = 5


@query(f"""WITH {BARS_SQL}, {TERM_SQL}, days AS (SELECT trading_date FROM bars ORDER BY trading_date DESC LIMIT {BACK_DAYS}), last AS (SELECT max(trading_date) AS d FROM days),
n AS (SELECT d.trading_date AS day, 'term_structure' AS phase, (SELECT count(*) FROM term t WHERE t.trading_date = d.trading_date) AS n_rows FROM days d UNION ALL SELECT trading_date, 'vol_stats', 1 FROM days)
SELECT day, phase, CASE WHEN day = (SELECT d FROM last) THEN 2 ELSE 1 END AS attempts, 'success' AS status, n_rows FROM n""")
def day_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days filled in one job a phase, the same asked for again (nothing to do), and the last day replaced by an override: one copy of each."""
    root = shared_folder(spark, "backfill")
    days = [r[0] for r in daily_bars(spark, sf_dir).select("trading_date").orderBy(F.desc("trading_date")).limit(BACK_DAYS).collect()]
    taken = lambda asked: orders_of(spark, sf_dir, asked, shared_folder(spark, "orders"))
    phases = {"term_structure": lambda asked: daily.daily_term_structure(spark, sf_dir, taken(asked)), "vol_stats": lambda asked: daily.vol_stats(spark, sf_dir, taken(asked))}
    run_days(spark, root, phases, days)
    run_days(spark, root, phases, days)
    run_days(spark, root, phases, days[:1], force=True)
    return run_days(spark, root, phases, days).select("day", "phase", "attempts", "status", "n_rows")


def folder_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("""SELECT o_orderkey AS run_id, count(*) AS contracts, CAST(sum(l_quantity * 10) AS BIGINT) AS open_interest FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 130 DAY WHERE o_orderstatus <> 'P' GROUP BY 1""")
def stream_complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of complete runs as a join of two streams, counted per run; orders stand for runs, open ones for partial runs."""
    o, li = folder_stream(spark, sf_dir, "orders"), folder_stream(spark, sf_dir, "lineitem")
    headers = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("captured_at"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("success").alias("status"))
    rows = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_quantity") * 10).cast("long").alias("open_interest"))
    return drain(spark, complete_runs(headers, rows)).groupBy("run_id").agg(F.count("*").alias("contracts"), F.sum("open_interest").alias("open_interest"))


#: Five-minute runs of a full session.
RUNS_A_DAY = 84


@query(f"""WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, CASE WHEN n / {RUNS_A_DAY}e0 >= 0.93e0 THEN 'pass' WHEN n / {RUNS_A_DAY}e0 >= 0.7e0 THEN 'warn' ELSE 'fail' END AS status FROM d WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each day against a full session, told once the watermark has passed the day."""
    return drain(spark, completeness(event_stream(spark, sf_dir), RUNS_A_DAY))


@query("""WITH e AS (SELECT event_type AS source, date_trunc('millisecond', ts) AS t FROM events), o AS (SELECT source, t, lag(t) OVER (PARTITION BY source ORDER BY t) AS before, lead(t) OVER (PARTITION BY source ORDER BY t) AS next_t FROM e)
SELECT source, t AS told_at, 'LIVE' AS state FROM o WHERE before IS NULL OR t > before + INTERVAL 10 MINUTE
UNION ALL SELECT source, t + INTERVAL 10 MINUTE, 'STALE' FROM o WHERE next_t > t + INTERVAL 10 MINUTE OR (next_t IS NULL AND t + INTERVAL 10 MINUTE <= (SELECT max(t) - INTERVAL 1 MINUTE FROM e))""")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event type came alive and when ten minutes of silence made it stale, by timers."""
    own = spark.newSession()  # the state store is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drain(own, liveness(event_stream(own, sf_dir)))


#: Similarity under which a question has no near vector, and answers to a question.
NEAR, ANSWERS = 0.75, 6


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT item_id, e AS qe FROM benchmark JOIN v ON vec_id = item_id),
s AS (SELECT item_id, vec_id AS doc_id, list_dot_product(qe, e) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(e, e))) AS score FROM q, v WHERE vec_id <> item_id),
near AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score >= {NEAR!r}::DOUBLE QUALIFY place <= {ANSWERS}), words AS ({SQL['keyword_search']})
SELECT item_id, doc_id, 'vector' AS kind, {sql_round('score', 6)} AS score, place FROM near UNION ALL SELECT item_id, doc_id, 'keyword', CAST(hits AS DOUBLE), place FROM words WHERE item_id NOT IN (SELECT item_id FROM near)
UNION ALL SELECT item_id, NULL, 'none', NULL, 0 FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM near) AND item_id NOT IN (SELECT item_id FROM words)""")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's nearest texts by vector; by its words where no vector is near; and a row that says so where neither answers."""
    q, v = table(spark, sf_dir, "benchmark").select("item_id"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.join(q, F.col("vec_id") == F.col("item_id"), "left_semi")
    near = nearest_rows(v, asked, ANSWERS, NEAR).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.lit("vector").alias("kind"), js_round(F.col("similarity"), 6).alias("score"), "place")
    words = keyword_search(spark, sf_dir).select("item_id", "doc_id", F.lit("keyword").alias("kind"), F.col("hits").cast("double").alias("score"), "place")
    found = near.unionByName(words.join(near.select("item_id").distinct(), "item_id", "left_anti"))
    none = q.join(found.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit("none").alias("kind"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("place"))
    return found.unionByName(none)


CLOSED = [str(d) for d in market_holidays(2023, 2025)]
ET = "timezone('America/New_York', timezone('UTC', ts))"


@query(f"""SELECT event_id, event_type FROM events WHERE isodow({ET}) < 6 AND CAST({ET} AS DATE) NOT IN ({', '.join(f"DATE '{d}'" for d in CLOSED)}) AND hour({ET}) + minute({ET}) / 60e0 BETWEEN 9.5e0 AND 16.5e0
UNION ALL SELECT event_id, event_type || ' (forced)' FROM events""")
def stream_ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the timed ingest takes up on trading days within its hours, and those of a forced run."""
    e = event_stream(spark, sf_dir)
    forced = ingest_gate(e, CLOSED, force=True).withColumn("event_type", F.concat("event_type", F.lit(" (forced)")))
    return drain(spark, ingest_gate(e, CLOSED).unionByName(forced).select("event_id", "event_type"))


CHECKS = ("spx_close_xcheck", "run_count", "partial_rate", "atm_iv_null_rate", "late_snapshot")


@query(f"""WITH r AS ({SQL['reconciliation']}), g AS (SELECT DISTINCT trading_date, unnest([{', '.join(f"'{c}'" for c in CHECKS)}]) AS check_name FROM r), s AS (SELECT trading_date, check_name, coalesce(status, 'skip') AS status FROM g LEFT JOIN r USING (trading_date, check_name))
SELECT check_name, {', '.join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in ('pass', 'warn', 'fail', 'skip'))} FROM s GROUP BY ROLLUP (check_name)""")
def reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each probe passed, warned, failed or had nothing to go by, and all of them (null name)."""
    r = surface.reconciliation(spark, sf_dir).select("trading_date", "check_name", "status")
    grid = r.select("trading_date").distinct().withColumn("check_name", F.explode(F.array(*map(F.lit, CHECKS))))
    s = grid.join(r, ["trading_date", "check_name"], "left").withColumn("status", F.coalesce("status", F.lit("skip")))
    return s.rollup("check_name").agg(*(F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("pass", "warn", "fail", "skip")))


@query(f"""WITH {MACRO_SQL}, m AS (SELECT *, datediff('day', date_trunc('week', (SELECT min(ts) FROM macro)), date_trunc('day', ts)) AS d FROM macro),
u AS (SELECT ts, title, 'xml' AS source, 0 AS week FROM m WHERE d < 7 UNION ALL SELECT ts, title, 'html', w FROM m, (SELECT unnest(generate_series(1, 4)) AS w) WHERE d BETWEEN 7 * w - 1 AND 7 * w + 6)
SELECT ts, title, min_by(source, week) AS source, CAST(min(week) AS INTEGER) AS week, count(*) AS times FROM u GROUP BY 1, 2""")
def announced_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of five weeks from their two kinds of source, each once: the first week's feed, then a page a week, which begins with the day before."""
    m = macro_events(spark, sf_dir)
    start = m.agg(F.date_trunc("week", F.min("ts")).alias("start"))
    m = m.join(F.broadcast(start)).withColumn("d", F.datediff("ts", "start"))
    feed = m.where("d < 7").select("ts", "title", F.lit("xml").alias("source"), F.lit(0).alias("week"))
    w = F.explode(F.filter(F.array(*map(F.lit, range(1, 5))), lambda w: F.col("d").between(7 * w - 1, 7 * w + 6)))
    page = m.select("ts", "title", F.lit("html").alias("source"), w.alias("week"))
    return feed.unionByName(page).groupBy("ts", "title").agg(F.min_by("source", "week").alias("source"), F.min("week").alias("week"), F.count("*").alias("times"))


@query(f"""WITH {CONTRACTS_SQL}, e AS (SELECT DISTINCT run_id, trading_date, expiration_date, CAST(trading_date AS TIMESTAMP) + INTERVAL 14 HOUR + run_id * INTERVAL 37 MINUTE AS captured_at FROM contracts), f AS (SELECT *, greatest(0, (epoch_us(CAST(expiration_date AS TIMESTAMP) + INTERVAL 20 HOUR) - epoch_us(captured_at)) / 864e8) AS left_days FROM e)
SELECT run_id, expiration_date, datediff('day', trading_date, expiration_date) AS whole_days, {sql_round('left_days', 1)} AS tenths, {sql_round('left_days', 6)} AS fractional FROM f""")
def days_to_expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to each expiration's close, from the moment a run was captured: between dates, to a tenth, and as a fraction; none under zero."""
    e = contracts(spark, sf_dir).select("run_id", "trading_date", "expiration_date").distinct()
    captured = F.unix_micros(F.col("trading_date").cast("timestamp")) + F.lit(14 * 3_600_000_000) + F.col("run_id").cast("long") * F.lit(37 * 60_000_000)
    close = F.unix_micros(F.col("expiration_date").cast("timestamp")) + F.lit(20 * 3_600_000_000)
    left = F.greatest(F.lit(0.0), (close - captured) / F.lit(864e8))
    return e.select("run_id", "expiration_date", F.datediff("expiration_date", "trading_date").cast("long").alias("whole_days"), js_round(left, 1).alias("tenths"), js_round(left, 6).alias("fractional"))


@query(f"""WITH {VIX_SQL}, d AS (SELECT a.trading_date, a.close AS far, b.close AS near, CASE WHEN a.close >= b.close THEN 'above' ELSE 'below' END AS side FROM vix a JOIN vix b ON b.trading_date = a.trading_date AND b.symbol = 'VIX' WHERE a.symbol = 'VIX3M'),
l AS (SELECT *, lag(trading_date) OVER w AS d0, lag(far) OVER w AS far0, lag(near) OVER w AS near0, coalesce(side <> lag(side) OVER w, false) AS new FROM d WINDOW w AS (ORDER BY trading_date)), s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY trading_date) AS segment, CASE WHEN abs(far0 - near0) + abs(far - near) > 0 THEN abs(far0 - near0) / (abs(far0 - near0) + abs(far - near)) ELSE 0.5e0 END AS share FROM l),
c AS (SELECT d0 + CAST(floor(share * (trading_date - d0)) AS INTEGER) AS trading_date, far0 + share * (far - far0) AS y, segment, side FROM s WHERE new)
SELECT trading_date, {sql_round('far', 6)} AS far, {sql_round('near', 6)} AS near, CAST(segment AS BIGINT) AS segment, side, false AS crossing FROM s
UNION ALL SELECT trading_date, {sql_round('y', 6)}, {sql_round('y', 6)}, CAST(segment AS BIGINT), side, true FROM c UNION ALL SELECT trading_date, {sql_round('y', 6)}, {sql_round('y', 6)}, CAST(segment - 1 AS BIGINT), CASE side WHEN 'above' THEN 'below' ELSE 'above' END, true FROM c""")
def curve_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which the three-month index is over the front one, or under it, with the points where they cross."""
    v = vol_indices(spark, sf_dir)
    far, near = (v.where(F.col("symbol") == s).select("trading_date", F.col("close").alias(n)) for s, n in (("VIX3M", "far"), ("VIX", "near")))
    # a crossing has one level on both lines
    x = sign_segments(far.join(near, "trading_date"), "trading_date", "far", "near")
    level = lambda c: js_round(F.when(F.col("crossing"), F.col("far")).otherwise(F.col(c)), 6).alias(c)
    return x.select("trading_date", level("far"), level("near"), "segment", "side", "crossing")
