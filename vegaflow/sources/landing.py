"""Landing-file sources: what a fetcher has put into a folder becomes typed rows.

Fetching itself is not a query. Every reader takes a path and an explicit
schema; nothing is inferred, and a broken record gives nulls, not a failure.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.text import lanes, option_root, tag_text

CHAIN_SCHEMA = """results array<struct<details: struct<ticker: string, contract_type: string, expiration_date: string, strike_price: double>,
 greeks: struct<delta: double, gamma: double, theta: double, vega: double>, implied_volatility: double, open_interest: bigint,
 day: struct<volume: bigint, close: double, previous_close: double>, last_quote: struct<bid: double, ask: double>, underlying_asset: struct<price: double>>>, page int, partial boolean"""
BARS_SCHEMA = "symbol string, results array<struct<t: bigint, o: double, h: double, l: double, c: double>>"


def chain_pages(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of an option chain from its pages: flattened, defaulted, first occurrence in page order kept.

    ``partial`` is true on every row if any page says that the fetch broke off.
    """
    p = spark.read.schema(CHAIN_SCHEMA).option("multiLine", True).json(path)
    rows = p.select("page", F.coalesce("partial", F.lit(False)).alias("partial"), F.posexplode("results").alias("place", "r"))
    flat = rows.select(
        "page",
        "place",
        "partial",
        option_root(F.col("r.details.ticker")).alias("root_symbol"),
        F.col("r.details.contract_type").alias("contract_type"),
        F.col("r.details.expiration_date").try_cast("date").alias("expiration_date"),
        F.col("r.details.strike_price").alias("strike"),
        F.col("r.implied_volatility").alias("implied_volatility"),
        *(F.col(f"r.greeks.{g}").alias(g) for g in ("delta", "gamma", "theta", "vega")),
        F.coalesce("r.open_interest", F.lit(0)).alias("open_interest"),
        F.coalesce("r.day.volume", F.lit(0)).alias("volume"),
        F.coalesce((F.col("r.last_quote.bid") + F.col("r.last_quote.ask")) / 2, F.col("r.day.close"), F.col("r.day.previous_close")).alias("mark"),
    )
    key = ["root_symbol", "expiration_date", "strike", "contract_type"]
    rest = [c for c in flat.columns if c not in (*key, "page", "place", "partial")]
    first = flat.groupBy(*key).agg(F.min(F.struct("page", "place", *rest)).alias("r"))
    broken = rows.agg(F.coalesce(F.max("partial"), F.lit(False)).alias("partial"))
    return first.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest)).join(F.broadcast(broken))


def prefer_root(contracts: DataFrame, preferred: str = "SPXW") -> DataFrame:
    """One row per expiration, strike and type: the preferred root's where it is listed."""
    key = ["expiration_date", "strike", "contract_type"]
    w = Window.partitionBy(*key).orderBy(F.when(F.col("root_symbol") == preferred, 0).otherwise(1), "root_symbol")
    return contracts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """symbol, trading_date (New York), open, high, low, close; bars with a price that is not positive are left out."""
    r = spark.read.schema(BARS_SCHEMA).option("multiLine", True).json(path).select("symbol", F.inline("results"))
    at = F.timestamp_millis(F.col("t"))
    ok = F.least("o", "h", "l", "c") > 0
    return r.where(ok).select("symbol", F.to_date(F.from_utc_timestamp(at, "America/New_York")).alias("trading_date"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"))


def last_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Newline-delimited records, the last of each key by file name and place in the file."""
    d = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    d = d.withColumn("r", F.from_json("value", schema)).where(F.col(f"r.{key}").isNotNull())
    return d.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max(F.struct("_file", "_at", "r")).alias("m")).select("m.r.*")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV with header: symbol, name, sector, volume."""
    return spark.read.option("header", True).schema("symbol string, name string, sector string, volume bigint").csv(path)


def feed_items(spark: SparkSession, path: str, item: str, fields: dict[str, str]) -> DataFrame:
    """Items of XML or RSS files: a column for each field from the element of that name."""
    whole = spark.read.option("wholetext", True).text(path)
    items = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?is)<{item}(?:\s[^>]*)?>(.*?)</{item}>"), 1)).alias("place", "x"))
    return items.select("place", *(tag_text(F.col("x"), tag).alias(name) for name, tag in fields.items()))


def embedded_days(spark: SparkSession, path: str, schema: str = "array<struct<date: string, events: array<struct<title: string, impact: string>>>>") -> DataFrame:
    """Rows of the JSON list that a page holds after ``days:``; the list ends where its brackets balance.

    Strings are blanked, then one pass over what is left counts brackets; so the
    end is found in time linear in the page.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("value", r"(?s)days\s*:\s*(\[.*)", 1).alias("tail")).where("tail <> ''")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"list": [balanced(t) for t in f["tail"]]})

    lists = whole.mapInPandas(cut, "list string").where("list is not null")
    return lists.select(F.inline(F.from_json("list", schema, {"mode": "PERMISSIVE"})))


def balanced(text: str) -> str | None:
    """The part of a text up to where its first bracket is closed, brackets in strings aside; None if it never is."""
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]]', text):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "]":
            return text[: m.end()]
    return None


EARNINGS_SCHEMA = "ticker string, company string, releaseTime int, nextEPSDate string, confirmDate string, epsTime string, q1EstEPS double, q1RevEst double, qSales double, total double"


def earnings_days(spark: SparkSession, path: str) -> DataFrame:
    """Reporting names from one JSON list a day, in files named by day (yyyymmdd): day, place in the list, and the fields as sent.

    A file that is empty or no list gives no rows.
    """
    whole = spark.read.option("wholetext", True).text(path).select("value", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{8})[^/]*$", 1), "yyyyMMdd").alias("day"))
    rows = whole.select("day", F.posexplode(F.from_json("value", f"array<struct<{EARNINGS_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("place", "r"))
    return rows.where("r is not null").select("day", "place", "r.*")


def sheet_rows(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Rows of a worksheet of spreadsheet files: file, row number, cells (by column letter, as text).

    A file is read whole by one task; a broken one gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(name, *r) for name, content in zip(f["path"], f["content"], strict=True) for r in cells_of(content, sheet)]
            yield pd.DataFrame(rows, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, cells map<string,string>")


def cells_of(content: bytes, sheet: int) -> list[tuple[int, dict[str, str]]]:
    """(row number, column letter -> text) of a worksheet: shared and inline strings are looked up, numbers stay as written."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = [text_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in z.namelist() else []
            root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for n, row in enumerate(root.iter(f"{ns}row"), 1):
        cells = {}
        for c in row.iter(f"{ns}c"):
            value = c.find(f"{ns}v")
            text = text_of(c) if c.get("t") == "inlineStr" else None if value is None else value.text
            if text is not None:
                cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" else text
        out.append((int(row.get("r", n)), cells))
    return out


#: The range of each stand-in: at-the-money volatility, put skew, call skew.
SEED_RANGES = (("atm_iv", "a", 0.2, 0.75), ("put_skew", "b", 0.005, 0.045), ("call_skew", "c", -0.015, 0.04))


def seeded(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Deterministic stand-ins for symbols without live data, by three hashes of the symbol, and the mode that says so."""
    out = symbols.withColumn("_h", lanes(F.col(symbol)))
    full = F.lit(float((1 << 32) - 1))
    out = out.withColumns({name: F.lit(low) + F.col(f"_h.{lane}") / full * F.lit(width) for name, lane, low, width in SEED_RANGES})
    return out.withColumns({"seed": F.col("_h.a") / full, "mode": F.lit("seed")}).drop("_h")
