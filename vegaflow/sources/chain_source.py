"""Option chains as a Spark data source: pages behind a cursor, a partition per chain, and a stream of pages as they land.

``spark.dataSource.register(ChainSource)``, then ``spark.read.format("option_chain")``
with one of

* ``urls`` – JSON object of chain name to the address of its first page; every
  page names the next in ``next_url``. Addresses are of http(s) or of a file
  system that Arrow opens.
* ``path`` – a landing folder with one folder per chain; its files, by the
  numbers in their names, are the pages. This also streams: the offset is the
  number of pages seen of each chain.

A page that fails to load for a passing reason is asked for once more; if that
fails too, or the number of pages reaches ``maxPages``, the chain is partial and
says so, with the reason, on every row. Of contracts that overlapping pages
repeat, the first stays.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_PAGES, TIMEOUT, RETRY_AFTER = 300, 30.0, 1.0
FIELDS = (
    ("chain", pa.string(), "string"), ("page", pa.int32(), "int"), ("place", pa.int32(), "int"), ("ticker", pa.string(), "string"), ("contract_type", pa.string(), "string"),
    ("expiration_date", pa.string(), "string"), ("strike", pa.float64(), "double"), ("implied_volatility", pa.float64(), "double"), ("delta", pa.float64(), "double"), ("gamma", pa.float64(), "double"),
    ("open_interest", pa.int64(), "bigint"), ("volume", pa.int64(), "bigint"), ("partial", pa.bool_(), "boolean"), ("partial_reason", pa.string(), "string"),
)
ARROW = pa.schema([(n, t) for n, t, _ in FIELDS])


class Transient(Exception):
    """A failure that may pass: a time-out, a server's error, or a page that is cut off."""


def load(address: str) -> dict:
    """A page as an object."""
    try:
        if address.startswith(("http://", "https://")):
            with urllib.request.urlopen(address, timeout=TIMEOUT) as r:  # noqa: S310 - the caller states the address
                text = r.read()
        else:
            system, path, _ = opened(address)
            with system.open_input_file(path) as f:
                text = f.read()
    except urllib.error.HTTPError as e:
        kind = Transient if e.code == 429 or e.code >= 500 else ValueError
        raise kind(f"status {e.code}") from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Transient(str(getattr(e, "reason", e))) from e
    try:
        page = json.loads(text)
    except ValueError as e:
        raise Transient("a page that is not whole") from e
    if not isinstance(page, dict):
        raise ValueError("a page that is no object")
    return page


def fetched(address: str, wait: float) -> dict:
    try:
        return load(address)
    except Transient:
        time.sleep(wait)
        return load(address)


def pages_behind(address: str, most: int, wait: float) -> tuple[list[dict], str | None]:
    """(pages, reason why they are not all) from the first page's address on."""
    pages: list[dict] = []
    while address:
        if len(pages) >= most:
            return pages, f"limit of {most} pages reached"
        try:
            page = fetched(address, wait)
        except (Transient, ValueError, OSError) as e:
            return pages, f"page {len(pages) + 1}: {e}"
        pages.append(page)
        after = page.get("next_url")
        address = urllib.parse.urljoin(address, after) if after else ""
    return pages, None


def contracts_of(page: dict) -> Iterator[tuple]:
    """(ticker, type, expiration, strike, volatility, delta, gamma, open interest, volume) with defaults."""
    for r in page.get("results") or []:
        details, greeks, day = r.get("details") or {}, r.get("greeks") or {}, r.get("day") or {}
        number = lambda x: None if x is None else float(x)
        yield details.get("ticker"), details.get("contract_type"), details.get("expiration_date"), number(details.get("strike_price")), number(r.get("implied_volatility")), number(greeks.get("delta")), number(greeks.get("gamma")), int(r.get("open_interest") or 0), int(day.get("volume") or 0)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, FIELDS, strict=True)], schema=ARROW)


@dataclass
class Chain(InputPartition):
    name: str
    first: str


@dataclass
class Landed(InputPartition):
    name: str
    files: list[str]
    seen: int


def numbers(path: str) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", path)]


def opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path in an address)."""
    if "://" in address:
        system, path = fs.FileSystem.from_uri(address)
        return system, path, address[: -len(path)] if address.endswith(path) else ""
    return fs.LocalFileSystem(), address.removeprefix("file:"), ""


def landed(folder: str) -> dict[str, list[str]]:
    """Chain -> addresses of its page files in order."""
    system, root, before = opened(folder)
    root, out = root.rstrip("/"), {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
        inside = f.path[len(root) + 1 :]
        if f.type == fs.FileType.File and "/" in inside and not any(x.startswith(("_", ".")) for x in inside.split("/")):
            out.setdefault(inside.split("/", 1)[0], []).append(f.path)
    # by the numbers of folders and file; a name that Spark gave says nothing
    order = lambda p: (numbers(p[len(root) :].split("part-")[0]), p)
    return {c: [before + p for p in sorted(files, key=order)] for c, files in sorted(out.items())}


class Reader(DataSourceReader):
    """Whole chains: a task follows one chain's cursor; pages in hand are bounded by ``maxPages``."""

    def __init__(self, options: dict):
        self.urls, self.path = json.loads(options.get("urls", "{}")), options.get("path")
        self.most, self.wait = int(options.get("maxpages", MAX_PAGES)), float(options.get("retryafter", RETRY_AFTER))

    def partitions(self) -> list[InputPartition]:
        if self.path:
            return [Landed(name, files, 0) for name, files in landed(self.path).items()]
        return [Chain(name, first) for name, first in sorted(self.urls.items())]

    def read(self, partition: Chain | Landed) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Chain):
            pages, reason = pages_behind(partition.first, self.most, self.wait)
        else:
            pages, reason = [], None
            for file in partition.files[: self.most]:
                try:
                    pages.append(fetched(file, self.wait))
                except (Transient, ValueError, OSError) as e:
                    reason = f"page {len(pages) + 1}: {e}"
                    break
            if reason is None and len(partition.files) > self.most:
                reason = f"limit of {self.most} pages reached"
        if reason is None and any(p.get("partial") for p in pages):
            reason = "a page says so"
        held: set[tuple] = set()
        for number, page in enumerate(pages, 1):
            rows = []
            for place, c in enumerate(contracts_of(page)):
                if c[:4] not in held:
                    held.add(c[:4])
                    rows.append((partition.name, number, place, *c, reason is not None, reason))
            yield batch(rows)


class Stream(DataSourceStreamReader):
    """Pages that have landed since the last batch; the checkpoint keeps how many of each chain were seen."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a stream of chains needs the landing folder as path")
        self.path, self.wait = options["path"], float(options.get("retryafter", RETRY_AFTER))

    def initialOffset(self) -> dict:  # noqa: N802 - named by Spark
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {name: len(files) for name, files in landed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = landed(self.path)
        return [Landed(name, files[name][start.get(name, 0) : n], start.get(name, 0)) for name, n in sorted(end.items()) if n > start.get(name, 0)]

    def read(self, partition: Landed) -> Iterator[pa.RecordBatch]:
        for number, file in enumerate(partition.files, partition.seen + 1):
            page = fetched(file, self.wait)
            partial = bool(page.get("partial"))
            yield batch([(partition.name, number, place, *c, partial, "a page says so" if partial else None) for place, c in enumerate(contracts_of(page))])


def lowered(options: Mapping[str, str]) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


class ChainSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "option_chain"

    def schema(self) -> str:
        return ", ".join(f"{n} {kind}" for n, _, kind in FIELDS)

    def reader(self, schema) -> Reader:
        return Reader(lowered(self.options))

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(lowered(self.options))
