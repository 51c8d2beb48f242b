"""URL rules indexed by their rarest literal token, in DataFrame functions only.

Every rule names the literal tokens that any URL it fits must hold as whole
tokens. The index is a table: each rule is filed under the one of its tokens that
is rarest among the URLs. The tokens of a URL are joined to it and so fetch the
candidate rules; only those run their regular expression, and the best one that
fits is kept. Any number of rules is one table; Spark broadcasts it while its
written size is under the session's threshold and shuffles by token beyond.
"""

from __future__ import annotations

import dataclasses
import re
import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace

TOKEN_SPLIT = "[^a-z0-9]+"
RULE_SCHEMA = "rank int, name string, action string, pattern string, tokens array<string>"


@dataclasses.dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path. ``tokens`` are whole lower-case tokens it implies. Higher ``rank`` wins; at rank 0 a rule gives a verdict and no name."""

    rank: int
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ ])", r"\\\1", text)


def tokens_in(text: str) -> list[str]:
    return [t for t in re.split(TOKEN_SPLIT, text.lower()) if t]


def host_rule(action: str, rule: str) -> UrlRule:
    """``host/path`` fits the host and its subdomains if the path starts with the rule's; longer ranks higher."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = re.split(TOKEN_SPLIT, path.lower())[:-1]  # the last may go on in the URL
    behind = quoted(path) if path else r"(?:/|\z)"
    return UrlRule(len(rule), rule, action, rf"^(?:[^/]*\.)?{quoted(host)}{behind}", tuple(tokens_in(host) + [t for t in whole if t]))


def word_rule(action: str, *words: str) -> UrlRule:
    """A host with these words side by side between dots, hyphens or its ends; joined words are a token of their own, so such a rule of several has none."""
    body = "-?".join(map(quoted, words))
    return UrlRule(0, "-".join(words), action, rf"^(?:[^/]*[.-])?{body}(?:[./-]|\z)", words if len(words) == 1 else ())


#: The method's own verdicts where no listed rule fits: words of hosts that are kept out of training data, by kind.
KINDS = {
    "gambling": ("bets", "betting", "bingo", "blackjack", "casino", "casinos", "gambling", "jackpot", "lottery", "poker", "roulette", "slots", "sportsbook"),
    "adult": ("adult", "camgirls", "escort", "escorts", "hentai", "nude", "nudes", "porn", "porno", "sex", "xxx"),
    "drugs": ("cialis", "pills", "steroids", "tramadol", "viagra", "xanax"),
    "spam": ("clickbait", "freemoney", "getrichquick", "linkfarm", "spam"),
    "adverts": ("adserver", "adservice", "adtech", "clicktracker", "doubleclick"),
    "piracy": ("crackz", "cracks", "keygen", "keygens", "serialz", "torrent", "torrents", "warez"),
    "fraud": ("botnet", "carding", "malware", "phishing", "ransomware", "scam"),
}
DEFAULT_RULES = tuple(word_rule("block", w) for kind in KINDS.values() for w in kind)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds _host and _path: both empty where the URL is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    behind = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return df.withColumns({"_host": ascii_lower(raw), "_path": F.regexp_extract(behind, "^[^?#]*", 0)})


def tokens_of(subject: Column) -> Column:
    """Distinct tokens, and the empty one, under which rules without a token are filed."""
    return F.array_union(F.split(ascii_lower(subject), TOKEN_SPLIT), F.array(F.lit("")))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """The rules as rows, from one literal that Spark's JSON functions read."""
    listed = json.dumps([{"rank": r.rank, "name": r.name, "action": r.action, "pattern": r.pattern, "tokens": list(r.tokens)} for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<{RULE_SCHEMA}>>")))


def filed(rules: DataFrame, held: DataFrame) -> DataFrame:
    """The index: every rule with the one of its tokens that fewest of ``held`` (subject, token) rows have; ties by length, then text."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = held.join(wanted, "token", "left_semi").groupBy("token").count()
    filing = rules.withColumn("token", F.explode_outer("tokens")).join(counts, "token", "left")
    order = F.struct(F.coalesce("count", F.lit(0)), -F.length("token"), "token")
    return filing.groupBy("rank", "name", "action", "pattern").agg(F.coalesce(F.min_by("token", order), F.lit("")).alias("token"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (the highest listed rule that fits, else null), verdict.

    ``rules`` has the columns of ``RULE_SCHEMA``. A null URL and one without
    ``://`` have empty host and path and are allowed, as is what no rule fits.
    Rules of equal rank are taken in order of their text, the last wins. URLs are
    read whole, however long. Null ids are kept, repeated rows repeat, an empty
    table gives no rows, an empty rule table allows all; other columns are not
    read. Each distinct URL is judged once.
    """
    work = Workspace(pages.sparkSession, "urls")
    parts = with_parts(pages.select(id_col, url_col), url_col).withColumn("_subject", F.concat("_host", "_path"))
    subjects = parts.where("_subject <> ''").select(F.col("_subject").alias("subject")).distinct()
    held = work.save(subjects, "subjects").select("subject", F.explode(tokens_of(F.col("subject"))).alias("token"))
    index = work.save(filed(rules, held), "index")
    fits = held.join(index, "token").where(F.regexp_like("subject", F.col("pattern")))
    best = fits.groupBy("subject").agg(F.max(F.struct("rank", "name", "action")).alias("best"))
    # written before it is joined, so that one URL on a large share of the rows is split over tasks
    best = work.save(best.toDF("_subject", "_best"), "best")
    return parts.join(best, "_subject", "left").select(
        id_col,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best.rank") > 0, F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit("allow")).alias("verdict"),
    )
