"""Text functions of the sources: option symbols, marked-up fields, numbers, formats and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references of feeds and what they stand for, in order.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def option_root(symbol: Column) -> Column:
    """Root of an option symbol: weekly index, index, else the letters before the first digit."""
    return F.when(symbol.startswith("O:SPXW"), "SPXW").when(symbol.startswith("O:SPX"), "SPX").otherwise(F.nullif(F.regexp_extract(symbol, r"^(?:O:)?([A-Z]+)[0-9]", 1), F.lit("")))


def unescaped(c: Column) -> Column:
    for name, out in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(out))
    return c


def tag_text(c: Column, tag: str) -> Column:
    """Content of the first element of a name, out of a character-data section if it is in one; null if there is none."""
    raw = F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
    return F.nullif(F.trim(unescaped(raw)), F.lit(""))


def leading_number(c: Column) -> Column:
    """The first number in a text as a double, with thousands separators taken out; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(",")), r"[-+]?[0-9]*\.?[0-9]+", 0), F.lit("")).try_cast("double")


def is_percent(c: Column) -> Column:
    return F.coalesce(c.contains("%"), F.lit(False))


def si_format(x: Column, digits: int = 1) -> Column:
    """1.2K, 3.4M, 5.6B; the sign is kept."""
    a = F.abs(x)
    part = lambda d, s: F.concat(F.format_number(x / F.lit(d), digits), F.lit(s))
    return F.when(a >= 1e9, part(1e9, "B")).when(a >= 1e6, part(1e6, "M")).when(a >= 1e3, part(1e3, "K")).otherwise(F.format_number(x, digits))


def embedded_object(c: Column) -> Column:
    """From the first opening to the last closing brace, without a code fence; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def narrative(c: Column) -> Column:
    """struct(headline, body, severity 0..3) of a model's JSON answer; long dashes become hyphens."""
    j = F.from_json(embedded_object(F.regexp_replace(c, "[–—]", "-")), "headline string, body string, severity double")
    return F.when(j["headline"].isNotNull(), F.struct(j["headline"].alias("headline"), j["body"].alias("body"), F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.coalesce(j["severity"], F.lit(0.0))))).cast("int").alias("severity")))


def significant(x: Column, digits: int) -> Column:
    """Rounded to significant digits, half up."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + F.lit(0.5)) / scale)


#: Start and factor of the three 32-bit lanes, and what a character is multiplied by in each.
LANES = (("a", 2166136261, 16777619, 1), ("b", 374761393, 2246822519, 31), ("c", 89568817, 3266489917, 17))


def lanes(c: Column) -> Column:
    """struct(a, b, c): three 32-bit hashes of a text by xor and multiplication; products are taken in halves, as 64 bits would overflow."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))

    def lane(start: int, factor: int, times: int) -> Column:
        def step(h: Column, code: Column) -> Column:
            x = h.bitwiseXOR(code * F.lit(times).cast("long"))
            high = F.shiftright(x, 16) * F.lit(factor).cast("long") % 65536 * 65536
            return (high + x.bitwiseAND(F.lit(65535).cast("long")) * F.lit(factor).cast("long")) % F.lit(1 << 32)

        return F.aggregate(codes, F.lit(start).cast("long"), step)

    return F.struct(*(lane(*how).alias(name) for name, *how in LANES))
