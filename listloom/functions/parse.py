"""Parsers of markup, salaries, places, dates and feeds as Column builders."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import bound, has, pattern

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"')]


def _decoded(text: Column, n: int = 7) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES[:n], text)


def strip_html(html: Column) -> Column:
    """Plain text on one line."""
    t = F.regexp_replace(_decoded(F.coalesce(html, F.lit(""))), r"(?is)<style.*?</style>|<script.*?</script>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[\s ]+", " "))


def html_to_text(html: Column) -> Column:
    """Plain text with paragraphs and bullets."""
    h = F.coalesce(html, F.lit(""))
    h = F.when(~F.regexp_like(h, F.lit(r"<\w+")) & F.regexp_like(h, F.lit(r"&lt;\w+")), _decoded(h, 3)).otherwise(h)
    h = F.regexp_replace(_decoded(h), r"(?is)<(style|script).*?</\1>", "")
    h = F.regexp_replace(h, r"(?i)<li[^>]*>", "\n• ")
    h = F.regexp_replace(h, r"(?i)</(p|div|h[1-6]|ul|ol|tr)>|<br\s*/?>", "\n")
    h = F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", ""), r"[ \t]+", " ")
    h = F.regexp_replace(F.regexp_replace(h, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(h, r"^\s+|\s+$", "")


def salary_of(text: Column, country: Column) -> Column:
    """struct<min, max, currency, period> or null."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?i)(\d+(?:\.\d+)?k?)"), F.lit(1))
    return F.get(F.transform(F.array(found), lambda s: _salary(s, text, country)), F.lit(0))


def _salary(found: Column, text: Column, country: Column) -> Column:
    n = F.transform(found, lambda s: F.regexp_replace(s, "(?i)k$", "").cast("double") * F.when(F.lower(s).endswith("k"), 1000.0).otherwise(1.0))
    low, high = F.get(n, F.lit(0)), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0)))
    hourly = has(text, r"hour|hr|/h\b") | (F.array_max(n) < 500)
    return F.when(F.size(found) > 0, F.struct(
        low.alias("min"), high.alias("max"), F.when(country == "CA", "CAD").otherwise("USD").alias("currency"), F.when(hourly, "hourly").otherwise("yearly").alias("period")
    ))


def _map(d: dict[str, str]) -> Column:
    """A fixed map, as one text: a node for each key and value would make every plan that many times larger."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in d.items())), F.lit("\x01"), F.lit("\x02"))


def _codes(table: dict[str, str]) -> dict[str, str]:
    """Code by lower-case name or code."""
    return {n.lower(): c for c, n in table.items()} | {c.lower(): c for c in table}


def _part(names: Iterable[str]) -> str:
    """Pattern of the first part that is one of these names, in a text of parts between commas of their own (",a,,b,"). Names
    are told apart by their first letter."""
    by: dict[str, list[str]] = {}
    for n in names:
        by.setdefault(n[0], []).append(re.escape(n[1:]))
    return ",(?=[a-z])(" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by.items()) + "),"


def _named(parts: Column, table: dict[str, str]) -> Column:
    """What the first part that ``table`` knows stands for, or null."""
    return F.try_element_at(_map(table), F.regexp_extract(parts, _part(table), 1))


def region_code(raw: Column, country: Column) -> Column:
    """A code stays, a full name is looked up, anything else is ''."""

    def of(table: dict[str, str]) -> Column:
        return F.try_element_at(_map(_codes(table)), F.lower(F.trim(raw)))

    return F.coalesce(F.when(country == "CA", of(lx.PROVINCES)).otherwise(of(lx.STATES)), F.lit(""))


def regions_for(country: str) -> dict[str, str]:
    """P06."""
    return lx.PROVINCES if country == "CA" else lx.STATES if country == "US" else lx.PROVINCES | lx.STATES


_COUNTRIES = {"united states": "US", "united states of america": "US", "usa": "US", "us": "US", "u.s.": "US", "canada": "CA"}


def location_of(text: Column, hint: Column | None = None) -> Column:
    """struct<city, region, country> of "City, Region, Country" texts. Parts are found by patterns in one text rather than
    by functions over an array, which would be interpreted, and repeated wherever a step is used."""
    clean = F.btrim(F.regexp_replace(text, "(?<! ) *+,[ ,]*+", ","), F.lit(" ,"))
    city, last, three = F.substring_index(clean, ",", 1), F.substring_index(clean, ",", -1), F.substring_index(clean, ",", 2) != clean
    line = F.concat(F.lit(","), F.replace(clean, F.lit(","), F.lit(",,")), F.lit(","))
    said = F.coalesce(F.when(three & (F.lower(last) == "ca"), "CA"), _named(F.regexp_extract(F.lower(line), f"(?s).*({_part(_COUNTRIES)})", 1), _COUNTRIES))
    rest = F.substr(line, F.length(city) + 3)
    # the last part is no region if a country is named
    rest = F.lower(F.when(three & said.isNotNull(), F.replace(rest, F.concat(F.lit(","), last, F.lit(",")), F.lit(""))).otherwise(rest))
    # no name is one of both countries, so the first known one says both if no country is named
    ca, us = _codes(lx.PROVINCES), _codes(lx.STATES)
    first = _named(rest, {k: "CA" + c for k, c in ca.items()} | {k: "US" + c for k, c in us.items()})
    country = F.coalesce(said, F.substr(first, F.lit(1), F.lit(2)), F.lit("US") if hint is None else F.coalesce(hint, F.lit("US")))
    region = F.when(said.isNull(), F.substr(first, F.lit(3))).when(said == "CA", _named(rest, ca)).otherwise(_named(rest, us))
    return F.struct(F.coalesce(city, F.lit("")).alias("city"), F.coalesce(region, F.lit("")).alias("region"), country.alias("country"))


def remote_country(restrictions: Column) -> Column:
    """Country of a remote listing's location restriction; null where it is neither."""
    parts = F.filter(F.transform(F.split(F.coalesce(restrictions, F.lit("")), r"[,;/|]"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    anywhere = F.exists(parts, lambda p: F.regexp_like(p, F.lit("worldwide|anywhere|global|americas|canada")))
    us = F.exists(parts, lambda p: F.regexp_like(p, F.lit(pattern(r"^(usa?|u\.s\.|united states|north america)", False))))
    return F.when((F.size(parts) == 0) | anywhere, "CA").when(us, "US")


def epoch_millis(v: Column) -> Column:
    """Seconds or milliseconds."""
    return F.when(v < 1e12, v * 1000).otherwise(v)


def safe_timestamp(text: Column, now: Column) -> Column:
    """P10: what can't be read is now."""
    return F.coalesce(F.try_to_timestamp(text), now)


def xml_tag(block: Column, name: str) -> Column:
    """Text of an element, CDATA unwrapped."""
    inner = F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def labelled(text: Column, *labels: str) -> Column:
    """The value after the first label found, to the end of the line or a bar."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, rf"(?i){x}\s*:\s*([^\n|]+)", 1)), F.lit("")) for x in labels])


def required_years(text: Column) -> Column:
    """The smallest number of years asked for beside experience."""
    p = pattern(lx.REQUIRED_YEARS)
    n = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: s.cast("int"))
    return F.array_min(F.filter(n, lambda y: (y > 0) & (y <= 20)))


def resume_years(text: Column, this_year: Column) -> Column:
    """The largest claim, else the merged length of dated spans outside schooling."""
    claims = F.transform(
        F.regexp_extract_all(text, F.lit("(?i)" + lx.CLAIMED_YEARS), F.lit(1)),
        lambda s: s.cast("int"),
    )
    claim = F.array_max(F.filter(claims, lambda y: (y > 0) & (y <= 45)))
    # only lines with a year are looked at for schools
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[0-9]{4}")) & ~has(x, lx.SCHOOLING))
    texts = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit("(?i)" + lx.DATED_SPAN), F.lit(1))))
    spans = F.transform(
        texts,
        lambda s: F.struct(F.substring(s, 1, 4).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(s, r"(\d{4})$", 1), F.lit("")).cast("int"), this_year).alias("b")),
    )
    spans = F.array_sort(F.filter(spans, lambda s: (s["a"] <= s["b"]) & (s["b"] <= this_year + 1)))
    none = F.struct(F.lit(0).alias("total"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))
    merged = F.aggregate(
        spans,
        none,
        lambda m, x: F.when(m["s"].isNull(), F.struct(F.lit(0).alias("total"), x["a"].alias("s"), x["b"].alias("e")))
        .when(x["a"] <= m["e"], F.struct(m["total"].alias("total"), m["s"].alias("s"), F.greatest(m["e"], x["b"]).alias("e")))
        .otherwise(F.struct((m["total"] + m["e"] - m["s"]).alias("total"), x["a"].alias("s"), x["b"].alias("e"))),
        lambda m: F.least(F.lit(45), m["total"] + F.coalesce(m["e"] - m["s"], F.lit(0))),
    )
    return bound(F.coalesce(claim, merged), lambda best: F.when(best > 0, best))
