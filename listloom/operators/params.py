"""Request parameters as columns (P17, P20, T21): query strings of a whole table checked, defaulted, counted and written again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: parameters of a search with their defaults, in the order in which they are written, and what each may be
DEFAULTS = {
    "q": "", "country": "ALL", "region": "", "city": "", "industry": "all", "workType": "all", "employmentType": "all", "company": "", "minSalary": "", "maxSalary": "", "days": "", "from": "", "to": "",
    "level": "all", "skills": "", "certs": "", "tools": "", "sort": "relevance", "pageSize": "25", "inf": "", "boost": "", "hide": "", "sponsor": "", "hasSalary": "", "set": "",
}
INDUSTRIES = ["technology", "healthcare", "trades_construction", "finance_accounting", "sales_marketing", "education", "hospitality_tourism", "customer_service", "legal", "manufacturing_logistics", "other"]
WORK_TYPES = ["remote", "hybrid", "onsite"]
EMPLOYMENT_TYPES = ["full-time", "part-time", "contract", "internship", "temporary"]
SORTS = ["relevance", "newest", "oldest", "salary", "company", "resume"]
LEVELS = ["entry", "mid", "senior", "lead", "manager", "executive"]
AUTH = ["citizenship", "pr-or-citizen", "clearance", "no-sponsorship", "must-be-eligible"]
#: Not filters: how a page is shown.
SHOWN = ["sort", "pageSize", "inf"]


def _spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\xa0"))


def raw(url: Column) -> Column:
    """struct of all parameters as text: the last value of each in the query string, or its default. A name or value that
    isn't encoded well stays as it is, but for its plus signs."""
    query = F.concat(F.lit("&"), F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1), r"[\r\n]", ""))

    def value(name: str, default: str) -> Column:
        found = F.regexp_extract(query, f"^.*&{name}=([^&]*)", 1)
        said = F.coalesce(F.try_url_decode(found), F.replace(found, F.lit("+"), F.lit(" ")))
        return F.when(F.regexp_like(query, F.lit(f"&{name}=")), said).otherwise(default).alias(name)

    return F.struct(*[value(n, d) for n, d in DEFAULTS.items()])


def _number(c: Column) -> Column:
    """A finite number above 0, else null."""
    n = F.when(F.regexp_like(_spaces(c), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), _spaces(c).try_cast("double"))
    return F.when((n > 0) & (n < float("inf")), n)


def _one_of(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(default)


def _list(c: Column) -> Column:
    """P20: at most ten parts of at most 40 characters."""
    return F.slice(F.filter(F.transform(F.split(c, ","), lambda x: F.substring(_spaces(x), 1, 40)), lambda x: x != ""), 1, 10)


def parsed(p: Column, page: Column | None = None) -> Column:
    """Struct of typed, checked parameters from ``raw``; what isn't allowed falls back on the default."""

    def among(c: Column, allowed: list[str]) -> Column:
        return F.filter(_list(c), lambda x: x.isin(allowed))

    def clamped(c: Column, low: int, high: int, default: int) -> Column:
        n = F.when(F.regexp_like(_spaces(c), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), _spaces(c).try_cast("double"))
        return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.when(F.coalesce(n, F.lit(0.0)) == 0, float(default)).otherwise(F.least(n, F.lit(1e9)))))).cast("int")

    date = lambda c: F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), c)
    short = lambda c, n: _spaces(F.substring(c, 1, n))
    fields = {
        "q": short(p["q"], 120), "country": _one_of(p["country"], ["CA", "US"], "ALL"), "region": F.substring(F.regexp_replace(F.upper(p["region"]), "[^A-Z]", ""), 1, 2), "city": short(p["city"], 80),
        "industry": _one_of(p["industry"], INDUSTRIES, "all"), "work_type": _one_of(p["workType"], WORK_TYPES, "all"), "employment_type": _one_of(p["employmentType"], EMPLOYMENT_TYPES, "all"),
        "company": short(p["company"], 120), "level": _one_of(p["level"], LEVELS, "all"), "skills": _list(p["skills"]), "certs": _list(p["certs"]), "tools": _list(p["tools"]), "date_from": date(p["from"]),
        "date_to": date(p["to"]), "min_salary": _number(p["minSalary"]), "max_salary": _number(p["maxSalary"]), "days": _number(p["days"]), "sort": _one_of(p["sort"], SORTS, "relevance"),
        "boost": among(p["boost"], LEVELS), "hide_auth": among(p["hide"], AUTH), "sponsorship": p["sponsor"] == "1", "has_salary": p["hasSalary"] == "1",
        "page": clamped(F.lit("1") if page is None else page, 1, 1000, 1), "page_size": clamped(p["pageSize"], 5, 100, 25),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def active_filters(p: Column) -> Column:
    """How many filters are set."""
    on = [(p[n] != "") & (p[n] != "all") & (F.lit(n != "country") | (p[n] != "ALL")) for n in DEFAULTS if n not in SHOWN]
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in on])


def shortest(p: Column) -> Column:
    """The query string of the parameters that aren't at their default, or '' if all are."""
    parts = [F.when((p[n] != "") & (p[n] != d), F.concat(F.lit(n + "="), F.url_encode(p[n]))) for n, d in DEFAULTS.items()]
    said = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "&")
    return F.when(said != "", F.concat(F.lit("?"), said)).otherwise("")
