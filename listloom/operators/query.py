"""Faceted search over listings: parameters, filters, rankings, pages and facets."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, normalize_company, plain, plain_company
from . import params
from .search import Matcher

PRIORITY = 14  # sources, the employer's own first: a listing's ``prio`` is 0 to 13


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    country: str = "ALL"
    region: str = ""
    city: str = ""
    industry: str = "all"
    work_type: str = "all"
    employment_type: str = "all"
    company: str = ""
    level: str = "all"
    skills: tuple[str, ...] = ()
    certs: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    has_salary: bool = False
    min_salary: float | None = None
    max_salary: float | None = None
    hide_auth: tuple[str, ...] = ()
    sponsorship: bool = False
    within_days: float | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    boost: tuple[str, ...] = ()
    sort: str = "newest"
    page: int = 1
    page_size: int = 25


def parse_params(raw: dict[str, str]) -> SearchParams:
    """P17, P20 for one request: what isn't allowed falls back on the default; numbers are clamped. ``params.parsed`` does the
    same to a whole table."""
    get = lambda name, most: raw.get(name, "")[:most].strip()
    one = lambda name, allowed, default: raw[name] if raw.get(name) in allowed else default

    def number(name: str) -> float | None:
        try:
            n = float(raw.get(name, ""))
        except ValueError:
            return None
        return n if 0 < n < float("inf") else None

    def listed(name: str, allowed: list[str] | None = None) -> tuple[str, ...]:
        some = [x.strip()[:40] for x in raw.get(name, "").split(",") if x.strip()][:10]
        return tuple(x for x in some if allowed is None or x in allowed)

    def date(name: str) -> dt.date | None:
        try:
            return dt.date.fromisoformat(raw.get(name, "")) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw.get(name, "")) else None
        except ValueError:
            return None

    def whole(name: str, low: int, high: int, default: int) -> int:
        try:
            n = float(raw.get(name, "")) or default
        except ValueError:
            n = default
        return int(min(high, max(low, n // 1 if n == n else default)))

    return SearchParams(
        q=get("q", 120), country=one("country", ("CA", "US"), "ALL"), region=re.sub("[^A-Z]", "", raw.get("region", "").upper())[:2], city=get("city", 80), company=get("company", 120),
        industry=one("industry", params.INDUSTRIES, "all"), work_type=one("workType", params.WORK_TYPES, "all"), employment_type=one("employmentType", params.EMPLOYMENT_TYPES, "all"),
        level=one("level", params.LEVELS, "all"), skills=listed("skills"), certs=listed("certs"), tools=listed("tools"), has_salary=raw.get("hasSalary") == "1", min_salary=number("minSalary"),
        max_salary=number("maxSalary"), hide_auth=listed("hide", params.AUTH), sponsorship=raw.get("sponsor") == "1", within_days=number("days"), date_from=date("from"), date_to=date("to"),
        boost=listed("boost", params.LEVELS), sort=one("sort", params.SORTS, "relevance"), page=whole("page", 1, 1000, 1), page_size=whole("pageSize", 5, 100, 25),
    )


def company_matches(company: Column, wanted: str) -> Column:
    """equal, or one is the beginning of the other at a word. One pattern, so the name is normalised once."""
    words = plain_company(wanted).split()
    shorter = [" ".join(words[:k]) for k in range(1, len(words))]
    return F.regexp_like(normalize_company(company), F.lit(f"^(?:{'|'.join([' '.join(words) + ('(?: .*)?' if words else ''), *shorter])})$"))


def low_cad() -> Column:
    """The bottom of the range a year in CAD."""
    from .identity import yearly_cad

    return yearly_cad(F.col("salary_min"), F.col("salary_min"), F.col("currency"), F.col("period"))


def _all(column: str, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.col(column), F.array().cast("array<string>")))) == 0


def predicates(p: SearchParams, now: Column, matcher: Matcher | None = None) -> dict[str, Column]:
    """The conditions that aren't at their default, cheap ones first, by id."""
    cad = F.coalesce("yearly_cad", F.lit(0))
    out: dict[str, Column] = {}
    if p.country != "ALL":
        out["f01"] = F.col("country") == p.country
    if p.region:
        out["f02"] = (F.col("region") == p.region) | (F.col("is_remote") & (F.col("region") == ""))
    for key, column, value in (("f04", "industry", p.industry), ("f05", "work_type", p.work_type), ("f06", "employment_type", p.employment_type), ("f08", "seniority", p.level)):
        if value != "all":
            out[key] = F.coalesce(F.col(column) == value, F.lit(False))
    if p.has_salary:
        out["f12"] = cad != 0
    if p.min_salary:
        out["f13"] = cad >= p.min_salary
    if p.max_salary:
        out["f14"] = F.coalesce(low_cad() <= p.max_salary, F.lit(True))
    if p.within_days:
        out["f17"] = F.col("posted_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(p.within_days * 86400))
    if p.date_from:
        out["f18"] = F.col("posted_at") >= F.lit(f"{p.date_from} 00:00:00").cast("timestamp_ntz")
    if p.date_to:
        out["f19"] = F.col("posted_at") <= F.lit(f"{p.date_to} 23:59:59").cast("timestamp_ntz")
    if p.city:
        out["f03"] = normalize(F.col("city")).contains(plain(p.city))
    if p.company:
        out["f07"] = company_matches(F.col("company"), p.company)
    for key, column, wanted in (("f09", "skills", p.skills), ("f10", "certifications", p.certs), ("f11", "tools", p.tools)):
        if wanted:
            out[key] = _all(column, wanted)
    if p.hide_auth:
        out["f15"] = ~F.coalesce(F.arrays_overlap("auth", F.array(*map(F.lit, p.hide_auth))), F.lit(False))
    if p.sponsorship:
        out["f16"] = F.coalesce(F.array_contains("auth", "sponsorship"), F.lit(False))
    if matcher and not matcher.empty:
        out["f20"] = matcher.test(F.col("hay"), F.col("tags"))
    return out


def apply_filters(listings: DataFrame, p: SearchParams, now: Column, matcher: Matcher | None = None) -> DataFrame:
    for condition in predicates(p, now, matcher).values():
        listings = listings.filter(condition)
    return listings


def relevance(now: Column, matcher: Matcher | None = None, boost: tuple[str, ...] = ()) -> Column:
    """O06."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 86_400e6
    score = F.greatest(F.lit(0.0), 30 - age) + F.when(F.coalesce("salary_max", "salary_min").isNotNull(), 5).otherwise(0) + F.col("prio")
    if matcher and not matcher.empty:
        score = score + 20 * matcher.title_hits(normalize(F.col("title")))
    if boost:
        level = F.coalesce("seniority", F.lit(""))
        score = score + F.when(level.isin(*boost), 12).when(level.isin("lead", "manager", "executive"), -8).otherwise(0)
    return score


def order(p: SearchParams, now: Column, matcher: Matcher | None = None, match: Column | None = None) -> list[Column]:
    """Canada first, then the sort, then snapshot order."""
    keys = {
        "newest": [F.desc("posted_at")], "oldest": [F.asc("posted_at")], "salary": [F.coalesce("yearly_cad", F.lit(0)).desc(), F.desc("posted_at")],
        "company": [F.collate("company", "UNICODE").asc()], "relevance": [relevance(now, matcher, p.boost).desc()], "resume": [match.desc(), F.desc("posted_at")] if match is not None else [],
    }[p.sort]
    return [(F.col("country") != "CA").asc(), *keys, F.asc("pos")]


def page(filtered: DataFrame, p: SearchParams, now: Column, matcher: Matcher | None = None, match: Column | None = None) -> DataFrame:
    """One page: a top-k of page * size rows, of which the last are taken."""
    return filtered.orderBy(*order(p, now, matcher, match)).offset((p.page - 1) * p.page_size).limit(p.page_size)


def facets(filtered: DataFrame, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Facet, key, count over all filtered rows; empty keys don't count. One pass, one aggregate."""
    one = [F.array(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("")).alias("key"))) for c in scalars]

    def keys(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("facet"), x.alias("key")))

    many = [keys(c) for c in arrays]
    pairs = filtered.select(F.explode(F.concat(*one, *many)).alias("f")).select("f.*")
    return pairs.filter("key <> ''").groupBy("facet", "key").agg(F.count("*").alias("count"))


def append_page(shown: DataFrame, more: DataFrame) -> DataFrame:
    """O09."""
    return shown.unionByName(more.join(shown.select("id"), "id", "left_anti"))


def new_since(listings: DataFrame, sets: dict[str, tuple[Matcher, str]]) -> DataFrame:
    """Set, new: listings posted after each saved search was last seen that match it. One pass for all sets."""
    counts = [F.count_if((F.col("posted_at") > F.lit(seen).cast("timestamp_ntz")) & m.test(F.col("hay"), F.col("tags"))).alias(name) for name, (m, seen) in sets.items()]
    row = listings.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("set"), F.col(n).alias("new")) for n in sets])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


@dataclass
class Response:
    """Q/F/O/A together: the answer of a search, as lazy frames over one filtered frame."""

    page: DataFrame
    total: DataFrame
    facets: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def search(listings: DataFrame, p: SearchParams, now: Column, matcher: Matcher | None = None) -> Response:
    filtered = apply_filters(listings, p, now, matcher)
    return Response(page(filtered, p, now, matcher), filtered.agg(F.count("*").alias("total")), facets(filtered, ["industry", "region", "seniority"], ["skills", "certifications", "tools"]))
