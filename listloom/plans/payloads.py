"""Queries of the payload parsers: bodies as the sources would send them are made from the listings, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..operators import identity, query, resume, tracker
from ..sources import files, parsers
from ..storage import once, stored
from . import views as v
from .catalog import _KEY, T_NOW, _with, register
from .views import NOW, listings, now, tables

#: Place of a listing as a source names it, and the region it stands for: the same expressions for both.
_PLACE = "CASE id % 4 WHEN 0 THEN 'Guelph, ON' WHEN 1 THEN 'Boise, ID' WHEN 2 THEN 'Laval, Quebec' ELSE 'Austin, Texas, US' END"
_REGION = "CASE id % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'ID' WHEN 2 THEN 'QC' ELSE 'TX' END"
_CITY = "CASE id % 4 WHEN 0 THEN 'Guelph' WHEN 1 THEN 'Boise' WHEN 2 THEN 'Laval' ELSE 'Austin' END"
_TITLE = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
_URL = "'https://jobs.example/' || id"


def _raw(spark, sf) -> DataFrame:
    return listings(spark, sf).withColumn("place", F.expr(_PLACE)).withColumn("url", F.concat(F.lit("https://jobs.example/"), F.col("id").cast("string")))


def _body(df: DataFrame, items: str, item: Column) -> DataFrame:
    """One body for each row."""
    return df.select(F.to_json(F.struct(F.array(item).alias(items))).alias("body"))


@register("s03_posted_search", _with(f"SELECT {_TITLE} AS title, company, CASE WHEN id % 4 IN (0, 2) THEN 'CA' ELSE 'US' END AS country, salary_min AS low, {_REGION} AS region, {_URL} AS apply_url FROM L"))
def s03(spark, sf):
    df = _raw(spark, sf)
    item = F.struct("title", F.col("place").alias("location"), F.lit("text").alias("snippet"), F.concat(F.lit("$"), F.col("salary_min").cast("long").cast("string"), F.lit(" a year")).alias("salary"), F.col("url").alias("link"), "company")
    # a call for each country
    parts = [parsers.jooble(_body(df.filter(half), "jobs", item), country, now()) for half, country in (("id % 4 in (0, 2)", "CA"), ("id % 4 in (1, 3)", "US"))]
    return parts[0].unionByName(parts[1]).select("title", "company", "country", F.col("salary.min").alias("low"), "region", "apply_url")


@register("s04_search_shapes", _with(f"SELECT {_TITLE} AS title, CASE WHEN country = 'CA' THEN 'ON' ELSE 'TX' END AS region, country, len(p) AS options, p[1] AS first FROM (SELECT *, CASE id % 3 WHEN 0 THEN ['Company site (Acme jobs)', 'Indeed'] WHEN 1 THEN ['Indeed'] ELSE ['Company site (Acme jobs)'] END AS p FROM L)"))
def s04(spark, sf):
    option = lambda name, url, direct: F.struct(F.lit(name).alias("publisher"), url.alias("apply_link"), F.lit(direct).alias("is_direct"))
    indeed, own = F.concat(F.lit("https://www.indeed.com/"), F.col("id").cast("string")), F.concat(F.lit("https://acme.example/"), F.col("id").cast("string"))
    more = F.when(F.col("id") % 3 == 0, F.array(option("Acme jobs", own, True)))
    item = F.struct(
        F.col("title").alias("job_title"), F.col("company").alias("employer_name"), F.when(F.col("country") == "CA", "Ontario").otherwise("tx").alias("job_state"), F.col("country").alias("job_country"),
        F.when(F.col("id") % 3 == 2, own).otherwise(indeed).alias("job_apply_link"), F.when(F.col("id") % 3 == 2, "Acme jobs").otherwise("Indeed").alias("job_publisher"), (F.col("id") % 3 == 2).alias("job_apply_is_direct"), more.alias("apply_options"),
    )
    rows = listings(spark, sf).withColumn("item", F.array(item))
    shapes = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("item").alias("data")))).otherwise(F.to_json(F.struct(F.struct(F.col("item").alias("jobs")).alias("data"))))
    return parsers.jsearch(rows.select(shapes.alias("body")), now()).select("title", "region", "country", F.size("apply_options").cast("long").alias("options"), F.get("apply_options", F.lit(0))["portal"].alias("first"))


@register("s05_federal_jobs", _with(f"SELECT {_TITLE} AS title, company, {_REGION} AS region, salary_min AS low, CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN period END AS period FROM L"))
def s05(spark, sf):
    pay = F.struct(F.col("salary_min").cast("string").alias("MinimumRange"), F.col("salary_max").cast("string").alias("MaximumRange"), F.when(F.col("period") == "hourly", "PH").otherwise("PA").alias("RateIntervalCode"))
    item = F.struct(F.struct(
        F.col("title").alias("PositionTitle"), F.col("company").alias("OrganizationName"), F.array("url").alias("ApplyURI"), F.array(F.struct(F.col("place").alias("LocationName"))).alias("PositionLocation"), F.array(pay).alias("PositionRemuneration")
    ).alias("MatchedObjectDescriptor"))
    df = _raw(spark, sf).select(F.to_json(F.struct(F.struct(F.array(item).alias("SearchResultItems")).alias("SearchResult"))).alias("body"))
    return parsers.usajobs(df, now()).select("title", "company", "region", F.col("salary.min").alias("low"), F.col("salary.period").alias("period"))


@register("s06_feed_items", _with(f"SELECT split_part({_TITLE}, ' - ', 1) AS title, company, 'ON' AS region, {_URL} || '?' AS apply_url FROM L"))
def s06(spark, sf):
    df = _raw(spark, sf)
    body = F.concat(F.lit("<rss><item><title>"), "title", F.lit(" - Town (ON)</title><link>"), "url", F.lit(";jsessionid=1?</link><description><![CDATA[Employer: "), "company", F.lit(" | Location: Guelph, ON]]></description></item></rss>"))
    return parsers.feed(df.select(body.alias("body")), now()).select("title", "company", "region", "apply_url")


_SAID = "CASE id % 5 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'USA' WHEN 2 THEN 'Germany' WHEN 3 THEN 'Canada, US' ELSE 'North America' END"
_LAND = "CASE id % 5 WHEN 0 THEN 'CA' WHEN 3 THEN 'CA' ELSE 'US' END"


@register("s07_remote_feed", _with(f"SELECT {_TITLE} AS title, company, {_LAND} AS country, 'remote' AS work_type, {_URL} AS apply_url FROM L WHERE id % 5 <> 2"))
def s07(spark, sf):
    df = _raw(spark, sf).withColumn("said", F.expr(_SAID))
    item = F.struct("url", "title", F.col("company").alias("company_name"), F.col("said").alias("candidate_required_location"), F.lit("").alias("salary"), F.lit("text").alias("description"))
    return parsers.remotive(_body(df, "jobs", item), now()).select("title", "company", "country", "work_type", "apply_url")


@register("s08_remote_search", _with(f"SELECT {_TITLE} AS title, {_LAND} AS country, salary_min AS low, strftime(make_timestamp((1700000000 + id) * 1000000), '%Y-%m-%d') AS posted FROM L WHERE id % 5 <> 2"))
def s08(spark, sf):
    df = _raw(spark, sf).withColumn("said", F.expr(_SAID))
    at = F.when(F.col("id") % 2 == 0, 1_700_000_000 + F.col("id")).otherwise((1_700_000_000 + F.col("id")) * 1000)
    item = F.struct("title", F.col("company").alias("companyName"), F.array("said").alias("locationRestrictions"), F.col("salary_min").alias("minSalary"), at.alias("pubDate"), F.col("url").alias("applicationLink"))
    return parsers.himalayas(_body(df, "jobs", item), now()).select("title", "country", F.col("salary.min").alias("low"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


def _boards(df: DataFrame) -> dict[str, DataFrame]:
    """A board's body for each listing, by source."""
    parts = F.split("place", ", ")
    city, region = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    land = F.when(F.col("id") % 4 == 1, "US").when(F.col("id") % 4 == 3, "US").otherwise("CA")
    far = F.lit(False)
    items = {
        "greenhouse": ("jobs", F.struct("title", F.struct(F.col("place").alias("name")).alias("location"), F.col("url").alias("absolute_url"))),
        "ashby": ("jobs", F.struct("title", F.col("place").alias("location"), F.col("url").alias("jobUrl"), far.alias("isRemote"))),
        "smartrecruiters": ("content", F.struct(F.col("title").alias("name"), F.col("url").alias("ref"), F.struct(city.alias("city"), region.alias("region"), F.lower(land).alias("country"), far.alias("remote")).alias("location"))),
        "workable": ("jobs", F.struct("title", far.alias("telecommuting"), F.col("url").alias("application_url"), F.array(F.struct(city.alias("city"), region.alias("region"), land.alias("countryCode"))).alias("locations"))),
        "recruitee": ("offers", F.struct("title", city.alias("city"), region.alias("state_code"), land.alias("country_code"), F.col("url").alias("careers_url"))),
    }
    out = {k: _body(df, name, item) for k, (name, item) in items.items()}
    lever = F.struct(F.col("title").alias("text"), F.struct(F.col("place").alias("location")).alias("categories"), F.col("url").alias("hostedUrl"))
    return {**out, "lever": df.select(F.to_json(F.array(lever)).alias("body"))}


@register("s09_boards", _with(f"SELECT s AS source, {_TITLE} AS title, {_CITY} AS city, {_REGION} AS region, 'Acme' AS company, {_URL} AS apply_url FROM L, (VALUES ('greenhouse'), ('lever'), ('ashby'), ('smartrecruiters'), ('workable'), ('recruitee')) t(s)"))
def s09(spark, sf):
    rows = stored(_raw(spark, sf).select("id", "title", "place", "url"), "boards")  # joined once, not once a board
    bodies = {k: once(df, "body", F.col("body")) for k, df in _boards(rows).items()}
    return parsers.boards(bodies, "Acme", now()).select("source", "title", "city", "region", "company", "apply_url")


_ALIASED = """'{"Job ' || c_custkey || '": ["' || lower(c_mktsegment) || ' ' || c_custkey || '", "j' || c_custkey || '"], "none ' || c_custkey || '": []}'"""


@register("s19_aliases", "SELECT 'Job ' || c_custkey AS canon, unnest([lower(c_mktsegment) || ' ' || c_custkey, 'j' || c_custkey]) AS variant FROM customer")
def s19(spark, sf):
    (customer,) = tables(spark, sf, "customer")
    return files.aliases(customer.select(F.expr(_ALIASED).alias("body")))


@register("s20_companies", "SELECT company, min(n) AS pos FROM (SELECT s_suppkey AS n, 'Acme ' || (s_suppkey % 7) AS company FROM supplier WHERE s_suppkey % 5 <> 0) GROUP BY company")
def s20(spark, sf):
    (supplier,) = tables(spark, sf, "supplier")
    name = F.concat(F.lit(" Acme "), (F.col("s_suppkey") % 7).cast("string"), F.lit(" "))
    lines = supplier.select(F.col("s_suppkey").alias("n"), F.when(F.col("s_suppkey") % 5 == 0, "# a note").otherwise(name).alias("line"))
    return files.company_file(lines)


_GATE = "CASE c_custkey % 6 WHEN 0 THEN 'Toronto, ON' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Berlin, Germany' WHEN 3 THEN 'Remote - Canada' WHEN 4 THEN 'Paris, US' ELSE 'Lyon, Remote' END"


@register("p07_place_gate", f"SELECT c_custkey, far OR ((contains(place, ',') OR country OR remote) AND (region OR country OR remote)) AS accepted FROM (SELECT c_custkey, place, c_custkey % 10 = 1 AS far, regexp_matches(place, '\\b(canada|united states|usa|us|ca)\\b', 'i') AS country, regexp_matches(place, '\\bremote\\b', 'i') AS remote, regexp_matches(place, ', ON$') AS region FROM (SELECT c_custkey, {_GATE} AS place FROM customer))")
def p07(spark, sf):
    (customer,) = tables(spark, sf, "customer")
    return customer.select("c_custkey", parsers.accepts(F.expr(_GATE), F.col("c_custkey") % 10 == 1).alias("accepted"))


@register("p10_dates", f"SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN {T_NOW} ELSE o_orderdate + to_seconds(o_orderkey % 86400) END, '%Y-%m-%d %H:%M:%S') AS said FROM orders")
def p10(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400), "yyyy-MM-dd'T'HH:mm:ss"))
    return orders.select("o_orderkey", F.date_format(parse.safe_timestamp(said, now().cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("said"))


@register("p11_markup_values", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, url || ' ' || page_id AS place FROM pages")
def p11(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    note = F.concat(F.lit("Pay: x | LOCATION :  "), F.col("url"), F.lit(" "), F.col("page_id").cast("string"), F.lit("  \nend"))
    return pages.select("page_id", parse.xml_tag(F.col("html"), "title").alias("title"), parse.labelled(note, "Place", "Location").alias("place"))


_A, _B, _C, _D = "2000 + id % 10", "2000 + id % 10 + id % 5", "2004 + id % 7", "2004 + id % 7 + id % 4"


@register("p15_resume_years", _with(f"SELECT id, CASE WHEN id % 11 = 0 THEN 3 WHEN n > 0 THEN CAST(n AS INT) END AS years FROM (SELECT id, CASE WHEN s2 <= e1 THEN greatest(e1, e2) - s1 ELSE e1 - s1 + e2 - s2 END AS n FROM (SELECT id, CASE WHEN (a, b) <= (c, d) THEN a ELSE c END AS s1, CASE WHEN (a, b) <= (c, d) THEN b ELSE d END AS e1, CASE WHEN (a, b) <= (c, d) THEN c ELSE a END AS s2, CASE WHEN (a, b) <= (c, d) THEN d ELSE b END AS e2 FROM (SELECT id, {_A} AS a, {_B} AS b, {_C} AS c, {_D} AS d FROM L)))"))
def p15(spark, sf):
    year = lambda x: F.expr(x).cast("string")
    claim = F.when(F.col("id") % 11 == 0, "3 years of experience\n").otherwise("")
    text = F.concat(claim, F.lit("Acme "), year(_A), F.lit(" - "), year(_B), F.lit("\nBeta "), year(_C), F.lit(" to "), year(_D), F.lit("\nCollege 1980 - 1999"))
    return listings(spark, sf).select("id", parse.resume_years(text, F.lit(2024)).alias("years"))


_LINK = "CASE id % 3 WHEN 0 THEN 'https://jobs.lever.co/a/' WHEN 1 THEN 'https://www.linkedin.com/jobs/' ELSE 'https://work.example/' END"


@register("d02_finalize", _with(f"SELECT id AS row_id, {_KEY} AS id, CASE id % 3 WHEN 0 THEN 'Company site (Lever)' WHEN 1 THEN 'LinkedIn' ELSE CASE source WHEN 'adzuna' THEN 'Adzuna' WHEN 'jooble' THEN 'Jooble' ELSE 'Company site (work.example)' END END AS portal, yearly_cad FROM L"))
def d02(spark, sf):
    pay = F.struct(F.col("salary_min").cast("double").alias("min"), F.col("salary_max").cast("double").alias("max"), "currency", "period")
    rows = listings(spark, sf).select(
        F.col("id").alias("row_id"), F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"), "company", "city", "region", "country", F.col("body").alias("description"), F.lit(None).cast("string").alias("snippet"),
        F.concat(F.expr(_LINK), F.col("id").cast("string")).alias("apply_url"), F.lit(None).cast(f"array<{identity.OPTION}>").alias("apply_options"), F.when(F.coalesce("salary_min", "salary_max").isNotNull(), pay).alias("salary"), "source",
    )
    return identity.finalize(rows).select("row_id", "id", F.get("apply_options", F.lit(0))["portal"].alias("portal"), F.col("salary_yearly_cad").alias("yearly_cad"))


@register("d09_tagged", _with(f"SELECT id, CASE WHEN t <> '' THEN t END AS tags, '{NOW}' AS seen FROM (SELECT id, array_to_string(list_filter([CASE WHEN {v.phrase_sql('h', 'registered nurse')} OR {v.phrase_sql('h', 'rn')} OR {v.phrase_sql('h', 'nurse')} THEN 'registered nurse' END, CASE WHEN {v.phrase_sql('h', 'soc analyst')} THEN 'soc analyst' END], lambda x: x IS NOT NULL), '|') AS t FROM (SELECT id, {v.norm_sql('title || chr(32) || body')} AS h FROM L))"))
def d09(spark, sf):
    rows = listings(spark, sf).select("id", "title", F.lit(None).cast("string").alias("snippet"), F.col("body").alias("description"), F.lit(NOW).alias("seen"))
    return identity.tagged(rows, ["registered nurse", "soc analyst"], {"registered nurse": ["rn", "nurse"]}).select("id", F.array_join("tags", "|").alias("tags"), "seen")


@register("o04_company_page", _with("SELECT id, nth FROM (SELECT id, row_number() OVER (ORDER BY country <> 'CA', company, pos) AS nth FROM L) WHERE nth <= 25"))
def o04(spark, sf):
    from pyspark.sql import Window

    p = query.SearchParams(sort="company")
    return query.page(listings(spark, sf), p, now()).withColumn("nth", F.row_number().over(Window.orderBy(*query.order(p, now())))).select("id", "nth")  # 25 rows


@register("o05_resume_page", _with("SELECT id, nth FROM (SELECT id, row_number() OVER (ORDER BY country <> 'CA', list_contains(skills, 'Python')::INT + list_contains(tools, 'AWS')::INT DESC, posted_at DESC, pos) AS nth FROM L) WHERE nth <= 25"))
def o05(spark, sf):
    from pyspark.sql import Window

    p, have = query.SearchParams(sort="resume"), F.array(F.lit("Python"), F.lit("AWS"))
    rows = listings(spark, sf).withColumn("fit", resume.match_score(F.concat("skills", "tools"), have, F.array().cast("array<string>"), F.array().cast("array<string>"))["score"])
    out = query.page(rows, p, now(), match=F.col("fit"))
    return out.withColumn("nth", F.row_number().over(Window.orderBy(*query.order(p, now(), match=F.col("fit"))))).select("id", "nth")


@register("o14_tracker_order", _with("SELECT id, row_number() OVER (ORDER BY coalesce(u, posted_at) DESC, id) AS nth FROM (SELECT id, posted_at, CASE WHEN id % 3 = 0 THEN TIMESTAMP '1999-01-01' END AS u FROM L) QUALIFY nth <= 50"))
def o14(spark, sf):
    from pyspark.sql import Window

    rows = listings(spark, sf).select("id", F.col("posted_at").alias("at"), F.when(F.col("id") % 3 == 0, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).alias("updated_at"))
    first = tracker.tracker_order(rows).limit(50)
    return first.withColumn("nth", F.row_number().over(Window.orderBy(F.coalesce("updated_at", "at").desc(), "id"))).select("id", "nth")  # 50 rows


_RESUME = "'Python and AWS; led a team. SIEM, CISSP.'"


def _hits(lexicon: list, soft: bool) -> str:
    from ..functions import lexicons as lx
    from ..functions.text import entry

    kept = [(n, p) for n, p in map(entry, lexicon) if (n in lx.SOFT_SKILLS) == soft]
    return ", ".join(f"CASE WHEN {v.rlike_sql('jd', p)} THEN {v.quoted(n)} END" for n, p in kept)


def _skills_sql() -> str:
    from ..functions import lexicons as lx

    every = [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]
    join = lambda x: f"array_to_string(list_sort(list_filter([{x}], lambda x: x IS NOT NULL)), '|')"
    return _with(f"SELECT id, {join(_hits(every, False))} AS hard, {join(_hits(lx.SKILLS, True))} AS soft FROM (SELECT id, title || chr(10) || body AS jd FROM L)")


@register("r02_skills", _skills_sql())
def r02(spark, sf):
    jd, own = F.concat_ws("\n", "title", "body"), F.expr(_RESUME)
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["term"])), "|")
    return listings(spark, sf).select("id", names(resume.hard_skills(jd, own)).alias("hard"), names(resume.soft_skills(jd, own)).alias("soft"))


_ASKED = f"list_min(list_filter(list_transform(regexp_extract_all(body, {v.quoted('(?i)' + classify.lx.REQUIRED_YEARS)}, 1), lambda s: CAST(s AS INT)), lambda y: y > 0 AND y <= 20))"
_LEVEL = "CASE " + " ".join(f"WHEN {v.rlike_sql('body', p)} THEN {k}" for _, p, k in classify.lx.EDUCATION) + " END"


@register("r07_asked_and_had", _with(f"SELECT id, asked <= 3 AS years_ok, lvl <= 2 AS degree_ok FROM (SELECT id, {_ASKED} AS asked, {_LEVEL} AS lvl FROM L)"))
def r07(spark, sf):
    own = F.lit("BSc; 3 years of experience")
    rows = listings(spark, sf).select("id", "body", parse.required_years(F.col("body")).alias("asked"))
    return rows.select("id", resume.experience(F.col("asked"), parse.resume_years(own, F.lit(2024))).alias("years_ok"), resume.education(F.col("body"), own).alias("degree_ok"))


_ROLES = ", ".join(f"CASE WHEN {' OR '.join(v.phrase_sql('h', text.plain(x)) for x in text.variants(k, v.ALIASES))} THEN {v.quoted(k)} END" for k in v.KEYWORDS)


@register("c12_profile", _with("SELECT id, array_to_string({0}, '|') AS skills, array_to_string({1}, '|') AS tools, array_to_string({2}, '|') AS certs, array_to_string(list_filter([{3}], lambda x: x IS NOT NULL), '|') AS roles FROM (SELECT *, {4} AS h FROM L)".format(*(v.extract_sql(x, "body", n) for x, n in ((classify.lx.SKILLS, 50), (classify.lx.TOOLS, 60), (classify.lx.CERTIFICATIONS, 30))), _ROLES, v.norm_sql("body"))))
def c12(spark, sf):
    p = classify.profile(F.col("body"), v.KEYWORDS, v.ALIASES)
    return listings(spark, sf).select("id", p.alias("p")).select("id", *[F.array_join(f"p.{c}", "|").alias(c) for c in ("skills", "tools", "certs", "roles")])
