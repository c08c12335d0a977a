"""Payload parsers (S01-S16): one row of raw JSON (``body``) in, listing rows out. Schemas are explicit; a payload that can't
be read gives no rows. Reading from the network is the caller's task: any source that yields bodies will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..operators import identity
from ..operators.identity import OPTION
from ..storage import once

LISTING = ["title", "company", "city", "region", "country", "is_remote", "work_type", "employment_type", "industry", "description", "snippet", "apply_url", "posted_at", "salary", "source", "apply_options"]


def _rows(raw: DataFrame, schema: str, items: str) -> DataFrame:
    """One row an item of the array at ``items``."""
    return raw.select(F.from_json("body", schema).alias("p")).select(F.explode(F.col(f"p.{items}" if items else "p")).alias("j")).select("j.*")


def _salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"), currency.alias("currency"), period.alias("period")))


def _listing(df: DataFrame, source: str | Column, now: Column, *, title, company, place, description, url, posted, salary=None, remote=None, hint=None, employment=None, options=None) -> DataFrame:
    """The common projection; rows without title or link go."""
    remote = F.coalesce(remote, F.lit(False)) if remote is not None else F.lit(False)
    body = F.concat_ws(" ", title, description)
    none = F.lit(None).cast("struct<min:double,max:double,currency:string,period:string>")
    out = df.select(
        text.spaces(title).alias("title"), company.alias("company"), place["city"].alias("city"), place["region"].alias("region"), place["country"].alias("country"),
        (remote | text.has(F.concat_ws(" ", title, place["city"]), r"\bremote\b")).alias("is_remote"), classify.work_type(body, remote).alias("work_type"),
        (classify.employment_type(body) if employment is None else F.coalesce(employment, classify.employment_type(body))).alias("employment_type"),
        classify.industry(title, hint).alias("industry"), parse.html_to_text(description).alias("description"), text.snippet(description).alias("snippet"), url.alias("apply_url"),
        F.coalesce(posted, now).alias("posted_at"), (none if salary is None else salary).alias("salary"), F.lit(source).alias("source"),
        (F.lit(None).cast(f"array<{OPTION}>") if options is None else identity.merge_options(options)).alias("apply_options"),
    )
    return out.filter("title <> '' and apply_url is not null")


def accepts(place: Column, remote: Column, region: Column | None = None) -> Column:
    """A board's posting is kept if it is remote or names a place in either country. ``region``: the place's, if it is
    known already. What is cheap stands first; most postings need no pattern."""
    country = text.has(place, r"\b(canada|united states|usa|u\.s\.|us|ca)\b")
    far = text.has(place, r"\bremote\b")
    region = parse.location_of(place)["region"] if region is None else region
    return F.coalesce(remote, F.lit(False)) | (place.contains(",") & (region != "")) | country | far


def adzuna(raw: DataFrame, country: str, now: Column) -> DataFrame:
    """S01."""
    j = _rows(raw, "results array<struct<title:string,description:string,redirect_url:string,created:string,salary_min:double,salary_max:double,contract_time:string,"
              "contract_type:string,company:struct<display_name:string>,category:struct<label:string>,location:struct<display_name:string,area:array<string>>>>", "results")  # fmt: skip
    c, area = F.lit(country), F.coalesce("location.area", F.array().cast("array<string>"))
    city = F.when(F.size(area) > 2, F.get(area, F.size(area) - 1)).otherwise(F.trim(F.split(F.coalesce("location.display_name", F.lit("")), ",")[0]))
    place = F.struct(city.alias("city"), parse.region_code(F.get(area, F.lit(1)), c).alias("region"), c.alias("country"))
    yearly = (F.coalesce("salary_min", F.lit(0)) > 1000) | (F.coalesce("salary_max", F.lit(0)) > 1000)
    pay = _salary(F.col("salary_min"), F.col("salary_max"), F.lit("CAD" if country == "CA" else "USD"), F.when(yearly, "yearly").otherwise("hourly"))
    employment = F.when(F.col("contract_time") == "part_time", "part-time").when(F.col("contract_type") == "contract", "contract")
    return _listing(j, "adzuna", now, title=F.col("title"), company=F.col("company.display_name"), place=place, description=F.col("description"), url=F.col("redirect_url"),
                    posted=F.try_to_timestamp("created"), salary=pay, hint=F.col("category.label"), employment=employment)


def jooble(raw: DataFrame, country: str, now: Column) -> DataFrame:
    """S03."""
    j = _rows(raw, "jobs array<struct<title:string,location:string,snippet:string,salary:string,type:string,link:string,company:string,updated:string,source:string>>", "jobs")
    pay = parse.salary_of(F.col("salary"), F.lit(country))
    return _listing(j, "jooble", now, title=parse.strip_html(F.col("title")), company=F.col("company"), place=parse.location_of(F.col("location"), F.lit(country)), description=F.col("snippet"),
                    url=F.col("link"), posted=F.try_to_timestamp("updated"), salary=pay)


def jsearch(raw: DataFrame, now: Column) -> DataFrame:
    """The list stands at data, data.jobs or jobs."""
    item = "array<struct<job_title:string,employer_name:string,job_city:string,job_state:string,job_country:string,job_apply_link:string,job_description:string,job_is_remote:boolean,job_posted_at_datetime_utc:string,job_publisher:string,job_apply_is_direct:boolean,apply_options:array<struct<publisher:string,apply_link:string,is_direct:boolean>>,job_min_salary:double,job_max_salary:double,job_salary_period:string>>"
    body = F.col("body")
    found = F.coalesce(F.from_json(F.get_json_object(body, "$.data.jobs"), item), F.from_json(F.get_json_object(body, "$.jobs"), item), F.from_json(F.get_json_object(body, "$.data"), item))
    j = raw.select(F.explode(found).alias("j")).select("j.*")
    country = F.when(F.upper("job_country").isin("CA", "CANADA"), "CA").otherwise("US")
    place = F.struct(F.coalesce("job_city", F.lit("")).alias("city"), parse.region_code(F.col("job_state"), country).alias("region"), country.alias("country"))
    pay = _salary(F.col("job_min_salary"), F.col("job_max_salary"), F.when(country == "CA", "CAD").otherwise("USD"), F.when(F.upper("job_salary_period") == "HOUR", "hourly").otherwise("yearly"))
    first = F.array(F.struct(F.col("job_publisher").alias("publisher"), F.col("job_apply_link").alias("apply_link"), F.col("job_apply_is_direct").alias("is_direct")))
    places = F.filter(F.concat(first, F.coalesce("apply_options", F.array().cast("array<struct<publisher:string,apply_link:string,is_direct:boolean>>"))), lambda o: o["apply_link"].isNotNull())
    options = F.transform(places, lambda o: F.struct(
        classify.publisher(o["publisher"], o["apply_link"], o["is_direct"]).alias("portal"), o["apply_link"].alias("url"), F.coalesce(o["is_direct"], classify.portal(o["apply_link"])["direct"]).alias("direct")
    ))
    return _listing(j, "jsearch", now, title=F.col("job_title"), company=F.col("employer_name"), place=place, description=F.col("job_description"), url=F.col("job_apply_link"),
                    posted=F.try_to_timestamp("job_posted_at_datetime_utc"), salary=pay, remote=F.col("job_is_remote"), options=options)


def usajobs(raw: DataFrame, now: Column) -> DataFrame:
    """The first location and the first pay of each."""
    j = _rows(raw, "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<PositionTitle:string,OrganizationName:string,PositionURI:string,ApplyURI:array<string>,"
              "PublicationStartDate:string,QualificationSummary:string,PositionLocation:array<struct<LocationName:string,CityName:string>>,"
              "PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string,RateIntervalCode:string>>,UserArea:struct<Details:struct<JobSummary:string>>>>>>",
              "SearchResult.SearchResultItems").select("MatchedObjectDescriptor.*")
    pay = F.get("PositionRemuneration", F.lit(0))
    hourly = F.lower(pay["RateIntervalCode"]).isin("ph", "per hour")
    place = parse.location_of(F.coalesce(F.get("PositionLocation", F.lit(0))["LocationName"], F.lit("")), F.lit("US"))
    return _listing(j, "usajobs", now, title=F.col("PositionTitle"), company=F.col("OrganizationName"), place=place, url=F.coalesce(F.get("ApplyURI", F.lit(0)), "PositionURI"),
                    description=F.concat_ws("\n", "UserArea.Details.JobSummary", "QualificationSummary"), posted=F.try_to_timestamp("PublicationStartDate"),
                    salary=_salary(pay["MinimumRange"].try_cast("double"), pay["MaximumRange"].try_cast("double"), F.lit("USD"), F.when(hourly, "hourly").otherwise("yearly")))


def remotive(raw: DataFrame, now: Column) -> DataFrame:
    """Rows whose restriction names neither country go."""
    j = _rows(raw, "jobs array<struct<url:string,title:string,company_name:string,job_type:string,publication_date:string,candidate_required_location:string,salary:string,description:string>>", "jobs")
    j = j.withColumn("country", parse.remote_country(F.col("candidate_required_location"))).filter("country is not null")
    place = F.struct(F.lit("").alias("city"), F.lit("").alias("region"), F.col("country").alias("country"))
    return _listing(j, "remotive", now, title=F.col("title"), company=F.col("company_name"), place=place, description=F.col("description"), url=F.col("url"),
                    posted=F.try_to_timestamp("publication_date"), salary=parse.salary_of(F.col("salary"), F.col("country")), remote=F.lit(True))


def himalayas(raw: DataFrame, now: Column) -> DataFrame:
    """Dates are seconds or milliseconds."""
    j = _rows(raw, "jobs array<struct<title:string,companyName:string,locationRestrictions:array<string>,minSalary:double,maxSalary:double,currency:string,pubDate:bigint,applicationLink:string,description:string>>", "jobs")
    j = j.withColumn("country", parse.remote_country(F.array_join("locationRestrictions", ","))).filter("country is not null")
    place = F.struct(F.lit("").alias("city"), F.lit("").alias("region"), F.col("country").alias("country"))
    return _listing(j, "himalayas", now, title=F.col("title"), company=F.col("companyName"), place=place, description=F.col("description"), url=F.col("applicationLink"), remote=F.lit(True),
                    posted=F.timestamp_millis(parse.epoch_millis(F.col("pubDate"))), salary=_salary(F.col("minSalary"), F.col("maxSalary"), F.coalesce("currency", F.lit("USD")), F.lit("yearly")))


_BOARDS = {
    # source: (schema, items, title, place, url, date, description, remote)
    "greenhouse": ("jobs array<struct<title:string,location:struct<name:string>,absolute_url:string,updated_at:string,content:string,departments:array<struct<name:string>>>>", "jobs", "title", "location.name", "absolute_url", "updated_at", "content", None),
    "lever": ("array<struct<text:string,categories:struct<location:string,team:string>,hostedUrl:string,applyUrl:string,createdAt:bigint,descriptionPlain:string,workplaceType:string>>", "", "text", "categories.location", "coalesce(applyUrl, hostedUrl)", "timestamp_millis(createdAt)", "descriptionPlain", "workplaceType = 'remote'"),
    "ashby": ("jobs array<struct<title:string,location:string,applyUrl:string,jobUrl:string,publishedAt:string,descriptionHtml:string,isRemote:boolean>>", "jobs", "title", "location", "coalesce(applyUrl, jobUrl)", "publishedAt", "descriptionHtml", "isRemote"),
    "smartrecruiters": ("content array<struct<name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>>>", "content", "name", "concat_ws(', ', location.city, location.region, if(lower(location.country) = 'ca', 'Canada', if(lower(location.country) = 'us', 'US', location.country)))", "ref", "releasedDate", "''", "location.remote"),
    "workable": ("jobs array<struct<title:string,shortcode:string,telecommuting:boolean,application_url:string,published_on:string,locations:array<struct<city:string,region:string,countryCode:string>>>>", "jobs", "title", "concat_ws(', ', get(locations, 0).city, get(locations, 0).region, if(get(locations, 0).countryCode = 'CA', 'Canada', get(locations, 0).countryCode))", "application_url", "published_on", "''", "telecommuting"),
    "recruitee": ("offers array<struct<title:string,city:string,state_code:string,country_code:string,careers_url:string,published_at:string,company_name:string,description:string,requirements:string>>", "offers", "title", "concat_ws(', ', city, state_code, if(country_code = 'CA', 'Canada', country_code))", "careers_url", "published_at", "concat_ws('\n', description, requirements)", None),
}


def _postings(raw: DataFrame, source: str) -> DataFrame:
    """A board's postings under common names."""
    schema, items, title, place, url, date, description, remote = _BOARDS[source]
    posted = F.expr(date) if date.startswith("timestamp") else F.try_to_timestamp(F.substring(F.expr(date), 1, 19))
    return _rows(raw, schema, items).select(
        F.lit(source).alias("source"), F.expr(title).alias("title"), F.coalesce(F.expr(place), F.lit("")).alias("location"), F.expr(url).alias("url"), posted.alias("posted"),
        F.expr(description).alias("html"), (F.expr(remote) if remote else F.lit(False)).alias("far"),
    )


def _of_boards(postings: DataFrame, company: str, now: Column) -> DataFrame:
    """Listings of boards' postings; places are parsed once for the filter and the columns."""
    j = once(postings, "place", parse.location_of(F.col("location"))).filter(accepts(F.col("location"), F.col("far"), F.col("place.region")))
    return _listing(j, F.col("source"), now, title=F.col("title"), company=F.lit(company), place=F.col("place"), description=F.col("html"), url=F.col("url"), posted=F.col("posted"), remote=F.col("far"))


def board(raw: DataFrame, source: str, company: str, now: Column) -> DataFrame:
    """An employer's own board."""
    return _of_boards(_postings(raw, source), company, now)


def boards(bodies: dict[str, DataFrame], company: str, now: Column) -> DataFrame:
    """All boards of an employer, by source; postings meet before they are made listings, in one plan for all."""
    return _of_boards(union_sources({source: _postings(raw, source) for source, raw in bodies.items()}), company, now)


def feed(raw: DataFrame, now: Column) -> DataFrame:
    """Items of an RSS or Atom feed (``body``); bodies that aren't one give no rows."""
    items = raw.filter(F.regexp_like("body", F.lit(r"(?i)<(rss|feed|rdf)"))).select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)(<(?:item|entry)[ >].*?</(?:item|entry)>)"), F.lit(1))).alias("b"))
    b = F.col("b")
    j = items.select(parse.strip_html(parse.xml_tag(b, "title")).alias("t"), parse.xml_tag(b, "link").alias("l"), parse.strip_html(parse.xml_tag(b, "description")).alias("flat"),
                     parse.html_to_text(parse.xml_tag(b, "description")).alias("d"), parse.xml_tag(b, "pubDate").alias("p"))
    parts = F.split("t", r"\s+[-–|]\s+")
    place = F.coalesce(parse.labelled(F.col("d"), "Location"), F.nullif(F.get(parts, F.size(parts) - 1), F.get(parts, F.lit(0))), F.lit(""))
    where = parse.location_of(F.regexp_replace(place, r"\s*\(([A-Z]{2})\)", ", $1"), F.lit("CA"))
    company = F.coalesce(parse.labelled(F.col("d"), "Employer", "Company"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))))
    posted = F.try_to_timestamp(F.regexp_replace("p", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return _listing(j, "canada_job_bank", now, title=F.get(parts, F.lit(0)), company=company, place=where, description=F.col("flat"), url=F.nullif(F.regexp_replace("l", r";jsessionid=[^?#]*", ""), F.lit("")),
                    posted=posted, salary=parse.salary_of(parse.labelled(F.col("d"), "Salary", "Wage"), F.lit("CA")))


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """U01."""
    out = None
    for df in parts.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def fan_out(branches: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str | None]]:
    """The rows of all branches that could be read (country by country, say), and what went wrong with the others; an
    error only if all failed. A branch is a function that reads and returns a frame."""
    parts, failed = {}, {}
    for name, read in branches.items():
        try:
            parts[name] = read()
        except Exception as e:  # whatever a source's reader raises
            failed[name] = e
    if failed and not parts:
        raise next(iter(failed.values()))
    return union_sources(parts), {n: str(failed[n]) if n in failed else None for n in branches}


def demo(spark: SparkSession, now: Column, rows: int = 23) -> DataFrame:
    """Finalized sample listings, always the same ones: trades by place, one a day back from now."""
    trades = ["Security Analyst", "Nurse", "Cook", "Electrician", "Accountant", "Driver", "Teacher", "Developer"]
    places = [("Guelph", "ON", "CA"), ("Laval", "QC", "CA"), ("Kelowna", "BC", "CA"), ("Tulsa", "OK", "US"), ("Boise", "ID", "US")]
    made = spark.range(rows).select(
        F.get(F.array(*map(F.lit, trades)), (F.col("id") % len(trades)).cast("int")).alias("title"), F.concat(F.lit("Sample Works "), (F.col("id") % 6 + 1).cast("string")).alias("company"),
        F.get(F.array(*[F.struct(F.lit(a).alias("city"), F.lit(b).alias("region"), F.lit(c).alias("country")) for a, b, c in places]), (F.col("id") % len(places)).cast("int")).alias("p"), "id",
    )
    pay = F.struct((40_000 + 1500.0 * F.col("id")).alias("min"), (50_000 + 1500.0 * F.col("id")).alias("max"), F.when(F.col("p.country") == "CA", "CAD").otherwise("USD").alias("currency"), F.lit("yearly").alias("period"))
    url = F.concat(F.lit("https://demo.example/"), F.col("id").cast("string"))
    text_ = F.concat(F.lit("Sample listing: "), F.lower("title"), F.lit(" wanted in "), F.col("p.city"), F.lit(". 2 years of experience."))
    out = made.select(
        "title", "company", "p.city", "p.region", "p.country", F.lit(False).alias("is_remote"), F.lit("onsite").alias("work_type"), F.lit("full-time").alias("employment_type"),
        classify.industry(F.col("title")).alias("industry"), text_.alias("description"), text_.alias("snippet"), url.alias("apply_url"), (now - F.make_dt_interval(F.col("id").cast("int"))).alias("posted_at"), pay.alias("salary"),
        F.lit("deep_link").alias("source"), F.array(F.struct(F.lit("Company site").alias("portal"), url.alias("url"), F.lit(True).alias("direct"))).alias("apply_options"),
    )
    return identity.finalize(out)


def registry(sources: DataFrame, status: DataFrame) -> DataFrame:
    """Metadata of all sources with what their run said."""
    return sources.join(status, "name", "left").withColumn("enabled", F.coalesce("ok", F.lit(False)))
