"""Company sites and outbound links (L01-L05, J10, J11, O11). Curated sites and platforms are tables, given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import normalize_company, slugify, url_component
from ..storage import small

# fixed values: board roots recognised in listings' links
BOARD_ROOTS = r"^(https?://(?:boards\.greenhouse\.io|job-boards\.greenhouse\.io|jobs\.lever\.co|jobs\.ashbyhq\.com|apply\.workable\.com)/[^/?#]+)"

#: Platforms that are sent to all tasks, at most.
PLATFORMS = 10_000


def career_sites(companies: DataFrame, curated: DataFrame, listings: DataFrame) -> DataFrame:
    """Company, url, verified: a curated site by equal key, else by a key of five letters or more that the name begins
    with at a word, else a board's root in the company's own listings, else a web search. ``curated``: key, url."""
    named = companies.select("company", normalize_company(F.col("company")).alias("key"))
    exact = named.join(curated.select("key", F.col("url").alias("exact")), "key", "left")
    # the name's word prefixes, so that a prefix match is an equality join too
    words = F.split("key", " ")
    prefixes = exact.select("company", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("prefix"))
    by_prefix = prefixes.filter(F.length("prefix") >= 5).join(curated.select(F.col("key").alias("prefix"), F.col("url").alias("purl")), "prefix")
    by_prefix = by_prefix.groupBy("company").agg(F.max_by("purl", F.length("prefix")).alias("by_prefix"))
    root = F.regexp_extract("apply_url", BOARD_ROOTS, 1)
    boards = listings.withColumn("root", root).filter("root <> ''").groupBy(normalize_company(F.col("company")).alias("bkey")).agg(F.min_by("root", "pos").alias("board"))
    out = exact.join(by_prefix, "company", "left").join(boards, F.col("key") == F.col("bkey"), "left")
    search = F.concat(F.lit("https://www.google.com/search?q="), url_component(F.concat("company", F.lit(" careers"))))
    known = F.coalesce("exact", "by_prefix", "board")
    return out.select("company", F.coalesce(known, search).alias("url"), known.isNotNull().alias("verified"))


def _where(p: Column) -> Column:
    """The place of a search for a platform of country ``p``: city and region of that country, else the country."""
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    region = F.coalesce(F.nullif("region", F.lit("")), F.lit(""))
    name = F.coalesce(F.when(p == "US", F.try_element_at(table(lx.STATES), region)).otherwise(F.try_element_at(table(lx.PROVINCES), region)), F.lit(""))
    parts = F.filter(F.array(F.coalesce("city", F.lit("")), name), lambda x: x != "")
    fits = ((region == "") | (name != "")) & (F.size(parts) > 0)
    return F.when(fits, F.array_join(parts, ", ")).when(p == "US", "United States").otherwise("Canada")


def platform_links(searches: DataFrame, platforms: DataFrame) -> DataFrame:
    """search_id, platform, url: Canadian platforms first, and those of the other country only if it is searched.
    ``searches``: search_id, q, country (CA, US or ALL), region (a code), city, and optionally extra (more words), days,
    work_type. ``platforms`` (a short list, sent to all tasks while it is one): platform, country, template, pos, and
    optionally days_part and remote_part, which are appended where there are days, and where only remote work is searched.
    Templates hold {q}, {where}, {days} and {seconds}; platforms without one have no link."""
    for c, kind in (("extra", "string"), ("days", "int"), ("work_type", "string")):
        if c not in searches.columns:
            searches = searches.withColumn(c, F.lit(None).cast(kind))
    for c in ("days_part", "remote_part"):
        if c not in platforms.columns:
            platforms = platforms.withColumn(c, F.lit(None).cast("string"))
    words = F.trim(F.array_join(F.filter(F.array(F.coalesce("q", F.lit("")), F.coalesce("extra", F.lit(""))), lambda x: x != ""), " "))
    # the join is on two countries, so a shuffle would put all searches into two tasks
    p = small(platforms.filter("template is not null").withColumnRenamed("country", "pcountry"), PLATFORMS)
    sides = F.when(F.col("country") == "ALL", F.array(F.lit("CA"), F.lit("US"))).otherwise(F.array("country"))
    j = searches.withColumn("_words", words).withColumn("pcountry", F.explode(sides)).join(p, "pcountry")
    dated = F.when(F.coalesce(F.col("days") > 0, F.lit(False)), F.coalesce("days_part", F.lit(""))).otherwise("")
    far = F.when(F.coalesce(F.col("work_type") == "remote", F.lit(False)), F.coalesce("remote_part", F.lit(""))).otherwise("")
    url = F.concat("template", dated, far)
    for mark, value in (("{q}", url_component(F.col("_words"))), ("{where}", url_component(_where(F.col("pcountry")))), ("{days}", F.coalesce(F.col("days").cast("string"), F.lit(""))),
                        ("{seconds}", F.coalesce((F.col("days").cast("long") * 86_400).cast("string"), F.lit("")))):
        url = F.replace(url, F.lit(mark), value)
    return j.select("search_id", "platform", url.alias("url"), F.col("pcountry").alias("note"), (F.when(F.col("pcountry") == "CA", 0).otherwise(1) * 1000 + F.col("pos")).alias("ord"))


def deep_links(searches: DataFrame, platforms: DataFrame) -> DataFrame:
    """platform_links; a search without words looks for those of its industry (column industry)."""
    words = F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.INDUSTRY_KEYWORDS.items() for x in kv]), F.col("industry"))
    return platform_links(searches.withColumn("extra", F.when(F.coalesce("q", F.lit("")) == "", words)), platforms)


def by_kind(platforms: DataFrame, kinds: list[str]) -> DataFrame:
    """Kind, platforms (names in their order), of the kinds in the order given that have any; a short list."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    g = platforms.withColumn("nth", order).filter("nth > 0").groupBy("nth", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "platform"))).alias("p"))
    return g.select("nth", "kind", F.transform("p", lambda x: x["platform"]).alias("platforms"))


def job_link(id_: Column) -> Column:
    """L04."""
    return F.concat(F.lit("/job?id="), url_component(id_))


def company_link(name: Column) -> Column:
    """L04."""
    return F.concat(F.lit("/company?name="), url_component(name))


def options_for(options: Column, url: Column) -> Column:
    """The listing's own link stands where there are no options."""
    own = F.array(F.struct(F.lit("Original posting").alias("portal"), url.alias("url"), F.lit(False).alias("direct")))
    return F.when(F.size(F.coalesce(options, F.array().cast("array<struct<portal:string,url:string,direct:boolean>>"))) > 0, options).otherwise(own)


def matching_companies(listings: DataFrame, query: str, k: int = 4) -> DataFrame:
    """Companies whose key holds every word of the query, by listings."""
    from ..functions.text import plain

    g = listings.withColumn("key", normalize_company(F.col("company")))
    for w in plain(query).split():
        g = g.filter(F.col("key").contains(w))
    g = g.groupBy("key").agg(F.count("*").alias("count"), F.max_by("company", "pos").alias("name"), F.min("pos").alias("first_pos"))
    return g.orderBy(F.desc("count"), "first_pos").limit(k).select("name", slugify(F.col("name")).alias("slug"), "count")


def first_in_group(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; Spark keeps one row a task before the shuffle."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
