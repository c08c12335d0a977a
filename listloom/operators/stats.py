"""Dashboard and coverage aggregates (A04-A25, O10, U, J04, J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_company, slugify
from ..functions import lexicons as lx


def age_days(now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 86_400e6


def totals(listings: DataFrame, now: Column, by: list[str] = ()) -> DataFrame:
    """A04-A08, for each group of ``by`` and for all (A16: grouping sets, one pass)."""
    age = age_days(now)
    aggs = [
        F.count("*").alias("total"), F.count_if(age < 1).alias("new_today"), F.count_if(age < 7).alias("new_week"), F.count_distinct(F.nullif(normalize_company(F.col("company")), F.lit(""))).alias("employers"),
        F.count_if(F.col("work_type") == "remote").alias("remote"), F.count_if(F.col("work_type") == "hybrid").alias("hybrid"),
        F.coalesce(F.try_divide(F.count_if(F.col("work_type") == "remote"), F.count("*")), F.lit(0.0)).alias("remote_share"),
        F.count_if((F.col("seniority") == "entry") | (F.col("employment_type") == "internship")).alias("entry_level"), F.count_if(F.coalesce("salary_max", "salary_min").isNotNull()).alias("with_salary"),
    ]
    if not by:
        return listings.agg(*aggs)
    return listings.groupingSets([[F.col(b)] for b in by] + [[]], *by).agg(*aggs)


def upper_median(listings: DataFrame) -> DataFrame:
    """The upper median of yearly amounts, whatever the currency. Exact without sorting all rows in one task: equal
    amounts are counted first, and a prefix sum over ranges of amounts finds the one that holds the middle."""
    year = F.coalesce("salary_max", "salary_min") * F.when(F.col("period") == "hourly", lx.HOURS).otherwise(1)
    counts = listings.select(year.alias("y")).filter("y > 0").groupBy("y").agg(F.count("*").alias("c")).withColumn("bin", F.floor(F.log2("y") * 64))
    bins = counts.groupBy("bin").agg(F.sum("c").alias("n"))  # a few thousand at most
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(w)).withColumn("middle", F.floor(F.sum("n").over(Window.partitionBy()) / 2))
    hit = bins.filter("middle >= upto - n and middle < upto").select(F.col("bin").alias("_bin"), (F.col("middle") - F.col("upto") + F.col("n")).alias("nth"))
    inside = counts.join(F.broadcast(hit), F.col("bin") == F.col("_bin"))  # one row by construction
    inside = inside.withColumn("before", F.sum("c").over(Window.partitionBy("bin").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    return inside.filter("nth >= before and nth < before + c").select(F.floor(F.col("y") + 0.5).cast("long").alias("median_yearly"))


def top(listings: DataFrame, key: Column, k: int, name: str) -> DataFrame:
    """List, key, count of the k commonest keys; ties by first occurrence."""
    counts = listings.select(key.alias("key"), "pos").filter("key <> ''").groupBy("key").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))
    return counts.orderBy(F.desc("count"), "first_pos").limit(k).select(F.lit(name).alias("list"), "key", "count")


#: Lists of the dashboard and how long they are.
LISTS = {"industry": 12, "region": 12, "work_type": 10, "level": 10, "source": 10, "city": 10, "skills": 8, "certifications": 8, "tools": 10}


def top_lists(listings: DataFrame, by: list[str] = ()) -> DataFrame:
    """List, key, count (after the columns ``by``) of all lists of the dashboard, in one pass and one aggregate."""
    one = {"industry": F.col("industry"), "region": place("region"), "work_type": F.col("work_type"), "level": F.col("seniority"), "source": F.col("source"), "city": place("city")}
    pair = lambda n, c: F.struct(F.lit(n).alias("list"), c.alias("key"))

    def each(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: pair(c, x))

    many = [each(c) for c in ("skills", "certifications", "tools")]
    pairs = listings.select(*by, "pos", F.explode(F.concat(F.array(*[pair(n, c) for n, c in one.items()]), *many)).alias("x")).select(*by, "pos", "x.*").filter("key <> ''")
    counts = pairs.groupBy(*by, "list", "key").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))
    most = F.try_element_at(F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv]), F.col("list"))
    ranked = counts.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "list").orderBy(F.desc("count"), "first_pos", "key")))
    return ranked.filter(F.col("_rn") <= max(LISTS.values())).filter(F.col("_rn") <= most).select(*by, "list", "key", "count", F.col("_rn").alias("nth"))


def place(column: str) -> Column:
    """A10, A12: 'Remote' for a remote listing without a place."""
    return F.when((F.coalesce(F.col(column), F.lit("")) == "") & F.col("is_remote"), "Remote").otherwise(F.col(column))


def top_companies(listings: DataFrame, k: int = 8) -> DataFrame:
    """By normalised name; shown in the last spelling seen."""
    g = listings.withColumn("key", normalize_company(F.col("company"))).filter("key <> ''").groupBy("key")
    g = g.agg(F.count("*").alias("count"), F.max_by("company", "pos").alias("name"), F.min("pos").alias("first_pos"))
    return g.orderBy(F.desc("count"), "first_pos").limit(k).select("name", slugify(F.col("name")).alias("slug"), "count")


def per_day(rows: DataFrame, now: str, days: int = 30, at: str = "posted_at") -> DataFrame:
    """Counts for each of the last days, with zeros."""
    spine = rows.sparkSession.sql(f"SELECT explode(sequence(date_sub(date'{now[:10]}', {days - 1}), date'{now[:10]}')) AS day")
    young = rows.filter(F.col(at) > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(young, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("count"))


def keyword_coverage(keywords: DataFrame, tagged: DataFrame, calls: DataFrame, thin: int = 10) -> DataFrame:
    """For every keyword, zeros included: listings now, of them Canadian, calls, fetched, thin."""
    now = tagged.select(F.explode("tags").alias("keyword"), "country").groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(F.col("country") == "CA").alias("ca"))
    spent = calls.groupBy("keyword").agg(F.sum("calls").alias("calls"), F.sum("fetched").alias("fetched"))
    j = keywords.join(now, "keyword", "left").join(spent, "keyword", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c if c not in ("n", "ca") else {"n": "jobs_now", "ca": "canada"}[c])
    return j.select("keyword", zero("n"), zero("ca"), zero("calls"), zero("fetched"), (F.coalesce("n", F.lit(0)) < thin).alias("thin"))


def source_coverage(status: DataFrame, listings: DataFrame) -> DataFrame:
    """Status of each source with its listings on the site."""
    n = listings.groupBy("source").agg(F.count("*").alias("on_site"))
    return status.join(n, "source", "left").withColumn("on_site", F.coalesce("on_site", F.lit(0)))


def fetched(rows: DataFrame) -> DataFrame:
    """How many listings this run has brought."""
    return rows.agg(F.count_distinct("id").alias("fetched"))


def derived(days: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Total, peak day and its count of ``per_day`` (the first of equal days); jobs in the US by keyword."""
    peak = days.agg(F.sum("count").alias("total"), F.max(F.struct("count", (-F.unix_date(F.to_date("day"))).alias("d"))).alias("p"))
    peak = peak.select("total", F.date_format(F.date_from_unix_date((-F.col("p.d")).cast("int")), "yyyy-MM-dd").alias("peak_day"), F.col("p.count").alias("peak"))
    return peak, keywords.select("keyword", F.col("jobs_now"), "canada", (F.col("jobs_now") - F.col("canada")).alias("us"))


def tag_choice(facet: DataFrame, chosen: list[str], most: int = 14) -> DataFrame:
    """Key, nth: the chosen ones first, in their order, then the commonest others. ``facet``: key, count."""
    picked = facet.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(chosen))], "key string, i int")
    j = facet.join(picked, "key", "full").orderBy(F.col("i").isNull(), "i", F.desc("count"), "key").limit(most)
    return j.select("key", (F.row_number().over(Window.orderBy(F.col("i").isNull(), "i", F.desc("count"), "key")) - 1).alias("nth"))  # at most 14 rows


def region_options(spark, country: str, facet: DataFrame) -> DataFrame:
    """Code, label in the order of names; the label has the number of listings, if there are any. ``facet``: key, count."""
    from ..functions.parse import regions_for

    names = spark.createDataFrame(list(regions_for(country).items()), "code string, name string")
    j = names.join(facet.select(F.col("key").alias("code"), "count"), "code", "left")
    label = F.concat("name", F.coalesce(F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit(")")), F.lit("")))
    return j.select("code", label.alias("label"), (F.row_number().over(Window.orderBy(F.collate("name", "UNICODE"))) - 1).alias("nth"))  # 64 rows at most
