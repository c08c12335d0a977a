"""File sources and sinks."""

from __future__ import annotations

import html
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import csv_quote, xml_escape
from ..operators import stats


def keyword_file(lines: DataFrame) -> DataFrame:
    """Keyword, tier, pos from (n, line): sections, comments, first of equal keywords. A configuration file is short, so
    its running section is one small window."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    section = F.nullif(F.lower(F.regexp_extract(line, r"(?i)^\[(priority|general)\]$", 1)), F.lit(""))
    w = Window.orderBy("n")
    marked = lines.select("n", line.alias("t"), section.alias("s")).withColumn("tier", F.coalesce(F.last("s", True).over(w), F.lit("priority")))
    words = marked.filter("t <> '' and s is null").withColumn("keyword", F.regexp_replace(F.lower("t"), r"\s+", " "))
    first = words.groupBy("keyword").agg(F.min_by("tier", "n").alias("tier"), F.min("n").alias("n"))
    return first.select("keyword", "tier", (F.row_number().over(Window.orderBy(F.col("tier") != "priority", "n")) - 1).alias("pos"))


def aliases(raw: DataFrame) -> DataFrame:
    """Canon, variant from one JSON object (``body``)."""
    m = F.from_json("body", "map<string,array<string>>")
    return raw.select(F.explode(m).alias("canon", "v")).select("canon", F.explode("v").alias("variant"))


def company_file(lines: DataFrame) -> DataFrame:
    """Company, pos: first of equal names whatever their case."""
    t = lines.select("n", F.trim("line").alias("company")).filter("company <> '' and not startswith(company, '#')")
    return t.groupBy(F.lower("company").alias("k")).agg(F.min_by("company", "n").alias("company"), F.min("n").alias("pos")).drop("k")


def env(text: str, present: dict[str, str] | None = None) -> dict[str, str]:
    """Settings that are already there win."""
    out = dict(present or {})
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Z0-9_]+)\s*=\s*(.*?)\s*$", line):
            out.setdefault(m[1], m[2].strip("\"'"))
    return out


def read_or(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or an empty one of its schema where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


VERSION = 1
#: Ids of descriptions that are broadcast; more are joined by a shuffle.
WANTED = 1_000_000


def write_state(listings: DataFrame, path: str, demo: bool = False) -> None:
    """What the next run merges with: the capped listings with seen_at; a run on sample rows leaves no state."""
    if not demo:
        listings.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state of the last run; of another version, or where there is none, an empty one."""
    return read_or(spark, path, f"{schema}, version int").filter(F.col("version") == VERSION).drop("version")


def or_previous(stored: DataFrame, previous: DataFrame, in_scope: Column) -> DataFrame:
    """If nothing at all was collected, what is live now stays; seen_at is then the time of that snapshot."""
    if not stored.isEmpty():
        return stored
    return previous.filter(in_scope).withColumn("seen_at", F.coalesce("seen_at", "updated_at")).drop("updated_at")


def write_snapshot(listings: DataFrame, folder: str) -> None:
    """Listings without their descriptions, and descriptions by the first two characters of the id."""
    listings.drop("description").write.mode("overwrite").parquet(f"{folder}/listings")
    shards = listings.filter("description is not null").select("id", "description", F.substring("id", 1, 2).alias("shard"))
    shards.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/descriptions")


def stats_snapshot(listings: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The dashboard's numbers, and its lists, of each country and of all (country null): two passes for all three."""
    either = listings.withColumn("country", F.explode(F.array("country", F.lit(None).cast("string"))))
    return stats.totals(listings, now, ["country"]), stats.top_lists(either, ["country"])


def write_reports(listings: DataFrame, keywords: DataFrame, sources: DataFrame, now: Column, folder: str) -> None:
    """Small tables of the dashboard, the keywords and what each source and keyword gave, as JSON lines."""
    numbers, lists = stats_snapshot(listings, now)
    for name, df in {"stats": numbers, "lists": lists, "keywords": keywords, "coverage": sources}.items():
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")  # some hundred rows each


def coverage_totals(listings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Jobs, canada, fetched_this_run (different ids), in one aggregate."""
    live = listings.select(F.lit(1).alias("live"), (F.col("country") == "CA").alias("ca"), F.lit(None).cast("string").alias("id"))
    both = live.unionByName(fresh.select(F.lit(0).alias("live"), F.lit(False).alias("ca"), F.col("id").cast("string").alias("id")))
    return both.agg(F.coalesce(F.sum("live"), F.lit(0)).cast("long").alias("jobs"), F.count_if("ca").alias("canada"), F.count_distinct("id").alias("fetched_this_run"))


def run_summary(totals: DataFrame, sources: DataFrame, keywords: DataFrame) -> DataFrame:
    """Nth, line of a summary in Markdown: totals (jobs, canada, fetched_this_run), a table of sources (source, count, ok,
    error) and one of keywords (keyword, jobs_now, canada, calls, thin). All are short."""
    head = totals.select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string(lx.SUMMARY, "jobs", "canada", F.col("jobs") - F.col("canada"), "fetched_this_run").alias("line")),
        *[F.struct(F.lit(p).alias("part"), F.lit("").alias("key"), F.lit(x).alias("line")) for p, x in ((1, lx.SOURCE_TABLE), (2, "|---|---|---|"), (4, lx.KEYWORD_TABLE), (5, "|---|---|---|---|---|"))],
    )).alias("x")).select("x.*")
    status = F.concat(F.when(F.col("ok"), "ok").otherwise(""), F.coalesce(F.concat(F.lit(" ! "), F.col("error")), F.lit("")))
    by_source = sources.select(F.lit(3).alias("part"), F.col("source").alias("key"), F.format_string("| %s | %d | %s |", "source", "count", status).alias("line"))
    by_keyword = keywords.select(F.lit(6).alias("part"), F.col("keyword").alias("key"), F.format_string("| %s | %d | %d | %d | %s |", "keyword", "jobs_now", "canada", "calls", F.when(F.col("thin"), "thin").otherwise("ok")).alias("line"))
    every = head.unionByName(by_source).unionByName(by_keyword)
    return every.select((F.row_number().over(Window.orderBy("part", "key")) - 1).alias("nth"), "line")


def description(spark: SparkSession, folder: str, id_: str) -> DataFrame:
    """A point lookup that reads one shard."""
    return spark.read.parquet(f"{folder}/descriptions").filter((F.col("shard") == id_[:2]) & (F.col("id") == id_)).select("id", "description")


def descriptions(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """Id, description of the ids (id) that have one. Spark finds out from the ids, at run time, which shards to read;
    others needn't even be there."""
    wanted = ids.filter(F.length("id") >= 2).select(F.col("id").alias("_id"), F.substring("id", 1, 2).alias("_shard")).distinct()
    shards = spark.read.schema("id string, description string, shard string").parquet(f"{folder}/descriptions")
    few = wanted.limit(WANTED + 1).count() <= WANTED
    wanted = F.broadcast(wanted) if few else wanted
    return shards.join(wanted, (F.col("shard") == F.col("_shard")) & (F.col("id") == F.col("_id"))).select("id", "description")


def feed_items(listings: DataFrame, keywords: list[str], most: int = 60) -> DataFrame:
    """Pos, item: the first listings with a tag of the set, as XML."""
    hit = listings.filter(F.arrays_overlap("tags", F.array(*map(F.lit, keywords)))).orderBy("pos").limit(most)
    stamp = F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), xml_escape(F.concat_ws(" - ", "title", "company")), F.lit("</title><link>"), xml_escape(F.col("apply_url")), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    return hit.select("pos", item.alias("item"))


def feed_xml(items: DataFrame, title: str, link: str, built: str) -> DataFrame:
    """Value: the lines of a feed's file: its head, the items (pos, item; at most those of a feed) and its end."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{html.escape(title)}</title><link>{html.escape(link)}</link><lastBuildDate>{html.escape(built)}</lastBuildDate>'
    ends = items.sparkSession.createDataFrame([(-1, head), (1 << 62, "</channel></rss>")], "pos long, value string")
    return ends.unionByName(items.select(F.col("pos").cast("long").alias("pos"), F.col("item").alias("value"))).orderBy("pos").select("value")


def _swap(spark: SparkSession, folder: str, run: str) -> None:
    """Makes ``run`` the current one: a small file is written aside and renamed, so that a reader sees the old run or the new."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    aside, current = path(f"{folder}/current.{run}"), path(f"{folder}/current.json")
    fs = current.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"version": VERSION, "run": run}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, current, overwrite)


def write_run(folder: str, tables: dict[str, DataFrame], feeds: dict[str, DataFrame] | None = None) -> str:
    """The files of a run as JSON lines (a table with a column ``description`` leaves it to shards
    by the first two characters of the id) and the feeds' XML, under a name of their own; then they become the current run
    at once. Returns that name."""
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    for name, df in tables.items():
        if "description" in df.columns:
            shards = df.filter("description is not null").select("id", "description", F.substring("id", 1, 2).alias("shard"))
            shards.repartition("shard").write.partitionBy("shard").json(f"{folder}/{run}/{name}-descriptions")
            df = df.drop("description")
        df.write.json(f"{folder}/{run}/{name}", ignoreNullFields=False)
    for name, lines in (feeds or {}).items():
        lines.coalesce(1).write.text(f"{folder}/{run}/feeds/{name}.xml")  # as many items as a feed has
    _swap(spark, folder, run)
    return run


def read_run(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the current run; an empty one if there is no run, or one of another version."""
    from pyspark.errors import AnalysisException

    try:
        current = spark.read.schema("version int, run string").json(f"{folder}/current.json").first()
    except AnalysisException:
        current = None
    if current is None or current["version"] != VERSION:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/{current['run']}/{name}")


def tracker_csv(entries: DataFrame, columns: list[str]) -> Column:
    """A line of quoted fields."""
    return F.concat_ws(",", *[csv_quote(F.substring(F.col(c).cast("string"), 1, 10) if dict(entries.dtypes)[c].startswith(("date", "timestamp")) else F.col(c).cast("string")) for c in columns])
