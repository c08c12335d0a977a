"""Keyed tables of a user: saved and applied listings, saved searches, recent searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: states of an application
STATUSES = ["applied", "screening", "interview", "offer", "rejected", "withdrawn"]


def toggle(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are there go, the others come, without their description."""
    slim = rows.drop("description")
    return table.join(slim.select(key), key, "left_anti").unionByName(slim.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def add_missing(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Inserted where absent."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def update(table: DataFrame, patch: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Columns of the patch that aren't null replace; keys that aren't there are ignored."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = table.join(p, F.col(key) == F.col("_key"), "left")
    out = j.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    return out.withColumn("updated_at", F.when(F.col("_key").isNotNull(), now).otherwise(F.col("updated_at"))).drop("_key", *[f"_{c}" for c in columns])


def remove(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """V03, V05."""
    return table.join(keys.select(key), key, "left_anti")


def status(c: Column) -> Column:
    """Null is applied; what isn't a status is null."""
    s = F.coalesce(c, F.lit("applied"))
    return F.when(s.isin(STATUSES), s)


def status_counts(table: DataFrame) -> DataFrame:
    """Every status, zeros included."""
    spine = table.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = table.groupBy(status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))
    return spine.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))


def recent(searches: DataFrame, most: int = 6) -> DataFrame:
    """User, q, city, at: a user's latest searches, each once by its words, whatever their case, and place."""
    same = Window.partitionBy("user", F.lower("q"), "city").orderBy(F.desc("at"), F.desc("pos"))
    last = searches.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1").drop("_rn")
    return last.withColumn("nth", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), F.desc("pos")))).filter(F.col("nth") <= most)


def recent_with_hits(searches: DataFrame, results: DataFrame, most: int = 6) -> DataFrame:
    """``recent`` with ``hits``: the total of the latest answer (user, q, city, at, pos, hits) to that search, whatever its
    case, as of its latest entry or later; an entry that has no answer yet carries none over from earlier ones, which a new
    entry replaces."""
    last = recent(searches, most)
    key = lambda q: F.lower(q)
    answers = results.select(F.col("user").alias("_u"), key(F.col("q")).alias("_q"), F.col("city").alias("_c"), F.struct("at", "pos").alias("_at"), F.col("hits").alias("_hits"))
    same = (F.col("user") == F.col("_u")) & (key(F.col("q")) == F.col("_q")) & (F.col("city") == F.col("_c")) & (F.col("_at") >= F.struct("at", "pos"))
    # a user has ``most`` entries at most, so answers join a few rows
    found = last.select("user", "q", "city", "at", "pos").join(answers, same).groupBy("user", "q", "city").agg(F.max_by("_hits", "_at").alias("hits"))
    return last.join(found, ["user", "q", "city"], "left")


def tracker_order(table: DataFrame) -> DataFrame:
    """O14."""
    return table.orderBy(F.coalesce("updated_at", "at").desc(), "id")


def by_id(listings: DataFrame, saved: DataFrame, ids: DataFrame) -> DataFrame:
    """The listing of each id, or where there is none any more the saved copy of it."""
    live = ids.join(listings, "id", "left_semi")
    return listings.join(ids, "id", "left_semi").unionByName(saved.join(ids, "id", "left_semi").join(live, "id", "left_anti"), allowMissingColumns=True)
