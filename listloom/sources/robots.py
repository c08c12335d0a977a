"""robots.txt (S28, J17): rules by agent, the longest match decides, allow wins ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(files: DataFrame, agent: str) -> DataFrame:
    """host, allow, pattern, delay of the groups that name the agent, else of the groups for all. ``files``: host, body."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("host", "n", F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("v")).filter("k <> ''")
    w = Window.partitionBy("host").orderBy("n")
    # a group begins with the first of a run of agent lines
    begins = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("b", begins.cast("int")).withColumn("g", F.sum("b").over(w))
    agents = lines.filter("k = 'user-agent'").groupBy("host", "g").agg(
        F.bool_or((F.col("v") != "*") & F.lit(agent.lower()).contains(F.lower("v"))).alias("mine"), F.bool_or(F.col("v") == "*").alias("all")
    )
    agents = agents.withColumn("any", F.max(F.col("mine").cast("int")).over(Window.partitionBy("host")))
    chosen = agents.filter((F.col("any") == 1) & F.col("mine") | (F.col("any") == 0) & F.col("all")).select("host", "g")
    kept = lines.join(chosen, ["host", "g"]).filter("k in ('allow', 'disallow', 'crawl-delay') and v <> ''")
    return kept.select("host", (F.col("k") == "allow").alias("allow"), F.when(F.col("k") != "crawl-delay", F.col("v")).alias("pattern"), F.when(F.col("k") == "crawl-delay", F.expr("try_cast(v as double)")).alias("delay"))


def allowed(paths: DataFrame, ruled: DataFrame) -> DataFrame:
    """host, path, allowed. ``paths``: host, path."""
    quoted = F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))
    r = ruled.filter("pattern is not null").select("host", "allow", "pattern", regex.alias("regex"))
    hit = paths.join(r, "host", "left").withColumn("hit", F.coalesce(F.regexp_like("path", F.col("regex")), F.lit(False)))
    best = F.max(F.when(F.col("hit"), F.struct(F.length("pattern"), "allow")))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))
