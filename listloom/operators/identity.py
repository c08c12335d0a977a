"""Record identity, duplicate merge, and merge with earlier state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions import lexicons as lx

BOARDS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee"]
OPTION = "struct<portal:string,url:string,direct:boolean>"


def fingerprint(title: Column, company: Column, city: Column, region: Column) -> Column:
    """20 hexadecimal characters."""
    key = F.concat_ws("|", text.normalize_title(title), text.normalize_company(company), text.normalize(city), text.normalize(region))
    return F.substring(F.sha2(key, 256), 1, 20)


def yearly_cad(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """The top of the range a year, in CAD; null outside the sane range. Rounds halves up."""
    year = F.coalesce(high, low) * F.when(period == "hourly", lx.HOURS).otherwise(1)
    sane = F.when((year >= lx.LOWEST) & (year <= lx.HIGHEST), year)
    return F.floor(sane * F.when(currency == "USD", lx.USD_TO_CAD).otherwise(1.0) + 0.5).cast("long")


def merge_options(options: Column) -> Column:
    """An array of apply options, in order, without bad or repeated links: one for each portal (a direct one takes the
    place of another), direct ones first, at most 12."""
    key = lambda o: F.lower(F.regexp_replace(F.regexp_replace(o["url"], r"[?#][\s\S]*$", ""), "/$", ""))
    good = F.filter(F.coalesce(options, F.array().cast(f"array<{OPTION}>")), lambda o: F.regexp_like(o["url"], F.lit("(?i)^https?://")))
    start = F.array().cast(f"array<{OPTION}>")

    def step(kept: Column, o: Column) -> Column:
        same = F.exists(kept, lambda k: F.lower(k["portal"]) == F.lower(o["portal"]))
        swapped = F.transform(kept, lambda k: F.when((F.lower(k["portal"]) == F.lower(o["portal"])) & o["direct"] & ~k["direct"], o).otherwise(k))
        return F.when(same, swapped).otherwise(F.concat(kept, F.array(o)))

    def distinct_links(rows: Column) -> Column:
        links = F.transform(rows, key)
        return F.filter(rows, lambda o, i: F.array_position(links, key(o)) == i + 1)

    one = F.get(F.transform(F.array(good), lambda g: F.aggregate(distinct_links(g), start, step)), F.lit(0))
    return F.get(F.transform(F.array(one), lambda a: F.slice(F.concat(F.filter(a, lambda o: o["direct"]), F.filter(a, lambda o: ~o["direct"])), 1, 12)), F.lit(0))


def finalize(rows: DataFrame) -> DataFrame:
    """Cleans and enriches raw rows (title, company, city, region, country, description, snippet, apply_url,
    apply_options, salary, source) and adds the identity last. Columns that are present and not null win."""
    title = text.spaces(F.col("title"))
    body = F.concat_ws("\n", title, F.coalesce("description", "snippet", F.lit("")))
    own = F.when(F.col("source").isin("adzuna", "jooble"), classify.source_portal(F.col("source")))
    link = classify.portal(F.col("apply_url"), own)
    given = F.coalesce(F.col("apply_options"), F.array().cast(f"array<{OPTION}>"))
    auth = classify.work_auth(body)
    derived = {
        "auth": F.when(F.size(auth) > 0, auth), "seniority": classify.seniority(title, body), "skills": classify.extract(lx.SKILLS, body),
        "certifications": classify.extract(lx.CERTIFICATIONS, body), "tools": classify.extract(lx.TOOLS, body),
    }
    out = rows.withColumn("_body", body).withColumns({k: F.coalesce(F.col(k), v) if k in rows.columns else v for k, v in derived.items()})
    out = out.withColumns({
        "apply_options": merge_options(F.concat(given, F.array(F.struct(link["portal"].alias("portal"), F.col("apply_url").alias("url"), link["direct"].alias("direct"))))),
        "salary_yearly_cad": yearly_cad(F.col("salary.min"), F.col("salary.max"), F.col("salary.currency"), F.col("salary.period")),
        "title": title, "company": F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Confidential employer")), "description": F.substring("description", 1, 20000),
    })
    out = out.withColumn("apply_url", F.coalesce(F.get("apply_options", F.lit(0))["url"], F.col("apply_url")))
    return out.withColumn("id", fingerprint(F.col("title"), F.col("company"), F.col("city"), F.col("region"))).drop("_body")


def dedupe(rows: DataFrame, key: str, order: str, priority: str, best_or_other: list[str], longest: list[str], least: list[str], options: str | None = None, link: str | None = None) -> DataFrame:
    """One row for each key, as a left fold in ``order`` would leave it. A row takes over if its priority is strictly
    higher than all before it; ``best_or_other`` columns then fall back on the other row, ``longest`` keep the longer text and
    ``least`` the smallest value. ``options`` (D04) are merged over all rows, those that took over first, the last of them
    foremost, then the others in order; ``link`` becomes the first option's.

    In closed form: only the first row of a priority can take over, so rows are summed by (key, priority) before anything
    meets by key alone; priorities are few, so a hot key is a few rows in any task."""
    o, p = F.col(order), F.col(priority)
    plain = [c for c in rows.columns if c not in {key, *best_or_other, *longest, *least, options}]
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    aggs = [F.min(o).alias("_o"), F.min_by(F.struct(*plain), o).alias("_row"), F.count("*").alias("_n")]
    for c in best_or_other:
        aggs += [F.min_by(F.struct(c), o).alias(f"_own_{c}"), F.min(F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v")))).alias(f"_any_{c}")]
    for c in longest:
        aggs += [F.min_by(F.struct(F.col(c).alias("v")), o).alias(f"_own_{c}"), F.max_by(F.struct(F.col(c).alias("v"), o.alias("o")), F.struct(n(F.col(c)), -o)).alias(f"_any_{c}")]
    aggs += [F.min(c).alias(f"_least_{c}") for c in least]
    few = rows.groupBy(key, p.alias("_p")).agg(*aggs)
    before = Window.partitionBy(key).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_b", F.coalesce(F.col("_p") > F.max("_p").over(before), F.lit(True)))
    o, b = F.col("_o"), F.col("_b")
    aggs = [F.max_by("_row", F.when(b, o)).alias("_best"), F.min(o).alias("first_seen"), F.sum("_n").alias("copies")]
    for c in best_or_other:
        own = F.col(f"_own_{c}")[c]
        aggs.append(F.coalesce(F.max_by(own, F.when(b & own.isNotNull(), o)), F.min(f"_any_{c}")["v"]).alias(c))
    for c in longest:
        own, any_ = F.col(f"_own_{c}")["v"], F.col(f"_any_{c}")
        # of the longest: the last that took over, else the first
        mine = F.struct(n(own).alias("n"), F.lit(1).alias("b"), o.cast("double").alias("o"), own.alias("v"))
        other = F.struct(n(any_["v"]).alias("n"), F.lit(0).alias("b"), (-any_["o"]).cast("double").alias("o"), any_["v"].alias("v"))
        aggs.append(F.max(F.when(b, F.greatest(mine, other)).otherwise(other))["v"].alias(c))
    aggs += [F.min(f"_least_{c}").alias(c) for c in least]
    out = few.groupBy(key).agg(*aggs)
    out = out.select(key, "_best.*", *best_or_other, *longest, *least, "first_seen", "copies")
    if not options:
        return out
    rank = few.filter("_b").select(F.col(key).alias("_k"), F.col("_o").alias("_t"))
    turn = F.when(F.col("_t").isNotNull(), F.struct(F.lit(0).alias("late"), (-F.col(order)).alias("o"))).otherwise(F.struct(F.lit(1).alias("late"), F.col(order).alias("o")))
    each = rows.join(rank, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_t")), "left").select(F.col(key).alias("_key"), turn.alias("turn"), F.posexplode(options).alias("nth", "option"))
    merged = options_by_key(each).withColumnRenamed("options", options)
    out = out.join(merged, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(options, F.coalesce(options, F.array().cast(f"array<{OPTION}>")))
    return out if link is None else out.withColumn(link, F.coalesce(F.get(options, F.lit(0))["url"], F.col(link)))


def options_by_key(each: DataFrame, most: int = 12) -> DataFrame:
    """D04 over rows: _key, options from (_key, turn, nth, option) in the order of (turn, nth): of a link the first stays, of a
    portal's the first direct one or else the first, in the place of its first; direct ones go first. A hot key's options
    are summed by link and then by portal before they meet."""
    link = F.lower(F.regexp_replace(F.regexp_replace(F.col("option.url"), r"[?#][\s\S]*$", ""), "/$", ""))
    at = F.struct("turn", "nth").alias("at")
    good = each.filter(F.regexp_like("option.url", F.lit("(?i)^https?://")))
    one = good.groupBy("_key", link.alias("_link")).agg(F.min_by("option", F.struct("turn", "nth")).alias("option"), F.min(F.struct("turn", "nth")).alias("at"))
    direct = F.coalesce("option.direct", F.lit(False))
    portals = one.groupBy("_key", F.lower("option.portal").alias("_portal")).agg(F.min("at").alias("at"), F.min_by("option", F.struct(~direct, "at")).alias("option"))
    place = F.struct((~F.coalesce("option.direct", F.lit(False))).alias("other"), "at")
    kept = portals.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(place))).filter(F.col("_rn") <= most)
    listed = kept.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_rn", "option"))).alias("x"))  # at most 12
    return listed.select("_key", F.transform("x", lambda v: v["option"].cast(OPTION)).alias("options"))


def merge_previous(fresh: DataFrame, previous: DataFrame, now: Column, keep_days: int = 3, board_hours: int = 6, order: str = "pos", priority: str = "prio",
                   best_or_other: list[str] = (), longest: list[str] = (), least: list[str] = (), options: str | None = None, link: str | None = None) -> DataFrame:
    """This run's rows and the earlier ones that aren't too old for their kind of source. Earlier
    rows get their id anew, so that a change of the fingerprint leaves no duplicates; then all are merged by id as ``dedupe``
    does, fresh ones first. seen_at is now for fresh ids, and the latest known time of an id, old or new, for the others.
    Both: id, source, title, company, city, region, pos, prio; ``previous`` also seen_at."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))
    most = F.when(F.col("source").isin(BOARDS), board_hours * 3_600_000_000).otherwise(keep_days * 86_400_000_000)
    again = previous.withColumn("_new", fingerprint(F.col("title"), F.col("company"), F.col("city"), F.col("region")))
    seen = again.select(F.explode(F.array("id", "_new")).alias("_id"), "seen_at").groupBy("_id").agg(F.max("seen_at").alias("_seen"))
    kept = again.filter(age <= most).withColumn("id", F.col("_new")).drop("seen_at", "_new").withColumn("_late", F.lit(1))
    both = fresh.drop("seen_at").withColumn("_late", F.lit(0)).unionByName(kept, allowMissingColumns=True)
    both = both.withColumn("_turn", F.col("_late") * F.lit(1 << 50) + F.col(order))
    merged = dedupe(both.withColumn("_fresh", F.col("_late")), "id", "_turn", priority, list(best_or_other), list(longest), ["_fresh", *least], options, link)
    out = merged.withColumn("fresh", F.col("_fresh") == 0).drop("_fresh", "_late", "_turn", "first_seen")
    return out.join(seen, F.col("id") == F.col("_id"), "left").withColumn("seen_at", F.when(F.col("fresh"), now).otherwise(F.coalesce("_seen", now))).drop("_seen", "_id")


def tagged(rows: DataFrame, keywords: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """Tags of title, snippet and description; null if there are none. seen_at stays as it is."""
    found = classify.tags(F.col("title"), F.concat_ws(" ", F.coalesce("snippet", F.lit("")), F.coalesce("description", F.lit(""))), keywords, aliases)
    return rows.withColumn("_tags", found).withColumn("tags", F.when(F.size("_tags") > 0, F.col("_tags"))).drop("_tags")


def in_scope(now: Column, days: int = 60) -> Column:
    """D07, W03."""
    return F.col("country").isin("CA", "US") & (F.col("posted_at") >= now - F.expr(f"interval {days} days"))


def cap(rows: DataFrame, most: int = 15_000, order: str = "pos") -> DataFrame:
    """Canada first, newest first; a top-k, never a full sort of one partition."""
    return rows.orderBy(F.col("country") != "CA", F.desc("posted_at"), order).limit(most)


def sticky_status(status: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Last success and last error by source: an error stays until the source succeeds again."""
    j = status.join(previous.select("source", F.col("last_success").alias("_ls"), F.col("last_error").alias("_le")), "source", "left")
    good = F.col("ok") & ~F.coalesce("skipped", F.lit(False))
    return j.select(
        "source", "ok", "count", F.when(good, now).otherwise(F.col("_ls")).alias("last_success"),
        F.when(~F.col("ok"), F.col("error")).when(good, None).otherwise(F.col("_le")).alias("last_error"),
    )
