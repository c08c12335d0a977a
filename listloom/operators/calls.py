"""Recorded calls of sources: where a run stops, how it ended, and which calls a budget lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .schedule import millis

DAY_MS = 86_400_000
# fixed values: answers after which a source isn't asked again in a run
STOPS = r"(?:^|[^A-Za-z0-9_])(401|403|429)(?:$|[^A-Za-z0-9_])"


def made(calls: DataFrame) -> DataFrame:
    """The planned calls (source, at, nth, error, jobs) that a run makes: up to the first of each source that says its key
    is bad or its quota used. Closed form: the first such call of each source, a row a source, against all calls."""
    place = F.struct("at", "nth")
    stop = F.regexp_like("error", F.lit(STOPS))
    first = calls.groupBy(F.col("source").alias("_s")).agg(F.min(F.when(stop, place)).alias("_stop"))
    # one row a source, of which there are a few
    return calls.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("_stop").isNull() | (place <= F.col("_stop"))).drop("_s", "_stop")


def outcomes(calls: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Source, planned, calls, failed, jobs, ok, error, last_success of a run over planned calls. A source fails only
    if no planned call gave a row and every one of them failed; its error tells how many did and what the last one said.
    ``skipped`` (source, reason): sources that weren't asked."""
    planned = calls.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("planned"))
    place = F.when(F.col("error").isNotNull(), F.struct("at", "nth"))
    done = made(calls).groupBy("source").agg(
        F.count("*").alias("calls"), F.count("error").alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("jobs"))), F.lit(0)).alias("jobs"), F.max_by("error", place).alias("_last"),
        F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("_good"),
    )
    out = done.join(planned, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.select(
        "source", "planned", "calls", "failed", "jobs", ((F.col("jobs") > 0) | (F.col("failed") < F.col("planned"))).alias("ok"),
        F.when(F.col("failed") > 0, F.format_string("%d/%d calls failed: %s", "failed", "calls", "_last")).alias("error"), F.col("_good").alias("last_success"),
    )
    if skipped is None:
        return out
    zero = F.lit(0).cast("long")
    none = skipped.select("source", *[zero.alias(c) for c in ("planned", "calls", "failed", "jobs")], F.lit(False).alias("ok"), F.col("reason").alias("error"), F.lit(None).cast(dict(out.dtypes)["last_success"]).alias("last_success"))
    return out.unionByName(none)


def let_through(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """G03, G08, G10, W06 together: ``requests`` (source, at, nth) with ``made``: whether the budget lets each call through.
    ``budgets``: source, daily (calls a UTC day), runs (slots a day), gap (seconds between calls). A day's calls are released
    slot by slot; what a slot leaves over is carried into the next until the day ends; no call comes sooner than the gap after
    the one before, across midnight too.

    Each (source, day) is folded on its own, in order, as a stream that keeps two numbers; so a source that makes most calls is
    dealt out by days. The only thing that days tell later ones is the last call. Days are folded again where that changes, until
    nothing does; a day that makes a call later than its first gap no longer depends on the day before, so rounds are few."""
    import pandas as pd

    ms = millis(F.col("at"))
    rows = requests.select("source", "at", "nth", ms.alias("ms"), F.floor(ms / DAY_MS).cast("long").alias("day")).join(F.broadcast(budgets.select("source", "daily", "runs", "gap")), "source")
    rows = stored(rows, "requests")

    def fold(frames):
        key, used, last = None, 0, None
        for f in frames:
            out = []
            for source, day, now, daily, runs, gap, carried in zip(*(f[c] for c in ("source", "day", "ms", "daily", "runs", "gap", "carried")), strict=True):
                if (source, day) != key:
                    key, used, last = (source, day), 0, None if carried != carried or carried is None else int(carried)
                released = (int((now % DAY_MS) * runs // DAY_MS) + 1) * daily // runs
                ok = used < min(daily, released) and (last is None or now - last >= gap * 1000)
                if ok:
                    used, last = used + 1, now
                out.append(ok)
            yield f.assign(made=out)[["source", "at", "nth", "ms", "day", "made"]]

    kinds = dict(rows.dtypes)
    schema = f"source {kinds['source']}, at {kinds['at']}, nth {kinds['nth']}, ms long, day long, made boolean"

    def folded(part: DataFrame) -> DataFrame:
        return stored(part.repartition("source", "day").sortWithinPartitions("source", "day", "ms", "nth").mapInPandas(fold, schema), "folded")

    def ends(done: DataFrame) -> DataFrame:
        """The last call before each day, over a row a day."""
        last = done.groupBy("source", "day").agg(F.max(F.when(F.col("made"), F.col("ms"))).alias("last"))
        earlier = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        return last.withColumn("carried", F.max("last").over(earlier)).filter("carried is not null").select("source", "day", "carried")

    done = folded(rows.withColumn("carried", F.lit(None).cast("long")))
    known = done.limit(0).select("source", "day", F.col("ms").alias("carried"))
    while True:
        now = stored(ends(done), "ends")
        before = known.select(F.col("source").alias("_s"), F.col("day").alias("_d"), F.col("carried").alias("_c"))
        same = (F.col("source") == F.col("_s")) & (F.col("day") == F.col("_d"))
        changed = stored(now.join(before, same, "full").filter(~F.col("carried").eqNullSafe(F.col("_c"))).select(F.coalesce("source", "_s").alias("source"), F.coalesce("day", "_d").alias("day"), "carried"), "changed")
        if changed.isEmpty():
            return done.select("source", "at", "nth", "made")
        again = folded(rows.join(changed, ["source", "day"]))
        done = stored(done.join(changed, ["source", "day"], "left_anti").unionByName(again), "folded")
        known = now


def usage(done: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, day, made, asked, left of each source's days."""
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    out = done.groupBy("source", day).agg(F.count_if("made").alias("made"), F.count("*").alias("asked"))
    return out.join(F.broadcast(budgets.select("source", "daily")), "source").select("source", "day", "made", "asked", (F.col("daily") - F.col("made")).alias("left"))

