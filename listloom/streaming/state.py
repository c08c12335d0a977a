"""Structured Streaming forms of the hourly run: counters by day and slot, and keyed state with expiry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity
from ..sources.files import read_or


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls by source and UTC day; works on batches and streams alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("calls")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "calls")


def slot_usage(events: DataFrame, slot: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls by source and slot."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", slot).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("slot"), "event_type", "calls", "value")


def upsert_state(events: DataFrame, key: str, ttl_hours: float, watermark: str = "1 hour") -> DataFrame:
    """The latest row of each key while it is seen, and its expiry when it hasn't been for ``ttl_hours``. State is one
    small row a key, kept and expired by Spark."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen_ms": [last], "n": [n], "expired": [True]})
            return
        last, n = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b["ms"].max()))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + int(ttl_hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_seen_ms": [last], "n": [n], "expired": [False]})

    rows = events.withWatermark("ts", watermark).select(key, "ts", F.unix_millis(F.col("ts")).alias("ms"))
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, last_seen_ms long, n long, expired boolean", "last long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def merge_each_batch(stream: DataFrame, folder: str, **options):
    """Keyed upserts of a stream of listings (with ``now``, the time of their run): each micro-batch is merged with the
    state of the one before, as ``merge_previous`` does with ``options``, and written under its own number, so a batch that
    runs again gives the same state. Returns the writer, to be started by the caller."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = read_or(spark, f"{folder}/{epoch - 1:012d}", batch.drop("now").withColumn("seen_at", F.lit(None).cast("timestamp_ntz")).schema)
        at = batch.agg(F.max("now")).first()[0]
        if at is None:
            out = before
        else:
            out = identity.merge_previous(batch.drop("now"), before, F.lit(at), **options).drop("fresh", "copies").select(before.columns)
        out.write.mode("overwrite").parquet(f"{folder}/{epoch:012d}")

    return stream.writeStream.foreachBatch(write)


def _merged(records: list[dict], best_or_other: list[str], longest: list[str], least: list[str], priority: str) -> dict:
    """``identity.dedupe`` of a key's few records, in their order: a higher priority takes over, gaps are filled from others."""
    out = dict(records[0])
    for r in records[1:]:
        best, other = (r, out) if r[priority] > out[priority] else (out, r)
        out = dict(best)
        out |= {c: best[c] if best[c] is not None else other[c] for c in best_or_other}
        out |= {c: best[c] if len(best[c] or "") >= len(other[c] or "") else other[c] for c in longest}
        out |= {c: min((x[c] for x in (best, other) if x[c] is not None), default=None) for c in least}
    return out


def keep_listings(stream: DataFrame, keep_days: int = 3, board_hours: int = 6, order: str = "pos", priority: str = "prio", best_or_other: list[str] = (), longest: list[str] = (), least: list[str] = ()) -> DataFrame:
    """Whole records in keyed state, as ``identity.merge_previous`` would have them after every run. ``stream``:
    rows with id, source and ``now``, the event time of their run. A key's record is merged with the rows of a run; a timer,
    as long as its kind of source allows, drops it when it hasn't been seen. Emits each record as it changes, with seen_at, and
    its id with ``expired`` when it goes. Only keys that a run touches or a timer reaches are read or written; the state store
    (which must be the one that keeps timers, RocksDB) writes what changed."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

    fields = [f for f in stream.schema.fields if f.name != "now"]
    names = [f.name for f in fields]
    kept = StructType([*fields, StructField("seen_at", TimestampType())])
    boards, hour = list(identity.BOARDS), 3_600_000
    merged, (fill, long, low) = _merged, (list(best_or_other), list(longest), list(least))

    def plain(x):
        return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x

    class Kept(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.record = handle, handle.getValueState("record", kept)

        def _until(self, record: dict, seen: int) -> int:
            return seen + (board_hours if record["source"] in boards else 24 * keep_days) * hour

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            new = pd.concat(list(rows)).sort_values(["now", order])
            out, ended = None, None
            if self.record.exists():
                out = dict(zip([*names, "seen_at"], self.record.get(), strict=True))
            for now, run in new.groupby("now", sort=True):
                at = int(pd.Timestamp(now).timestamp() * 1000)
                records = [{c: plain(v) for c, v in zip(names, r, strict=True)} for r in run[names].itertuples(index=False, name=None)]
                if out is not None and self._until(out, int(pd.Timestamp(out["seen_at"]).timestamp() * 1000)) >= at:
                    records.append(out)
                out = merged(records, fill, long, low, priority) | {"seen_at": pd.Timestamp(now).to_pydatetime()}
                ended = self._until(out, at) + 1
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ended)
            self.record.update(tuple(out[c] for c in [*names, "seen_at"]))
            yield pd.DataFrame([[*(out[c] for c in [*names, "seen_at"]), False]], columns=[*names, "seen_at", "expired"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            self.record.clear()
            yield pd.DataFrame([[key[0] if n == "id" else True if n == "expired" else None for n in [*names, "seen_at", "expired"]]], columns=[*names, "seen_at", "expired"])

        def close(self) -> None:
            pass

    out = StructType([*fields, StructField("seen_at", TimestampType()), StructField("expired", BooleanType())])
    rows = stream.withWatermark("now", "0 seconds")
    return rows.groupBy("id").transformWithStateInPandas(Kept(), outputStructType=out, outputMode="Update", timeMode="eventTime")
