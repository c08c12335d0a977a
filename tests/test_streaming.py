from pyspark.sql import functions as F

from listloom.streaming import state


def test_counters_are_the_same_in_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.daily_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.select("day", "event_type", "calls").collect()))
    assert rows(spark.table("usage")) == rows(state.daily_usage(events))


def test_keys_are_kept_until_they_expire(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00")]
    make = lambda r: spark.createDataFrame(r, "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
    make(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = state.upsert_state(stream, "id", 6).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    make([("c", "2024-01-03 00:00:00")]).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r["id"], r["n"], r["expired"]) for r in spark.table("kept").collect()}
    assert ("a", 2, False) in got and ("b", 1, False) in got and ("c", 1, False) in got
    assert ("a", 2, True) in got


def test_listings_are_merged_batch_by_batch(spark, tmp_path):
    schema = "id string, title string, company string, city string, region string, source string, pos int, prio int, description string, now timestamp_ntz"
    make = lambda rows, at: spark.createDataFrame([(*r, at) for r in rows], schema.replace("timestamp_ntz", "string")).withColumn("now", F.col("now").cast("timestamp_ntz"))
    cook, nurse = ("x", "Cook", "A", "", "", "adzuna", 0, 4, "c"), ("y", "Nurse", "B", "", "", "lever", 1, 7, "n")
    make([cook, nurse], "2024-01-01 00:00:00").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = state.merge_each_batch(stream, str(tmp_path / "state"), longest=["description"]).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    make([("x", "Chef", "A", "", "", "adzuna", 0, 4, None)], "2024-01-01 12:00:00").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    last = sorted(p.name for p in (tmp_path / "state").iterdir())
    r = {x["title"]: x for x in spark.read.parquet(str(tmp_path / "state" / last[-1])).collect()}
    assert len(last) == 2 and set(r) == {"Cook", "Chef"}  # a board's posting that isn't seen goes within hours
    assert r["Cook"]["seen_at"].hour == 0 and r["Chef"]["seen_at"].hour == 12 and r["Cook"]["description"] == "c"


def test_state_of_the_stream_is_that_of_merged_runs(spark, tmp_path):
    """Every run is a start of the query from its checkpoint; after each, the stream's records are the batch's."""
    import datetime as dt
    import random

    from listloom.operators import identity

    random.seed(3)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "title string, company string, city string, region string, source string, pos long, prio int, description string, salary double, now timestamp"
        start, live, kept = dt.datetime(2024, 1, 1), {}, None

        def sink(batch, _):
            for r in batch.collect():
                live.pop(r["id"], None)
                if not r["expired"]:
                    live[r["id"]] = r

        for hours in (0, 4, 9, 11, 30, 77, 150):
            rows = []
            for k in range(12):
                source, prio = random.choice([("lever", 7), ("adzuna", 4), ("jooble", 3)])
                rows.append((f"Job {random.randrange(9)}", "Acme", "", "ON", source, k, prio, random.choice([None, "d" * random.randrange(5)]), random.choice([None, 1.0, 2.0]), start + dt.timedelta(hours=hours)))
            fresh = spark.createDataFrame(rows, schema).withColumn("id", identity.fingerprint(F.col("title"), F.col("company"), F.col("city"), F.col("region")))
            fresh.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(fresh.schema).parquet(str(tmp_path / "in"))
            q = state.keep_listings(stream, best_or_other=["salary"], longest=["description"]).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
            q.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
            empty = spark.createDataFrame([], fresh.drop("now").schema).withColumn("seen_at", F.lit(None).cast("timestamp"))
            kept = identity.merge_previous(fresh.drop("now"), empty if kept is None else spark.createDataFrame(kept, empty.schema), F.lit(start + dt.timedelta(hours=hours)), best_or_other=["salary"], longest=["description"])
            kept = [tuple(r) for r in kept.select(empty.columns).collect()]
            cells = ["id", "title", "source", "prio", "description", "salary", "seen_at"]
            want = {r[empty.columns.index("id")]: tuple(r[empty.columns.index(c)] for c in cells) for r in kept}
            assert {k: tuple(r[c] for c in cells) for k, r in live.items()} == want, hours
    finally:
        spark.conf.set(provider, before)
