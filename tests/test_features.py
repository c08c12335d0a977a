"""Saved searches, request parameters, call logs and budgets, files of a run: brute force, plain loops and round trips."""

import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from listloom.operators import calls, params, query, resume, saved, search, tracker
from listloom.sources import files


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_saved_searches_are_brute_force(spark, monkeypatch, few):
    """All kinds of searches, on the compiled matcher of each; with nothing small enough to broadcast too."""
    monkeypatch.setattr(saved, "FEW", few)
    random.seed(few + 1)
    words = ["soc", "analyst", "analysts", "nurse", "rn", "help", "desk", "senior", "a", "it", "c", "cloud engineer", "x1"]
    aliases = {"soc analyst": ["security analyst"], "nurse": ["rn"]}
    listings = [(k, f"2024-01-{1 + k % 28:02d} 00:00:00", " ".join(random.choices(words, k=random.randrange(6))), random.choice([None, [], ["soc analyst"], ["nurse", "help desk"]])) for k in range(120)]
    rows = spark.createDataFrame(listings, "id long, t string, hay string, tags array<string>").select("id", F.col("t").cast("timestamp_ntz").alias("posted_at"), "hay", "tags")

    def term():
        w = random.choice(["soc", "analyst", "alyst", "nurse", '"help desk"', "rn", "senior", "ti", "c", '"soc analyst"', "zzz", "+", '"a it"'])
        return ("-" if random.random() < 0.2 else "") + w

    said = ["", "-senior", '-"help desk" -rn', "soc analyst", "nurse OR -x1", "zzz", "+", '""', "soc OR soc"] + [" ".join(random.choice([term(), "OR"]) if random.random() < 0.25 else term() for _ in range(random.randrange(1, 5))) for _ in range(60)]
    sets = [(k, q, f"2024-01-{1 + (k * 7) % 30:02d} 00:00:00") for k, q in enumerate([*said, None, "soc", "soc"])]
    frame = spark.createDataFrame(sets, "set int, query string, t string").select("set", "query", F.col("t").cast("timestamp_ntz").alias("since"))
    got = {r["set"]: r["new"] for r in saved.new_counts(rows, frame, ["soc analyst", "nurse"], aliases).collect()}
    hits = rows.select("posted_at", *[search.compile_query(q or "", ["soc analyst", "nurse"], aliases).test(F.col("hay"), F.col("tags")).alias(f"m{k}") for k, q, _ in sets]).collect()
    want = {k: sum(bool(r[f"m{k}"]) and str(r["posted_at"]) > t for r in hits) for k, _, t in sets}
    assert got == want


def test_saved_searches_store_words_and_counts_not_pieces_and_hits(spark, monkeypatch):
    """What is stored grows with the distinct words and the times of a search, not with the listings' pieces or the hits; ids may repeat."""
    kept = {}
    stored = saved.stored
    monkeypatch.setattr(saved, "stored", lambda df, label: kept.update({label: stored(df, label)}) or kept[label])
    rows = spark.range(400).selectExpr("id % 100 AS id", "'acme ' || if(id % 4 = 0, 'inc analyst', 'ltd') AS hay", "CAST(array() AS array<string>) AS tags", "CAST(if(id % 2 = 0, '2024-01-02', '2024-01-03') AS timestamp_ntz) AS posted_at")
    sets = spark.range(90).selectExpr("id AS set", "if(id % 2 = 0, '-inc', 'analyst \"inc\"') AS query", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS since")
    got = {r["set"]: r["new"] for r in saved.new_counts(rows, sets).collect()}
    assert got == {k: (300 if k < 24 else 200 if k < 48 else 0) if k % 2 == 0 else (100 if k < 24 else 0) for k in range(90)}
    assert kept["hits"].count() == 2 and kept["tokens"].count() == 4
    assert kept["listings"].count() == 400 and "listing-keys" not in kept


def test_plan_of_saved_searches_has_no_cross_join(spark):
    rows = spark.createDataFrame([(1, "a b", [])], "id long, hay string, tags array<string>").withColumn("posted_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    sets = spark.createDataFrame([(1, "a"), (2, "-b")], "set int, query string").withColumn("since", F.lit("2023-01-01").cast("timestamp_ntz"))
    plan = saved.new_counts(rows, sets)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_parameters_round_trip(spark):
    """The shortest URL has the same meaning, and is its own shortest; columns and one request agree."""
    random.seed(2)
    pick = {"q": ["", "a&b=c", "soc+é %"], "country": ["CA", "ALL", "xx"], "skills": ["", "Python, SQL", ",".join("abcdefghijkl")], "minSalary": ["", "5e4", "-1", "1d"], "level": ["all", "senior"], "sort": ["relevance", "newest"],
            "pageSize": ["25", "7.9", "0", "-4", "1000"], "boost": ["lead,nope", ""], "hide": ["clearance,x"], "from": ["2024-01-05", "x"], "sponsor": ["1", "2"], "region": ["on", "b.c"], "company": [" Acme "]}
    asked = [{k: random.choice(v) for k, v in pick.items() if random.random() < 0.6} for _ in range(80)]
    rows = spark.createDataFrame([(i, "https://x.example/?" + urllib.parse.urlencode(a) + "#top") for i, a in enumerate(asked)], "i int, u string")
    rows = rows.withColumn("p", params.raw(F.col("u"))).withColumn("s", params.shortest(F.col("p")))
    rows = rows.withColumn("p2", params.raw(F.concat(F.lit("/"), "s")))
    out = rows.select("i", "s", params.shortest(F.col("p2")).alias("s2"), params.parsed(F.col("p")).alias("x"), params.parsed(F.col("p2")).alias("y"), params.active_filters(F.col("p")).alias("n"), params.active_filters(F.col("p2")).alias("n2")).collect()
    assert len(out) == 80
    for r in out:
        a = asked[r["i"]]
        assert r["s"] == r["s2"] and r["x"] == r["y"] and r["n"] == r["n2"]
        assert dict(urllib.parse.parse_qsl(r["s"][1:])) == {k: v for k, v in a.items() if v and v != params.DEFAULTS[k]}
        one = query.parse_params(a)
        assert (one.q, one.country, one.skills, one.min_salary, one.level, one.sort, one.page_size, one.boost, one.hide_auth, one.sponsorship, one.region, one.company) == tuple(
            tuple(r["x"][c]) if isinstance(r["x"][c], list) else r["x"][c] for c in ("q", "country", "skills", "min_salary", "level", "sort", "page_size", "boost", "hide_auth", "sponsorship", "region", "company")
        ) or a.get("minSalary") == "1d"


def test_runs_stop_at_a_bad_key_or_quota(spark):
    rows = [("a", 1, None, 2), ("a", 2, "HTTP 500", 0), ("a", 3, "quota: 429", 0), ("a", 4, None, 9), ("b", 1, "error 4290", 0), ("b", 2, "timed out", 0), ("c", 1, None, 0), ("d", 1, "401", 0), ("d", 2, None, 5)]
    frame = spark.createDataFrame([(s, at, at, e, n) for s, at, e, n in rows], "source string, at long, nth long, error string, jobs long")
    r = {x["source"]: x for x in calls.outcomes(frame, spark.createDataFrame([("z", "no key")], "source string, reason string")).collect()}
    assert [(r["a"][c]) for c in ("planned", "calls", "failed", "jobs", "ok", "error", "last_success")] == [4, 3, 2, 2, True, "2/3 calls failed: quota: 429", 1]
    assert (r["b"]["ok"], r["b"]["error"]) == (False, "2/2 calls failed: timed out") and r["c"]["ok"] and r["d"]["calls"] == 1 and r["d"]["ok"] and not r["z"]["ok"]
    assert calls.outcomes(frame.limit(0)).count() == 0


def test_budget_is_a_plain_loop(spark):
    random.seed(6)
    day = 86_400_000
    budgets = {"a": (5, 24, 7200), "b": (50, 4, 0), "c": (3, 1, 100_000), "d": (1000, 24, 50_000)}
    asked = sorted((random.choice("abcd"), random.randrange(9 * day), k) for k in range(1500))
    want, used, last = {}, {}, {}
    for s, t, k in asked:
        daily, runs, gap = budgets[s]
        n = used.get((s, t // day), 0)
        want[k] = n < min(daily, (t % day * runs // day + 1) * daily // runs) and (s not in last or t - last[s] >= gap * 1000)
        if want[k]:
            used[s, t // day], last[s] = n + 1, t
    rows = spark.createDataFrame(asked, "source string, t long, nth long").select("source", F.timestamp_millis("t").alias("at"), "nth")
    limits = spark.createDataFrame([(s, *b) for s, b in budgets.items()], "source string, daily long, runs long, gap long")
    done = calls.let_through(rows, limits)
    assert {r["nth"]: r["made"] for r in done.collect()} == want and 0 < sum(want.values()) < 1500
    assert all(r["left"] >= 0 for r in calls.usage(done, limits).collect())
    assert calls.let_through(rows.limit(0), limits).count() == 0


def test_hits_are_of_the_latest_entry(spark):
    entries = spark.createDataFrame([("u", "Nurse", "X", 1, 1), ("u", "nurse", "X", 5, 2), ("u", "cook", "", 2, 3), ("u", "cook", "Y", 3, 4)], "user string, q string, city string, at long, pos long")
    results = spark.createDataFrame([("u", "NURSE", "X", 4, 9, 7), ("u", "nurse", "X", 6, 10, 3), ("u", "nurse", "X", 8, 11, 4), ("u", "cook", "Z", 9, 12, 1)], "user string, q string, city string, at long, pos long, hits long")
    got = {(r["q"], r["city"]): (r["nth"], r["hits"]) for r in tracker.recent_with_hits(entries, results).collect()}
    assert got == {("nurse", "X"): (1, 4), ("cook", "Y"): (2, None), ("cook", ""): (3, None)}


def test_files_of_a_run_are_swapped_whole(spark, tmp_path):
    folder, schema = str(tmp_path / "out"), "id string, title string"
    assert files.read_run(spark, folder, "jobs", schema).count() == 0
    first = spark.createDataFrame([("aa1", "x", "said"), ("bb2", "y", None), ("aa3", None, "more")], "id string, title string, description string")
    items = files.feed_xml(spark.createDataFrame([(2, "<item>b</item>"), (1, "<item>a</item>")], "pos int, item string"), "A & B", "https://x.example/?a=1&b=2", "now")
    files.write_run(folder, {"jobs": first, "state": first.select("id")}, {"soc": items})
    run = files.write_run(folder, {"jobs": first.filter("id = 'bb2'")}, {"soc": items})
    assert [tuple(r) for r in files.read_run(spark, folder, "jobs", schema).collect()] == [("bb2", "y")]
    text = "".join(r["value"] for r in spark.read.text(f"{folder}/{run}/feeds/soc.xml").collect())
    assert text.count("<item>") == 2 and text.index("a</item>") < text.index("b</item>") and "A &amp; B" in text and text.endswith("</rss>")
    import xml.dom.minidom

    assert xml.dom.minidom.parseString(text).documentElement.tagName == "rss"
    (tmp_path / "out" / ".current.json.crc").unlink(missing_ok=True)
    (tmp_path / "out" / "current.json").write_text('{"version": 99, "run": "' + run + '"}')
    assert files.read_run(spark, folder, "jobs", schema).count() == 0


def test_only_shards_asked_for_are_read(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("aa1", "t", "one"), ("ab2", "t", "two"), ("ba3", "t", None), ("bb4", "t", "four")], "id string, title string, description string")
    files.write_snapshot(rows, folder)
    for p in (tmp_path / "out" / "descriptions" / "shard=bb").iterdir():
        p.write_bytes(b"not a table")  # nobody asks for it
    ids = spark.createDataFrame([("aa1",), ("ab2",), ("ab9",), ("ba3",), ("x",)], "id string")
    got = files.descriptions(spark, folder, ids)
    assert sorted(tuple(r) for r in got.collect()) == [("aa1", "one"), ("ab2", "two")]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_keywords_by_pair(spark):
    """The streamed choice is the greedy one, with exclusions and limits of each posting."""
    random.seed(4)
    words = ["alpha", "beta", "gamma", "alphabet", "delta", "be", "eta", "ray", "rays", "epsilon"]
    texts = [(k, " ".join(random.choices(words, k=120))) for k in range(25)]
    rules = [(k, random.sample(["alpha", "gamma ray", "delta", "zeta"], k % 3), 3 + k % 9) for k in range(25)]
    frame = spark.createDataFrame(texts, "k int, text string")
    got = resume.keywords(frame, "k", "text", ["ray"], ["epsilon"], rules=spark.createDataFrame(rules, "k int, exclude array<string>, most int"))
    terms = {}
    for r in resume.term_counts(frame, "k", "text", ["ray"]).collect():
        terms.setdefault(r["k"], []).append((-r["count"] * (1.6 if " " in r["term"] else 1), r["first_pos"], r["term"], r["count"]))
    want = set()
    for k, exclude, most in rules:
        chosen = []
        for _, _, t, n in sorted(terms[k]):
            if n >= 2 and len(chosen) < most and not any(e in t or t in e for e in [*exclude, "epsilon", *chosen]):
                want.add((k, t, n, len(chosen)))
                chosen.append(t)
    assert {tuple(r) for r in got.collect()} == want
