import random

import pytest
from pyspark.sql import functions as F

from listloom.operators import identity, links, query, resume, schedule, search
from listloom.sources import files, parsers, robots


def merged_by_fold(rows):
    """The left fold that dedupe's closed form stands for."""
    out = None
    for r in rows:
        if out is None:
            out = dict(r)
            continue
        best, other = (r, out) if r["prio"] > out["prio"] else (out, r)
        longer = best["body"] if len(best["body"]) >= len(other["body"]) else other["body"]
        out = dict(best, salary=best["salary"] if best["salary"] is not None else other["salary"], body=longer, at=min(best["at"], other["at"]))
    return out


def test_dedupe_is_the_fold(spark):
    random.seed(4)
    rows = [{"k": random.randrange(300), "ord": i, "prio": random.randrange(4), "salary": random.choice([None, i]), "body": "x" * random.randrange(3) + str(i % 10), "at": random.randrange(99)} for i in range(2000)]
    got = {r["k"]: r for r in identity.dedupe(spark.createDataFrame(rows, "k int, ord int, prio int, salary int, body string, at int"), "k", "ord", "prio", ["salary"], ["body"], ["at"]).collect()}
    for k in {r["k"] for r in rows}:
        want = merged_by_fold([r for r in rows if r["k"] == k])
        assert {c: got[k][c] for c in want} == want


def options_by_hand(lists):
    links, portals = set(), {}
    for o in (o for options in lists for o in options):
        link = o[1].split("?")[0].split("#")[0].rstrip("/").lower()
        if not o[1].lower().startswith("http") or link in links:
            continue
        links.add(link)
        if o[0].lower() not in portals or (o[2] and not portals[o[0].lower()][2]):
            portals[o[0].lower()] = o
    return ([o for o in portals.values() if o[2]] + [o for o in portals.values() if not o[2]])[:12]


def test_dedupe_merges_options(spark):
    """Those that took over, the last of them first, then the others in order; a key that a third of all rows share too."""
    random.seed(6)
    rows = []
    for i in range(1500):
        options = [(f"P{random.randrange(16)}", random.choice(["https", "HTTP", "ftp"]) + f"://h/{random.randrange(40)}{random.choice(['', '?a', '/'])}", random.random() < 0.3) for _ in range(random.randrange(3))]
        rows.append((0 if random.random() < 0.3 else random.randrange(100), i, random.randrange(5), f"https://own/{i}", options))
    frame = spark.createDataFrame(rows, f"k int, ord int, prio int, url string, options array<{identity.OPTION}>")
    got = {r["k"]: r for r in identity.dedupe(frame, "k", "ord", "prio", [], [], [], options="options", link="url").collect()}
    for k in {r[0] for r in rows}:
        late, early = [], []
        for r in (r for r in rows if r[0] == k):
            (early if not early or r[2] > max(x[2] for x in early) else late).append(r)
        want = options_by_hand([r[4] for r in [*early[::-1], *late]])
        assert [tuple(o) for o in got[k]["options"]] == want
        assert got[k]["url"] == (want[0][1] if want else early[-1][3])


def test_earlier_rows_are_keyed_anew(spark):
    schema = "id string, title string, company string, city string, region string, source string, pos int, prio int, salary int, description string"
    key = spark.range(1).select(identity.fingerprint(F.lit("Cook"), F.lit("Acme"), F.lit("Guelph"), F.lit("ON")).alias("k")).first()["k"]
    fresh = spark.createDataFrame([(key, "Cook", "Acme", "Guelph", "ON", "adzuna", 0, 4, None, "short")], schema)
    old = spark.createDataFrame([("old", "cook", "ACME Inc.", "Guelph", "ON", "usajobs", 0, 6, 9, "much longer"), ("gone", "Nurse", "B", "", "", "lever", 1, 7, None, None), ("kept", "Nurse", "B", "", "", "adzuna", 2, 4, None, None)], schema)
    old = old.withColumn("seen_at", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    r = {x["title"]: x for x in identity.merge_previous(fresh, old, now, board_hours=6, best_or_other=["salary"], longest=["description"]).collect()}
    assert set(r) == {"cook", "Nurse"}
    assert (r["cook"]["id"], r["cook"]["fresh"], r["cook"]["salary"], r["cook"]["description"], r["cook"]["seen_at"].day) == (key, True, 9, "much longer", 2)
    assert (r["Nurse"]["source"], r["Nurse"]["fresh"], r["Nurse"]["seen_at"].hour) == ("adzuna", False, 12)


def test_terms_of_a_very_long_text(spark):
    rows = resume.term_counts(spark.createDataFrame([(1, "night shift, " * 100_000)], "id int, t string"), "id", "t", []).collect()
    assert {r["term"]: r["count"] for r in rows} == {"night": 100_000, "shift": 100_000, "night shift": 100_000}


def test_title_variants(spark):
    m = resume.title_match(F.col("t"), F.lit("an sre of ten years"), aliases={"site reliability engineer": ["SRE"]})
    r = spark.createDataFrame([("Senior Site Reliability Engineer",), ("Cook",), ("",)], "t string").select(m.alias("m")).collect()
    assert [x["m"]["ok"] for x in r] == [True, False, False]


def test_options(spark):
    o = [("LinkedIn", "https://l.com/1?x", False), ("linkedin", "https://l.com/2", True), ("Other", "https://l.com/1/", True), ("Bad", "ftp://x", True), ("Z", "https://z.com", False)]
    got = spark.createDataFrame([(o,)], f"o array<{identity.OPTION}>").select(identity.merge_options(F.col("o")).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [("linkedin", "https://l.com/2", True), ("Z", "https://z.com", False)]


def test_finalize(spark):
    row = [("  Sr.  Cloud Eng ", "", "Toronto", "ON", "CA", "AWS and Terraform", None, "https://jobs.lever.co/acme/1", None, (90000.0, None, "CAD", "yearly"), "lever")]
    schema = f"title string, company string, city string, region string, country string, description string, snippet string, apply_url string, apply_options array<{identity.OPTION}>, salary struct<min:double,max:double,currency:string,period:string>, source string"
    r = identity.finalize(spark.createDataFrame(row, schema)).first()
    assert (r["title"], r["company"], r["salary_yearly_cad"], r["seniority"], r["tools"]) == ("Sr. Cloud Eng", "Confidential employer", 90000, "senior", ["AWS", "Terraform"])
    assert len(r["id"]) == 20 and r["apply_options"][0]["portal"] == "Company site (Lever)"


def test_params():
    p = query.parse_params({"country": "XX", "pageSize": "9999", "page": "-3", "region": "on1", "industry": "drop table", "minSalary": "-5", "from": "2024-02-31", "skills": "a,b,,c"})
    assert (p.country, p.page_size, p.page, p.region, p.industry, p.min_salary, p.date_from, p.skills) == ("ALL", 100, 1, "ON", "all", None, None, ("a", "b", "c"))


def test_query_grammar():
    assert search.tokens('soc OR "help desk" -guard -"team lead"') == ([[("soc", False)], [("help desk", True)]], ["guard", "team lead"])
    assert search.compile_query("").empty and not search.compile_query("-x").empty
    m = search.compile_query("site reliability engineer", ["site reliability engineer"], {"site reliability engineer": ["sre"]})
    assert len(m.clauses) == 1 and m.clauses[0][0].phrase and "sre" in m.clauses[0][0].variants


def test_split_and_rotation(spark):
    lanes = spark.createDataFrame([("a", 10, 1.0, 0), ("b", 10, 1.0, 1), ("c", 1, 1.0, 2)], "key string, size long, share double, pos int")
    assert {r["key"]: r["calls"] for r in schedule.split_calls(lanes, 10).collect()} == {"a": 5, "b": 4, "c": 1}
    plan = spark.range(5).withColumnRenamed("id", "ord")
    assert [r["ord"] for r in schedule.rotate(plan, 3, 4, 5).orderBy("turn").collect()] == [3, 4, 0, 1]


def test_resume_score(spark):
    f = resume.match_score(F.array().cast("array<string>"), F.array(F.lit("x")), F.array(F.lit("t")), F.array(F.lit("t")))
    assert spark.range(1).select(f.alias("m")).first()["m"]["score"] == 80


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 5\n\nUser-agent: evil\nDisallow: /"
    rules = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"), "goodbot")
    paths = spark.createDataFrame([("h", p) for p in ("/", "/private/x", "/private/open/y")], "host string, path string")
    assert {r["path"]: r["allowed"] for r in robots.allowed(paths, rules).collect()} == {"/": True, "/private/x": False, "/private/open/y": True}
    bad = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"), "EvilBot")
    assert not robots.allowed(paths, bad).filter("allowed").count()


def test_payloads(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    body = lambda s: spark.createDataFrame([(s,), ("not json",)], "body string")
    r = parsers.adzuna(body('{"results":[{"title":"Cook","description":"<b>Hot</b> kitchen","redirect_url":"https://a.b/1","created":"2024-01-01T00:00:00Z","salary_min":30,"salary_max":35,"company":{"display_name":"Acme"},"location":{"display_name":"Guelph, ON","area":["Canada","Ontario","Guelph"]}}]}'), "CA", now).collect()
    assert len(r) == 1 and (r[0]["city"], r[0]["region"], r[0]["salary"]["period"]) == ("Guelph", "ON", "hourly")
    r = parsers.jsearch(body('{"data":{"jobs":[{"job_title":"Dev","employer_name":"X","job_city":"Austin","job_state":"Texas","job_country":"US","job_apply_link":"https://x.y"}]}}'), now).first()
    assert (r["region"], r["country"], r["industry"]) == ("TX", "US", "other")
    r = parsers.board(body('{"jobs":[{"title":"Engineer","location":{"name":"Toronto, ON"},"absolute_url":"https://boards.greenhouse.io/a/1","updated_at":"2024-01-01T00:00:00Z","content":"&lt;p&gt;Hi&lt;/p&gt;"},{"title":"Far","location":{"name":"Berlin"},"absolute_url":"https://z"}]}'), "greenhouse", "Acme", now).collect()
    assert [(x["title"], x["region"], x["description"]) for x in r] == [("Engineer", "ON", "Hi")]
    r = parsers.remotive(body('{"jobs":[{"url":"https://r/1","title":"SRE","company_name":"Q","candidate_required_location":"USA","salary":"$100k"},{"url":"https://r/2","title":"X","candidate_required_location":"Germany"}]}'), now).collect()
    assert [(x["country"], x["salary"]["min"], x["work_type"]) for x in r] == [("US", 100000, "remote")]
    r = parsers.himalayas(body('{"jobs":[{"title":"PM","companyName":"H","locationRestrictions":["Canada"],"pubDate":1700000000,"applicationLink":"https://h/1"}]}'), now).first()
    assert r["posted_at"].year == 2023
    rss = "<rss><item><title>Cook - Acme (ON)</title><link>https://j/1;jsessionid=9?x=1</link><description><![CDATA[Employer: Diner\nSalary: $20 hour]]></description></item></rss>"
    r = parsers.feed(body(rss), now).first()
    assert (r["title"], r["company"], r["apply_url"], r["salary"]["period"]) == ("Cook", "Diner", "https://j/1?x=1", "hourly")
    r = parsers.jsearch(body('{"data":[{"job_title":"Dev","job_apply_link":"https://www.indeed.com/1","job_publisher":"Indeed","apply_options":[{"publisher":"Acme","apply_link":"https://acme.example/1","is_direct":true}]}]}'), now).first()
    assert [tuple(o) for o in r["apply_options"]] == [("Company site (Acme)", "https://acme.example/1", True), ("Indeed", "https://www.indeed.com/1", False)]
    r = parsers.board(body('[{"text":"Nurse","categories":{"location":"Toronto, ON"},"hostedUrl":"https://l/1","createdAt":1700000000000,"descriptionPlain":"hi","workplaceType":"remote"}]'), "lever", "Acme", now).first()
    assert (r["title"], r["region"], r["is_remote"], r["apply_url"], r["posted_at"].year) == ("Nurse", "ON", True, "https://l/1", 2023)
    r = parsers.board(body('{"jobs":[{"title":"Cook","location":"Austin, TX","applyUrl":"https://a/1","publishedAt":"2024-02-03T00:00:00Z","descriptionHtml":"<p>x</p>","isRemote":false}]}'), "ashby", "Acme", now).first()
    assert (r["city"], r["region"], r["description"], r["posted_at"].month) == ("Austin", "TX", "x", 2)
    r = parsers.board(body('{"content":[{"name":"Clerk","ref":"https://s/1","releasedDate":"2024-02-03T00:00:00Z","location":{"city":"Guelph","region":"ON","country":"ca","remote":false}},{"name":"Far","ref":"https://s/2","location":{"city":"Paris","country":"fr"}}]}'), "smartrecruiters", "Acme", now).collect()
    assert [(x["title"], x["region"], x["country"]) for x in r] == [("Clerk", "ON", "CA")]
    r = parsers.board(body('{"jobs":[{"title":"Driver","telecommuting":true,"application_url":"https://w/1","published_on":"2024-02-03","locations":[{"city":"Laval","region":"Quebec","countryCode":"CA"}]}]}'), "workable", "Acme", now).first()
    assert (r["city"], r["region"], r["is_remote"]) == ("Laval", "QC", True)
    r = parsers.board(body('{"offers":[{"title":"Welder","city":"Boise","state_code":"ID","country_code":"US","careers_url":"https://r/1","published_at":"2024-02-03 00:00:00","company_name":"A","description":"d","requirements":"q"}]}'), "recruitee", "Acme", now).first()
    assert (r["city"], r["region"], r["country"], r["posted_at"].day) == ("Boise", "ID", "US", 3)
    item = '{"MatchedObjectDescriptor":{"PositionTitle":"Ranger","OrganizationName":"Parks","PositionURI":"https://u/1","PublicationStartDate":"2024-02-03","PositionLocation":[{"LocationName":"Boise, Idaho"}],"PositionRemuneration":[{"MinimumRange":"20","MaximumRange":"30","RateIntervalCode":"PH"}],"UserArea":{"Details":{"JobSummary":"walk"}}}}'
    r = parsers.usajobs(body('{"SearchResult":{"SearchResultItems":[' + item + "]}}"), now).first()
    assert (r["region"], r["salary"]["period"], r["salary"]["max"], r["apply_url"]) == ("ID", "hourly", 30, "https://u/1")
    r = parsers.jooble(body('{"jobs":[{"title":"<b>Cook</b>","location":"Guelph, ON","snippet":"hot","salary":"$20 - $25 per hour","link":"https://j/1","company":"Diner"}]}'), "CA", now).first()
    assert (r["title"], r["region"], r["salary"]["min"], r["company"]) == ("Cook", "ON", 20, "Diner")
    for source in ("lever", "ashby", "smartrecruiters", "workable", "recruitee"):
        assert parsers.board(body("[]"), source, "A", now).count() == 0
    assert parsers.usajobs(body("{}"), now).count() == parsers.jooble(body("{}"), "CA", now).count() == 0


def test_files(spark, tmp_path):
    lines = [(i, x) for i, x in enumerate(["# c", "[general]", "Data  Analyst", "[priority]", "SOC analyst # note", "data analyst", ""])]
    got = [(r["keyword"], r["tier"]) for r in files.keyword_file(spark.createDataFrame(lines, "n int, line string")).orderBy("pos").collect()]
    assert got == [("soc analyst", "priority"), ("data analyst", "general")]
    rows = spark.createDataFrame([("ab1", "t", "long"), ("cd2", "u", None)], "id string, title string, description string")
    files.write_snapshot(rows, str(tmp_path))
    assert files.description(spark, str(tmp_path), "ab1").first()["description"] == "long"
    assert files.read_or(spark, str(tmp_path / "none"), "a int").count() == 0
    assert files.env("A=1\nB='x'", {"A": "0"}) == {"A": "0", "B": "x"}


def test_fan_out(spark):
    rows = spark.range(2).toDF("id")

    def fails():
        raise OSError("away")

    df, said = parsers.fan_out({"CA": lambda: rows, "US": fails})
    assert df.count() == 2 and said == {"CA": None, "US": "away"}
    with pytest.raises(OSError, match="away"):
        parsers.fan_out({"US": fails})


def test_state_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01")], "id string, seen_at string")
    files.write_state(rows, f"{tmp_path}/s")
    assert files.read_state(spark, f"{tmp_path}/s", "id string, seen_at string").count() == 1
    rows.withColumn("version", F.lit(2)).write.parquet(f"{tmp_path}/t")
    files.write_state(rows, f"{tmp_path}/d", demo=True)
    assert files.read_state(spark, f"{tmp_path}/t", "id string, seen_at string").count() == files.read_state(spark, f"{tmp_path}/d", "id string, seen_at string").count() == 0
    previous = spark.createDataFrame([("b", None, "2023-01-01", "CA")], "id string, seen_at string, updated_at string, country string")
    live = files.or_previous(rows.limit(0), previous, F.col("country") == "CA").collect()
    assert [(r["id"], r["seen_at"]) for r in live] == [("b", "2023-01-01")] and files.or_previous(rows, previous, F.lit(True)).first()["id"] == "a"
    from listloom.plans import views

    listings = views.listings(spark, "/root/testdata/sf0.001")
    keywords = spark.createDataFrame([("soc analyst",)], "keyword string")
    files.write_reports(listings, keywords, listings.groupBy("source").count(), views.now(), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/stats").count() == 3 and spark.read.json(f"{tmp_path}/keywords").first()["keyword"] == "soc analyst"


def test_tags_are_projected(spark):
    rows = spark.createDataFrame([("Night Nurse", None, None, "s"), ("Cook", "x", "y", "t")], "title string, snippet string, description string, seen_at string")
    r = identity.tagged(rows, ["registered nurse"], {"registered nurse": ["nurse"]}).orderBy("title").collect()
    assert [(x["tags"], x["seen_at"]) for x in r] == [(None, "t"), (["registered nurse"], "s")]


def test_discovery(spark):
    companies = spark.createDataFrame([("Acme Robotics Inc.",)], "company string")
    answers = spark.createDataFrame([("lever", "acme", None, 2), ("lever", "acme-robotics", None, 1), ("greenhouse", "acmerobotics", "Someone Else", 5), ("ashby", "acme", None, 0)], "board string, slug string, name string, jobs int")
    r = schedule.discovered(companies, answers).collect()
    assert [(x["board"], x["slug"], x["name"]) for x in r] == [("lever", "acme", "Acme Robotics Inc.")]
    misses = spark.createDataFrame([("lever:acme",)], "address string")
    assert [x["slug"] for x in schedule.discovered(companies, answers, misses).collect()] == ["acme-robotics"]


def test_links(spark):
    searches = spark.createDataFrame([(1, "soc analyst", "CA", "", "ON", 7), (2, "", "ALL", "Toronto", "ON", None)], "search_id int, q string, country string, city string, region string, days int")
    platforms = spark.createDataFrame([("P", "CA", "https://p/?q={q}&l={where}", "&d={days}", 0), ("N", "CA", None, None, 1), ("U", "US", "https://u/{where}", None, 2)], "platform string, country string, template string, days_part string, pos int")
    r = links.platform_links(searches, platforms).orderBy("search_id", "ord").collect()
    assert [x["url"] for x in r] == ["https://p/?q=soc%20analyst&l=Ontario&d=7", "https://p/?q=&l=Toronto%2C%20Ontario", "https://u/United%20States"]


def test_next_call_of_any_number_of_runs(spark):
    """G04 by trying every slot; more runs a day than there are minutes too."""
    from listloom.operators import schedule

    day = 86_400_000
    rows = [(d, u, h * day // 48 + 7, r) for d in (0, 1, 6, 48, 240) for u in (-1, 0, 1, 5, 6, 47, 239, 240) for h in (0, 17, 47) for r in (1, 7, 24, 2880)]
    df = spark.createDataFrame([*rows, (6, None, 0, 24)], "d int, u int, at long, r int")
    got = [tuple(x) for x in df.select("d", "u", "at", "r", schedule.hours_until_next(F.col("d"), F.col("u"), F.col("at"), F.col("r"))).collect()]

    def want(d, u, at, r):
        slot = int(at % day // (day / r))
        t = next((t for t in range(slot + 1, r) if u is not None and (t + 1) * d // r > u), r)
        return int((t - slot) * 24 / r + 0.5)

    assert got == [(*x, want(*x)) for x in [*rows, (6, None, 0, 24)]]


def test_terms_of_postings_that_share_a_key_meet(spark):
    """A posting is counted where it is; postings of one key, null too, are one, and no posting's terms are shuffled if none do."""
    rows = [(1, "solar panel, solar panel."), (2, "wind farm"), (1, "solar wind"), (None, "wind farm"), (None, "farm wind farm"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {(r["k"], r["term"]): r["count"] for r in resume.term_counts(df, "k", "t", ["the"]).collect()}
    assert got[1, "solar"] == 3 and got[1, "solar panel"] == 2 and got[1, "solar wind"] == 1 and got[None, "farm"] == 3 and got[None, "wind farm"] == 2 and got[2, "wind farm"] == 1 and len(got) == 12
    plan = resume.term_counts(df.filter("k = 2"), "k", "t", [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_few_platforms_are_sent_to_the_searches(spark):
    """No shuffle by the two countries."""
    searches = spark.createDataFrame([(1, "a", "CA", "", "", "legal")], "search_id int, q string, country string, region string, city string, industry string")
    platforms = spark.createDataFrame([("one", "CA", "https://one.example/{q}", 1)], "platform string, country string, template string, pos int")
    plan = links.deep_links(searches, platforms)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_options_of_few_pages_groups_are_not_collected(spark, sf):
    from listloom.plans import catalog

    plan = catalog.QUERIES["d04_options"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "min_by" in plan  # the one is of at most 12


def test_boards_read_listings_once_and_parse_a_place_once(spark, sf):
    """No function over an array is interpreted for each posting, and the listings aren't joined again for each board."""
    import __spark_entry__ as e

    plan = e.queries()["s09_boards"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") == 0 and plan.count("Join ") == 0
    assert plan.count("(?<! ) *+,[ ,]*+") > 0 and all("(?<! ) *+,[ ,]*+" not in line for line in plan.splitlines() if "Filter " in line)


def test_a_posting_is_kept_by_its_region_country_or_distance(spark):
    places = ["Guelph, ON", "Berlin", "Berlin, Germany", "Austin, US", "Canada", "remote", "Remote, Germany", "Paris, Texas", "Texas", "", None]
    rows = spark.createDataFrame([(p, r) for p in places for r in (None, False, True)], "p string, r boolean")
    want = {p: p in ("Guelph, ON", "Austin, US", "Canada", "remote", "Remote, Germany", "Paris, Texas") for p in places}
    for r in rows.select("*", parsers.accepts(F.col("p"), F.col("r")).alias("x")).collect():
        assert bool(r["x"]) == (want[r["p"]] or bool(r["r"])), r


@pytest.mark.parametrize("name", ["g03_allowances", "g04_next_call", "g03_budget_fold"])
def test_times_are_rounded_to_milliseconds(spark, same_rows, tmp_path, name):
    """The last half millisecond of an hour belongs to the next one; before 1970 slots are counted back from zero."""
    import duckdb

    import __spark_entry__ as e

    first = "" if name == "g03_budget_fold" else "UNION ALL SELECT make_timestamp(-h * 3600000000 + d) FROM range(49) h(h), (VALUES (-501), (-500), (-499), (-1), (0), (499), (500)) d(d) UNION ALL SELECT NULL"
    duckdb.sql(f"""COPY (SELECT row_number() OVER () - 20 AS event_id, ts, (row_number() OVER ()) % 40 AS user_id FROM (
      SELECT make_timestamp(1704067200000000 + h * 3600000000 + d) AS ts FROM range(49) h(h), (VALUES (-501), (-500), (-499), (-1), (0), (499), (500)) d(d) {first})) TO '{tmp_path}/events.parquet'""")
    same_rows(e.queries()[name], e.oracle_sql()[name], str(tmp_path))


def test_reports_of_equal_texts_are_made_once(spark, monkeypatch):
    """Pairs whose texts and terms are equal are analysed for one of them; empty texts and null differ."""
    made = []
    keep = resume.stored
    monkeypatch.setattr(resume, "stored", lambda df, label: made.append(keep(df, label)) or made[-1])
    terms = "array<struct<term:string,jd_count:int,in_resume:boolean>>"
    texts = [("Cloud Engineer", "5 years of experience with Docker and Azure", "Experience\n2015 - 2019\nDocker"), ("Cloud Engineer", "", "Docker"), ("Cloud Engineer", None, "Docker"), ("Cloud Engineer", "Docker", None)]
    df = spark.createDataFrame([(i, *texts[i % 4]) for i in range(400)], "pair_id long, title string, posting string, resume string").withColumn("terms", F.array().cast(terms))
    got = [(r["pair_id"] % 4, r["score"], r["required"], r["have"], str(r["hard"]), str(r["tips"])) for r in resume.analyze(df, 2020).collect()]
    assert len(got) == 400 and len(set(got)) == 4 and sum(t.count() for t in made) == 4
    assert [x[2:4] for x in set(got) if x[0] == 0] == [(5, 4)]
