import random
import re

from pyspark.sql import functions as F

from listloom.functions import classify, parse, text
from listloom.functions import lexicons as lx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_titles_meet(spark):
    a = one(spark, text.normalize_title(F.col("t")), t="Sr. Cloud Eng II (Remote)")
    assert a == one(spark, text.normalize_title(F.col("t")), t="Senior Cloud Engineer 2") == "senior cloud engineer 2"


def test_plain_and_column_forms_agree(spark):
    for s in ("Café & Bar (x) Ünï", "A/B  c\n(d)", "", "R&D"):
        assert one(spark, text.normalize(F.col("t")), t=s) == text.plain(s)


def test_every_character_is_decomposed(spark):
    """All of Unicode, against its own decomposition."""
    texts = [f"a{chr(k)}b" for k in range(0x20, 0x2FA20) if not 0xD800 <= k <= 0xDFFF]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r["i"]: r["n"] for r in rows.select("i", text.normalize(F.col("t")).alias("n")).collect()}
    wrong = [(texts[i], n, text.plain(texts[i])) for i, n in got.items() if n != text.plain(texts[i])]
    assert not wrong, wrong[:20]
    assert one(spark, text.normalize(F.col("t")), t="Ａ Škoda") == "a skoda"
    assert one(spark, text.normalize(F.col("t")), t="ﬁnance ½ Škoda Ⅳ ﬃ") == "finance 1 2 skoda iv ffi"
    assert one(spark, text.normalize(F.col("t")), t="⑴x (y ﬁ) ㎏ﬀ") == text.plain("⑴x (y ﬁ) ㎏ﬀ") == "x kgff"


def test_titles_with_words_side_by_side(spark):
    for said, want in (("Sr Sr dev DEV remote hybrid", "senior senior developer developer"), ("ii", "2"), ("Remote", ""), ("the new job", ""), ("Deveng ii/iii l1", "deveng 2 3 1"), (None, "")):
        assert one(spark, text.normalize_title(F.col("t")), t=said) == want


def test_company_is_a_beginning_at_a_word(spark):
    from listloom.operators import query

    names = ["Acme Labs Inc.", "acme", "Acme Labs North", "Acmelabs", "ACME L", "", "Inc", "Škoda & Co"]
    asked = [*names, "acme labs north east"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").select("t", *[query.company_matches(F.col("t"), w).alias(f"w{k}") for k, w in enumerate(asked)]).collect()
    for k, wanted in enumerate(asked):
        for r in rows:
            a, b = text.plain_company(r["t"]), text.plain_company(wanted)
            assert r[f"w{k}"] == (a == b or a.startswith(b + " ") or b.startswith(a + " ")), (r["t"], wanted)


def test_phrase(spark):
    assert not one(spark, text.has_phrase(F.col("t"), "art"), t="smart work")
    assert one(spark, text.has_phrase(F.col("t"), "smart work"), t="very smart work")
    assert not one(spark, text.has_phrase(F.col("t"), ""), t="x")


def test_small_texts(spark):
    assert one(spark, text.pretty(F.col("t")), t="acme-corp_labs") == "Acme Corp Labs"
    assert one(spark, text.url_component(F.col("t")), t="a b+c") == "a%20b%2Bc"
    assert one(spark, text.xml_escape(F.col("t")), t='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, F.array_join(text.ngrams(F.col("t"), 2), "|"), t="a b c") == "a|a b|b|b c|c"
    assert one(spark, text.format_salary(F.lit(65000.0), F.lit(80000.0), F.lit("CAD"), F.lit("yearly")), t="") == "$65k–$80k CAD/yr"
    assert one(spark, text.format_salary(F.lit(28.5), F.lit(None).cast("double"), F.lit("USD"), F.lit("hourly")), t="") == "$28.50 USD/hr"


def test_ages(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, text.freshness(at("2024-01-01 00:00:00"), at("2024-01-01 05:00:00")), t="") == "5 h ago"
    assert one(spark, text.time_ago(at("2024-01-01 00:00:00"), at("2024-01-02 05:00:00")), t="") == "Yesterday"


def test_salary_and_place(spark):
    s = one(spark, parse.salary_of(F.col("t"), F.lit("CA")), t="$65,000 - $80k a year")
    assert (s["min"], s["max"], s["currency"], s["period"]) == (65000, 80000, "CAD", "yearly")
    assert one(spark, parse.salary_of(F.col("t"), F.lit("US")), t="no pay") is None
    assert one(spark, parse.salary_of(F.col("t"), F.lit("US")), t="28/hr")["period"] == "hourly"
    place = one(spark, parse.location_of(F.col("t")), t="San Jose, CA")
    assert (place["city"], place["region"], place["country"]) == ("San Jose", "CA", "US")
    assert one(spark, parse.remote_country(F.col("t")), t="Worldwide") == "CA" and one(spark, parse.remote_country(F.col("t")), t="Japan") is None


def test_stems_do_not_match_inflections(spark):
    assert one(spark, classify.industry(F.col("t")), t="Pharmacist") == "other"
    assert one(spark, classify.industry(F.col("t")), t="SOC Analyst") == "finance_accounting"


def test_lexicons(spark):
    found = one(spark, F.array_join(classify.extract(lx.SKILLS, F.col("t")), "|"), t="C++, C# and .NET; Go is not Golang's Node")
    assert found == "C#|C++|Go|Node.js|.NET"
    assert one(spark, F.array_join(classify.extract(lx.SKILLS, F.col("t")), "|"), t="Going javascripting") == ""
    auth = one(spark, F.array_join(classify.work_auth(F.col("t")), "|"), t="We will sponsor, but visa sponsorship is not available")
    assert auth == "no-sponsorship"


def test_years(spark):
    assert one(spark, parse.required_years(F.col("t")), t="5+ years of experience; 3 years working with SQL") == 3
    years = one(spark, parse.resume_years(F.col("t"), F.lit(2020)), t="Acme 2010 - 2014\nBeta 2013 – 2016\nCollege 2000-2005\nGamma 2018 to present")
    assert years == 8
    assert one(spark, parse.resume_years(F.col("t"), F.lit(2020)), t="2 years of experience, 2000-2019") == 2


def test_portals(spark):
    p = one(spark, classify.portal(F.col("t")), t="https://boards.greenhouse.io/acme/jobs/1")
    assert p["portal"] == "Company site (Greenhouse)" and p["direct"]
    assert one(spark, classify.portal(F.col("t")), t="not a url")["portal"] == "Original posting"
    assert one(spark, classify.portal(F.col("t")), t="https://www.acme.com/x")["portal"] == "Company site (acme.com)"


def test_feed_text(spark):
    block = "<item><title><![CDATA[Cook - Acme (ON)]]></title></item>"
    assert one(spark, parse.xml_tag(F.col("t"), "title"), t=block) == "Cook - Acme (ON)"
    assert one(spark, parse.labelled(F.col("t"), "Employer"), t="x\nEmployer: Acme | y") == "Acme"


def test_publishers(spark):
    say = lambda name, url, direct: one(spark, classify.publisher(F.col("n"), F.col("u"), F.lit(direct)), n=name, u=url)
    assert say("Board X", "https://www.indeed.com/1", True) == "Company site (Board X)"
    assert say("Board X", "https://www.indeed.com/1", False) == "Indeed"
    assert say("", "https://jobs.lever.co/a", True) == "Company site (Lever)"


def test_tags_by_join(spark):
    keywords = ["soc analyst", "help desk", "registered nurse"] + [f"trade {i}" for i in range(200)]
    aliases = {"registered nurse": ["rn", "nurse"], "help desk": ["service desk"]}
    rows = spark.createDataFrame([(1, "SOC Analyst", "at the service desk; trade 7"), (2, "Nurse (RN)", None), (3, "Cook", "nothing")], "id int, title string, body string")
    got = {r["id"]: r["tags"] for r in classify.tags_by_join(rows, "id", F.col("title"), F.col("body"), keywords, aliases).collect()}
    want = {r["id"]: r["t"] for r in rows.select("id", classify.tags(F.col("title"), F.col("body"), keywords[:12], aliases).alias("t")).collect()}
    assert got == {k: t for k, t in want.items() if t} and got[1] == ["soc analyst", "help desk", "trade 7"]


def test_stems_are_in_every_match():
    from listloom.functions import lexicons as lx

    assert text.stems(r"penetration test\w*|pentest\w*") == ["penetration test", "pentest"] and text.stems(r"\.NET") is None and text.stems("Power ?BI") == ["power"]
    assert text.stems("Epic (EMR|EHR|systems)?") == ["epic "] and text.stems(r"Node(\.js)?") == ["node"] and text.stems("Class [1-5] (licen[cs]e)?") == ["class "]
    texts = ["penetration tester", "PENTESTS", "Power BI powerbi", "Epic EMR", "Epic", "Class 5 licence", "AZ-104, SC-200", "Security+", "c++ C# .net node.js", "ISO 27001 SOC2 PCI", "first aid CPR", "budgeting forecasts", "Red Seal"]
    for x in [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]:
        label, p = text.entry(x)
        own = x[1] if isinstance(x, tuple) else text.entry(x)[1].split(")(", 1)[1].rsplit(")(?!", 1)[0]
        begun = text.stems(own)
        for t in [*texts, label, f"a {label}, b"]:
            if begun and re.search(p, t, re.IGNORECASE):
                assert any(s in t.lower() for s in begun), (label, t)


def test_patterns_are_tried_where_they_may_begin(spark):
    """The edged text never hides a match: rules and entries give what matching each pattern gives, on odd texts too."""
    assert text.starts(r"\b(ph\.?\s?d|doctorate)\b") == [" ph", " doctorate"] and text.starts(text.entry((".NET", r"\.NET"))[1]) == [" net"]
    assert text.starts(r"\b(legally )?(eligible|entitled)\b") == [" legally ", " eligible", " entitled"] and text.starts(r"(\d{1,2})\+? years") is None
    odd = ["C++/C#,.NET;Node.js", "x_RN rn_x «RN»", "KRN İRN", "éRN RNé", "Security+ AZ-500 AZ-1", "RN+ RN++ RN#", "ph.d Ph D b.sc b a", "U.S. citizens only", "won't sponsor; no LMIA", "", "co-op full-stack part  time", "SOC 2\nISO27001\tK8S", "full stack sre"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    t = F.col("t")
    lexicon = [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]
    plain = F.filter(F.array(*[F.when(text.has(t, p), k) for k, p in map(text.entry, lexicon)]), lambda x: x.isNotNull())
    first = F.coalesce(*[F.when(text.has(t, p), k) for k, p in lx.INDUSTRY])
    level = F.coalesce(*[F.when(text.has(t, p), k) for _, p, k in lx.EDUCATION])
    rows = df.select(plain.alias("a"), classify.extract(lexicon, t, 200).alias("b"), first.alias("c"), classify._first(t, lx.INDUSTRY).alias("d"), level.alias("e"), classify.education(t)["level"].alias("f")).collect()
    assert [(r["a"], r["c"], r["e"]) for r in rows] == [(r["b"], r["d"], r["f"]) for r in rows]


def test_entries_are_looked_for_before_their_edges(spark):
    """As many matches as with the edge first; one pass finds what patterns begin with."""
    import re

    random.seed(20)
    named = [p for _, p in map(text.entry, [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS])]
    words = [w for p in named for w in re.findall(r"[A-Za-z0-9]+", p)] + ["C#", "C++", ".NET", "Security+", "az-500", "K", "\u0130", "RN", "_", "+", "#", "++", ".", "x"]
    texts = ["".join(w + random.choice(["", " ", " ", ".", "_", "-", "\n"]) for w in random.choices(words, k=12)) for _ in range(3000)]
    for p in named:
        old, new = re.compile(p, re.I | re.A), re.compile(text.pattern(p), re.A)
        assert [len(list(old.finditer(t))) for t in texts] == [len(list(new.finditer(t))) for t in texts], p
    every = [*named, *[p for _, p, _ in lx.EDUCATION]]
    df = spark.createDataFrame([(t,) for t in texts[:300]], "t string").withColumn("e", text.edged(F.col("t"))).withColumn("b", text.beginnings(F.col("e"), every))
    # the short text may say more, as patterns are matched afterwards, but never less
    assert df.filter(F.array_contains(F.array(*[text.begun(F.col("e"), p) & ~text.begun(F.col("b"), p) for p in every]), True)).count() == 0
    assert df.filter(F.length("b") < F.length("e")).count() > 200


def test_listings_are_dealt_over_the_cores(spark, sf):
    """One row group is one task of a scan; the work on its rows isn't."""
    from listloom.plans import views

    assert views.listings(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_ngrams_are_made_once_for_each_text(spark, sf):
    """They were made anew for the filter and for each column."""
    from listloom.plans import catalog

    plan = catalog.QUERIES["t09_ngrams"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1


def test_ngrams_of_whole_texts(spark, same_rows, tmp_path):
    """Words after the 1,200th count too; repeats, beginnings of other words, texts without words."""
    import duckdb

    import __spark_entry__ as e

    texts = [" ".join(f"w{i}" for i in range(3000)), "a ab a abc a ab a", "a a a a a a a a", "b", "x1 x x1 x x10", " ()-- ", "", None, "Été (no) & ÉTÉ\tété\nx\u0085y\u00a0z", " ".join(random.choices(["a", "a1", "ab", "b"], k=2500))]
    docs = [(i, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = {r["doc_id"]: r["n"] for r in e.queries()["t09_ngrams"](spark, str(tmp_path)).collect()}
    assert got[0] == 6 * 3000 - 15 and got[2] == 6 and not got.keys() & {5, 6, 7}
    same_rows(e.queries()["t09_ngrams"], e.oracle_sql()["t09_ngrams"], str(tmp_path))


def test_normalize_takes_one_class_for_all_that_is_no_word(spark):
    """A class within a class is matched seven times as slowly."""
    df = spark.range(1).select(text.normalize(F.lit("a").cast("string")).alias("x"))
    assert one(spark, text.normalize(F.col("t")), t="\x0bA\u0085\u2028b\x1c \t-c!?\n") == "a b c"
    assert r"[^a-z0-9\s]" not in df._jdf.queryExecution().analyzed().toString()


def test_places_are_a_plain_loop(spark):
    random.seed(13)
    names = {c: {k.lower(): code for code, name in table.items() for k in (name, code)} for c, table in (("CA", lx.PROVINCES), ("US", lx.STATES))}
    assert not names["CA"].keys() & names["US"].keys()
    countries = dict.fromkeys(("united states", "united states of america", "usa", "us", "u.s."), "US") | {"canada": "CA"}

    def place(t, hint):
        parts = [p for p in (x.strip(" ") for x in (t or "").split(",")) if p]
        n = len(parts)
        said = [countries.get(p.lower()) or ("CA" if p.lower() == "ca" and i == n - 1 and n >= 3 else None) for i, p in enumerate(parts)]
        said = [c for c in said if c]
        guess = [c for p in parts[1:] for c in ("CA", "US") if p.lower() in names[c]]
        country = said[-1] if said else guess[0] if guess else hint or "US"
        codes = [names["CA" if country == "CA" else "US"].get(p.lower()) for p in parts[1:] if not (said and n >= 3 and p == parts[-1])]
        return (parts[0] if parts else "", next((c for c in codes if c), ""), country)

    known = ["Toronto", "Berlin", "St. John's", "", " ", "\t", "a\nb", "Ontario", "on", "ON", "Quebec", "Texas", "tx", "ca", "CA", "Canada", "US", "u.s.", "USA", "United States", "us of a", "Newfoundland and Labrador"]
    texts = [None, "", ",", "Toronto, Canada, ON", "Toronto, on, Canada, ON", "Reno,CA,Canada,CA", "  a   ,, b ,"] + [random.choice([",", ", ", " , "]).join(random.choices(known, k=random.randrange(6))) for _ in range(3000)]
    rows = spark.createDataFrame([(t, random.choice([None, "CA", "US", "FR"])) for t in texts], "t string, h string")
    for r in rows.select("*", parse.location_of(F.col("t"), F.col("h")).alias("x"), parse.location_of(F.col("t")).alias("y")).collect():
        assert tuple(r["x"]) == place(r["t"], r["h"]) and tuple(r["y"]) == place(r["t"], None), r
