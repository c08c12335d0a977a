"""Queries of saved searches, request parameters, call logs, budgets, descriptions, files and configuration, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import calls, params, saved, tracker
from ..sources import files
from ..storage import shared_dir
from . import views as v
from .catalog import _with, register
from .views import listings, tables

# ------------------------------------------------------------------ saved searches

_WORDS = ["analyst", "nurse", "cook", "developer", "eng", "tea", "it", "sales"]
_PHRASES = ["soc analyst", "registered nurse", "line cook", "help desk", "software developer", "truck driver", "az", "data"]


def _sets(pick, string: str) -> str:
    """A set of each customer: two clauses of a word and a company's number or a phrase, and an exclusion; some only exclude."""
    k = "c_custkey"
    return f"""SELECT {k} AS "set", {pick(_WORDS, f"{k} % 8")} AS a, 'acme ' || CAST({k} % 90 AS {string}) AS b, {pick(_PHRASES, f"({k} * 3) % 8")} AS c,
 CASE {k} % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'inc' ELSE '' END AS e, CAST('1998-01-01' AS TIMESTAMP) + make_interval_days({k} % 1200) AS since, {k} % 17 = 3 AS broad FROM customer"""


_SETS_DUCK = _sets(v._pick, "VARCHAR").replace("make_interval_days", "to_days").replace("AS INT)", "AS INTEGER)")
_SETS_SPARK = _sets(v._pick, "STRING").replace("AS TIMESTAMP", "AS TIMESTAMP_NTZ").replace("make_interval_days(c_custkey % 1200)", "make_dt_interval(CAST(c_custkey % 1200 AS INT), 0, 0, 0)").replace('"set"', "`set`").replace("FROM customer", "FROM {customer}")


@register("j12_saved_searches", _with(f""", s AS ({_SETS_DUCK}), h AS (SELECT id, posted_at, {v.norm_sql("title || ' ' || company || ' ' || body")} AS h FROM L),
d AS (SELECT DISTINCT a, b, c, e, broad FROM s), m AS (SELECT d.*, h.posted_at FROM d, h WHERE (broad OR (contains(h, a) AND contains(' ' || h || ' ', ' ' || b || ' ')) OR (NOT broad AND contains(' ' || h || ' ', ' ' || c || ' ') AND contains(h, 'a' || a[2:])))
 AND NOT (e <> '' AND contains(' ' || h || ' ', ' ' || e || ' '))) SELECT "set", count(m.posted_at) AS "new" FROM s LEFT JOIN m ON s.a = m.a AND s.b = m.b AND s.c = m.c AND s.e = m.e AND s.broad = m.broad AND m.posted_at > s.since GROUP BY "set\""""))
def j12(spark, sf):
    (customer,) = tables(spark, sf, "customer")
    sets = spark.sql(_SETS_SPARK, customer=customer)
    left_out = F.when(F.col("e") != "", F.concat(F.lit(" -"), F.col("e"))).otherwise("")
    clauses = F.concat(F.col("a"), F.lit(' "'), F.col("b"), F.lit('" OR "'), F.col("c"), F.lit('" a'), F.expr("substr(a, 2)"))
    query = F.concat(F.when(F.col("broad"), "").otherwise(clauses), left_out)
    rows = listings(spark, sf).select("id", "posted_at", normalize(F.concat_ws(" ", "title", "company", "body")).alias("hay"), F.array().cast("array<string>").alias("tags"))
    return saved.new_counts(rows, sets.select("set", query.alias("query"), "since"))


# ------------------------------------------------------------------ request parameters

_SAID = {
    "q": ["soc+analyst", "%22help%20desk%22", "", "a%26b%3Dc", "%zz+x", "nurse++"], "country": ["CA", "XX", "", "US", "ALL"], "region": ["on", "QC1", "b.c.", ""], "industry": ["technology", "drop+table", "legal", "all"],
    "minSalary": ["50000", "-3", "1e5", "abc", "", "0x10", "+60000+"], "skills": ["Python%2C+SQL,,", "", ",", "a,b,c,d,e,f,g,h,i,j,k,l"], "level": ["senior", "boss", "all"], "sort": ["newest", "relevance", "x"], "boost": ["lead,x,entry", ""],
    "hide": ["clearance,none", ""], "sponsor": ["1", "0", "yes"], "pageSize": ["25", "9999", "2", "50.9", "no"], "from": ["2024-01-05", "5.1.2024", ""], "city": ["S%C3%A3o+Paulo", "", "+Toronto+"],
}
_ALWAYS = "&days=7&days=14&set=mine&unknown=1&inf=1#part?q=no"


def _url(string: str) -> str:
    parts = [f"'{'?' if not i else '&'}{n}=' || {v._pick(x, f'(page_id + {i}) % {len(x)}')}" for i, (n, x) in enumerate(_SAID.items())]
    return f"page_id, regexp_replace(CAST(url AS {string}), '[?#].*$', '') || {' || '.join(parts)} || {v.quoted(_ALWAYS)} AS u"


def _params_sql() -> str:
    value = lambda n: f"CASE WHEN contains(s, '&{n}=') THEN url_decode(replace(regexp_extract(s, '^.*&{n}=([^&]*)', 1), '+', ' ')) ELSE {v.quoted(params.DEFAULTS[n])} END"
    listed = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: substr(trim(x), 1, 40)), lambda x: x <> '')[1:10]"
    among = lambda c, ok: f"list_filter({listed(c)}, lambda x: x IN ({', '.join(map(v.quoted, ok))}))"
    allowed = lambda c, ok, d: f"CASE WHEN {c} IN ({', '.join(map(v.quoted, ok))}) THEN {c} ELSE {v.quoted(d)} END"
    number = lambda c: f"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    positive = lambda c: f"CASE WHEN {number(c)} > 0 THEN {number(c)} END"
    name = lambda n: f'p_{n}'
    active = " + ".join(f"CASE WHEN {name(n)} NOT IN ('', 'all'{', ' + v.quoted('ALL') if n == 'country' else ''}) THEN 1 ELSE 0 END" for n in params.DEFAULTS if n not in params.SHOWN)
    written = ", ".join(f"CASE WHEN {name(n)} NOT IN ('', {v.quoted(d)}) THEN '{n}=' || replace(url_encode({name(n)}), '%20', '+') END" for n, d in params.DEFAULTS.items())
    size = f"CAST(least(100, greatest(5, floor(CASE WHEN coalesce({number('p_pageSize')}, 0) = 0 THEN 25 ELSE {number('p_pageSize')} END))) AS INTEGER)"
    return f"""
WITH u AS (SELECT {_url('VARCHAR')} FROM pages), s AS (SELECT page_id, '&' || regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS s FROM u),
p AS (SELECT page_id, {', '.join(f'{value(n)} AS {name(n)}' for n in params.DEFAULTS)} FROM s), w AS (SELECT *, array_to_string(list_filter([{written}], lambda x: x IS NOT NULL), '&') AS w FROM p)
SELECT page_id, CASE WHEN w <> '' THEN '?' || w ELSE '' END AS shortest, CAST({active} AS INTEGER) AS active, trim(substr(p_q, 1, 120)) AS q, {allowed('p_country', ['CA', 'US'], 'ALL')} AS country, substr(regexp_replace(upper(p_region), '[^A-Z]', '', 'g'), 1, 2) AS region,
 trim(substr(p_city, 1, 80)) AS city, {allowed('p_industry', params.INDUSTRIES, 'all')} AS industry, {positive('p_minSalary')} AS min_salary, array_to_string({listed('p_skills')}, '|') AS skills, {allowed('p_level', params.LEVELS, 'all')} AS level,
 {allowed('p_sort', params.SORTS, 'relevance')} AS sort, array_to_string({among('p_boost', params.LEVELS)}, '|') AS boost, array_to_string({among('p_hide', params.AUTH)}, '|') AS hide_auth, p_sponsor = '1' AS sponsorship, {size} AS page_size,
 CASE WHEN regexp_full_match(p_from, '[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]') THEN p_from END AS date_from, {positive('p_days')} AS days FROM w"""


@register("t21_parameters", _params_sql())
def t21(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    rows = pages.selectExpr("page_id", _url("STRING").removeprefix("page_id, ")).withColumn("p", params.raw(F.col("u")))
    rows = rows.select("page_id", params.shortest(F.col("p")).alias("shortest"), params.active_filters(F.col("p")).alias("active"), params.parsed(F.col("p")).alias("x"))
    lists = [F.array_join(F.col("x")[c], "|").alias(c) for c in ("skills", "boost", "hide_auth")]
    return rows.select("page_id", "shortest", "active", *[f"x.{c}" for c in ("q", "country", "region", "city", "industry", "min_salary", "level", "sort", "sponsorship", "page_size", "date_from", "days")], *lists)


# ------------------------------------------------------------------ calls and budgets

_CALLS = "SELECT 'S' || CAST(user_id % 40 AS {string}) AS source, ts AS at, event_id AS nth, CASE WHEN event_id % 97 = 0 THEN 'HTTP 429: slow down' WHEN event_id % 13 = 0 THEN 'timed out after 4290 ms' END AS error, event_id % 7 AS jobs FROM {events}"
_CALLS_DUCK = _CALLS.format(string="VARCHAR", events="events").replace(" AS at,", " AS t_at,")


@register("g09_call_outcomes", f"""WITH c AS ({_CALLS_DUCK}), s AS (SELECT source, min((t_at, nth)) FILTER (error LIKE 'HTTP%') AS stop, count(*) AS planned FROM c GROUP BY source),
m AS (SELECT c.*, planned FROM c JOIN s USING (source) WHERE stop IS NULL OR (t_at, nth) <= stop),
o AS (SELECT source, any_value(planned) AS planned, count(*) AS calls, count(error) AS failed, coalesce(sum(jobs) FILTER (error IS NULL), 0)::BIGINT AS jobs, arg_max(error, (t_at, nth)) FILTER (error IS NOT NULL) AS last, max(t_at) FILTER (error IS NULL) AS good FROM m GROUP BY source)
SELECT source, planned, calls, failed, jobs, jobs > 0 OR failed < planned AS ok, CASE WHEN failed > 0 THEN failed || '/' || calls || ' calls failed: ' || last END AS error, strftime(good, '%Y-%m-%d %H:%M:%S') AS last_success FROM o""")
def g09(spark, sf):
    (events,) = tables(spark, sf, "events")
    rows = spark.sql(_CALLS.replace("{string}", "STRING"), events=events)
    return calls.outcomes(rows).withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss"))


_BUDGETS = [(f"S{k}", 12 + 7 * (k % 9), (24, 6, 1, 48)[k % 4], (0, 90, 3600, 20000)[k % 4]) for k in range(40)]


@register("g03_budget_fold", f"""WITH RECURSIVE b(source, daily, runs, gap) AS (VALUES {", ".join(map(str, _BUDGETS))}),
r AS (SELECT c.source, c.nth, epoch_ms(t_at) AS ms, epoch_ms(t_at) // 86400000 AS day, daily, runs, gap, row_number() OVER (PARTITION BY c.source ORDER BY t_at, c.nth) AS k FROM ({_CALLS_DUCK}) c JOIN b USING (source)),
f AS (SELECT source, 0::BIGINT AS k, -1::BIGINT AS nth, false AS made, 0::BIGINT AS used, NULL::BIGINT AS last, NULL::BIGINT AS day FROM b
 UNION ALL SELECT source, k, nth, ok AS made, u + ok::INT AS used, CASE WHEN ok THEN ms ELSE last END AS last, day FROM (
  SELECT r.*, f.last, u, u < least(r.daily, ((r.ms % 86400000) * r.runs // 86400000 + 1) * r.daily // r.runs) AND (f.last IS NULL OR r.ms - f.last >= r.gap * 1000) AS ok
  FROM (SELECT f0.*, CASE WHEN f0.day IS NOT DISTINCT FROM r0.day THEN f0.used ELSE 0 END AS u FROM f f0 JOIN r r0 ON r0.source = f0.source AND r0.k = f0.k + 1) f JOIN r ON r.source = f.source AND r.k = f.k + 1))
SELECT source, nth, made FROM f WHERE k > 0""")
def g03_fold(spark, sf):
    (events,) = tables(spark, sf, "events")
    rows = spark.sql(_CALLS.replace("{string}", "STRING"), events=events)
    budgets = spark.createDataFrame(_BUDGETS, "source string, daily long, runs long, gap long")
    return calls.let_through(rows, budgets).select("source", "nth", "made")


@register("v07_hits", """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS q FROM events WHERE event_id % 2 = 0), r AS (SELECT * FROM events WHERE event_id % 2 = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(q) ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1)
SELECT l.user_id, l.q, nth, arg_max(r.event_id % 100, (r.ts, r.event_id)) AS hits FROM l LEFT JOIN r ON l.user_id = r.user_id AND lower(l.q) = r.event_type AND (r.ts, r.event_id) >= (l.ts, l.event_id) WHERE nth <= 6 GROUP BY ALL""")
def v07_hits(spark, sf):
    (events,) = tables(spark, sf, "events")
    rows = events.select(F.col("user_id").alias("user"), "event_type", F.lit("").alias("city"), F.col("ts").alias("at"), F.col("event_id").alias("pos"))
    entries = rows.filter("pos % 2 = 0").withColumn("q", F.when(F.col("pos") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    answers = rows.filter("pos % 2 = 1").select("user", F.col("event_type").alias("q"), "city", "at", "pos", (F.col("pos") % 100).alias("hits"))
    return tracker.recent_with_hits(entries, answers).select(F.col("user").alias("user_id"), "q", "nth", "hits")


# ------------------------------------------------------------------ files of a run


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


_KEYS = "substr(md5(CAST(id AS {0})), 1, 12)"


@register("j05_descriptions", _with(f"SELECT {_KEYS.format('VARCHAR')} AS id, body AS description FROM L WHERE body <> '' AND substr(md5(CAST(id AS VARCHAR)), 1, 1) = 'a'"))
def j05(spark, sf):
    folder = _folder(spark)
    rows = listings(spark, sf).withColumn("key", F.expr(_KEYS.format("STRING")))
    files.write_snapshot(rows.select(F.col("key").alias("id"), "title", F.nullif(F.col("body"), F.lit("")).alias("description")), folder)
    return files.descriptions(spark, folder, rows.filter("startswith(key, 'a')").select(F.col("key").alias("id")))


@register("k01_files_of_a_run", _with(f"SELECT {_KEYS.format('VARCHAR')} AS id, title, company, strftime(posted_at, '%Y-%m-%d') AS posted, salary_max, array_to_string(tags, '|') AS tags, nullif(body, '') AS description FROM L"))
def k01(spark, sf):
    folder = _folder(spark)
    rows = listings(spark, sf).select(F.expr(_KEYS.format("STRING")).alias("id"), "title", "company", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "salary_max", "tags", F.nullif(F.col("body"), F.lit("")).alias("description"))
    files.write_run(folder, {"jobs": rows, "state": rows.select("id", F.lit("2001-08-02").alias("seen_at"))})
    jobs = files.read_run(spark, folder, "jobs", "id string, title string, company string, posted string, salary_max double, tags array<string>")
    said = files.read_run(spark, folder, "jobs-descriptions", "id string, description string, shard string").select(F.col("id").alias("_id"), "description")
    state = files.read_run(spark, folder, "state", "id string, seen_at string").filter("seen_at = '2001-08-02'").select(F.col("id").alias("_s"))
    out = jobs.join(state, F.col("id") == F.col("_s")).join(said, F.col("id") == F.col("_id"), "left")
    return out.select("id", "title", "company", "posted", "salary_max", F.array_join("tags", "|").alias("tags"), "description")
