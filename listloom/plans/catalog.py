"""All queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..functions import lexicons as lx
from ..operators import identity, query, resume, schedule, stats, tracker
from ..operators import links as link_ops
from ..operators import search as search_ops
from ..sources import files
from ..storage import spread
from ..streaming import state
from . import views as v
from .views import DUCK, NOW, listings, now, tables

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(sql: str) -> str:
    return f"WITH L AS ({DUCK})\n{sql}"


T_NOW = f"TIMESTAMP '{NOW}'"
FIRST_LINE = "split_part(coalesce(text, ''), chr(10), 1)"
PARAMS = query.SearchParams(country="US", min_salary=40_000, max_salary=150_000, within_days=1500, sort="salary", page=2, page_size=25)


# ------------------------------------------------------------------ scalar functions


@register("t01_normalize", f"SELECT doc_id, {v.norm_sql('text')} AS norm, {v.company_sql('text')} AS company FROM documents")
def t01(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    return docs.select("doc_id", text.normalize(F.col("text")).alias("norm"), text.normalize_company(F.col("text")).alias("company"))


@register("t03_titles", _with(f"SELECT id, {v.title_sql('title')} AS title_key, {v.company_sql('company')} AS company_key, coalesce(nullif(replace({v.company_sql('company')}, ' ', '-'), ''), 'company') AS slug FROM L"))
def t03(spark, sf):
    return listings(spark, sf).select("id", text.normalize_title(F.col("title")).alias("title_key"), text.normalize_company(F.col("company")).alias("company_key"), text.slugify(F.col("company")).alias("slug"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<style.*?</style>|<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s ]+', ' ', 'g'))"
_DEC = "replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&nbsp;', ' '), '&#39;', ''''), '&apos;', ''''), '&quot;', '\"')"


@register("p01_strip_html", f"SELECT page_id, {_STRIP.format(_DEC)} AS plain, CASE WHEN length({_STRIP.format(_DEC)}) > 260 THEN rtrim(substr({_STRIP.format(_DEC)}, 1, 259)) || '…' ELSE {_STRIP.format(_DEC)} END AS snippet FROM pages")
def p01(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    return pages.select("page_id", parse.strip_html(F.col("html")).alias("plain"), text.snippet(F.col("html")).alias("snippet"))


_H = f"regexp_replace(regexp_replace({_DEC}, '(?is)<style.*?</style>|<script.*?</script>', '', 'g'), '(?i)<li[^>]*>', chr(10) || '• ', 'g')"
_H = f"regexp_replace(regexp_replace(regexp_replace({_H}, '(?i)</(p|div|h[1-6]|ul|ol|tr)>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g')"
_H = f"regexp_replace(regexp_replace(regexp_replace({_H}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@register("p02_html_to_text", f"SELECT page_id, {_H} AS body FROM pages")
def p02(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    return pages.select("page_id", parse.html_to_text(F.col("html")).alias("body"))


_NUMS = r"list_transform(regexp_extract_all(replace(body, ',', ''), '(?i)(\d+(?:\.\d+)?k?)', 1), lambda s: CAST(regexp_replace(s, '(?i)k$', '') AS DOUBLE) * CASE WHEN lower(s) LIKE '%k' THEN 1000 ELSE 1 END)"


@register("p03_salary_text", _with(f"""SELECT id, n[1] AS low, coalesce(n[2], n[1]) AS high, CASE WHEN n[1] IS NOT NULL THEN CASE WHEN country = 'CA' THEN 'CAD' ELSE 'USD' END END AS cur,
  CASE WHEN n[1] IS NOT NULL THEN CASE WHEN regexp_matches(body, 'hour|hr|/h\\b', 'i') OR list_max(n) < 500 THEN 'hourly' ELSE 'yearly' END END AS per FROM (SELECT *, {_NUMS} AS n FROM L)"""))
def p03(spark, sf):
    s = F.col("s")
    out = listings(spark, sf).select("id", parse.salary_of(F.col("body"), F.col("country")).alias("s"))
    return out.select("id", s["min"].alias("low"), s["max"].alias("high"), s["currency"].alias("cur"), s["period"].alias("per"))


#: Places made of orders: city, region by code or name in some letter case, country in some spelling; the same expression for both.
_CODE = "CASE o_custkey % 5 WHEN 0 THEN 'ON' WHEN 1 THEN 'Quebec' WHEN 2 THEN 'tx' WHEN 3 THEN 'British Columbia' ELSE 'CA' END"
_LAND = "CASE o_orderkey % 6 WHEN 0 THEN ', Canada' WHEN 1 THEN ', USA' WHEN 2 THEN ', CA' ELSE '' END"
_PLACE = f"CASE o_orderkey % 9 WHEN 0 THEN 'Remote' WHEN 1 THEN '' ELSE concat('Town ', o_custkey % 100, ', ', {_CODE}, {_LAND}) END"
_NAMES = lambda t: "CASE lower({0}) " + " ".join(f"WHEN '{c.lower()}' THEN '{c}' WHEN '{n.lower()}' THEN '{c}'" for c, n in t.items()) + " ELSE '' END"


@register("p04_locations", f"""
WITH x AS (SELECT o_orderkey AS id, list_filter(list_transform(string_split({_PLACE}, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM orders),
r AS (SELECT id, p, len(p) AS n, coalesce(p[2], '') AS b, coalesce(p[3], '') AS c FROM x),
g AS (SELECT *, CASE WHEN n = 3 THEN CASE WHEN lower(c) = 'usa' THEN 'US' ELSE 'CA' END END AS said, {_NAMES(lx.PROVINCES).format('b')} AS prov, {_NAMES(lx.STATES).format('b')} AS state FROM r),
k AS (SELECT *, coalesce(said, CASE WHEN prov <> '' AND state = '' THEN 'CA' ELSE 'US' END) AS country FROM g)
SELECT id, coalesce(p[1], '') AS city, CASE WHEN country = 'CA' THEN prov ELSE state END AS region, country FROM k""")
def p04(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), parse.location_of(F.expr(_PLACE)).alias("l")).select("id", "l.city", "l.region", "l.country")


_AUTH = "list_filter(list_value(" + ", ".join(f"CASE WHEN {v.rlike_sql('body', p)} THEN {v.quoted(k)} END" for k, p in lx.WORK_AUTH) + "), lambda x: x IS NOT NULL)"
_SEN = "coalesce(CASE " + " ".join(f"WHEN regexp_matches(lower(title), {v.quoted(p)}) THEN {v.quoted(s)}" for s, p in lx.SENIORITY) + " END, CASE WHEN y <= 1 THEN 'entry' WHEN y <= 4 THEN 'mid' WHEN y <= 8 THEN 'senior' WHEN y > 8 THEN 'lead' END)"


@register("c01_classify", _with(f"""SELECT id, coalesce({v.rules_sql(lx.INDUSTRY, 'title')}, {v.rules_sql(lx.INDUSTRY, "title || ' ' || body")}, 'other') AS kind,
  CASE WHEN {v.rlike_sql('body', lx.HYBRID)} THEN 'hybrid' WHEN is_remote OR {v.rlike_sql('body', lx.REMOTE)} THEN 'remote' ELSE 'onsite' END AS work,
  coalesce({v.rules_sql(lx.EMPLOYMENT, 'title')}, 'full-time') AS employment, {_SEN} AS level,
  array_to_string({v.extract_sql(lx.SKILLS, 'body')}, '|') AS skills, array_to_string({v.extract_sql(lx.TOOLS, 'body')}, '|') AS tools, array_to_string({v.extract_sql(lx.CERTIFICATIONS, 'body')}, '|') AS certs,
  array_to_string(CASE WHEN list_contains(a, 'no-sponsorship') THEN list_filter(a, lambda x: x <> 'sponsorship') ELSE a END, '|') AS auth
  FROM (SELECT *, {_AUTH} AS a, TRY_CAST(nullif(regexp_extract(body, '(?i)' || {v.quoted(lx.YEARS)}, 1), '') AS INT) AS y FROM L)"""))
def c01(spark, sf):
    joined = lambda c: F.array_join(c, "|")
    t, b = F.col("title"), F.col("body")
    return listings(spark, sf).select(
        "id", classify.industry(t, b).alias("kind"), classify.work_type(b, F.col("is_remote")).alias("work"), classify.employment_type(t).alias("employment"), classify.seniority(t, b).alias("level"),
        joined(classify.extract(lx.SKILLS, b)).alias("skills"), joined(classify.extract(lx.TOOLS, b)).alias("tools"), joined(classify.extract(lx.CERTIFICATIONS, b)).alias("certs"), joined(classify.work_auth(b)).alias("auth"),
    )


_TAGS = "array_to_string(list_filter(list_value(" + ", ".join("CASE WHEN " + " OR ".join(v.phrase_sql("h", text.plain(x)) for x in text.variants(k, v.ALIASES)) + f" THEN {v.quoted(k)} END" for k in v.KEYWORDS) + "), lambda x: x IS NOT NULL), '|')"


@register("c07_tags", _with(f"SELECT id, {_TAGS} AS found FROM (SELECT id, {v.norm_sql(chr(116) + 'itle || ' + v.quoted(' ') + ' || body')} AS h FROM L)"))
def c07(spark, sf):
    return listings(spark, sf).select("id", F.array_join(classify.tags(F.col("title"), F.col("body"), v.KEYWORDS, v.ALIASES), "|").alias("found"))


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@register("c08_portals", f"""SELECT page_id, coalesce({"CASE " + " ".join(f"WHEN {v.rlike_sql(_HOST, p)} THEN {v.quoted(n)}" for p, n, _ in lx.PORTALS) + " END"}, 'Company site (' || regexp_replace({_HOST}, '^www\\.', '') || ')') AS portal,
  coalesce({"CASE " + " ".join(f"WHEN {v.rlike_sql(_HOST, p)} THEN {d}" for p, _, d in lx.PORTALS) + " END"}, true) AS direct FROM pages""")
def c08(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    return pages.select("page_id", classify.portal(F.col("url")).alias("p")).select("page_id", "p.portal", "p.direct")


@register("c10_education_years", _with(f"""SELECT id, {v.rules_sql(lx.EDUCATION, 'body')} AS degree, {" + ".join(f"CASE WHEN {v.rlike_sql('body', p)} THEN 1 ELSE 0 END" for p in lx.SOFT_SKILLS.values())} AS soft,
  list_min(list_filter(list_transform(regexp_extract_all(body, {v.quoted("(?i)" + lx.REQUIRED_YEARS)}, 1), lambda s: CAST(s AS INT)), lambda y: y > 0 AND y <= 20)) AS asked FROM L"""))
def c10(spark, sf):
    b = F.col("body")
    return listings(spark, sf).select("id", classify.education(b)["degree"].alias("degree"), F.size(classify.soft_skills(b)).alias("soft"), parse.required_years(b).alias("asked"))


# ------------------------------------------------------------------ identity, merge, state

_OPTIONS = {
    "duck": "list_value(struct_pack(portal := 'Portal ' || (doc_id % 4), url := 'https://p' || (doc_id % 4) || '.example/' || (doc_id % 7) || CASE doc_id % 2 WHEN 0 THEN '?a=1' ELSE '' END, direct := doc_id % 5 = 0), struct_pack(portal := 'Other', url := CASE doc_id % 6 WHEN 0 THEN 'ftp://x' ELSE 'https://o.example/' || doc_id END, direct := false))",
    "spark": "array(named_struct('portal', concat('Portal ', doc_id % 4), 'url', concat('https://p', doc_id % 4, '.example/', doc_id % 7, CASE doc_id % 2 WHEN 0 THEN '?a=1' ELSE '' END), 'direct', doc_id % 5 = 0), named_struct('portal', 'Other', 'url', CASE doc_id % 6 WHEN 0 THEN 'ftp://x' ELSE concat('https://o.example/', doc_id) END, 'direct', false))",
}
_DOCROWS = f"SELECT doc_id, {v.norm_sql(FIRST_LINE)} AS k, doc_id AS ord, doc_id % 14 AS prio, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS salary, text AS body, {_OPTIONS['duck']} AS options FROM documents"


def _doc_rows(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    first = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return docs.select("doc_id", text.normalize(first).alias("k"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 14).alias("prio"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("salary"), F.col("text").alias("body"), F.expr(_OPTIONS["spark"]).alias("options"))


def _merged_options_sql(rows: str, key: str) -> str:
    """Options merged over the rows (key, late, o, nth, option) of a group: one a link, one a portal, direct ones first."""
    return f"""
o1 AS (SELECT {key}, late, o, nth, option, lower(regexp_replace(regexp_replace(option.url, '[?#].*$', ''), '/$', '')) AS link FROM {rows} WHERE regexp_matches(option.url, '^https?://', 'i')),
o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY {key}, link ORDER BY late, o, nth) = 1),
o3 AS (SELECT *, row_number() OVER (PARTITION BY {key}, lower(option.portal) ORDER BY late, o, nth) AS r1, row_number() OVER (PARTITION BY {key}, lower(option.portal) ORDER BY NOT option.direct, late, o, nth) AS r2 FROM o2),
o4 AS (SELECT a.{key}, a.late, a.o, a.nth, b.option FROM o3 a JOIN o3 b ON a.{key} = b.{key} AND lower(a.option.portal) = lower(b.option.portal) AND a.r1 = 1 AND b.r2 = 1),
o5 AS (SELECT {key}, string_agg(option.portal || '=' || option.url, ' ' ORDER BY NOT option.direct, late, o, nth) AS options FROM (SELECT * FROM o4 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY NOT option.direct, late, o, nth) <= 12) GROUP BY {key})"""


def _said():
    return F.array_join(F.transform("options", lambda o: F.concat(o["portal"], F.lit("="), o["url"])), " ")


@register("d01_fingerprints", _with(f"SELECT id, substr(sha256({v.title_sql('title')} || '|' || {v.company_sql('company')} || '|' || {v.norm_sql('city')} || '|' || {v.norm_sql('region')}), 1, 20) AS key FROM L"))
def d01(spark, sf):
    return listings(spark, sf).select("id", identity.fingerprint(F.col("title"), F.col("company"), F.col("city"), F.col("region")).alias("key"))


@register("d03_yearly_cad", _with("SELECT id, yearly_cad FROM L"))
def d03(spark, sf):
    return listings(spark, sf).select("id", "yearly_cad")


@register("d05_dedupe", f"""WITH r AS ({_DOCROWS}),
b AS (SELECT *, coalesce(prio > max(prio) OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS br FROM r),
w AS (SELECT k, max(ord) FILTER (br) AS best, max(ord) FILTER (br AND salary IS NOT NULL) AS sb, min(ord) FILTER (salary IS NOT NULL) AS sa, min(ord) AS first_seen, count(*) AS copies FROM b GROUP BY k),
x AS (SELECT k, ord, body, row_number() OVER (PARTITION BY k ORDER BY length(coalesce(body, '')) DESC, br DESC, CASE WHEN br THEN -ord ELSE ord END) AS rn FROM b),
each AS (SELECT k, CASE WHEN br THEN 0 ELSE 1 END AS late, CASE WHEN br THEN -ord ELSE ord END AS o, unnest([0, 1]) AS nth, unnest(options) AS option FROM b),
{_merged_options_sql("each", "k")}
SELECT w.k, best AS doc_id, (SELECT salary FROM r WHERE r.ord = coalesce(sb, sa)) AS salary, md5(x.body) AS body, first_seen, copies, coalesce(o5.options, '') AS options FROM w JOIN x ON x.k = w.k AND rn = 1 LEFT JOIN o5 ON o5.k = w.k""")
def d05(spark, sf):
    out = identity.dedupe(_doc_rows(spark, sf), "k", "ord", "prio", ["salary"], ["body"], [], options="options")
    return out.select("k", "doc_id", "salary", F.md5("body").alias("body"), "first_seen", "copies", _said().alias("options"))


@register("d04_options", f"""WITH each AS (SELECT page_id % 40 AS g, 0 AS late, page_id AS o, 0 AS nth, struct_pack(portal := 'Portal ' || (page_id % 5), url := url, direct := page_id % 3 = 0) AS option FROM pages),
{_merged_options_sql("each", "g")} SELECT g, options FROM o5""")
def d04(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    option = F.struct(F.concat(F.lit("Portal "), (F.col("page_id") % 5).cast("string")).alias("portal"), F.col("url").alias("url"), (F.col("page_id") % 3 == 0).alias("direct"))
    # few groups of any number of options: none is collected
    each = pages.select((F.col("page_id") % 40).alias("_key"), F.col("page_id").alias("turn"), option.alias("nth"), option.alias("option"))
    return identity.options_by_key(each).select(F.col("_key").alias("g"), _said().alias("options"))


_KEY = f"substr(sha256({v.title_sql('title')} || '|' || {v.company_sql('company')} || '|' || {v.norm_sql('city')} || '|' || {v.norm_sql('region')}), 1, 20)"


@register("d06_merge_previous", _with(f"""
, e AS (SELECT *, {_KEY} AS key FROM L), prev AS (SELECT *, posted_at AS seen_at, CASE WHEN id % 2 = 0 THEN 'old ' || id ELSE key END AS old FROM e WHERE id % 3 <> 0),
u AS (SELECT key, 0 AS late, pos, prio, id, salary_max, body, posted_at FROM e WHERE id % 5 = 0 UNION ALL SELECT key, 1, pos, prio, id, salary_max, body, posted_at FROM prev
 WHERE {T_NOW} - seen_at <= CASE WHEN source IN ('greenhouse','lever','ashby','smartrecruiters','workable','recruitee') THEN INTERVAL 6 HOUR ELSE INTERVAL 600 DAY END),
r AS (SELECT *, row_number() OVER (ORDER BY late, pos) AS o FROM u),
b AS (SELECT *, coalesce(prio > max(prio) OVER (PARTITION BY key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS br FROM r),
t AS (SELECT key, max(seen_at) AS seen FROM (SELECT key, seen_at FROM prev UNION ALL SELECT old, seen_at FROM prev) GROUP BY key)
SELECT b.key, min(late) = 0 AS fresh, arg_max(id, o) FILTER (br) AS row_id, coalesce(arg_max(salary_max, o) FILTER (br AND salary_max IS NOT NULL), arg_min(salary_max, o) FILTER (salary_max IS NOT NULL)) AS salary, max(length(body)) AS longest,
 strftime(min(posted_at), '%Y-%m-%d') AS posted, count(*) AS copies, CASE WHEN min(late) = 0 THEN '{NOW}' ELSE strftime(any_value(t.seen), '%Y-%m-%d %H:%M:%S') END AS seen FROM b LEFT JOIN t USING (key) GROUP BY b.key"""))
def d06(spark, sf):
    rows = listings(spark, sf).select(F.col("id").alias("row_id"), "title", "company", "city", "region", "source", "pos", "prio", "salary_max", "body", "posted_at")
    key = identity.fingerprint(F.col("title"), F.col("company"), F.col("city"), F.col("region"))
    rows = rows.withColumn("id", key)
    prev = rows.filter("row_id % 3 <> 0").withColumn("seen_at", F.col("posted_at")).withColumn("id", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("old "), F.col("row_id").cast("string"))).otherwise(F.col("id")))
    fresh = rows.filter("row_id % 5 = 0").withColumn("seen_at", now())
    out = identity.merge_previous(fresh, prev, now(), keep_days=600, best_or_other=["salary_max"], longest=["body"], least=["posted_at"])
    return out.select(
        F.col("id").alias("key"), "fresh", "row_id", F.col("salary_max").alias("salary"), F.length("body").cast("long").alias("longest"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "copies",
        F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen"),
    )


@register("d08_scope_cap", _with(f"SELECT id FROM L WHERE country IN ('CA', 'US') AND posted_at >= {T_NOW} - INTERVAL 600 DAY ORDER BY country <> 'CA', posted_at DESC, pos LIMIT 500"))
def d08(spark, sf):
    return identity.cap(listings(spark, sf).filter(identity.in_scope(now(), 600)), 500).select("id")


@register("d10_sticky_status", _with(f"""
, s AS (SELECT source, count(*) AS n, max(id) AS m FROM L GROUP BY source)
SELECT source, m % 3 <> 0 AS ok, CASE WHEN m % 3 <> 0 AND m % 2 = 0 THEN '{NOW}' ELSE 'before' END AS last_success, CASE WHEN m % 3 = 0 THEN 'new error' WHEN m % 2 = 0 THEN NULL ELSE 'old error' END AS last_error FROM s"""))
def d10(spark, sf):
    s = listings(spark, sf).groupBy("source").agg(F.count("*").alias("count"), F.max("id").alias("m"))
    s = s.withColumns({"ok": F.col("m") % 3 != 0, "skipped": F.col("m") % 2 != 0, "error": F.lit("new error")})
    prev = s.select("source", F.lit("before").alias("last_success"), F.lit("old error").alias("last_error"))
    return identity.sticky_status(s, prev, F.lit(NOW)).select("source", "ok", "last_success", "last_error")


# ------------------------------------------------------------------ filters, search, rankings, facets

ALL_FILTERS = query.SearchParams(
    country="CA", region="CANADA", city="city 1", industry="building", work_type="remote", employment_type="contract", company="Acme 12", level="senior", skills=("Python", "Leadership"), certs=("PMP",), tools=("AWS",),
    has_salary=True, min_salary=60_000, max_salary=90_000, hide_auth=("clearance", "no-sponsorship"), sponsorship=True, within_days=700,
)
_LOW = v.CAD_SQL.replace("coalesce(salary_max, salary_min)", "salary_min")
_CO = v.company_sql("company")
FILTER_SQL = {
    "f01": "country = 'CA'", "f02": "region = 'CA' OR (is_remote AND region = '')", "f03": f"contains({v.norm_sql('city')}, 'city 1')", "f04": "industry = 'building'", "f05": "work_type = 'remote'",
    "f06": "employment_type = 'contract'", "f07": f"{_CO} = 'acme 12' OR starts_with({_CO}, 'acme 12 ') OR starts_with('acme 12', {_CO} || ' ')", "f08": "coalesce(seniority = 'senior', false)",
    "f09": "list_has_all(skills, ['Python', 'Leadership'])", "f10": "list_has_all(certifications, ['PMP'])", "f11": "list_has_all(tools, ['AWS'])", "f12": "coalesce(yearly_cad, 0) <> 0",
    "f13": "coalesce(yearly_cad, 0) >= 60000", "f14": f"coalesce({_LOW} <= 90000, true)", "f15": "NOT coalesce(list_has_any(auth, ['clearance', 'no-sponsorship']), false)",
    "f16": "coalesce(list_contains(auth, 'sponsorship'), false)", "f17": f"posted_at >= {T_NOW} - INTERVAL 700 DAY", "f18": "posted_at >= TIMESTAMP '1998-01-01 00:00:00'", "f19": "posted_at <= TIMESTAMP '2000-12-31 23:59:59'",
}


@register("f_predicates", _with("SELECT id, " + ", ".join(f"({c}) AS {k}" for k, c in sorted(FILTER_SQL.items())) + " FROM L"))
def f_predicates(spark, sf):
    import datetime as dt
    from dataclasses import replace

    p = replace(ALL_FILTERS, region="CA", date_from=dt.date(1998, 1, 1), date_to=dt.date(2000, 12, 31))
    return listings(spark, sf).select("id", *[c.alias(k) for k, c in sorted(query.predicates(p, now()).items())])


_FILTERED = f"country = 'US' AND coalesce(yearly_cad, 0) >= 40000 AND coalesce({_LOW} <= 150000, true) AND posted_at >= {T_NOW} - INTERVAL 1500 DAY"


@register("o_salary_page", _with(f"""SELECT nth, id, yearly_cad FROM (SELECT id, yearly_cad, row_number() OVER (ORDER BY country <> 'CA', coalesce(yearly_cad, 0) DESC, posted_at DESC, pos) AS nth FROM L WHERE {_FILTERED}) WHERE nth BETWEEN 26 AND 50"""))
def o_salary_page(spark, sf):
    p = query.page(query.apply_filters(listings(spark, sf), PARAMS, now()), PARAMS, now())
    return p.withColumn("nth", F.row_number().over(Window.orderBy(*query.order(PARAMS, now()))) + 25).select("nth", "id", "yearly_cad")  # 25 rows


def _sorted(sort: str, key: str):
    from dataclasses import replace

    p = replace(PARAMS, sort=sort, page=1, country="ALL")

    @register(f"o_{sort}_page", _with(f"SELECT nth, id FROM (SELECT id, row_number() OVER (ORDER BY country <> 'CA', {key}, pos) AS nth FROM L WHERE {_FILTERED.replace(chr(99) + 'ountry = ' + v.quoted('US') + ' AND ', '')}) WHERE nth <= 25"))
    def run(spark, sf):
        out = query.page(query.apply_filters(listings(spark, sf), p, now()), p, now())
        return out.withColumn("nth", F.row_number().over(Window.orderBy(*query.order(p, now())))).select("nth", "id")


_AGE = f"((epoch_us({T_NOW}) - epoch_us(posted_at)) / 86400000000.0::DOUBLE)"
for _sort, _key in (("newest", "posted_at DESC"), ("oldest", "posted_at"), ("relevance", f"greatest(0.0::DOUBLE, 30 - {_AGE}) + CASE WHEN coalesce(salary_max, salary_min) IS NOT NULL THEN 5 ELSE 0 END + prio DESC")):
    _sorted(_sort, _key)


@register("a01_facets", _with(f"""
, f AS (SELECT * FROM L WHERE {_FILTERED}), x AS (SELECT 'industry' AS facet, industry AS key FROM f UNION ALL SELECT 'region', region FROM f UNION ALL SELECT 'seniority', coalesce(seniority, '') FROM f
UNION ALL SELECT 'skills', unnest(skills) FROM f UNION ALL SELECT 'certifications', unnest(certifications) FROM f UNION ALL SELECT 'tools', unnest(tools) FROM f)
SELECT facet, key, count(*) AS count FROM x WHERE key <> '' GROUP BY ALL"""))
def a01(spark, sf):
    return query.search(listings(spark, sf), PARAMS, now()).facets


@register("a03_total", _with(f"SELECT count(*) AS total FROM L WHERE {_FILTERED}"))
def a03(spark, sf):
    return query.search(listings(spark, sf), PARAMS, now()).total


SEARCHES = {"plain": "cloud analyst", "either": 'soc OR "help desk" -guard', "synonym": "sre", "phrase": '"registered nurse" | accountant', "exclude": '-engineer -"line cook"', "part": "art -smart"}


def _search_sql(q: str, norm: str, tags: str) -> tuple[str, str]:
    m = search_ops.compile_query(q, v.KEYWORDS, v.ALIASES)

    def hit(t, h, tagged=True):
        tests = [f"list_contains({tags}, {v.quoted(t.tag)})"] if t.tag and tagged else []
        for x in t.variants:
            p = text.plain(x)
            if not tagged:
                tests.append(f"({v.phrase_sql(h, p)} OR contains({h}, {v.quoted(p)}))")
            else:
                tests.append(v.phrase_sql(h, p) if t.phrase or " " in x else f"contains({h}, {v.quoted(p)})")
        return "(" + " OR ".join(tests) + ")"

    body = "(" + " OR ".join("(" + " AND ".join(hit(t, norm) for t in c) + ")" for c in m.clauses) + ")" if m.clauses else "true"
    ok = " AND ".join([body, *[f"NOT {v.phrase_sql(norm, e)}" for e in m.exclude]])
    hits = " + ".join([f"CASE WHEN {hit(t, 'tn', False)} THEN 1 ELSE 0 END" for c in m.clauses for t in c]) or "0"
    return ok, hits


@register("q_searches", _with("SELECT id, " + ", ".join(f"({a}) AS {k}_ok, ({b}) AS {k}_title" for k, (a, b) in ((k, _search_sql(q, "h", "tags")) for k, q in SEARCHES.items()))
          + f" FROM (SELECT id, tags, {v.norm_sql('title')} AS tn, {v.norm_sql('title || chr(32) || company || chr(32) || city || chr(32) || array_to_string(skills, chr(32)) || chr(32) || array_to_string(tags, chr(32))')} AS h FROM L)"))
def q_searches(spark, sf):
    rows = listings(spark, sf).select("id", "tags", text.normalize(F.col("title")).alias("tn"), search_ops.haystack(F.col("title"), F.col("company"), F.col("city"), F.col("skills"), F.col("tags")).alias("hay"))
    compiled = {k: search_ops.compile_query(q, v.KEYWORDS, v.ALIASES) for k, q in SEARCHES.items()}
    out = [c for k, m in compiled.items() for c in (m.test(F.col("hay"), F.col("tags")).alias(f"{k}_ok"), m.title_hits(F.col("tn")).alias(f"{k}_title"))]
    return rows.select("id", *out)


@register("f21_new_since", _with("SELECT 'soc' AS set, count(*) AS new FROM L WHERE posted_at > TIMESTAMP '2000-01-01' AND contains(lower(title), 'soc') UNION ALL SELECT 'cook', count(*) FROM L WHERE posted_at > TIMESTAMP '1999-01-01' AND contains(lower(title), 'cook')"))
def f21(spark, sf):
    rows = listings(spark, sf).withColumn("hay", text.normalize(F.col("title")))
    return query.new_since(rows, {"soc": (search_ops.compile_query("soc"), "2000-01-01 00:00:00"), "cook": (search_ops.compile_query("cook"), "1999-01-01 00:00:00")})


# ------------------------------------------------------------------ dashboard and coverage


@register("a04_dashboard", _with(f"""SELECT country, count(*) AS total, count(*) FILTER ({_AGE} < 1) AS new_today, count(*) FILTER ({_AGE} < 7) AS new_week, count(DISTINCT nullif({_CO}, '')) AS employers,
 count(*) FILTER (work_type = 'remote') AS remote, count(*) FILTER (work_type = 'hybrid') AS hybrid, round(count(*) FILTER (work_type = 'remote') / count(*), 6) AS remote_share,
 count(*) FILTER (seniority = 'entry' OR employment_type = 'internship') AS entry_level, count(*) FILTER (coalesce(salary_max, salary_min) IS NOT NULL) AS with_salary FROM L GROUP BY GROUPING SETS ((country), ())"""))
def a04(spark, sf):
    return stats.totals(listings(spark, sf), now(), ["country"]).withColumn("remote_share", F.round("remote_share", 6))


@register("a09_upper_median", _with(f"SELECT CAST(floor(y + 0.5) AS BIGINT) AS median_yearly FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS rn, count(*) OVER () AS n FROM (SELECT {v.YEAR} AS y FROM L) WHERE y > 0) WHERE rn = n // 2"))
def a09(spark, sf):
    return stats.upper_median(listings(spark, sf))


_PLACED = "CASE WHEN {0} = '' AND is_remote THEN 'Remote' ELSE {0} END"
_KEYS = {"industry": "industry", "region": _PLACED.format("region"), "work_type": "work_type", "level": "seniority", "source": "source", "city": _PLACED.format("city")}
_MANY = {"skills": 8, "certifications": 8, "tools": 10}


@register("a10_top_lists", _with("SELECT list, key, count FROM (" + " UNION ALL ".join(
    f"(SELECT {v.quoted(n)} AS list, {e} AS key, count(*) AS count, min(pos) AS fp FROM L WHERE {e} <> '' GROUP BY 1, 2 ORDER BY count DESC, fp LIMIT {stats.LISTS[n]})" for n, e in _KEYS.items()) + ")"))
def a10(spark, sf):
    return stats.top_lists(listings(spark, sf)).filter(F.col("list").isin(list(_KEYS))).drop("nth")


@register("a13_top_skills", _with("SELECT list, key, count FROM (" + " UNION ALL ".join(
    f"(SELECT '{n}' AS list, s AS key, count(*) AS count, min(pos) AS fp FROM (SELECT unnest({n}) AS s, pos FROM L) GROUP BY s ORDER BY count DESC, fp LIMIT {k})" for n, k in _MANY.items()) + ")"))
def a13(spark, sf):
    return stats.top_lists(listings(spark, sf)).filter(F.col("list").isin(list(_MANY))).drop("nth")


@register("a14_top_companies", _with(f"SELECT arg_max(company, pos) AS name, replace({_CO.replace('company', 'arg_max(company, pos)')}, ' ', '-') AS slug, count(*) AS count FROM L GROUP BY {_CO} ORDER BY count DESC, min(pos) LIMIT 8"))
def a14(spark, sf):
    return stats.top_companies(listings(spark, sf))


@register("a15_per_day", "SELECT strftime(d, '%Y-%m-%d') AS day, count(ts) AS count FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT ts FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) ON date_trunc('day', ts) = d GROUP BY d")
def a15(spark, sf):
    (events,) = tables(spark, sf, "events")
    return stats.per_day(events, "2024-01-31 00:00:00", at="ts")


@register("a21_keyword_coverage", _with("SELECT k AS keyword, count(t) AS jobs_now, count(t) FILTER (country = 'CA') AS canada, CAST(length(k) AS BIGINT) AS calls, CAST(2 * length(k) AS BIGINT) AS fetched, count(t) < 10 AS thin FROM (VALUES " + ", ".join(f"({v.quoted(k)})" for k in v.KEYWORDS) + ") x(k) LEFT JOIN (SELECT unnest(tags) AS t, country FROM L) ON t = k GROUP BY k"))
def a21(spark, sf):
    kw = spark.createDataFrame([(k,) for k in v.KEYWORDS], "keyword string")
    calls = kw.select("keyword", F.length("keyword").alias("calls"), (2 * F.length("keyword")).alias("fetched"))
    return stats.keyword_coverage(kw, listings(spark, sf), calls)


@register("a18_source_coverage", _with("SELECT s AS source, coalesce(n, 0) AS on_site FROM (VALUES ('adzuna'), ('lever'), ('nowhere')) x(s) LEFT JOIN (SELECT source, count(*) AS n FROM L GROUP BY source) ON source = s"))
def a18(spark, sf):
    return stats.source_coverage(spark.createDataFrame([("adzuna",), ("lever",), ("nowhere",)], "source string"), listings(spark, sf)).select("source", "on_site")


@register("a23_tracker_counts", _with("SELECT s AS status, count(id) AS count FROM (VALUES " + ", ".join(f"('{s}')" for s in tracker.STATUSES) + ") x(s) LEFT JOIN (SELECT id, CASE id % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'offer' WHEN 2 THEN 'odd' ELSE 'applied' END AS st FROM L) ON st = s GROUP BY s"))
def a23(spark, sf):
    return tracker.status_counts(listings(spark, sf).select("id", F.when(F.col("id") % 4 == 1, "offer").when(F.col("id") % 4 == 2, "odd").when(F.col("id") % 4 == 0, "applied").alias("status")))


# ------------------------------------------------------------------ plans, links, resumes, tracker, streams


@register("g01_broad_plan", """WITH n AS (SELECT n_name AS r, n_nationkey AS i, n_regionkey, 1 + count(c_custkey) % 5 AS p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN page ELSE 0 END, i, page) - 1 AS ord, country, region, q, page FROM (SELECT 0 AS part, i, 'CA' AS country, r AS region, '' AS q, unnest(range(1, p + 1)) AS page FROM n WHERE n_regionkey = 1
UNION ALL SELECT 1, p, 'CA', '', 'remote', p FROM (VALUES (1), (2)) t(p) UNION ALL SELECT 2, i, 'US', r, '', 1 FROM n WHERE n_regionkey <> 1 UNION ALL SELECT 3, 0, 'US', '', 'remote', 1)""")
def g01(spark, sf):
    nation, customer = tables(spark, sf, "nation", "customer")
    rows = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("region"), F.col("n_nationkey").alias("i"), "n_regionkey").agg((1 + F.count("c_custkey") % 5).alias("pages"))
    return schedule.broad_plan(spark, rows.filter("n_regionkey = 1"), rows.filter("n_regionkey <> 1"))


@register("g02_keyword_plans", """WITH k AS (SELECT lower(n_name) AS k, CASE WHEN n_regionkey < 2 THEN 'priority' ELSE 'general' END AS t FROM nation), c AS (SELECT 'City ' || c_custkey % 12 AS c, n_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT lane, country, q, city, region, work_type, page FROM (SELECT 'core' AS lane, 'CA' AS country, k AS q, '' AS city, '' AS region, 'all' AS work_type, p AS page FROM k, (VALUES (1), (2), (3)) x(p) WHERE t = 'priority' UNION ALL SELECT 'core', 'CA', k || ' remote', '', '', 'remote', 1 FROM k WHERE t = 'priority'
UNION ALL SELECT 'more', 'CA', k, c, r, 'all', 1 FROM k, c WHERE t = 'priority' UNION ALL SELECT 'more', 'CA', k, '', '', 'all', 1 FROM k WHERE t = 'general' UNION ALL SELECT 'more', 'US', k, '', '', 'all', 1 FROM k UNION ALL SELECT 'more', 'US', k || ' remote', '', '', 'remote', 1 FROM k WHERE t = 'priority')""")
def g02(spark, sf):
    nation, customer = tables(spark, sf, "nation", "customer")
    keywords = nation.select(F.lower("n_name").alias("keyword"), F.when(F.col("n_regionkey") < 2, "priority").otherwise("general").alias("tier"), F.col("n_nationkey").cast("int").alias("pos"))
    cities = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("City "), (F.col("c_custkey") % 12).cast("string")).alias("city"), F.col("n_name").alias("region")).distinct()
    return schedule.keyword_plans(keywords, cities.withColumn("pos", F.hash("city", "region"))).select("lane", "country", "q", "city", "region", "work_type", "page")


@register("g03_allowances", "SELECT event_id, CAST(greatest(0, least(d, floor((s + 1) * d / 24)) - u) AS BIGINT) AS calls FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 240 WHEN 1 THEN 6 ELSE 48 END AS d, event_id % 50 AS u, floor((epoch_ms(ts) % 86400000) / 3600000) AS s FROM events)")
def g03(spark, sf):
    (events,) = tables(spark, sf, "events")
    daily = F.when(F.col("event_id") % 3 == 0, 240).when(F.col("event_id") % 3 == 1, 6).otherwise(48)
    return events.select("event_id", schedule.allowance(daily, F.col("event_id") % 50, schedule.millis(F.col("ts")), F.lit(24)).alias("calls"))


@register("g04_next_call", "SELECT event_id, CAST(floor((coalesce((SELECT min(t) FROM range(24) r(t) WHERE t > s AND floor((t + 1) * 6 / 24) > u), 24) - s) + 0.5) AS BIGINT) AS hours FROM (SELECT event_id, event_id % 7 AS u, floor((epoch_ms(ts) % 86400000) / 3600000) AS s FROM events)")
def g04(spark, sf):
    (events,) = tables(spark, sf, "events")
    return events.select("event_id", schedule.hours_until_next(F.lit(6), F.col("event_id") % 7, schedule.millis(F.col("ts")), F.lit(24)).alias("hours"))


@register("g05_split", """WITH l AS (SELECT o_orderpriority AS key, count(*) FILTER (o_orderkey % 150 = 0) AS size, round(0.1 + avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END::DOUBLE), 2) AS share, substr(o_orderpriority, 1, 1)::INT AS pos FROM orders GROUP BY ALL),
x AS (SELECT *, 60.0::DOUBLE * share / sum(share) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS exact FROM l WHERE size > 0), n AS (SELECT *, least(size, floor(exact))::BIGINT AS n, row_number() OVER (ORDER BY exact - floor(exact) DESC, pos) AS turn FROM x),
t AS (SELECT key, row_number() OVER (ORDER BY t, turn) AS place, left_over FROM (SELECT key, turn, size - n AS room, unnest(range(1, 61)) AS t, 60 - sum(n) OVER () AS left_over FROM n) WHERE t <= room)
SELECT key, n + (SELECT count(*) FROM t WHERE t.key = n.key AND place <= left_over) AS calls FROM n""")
def g05(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    share = F.round(0.1 + F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)), 2)
    lanes = orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count_if(F.col("o_orderkey") % 150 == 0).alias("size"), share.alias("share"))
    return schedule.split_calls(lanes.withColumn("pos", F.substring("key", 1, 1).cast("int")), 60)


@register("g13_slugs", _with(f"""SELECT id, array_to_string(list_filter(list_distinct_kept, lambda s: length(s) >= 3), '|') AS slugs FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_kept FROM (
  SELECT id, list_concat(CASE WHEN len(string_split(a, ' ')) <= 4 AND length(a) >= 3 THEN list_filter([replace(a, ' ', ''), replace(a, ' ', '-'), CASE WHEN contains(a, ' ') AND length(split_part(a, ' ', 1)) >= 4 THEN split_part(a, ' ', 1) END], lambda x: x IS NOT NULL) ELSE [] END,
  CASE WHEN len(string_split(b, ' ')) <= 4 AND length(b) >= 3 THEN list_filter([replace(b, ' ', ''), replace(b, ' ', '-'), CASE WHEN contains(b, ' ') AND length(split_part(b, ' ', 1)) >= 4 THEN split_part(b, ' ', 1) END], lambda x: x IS NOT NULL) ELSE [] END) AS l
  FROM (SELECT id, {v.norm_sql('company')} AS a, {_CO} AS b FROM L)))"""))
def g13(spark, sf):
    return listings(spark, sf).select("id", F.array_join(schedule.slug_candidates(F.col("company")), "|").alias("slugs"))


@register("l01_career_sites", _with(f""", c AS (SELECT DISTINCT 'Acme ' || CAST(c_custkey % 400 AS VARCHAR) || CASE c_custkey % 2 WHEN 0 THEN ' Inc' ELSE ' Labs' END AS company FROM customer),
k AS (SELECT company, {v.company_sql('company')} AS key FROM c),
b AS (SELECT {v.company_sql('company')} AS key, arg_min('https://jobs.lever.co/' || lower(replace(company, ' ', '-')), pos) AS board FROM L WHERE source = 'lever' AND id % 3 = 0 GROUP BY 1)
SELECT company, CASE WHEN key = 'acme 7 labs' THEN 'https://seven.example' WHEN key = 'acme 12' OR starts_with(key, 'acme 12 ') THEN 'https://twelve.example' WHEN board IS NOT NULL THEN board ELSE 'https://www.google.com/search?q=' || replace(company, ' ', '%20') || '%20careers' END AS url,
 key = 'acme 7 labs' OR key = 'acme 12' OR starts_with(key, 'acme 12 ') OR board IS NOT NULL AS verified FROM k LEFT JOIN b USING (key)"""))
def l01(spark, sf):
    (customer,) = tables(spark, sf, "customer")
    name = F.concat(F.lit("Acme "), (F.col("c_custkey") % 400).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " Inc").otherwise(" Labs"))
    curated = spark.createDataFrame([("acme 7 labs", "https://seven.example"), ("acme 12", "https://twelve.example")], "key string, url string")
    slug = F.lower(F.replace("company", F.lit(" "), F.lit("-")))
    link = F.when((F.col("source") == "lever") & (F.col("id") % 3 == 0), F.concat(F.lit("https://jobs.lever.co/"), slug, F.lit("/"), F.col("id").cast("string"), F.lit("?x=1"))).otherwise("https://elsewhere.example/1")
    return link_ops.career_sites(customer.select(name.alias("company")).distinct(), curated, listings(spark, sf).select("company", "pos", link.alias("apply_url")))


@register("r01_match_scores", _with("""SELECT id, CAST(floor(least(1.0, CASE WHEN len(w) > 0 THEN len(m) / len(w) ELSE 0.5 END * 0.8 + r + CASE WHEN len(w) > 0 THEN 0 ELSE r END) * 100 + 0.5) AS INT) AS score, array_to_string(m, '|') AS matched
 FROM (SELECT id, w, list_filter(w, lambda x: x IN ('Python', 'Leadership', 'AWS', 'PMP')) AS m, CASE WHEN list_contains(tags, 'cloud engineer') THEN 0.2 ELSE 0 END::DOUBLE AS r FROM (SELECT id, tags, list_concat(list_concat(skills, tools), certifications) AS w FROM L))"""))
def r01(spark, sf):
    have, roles = F.array(*map(F.lit, ("Python", "Leadership", "AWS", "PMP"))), F.array(F.lit("cloud engineer"))
    m = resume.match_score(F.concat("skills", "tools", "certifications"), have, F.col("tags"), roles)
    return listings(spark, sf).select("id", m.alias("m")).select("id", "m.score", F.array_join("m.matched", "|").alias("matched"))


_TERMS = f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,.;:!?()\\[\\]\\n\\r•|/]+|\\s[-–—]\\s')) AS t, unnest(range(len(regexp_split_to_array(text, '[,.;:!?()\\[\\]\\n\\r•|/]+|\\s[-–—]\\s')))) AS part FROM documents),
w AS (SELECT doc_id, part, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, part, list_filter(string_split({v.norm_sql('t')}, ' '), lambda y: y <> '') AS x FROM p)),
n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, part ORDER BY i) AS nx FROM w),
k AS (SELECT * FROM n WHERE length(w) >= 3 AND w NOT IN ('the', 'les', 'und') AND NOT regexp_full_match(w, '\\d+')),
t AS (SELECT doc_id, w AS term, part * 4294967296 + 2 * i AS place FROM k UNION ALL SELECT doc_id, w || ' ' || nx, part * 4294967296 + 2 * i + 1 FROM k WHERE length(nx) >= 3 AND nx NOT IN ('the', 'les', 'und') AND NOT regexp_full_match(nx, '\\d+'))"""


@register("r05_term_counts", _TERMS + "\nSELECT doc_id, term, count(*) AS count FROM t GROUP BY doc_id, term")
def r05(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    return resume.term_counts(spread(docs), "doc_id", "text", ["the", "les", "und"]).select("doc_id", "term", "count")


@register("r05_keywords", _TERMS + """,
c AS (SELECT doc_id, term, count(*) AS n, min(place) AS place FROM t GROUP BY doc_id, term HAVING count(*) >= 2),
l AS (SELECT doc_id, list(struct_pack(term := term, n := n) ORDER BY n * CASE WHEN contains(term, ' ') THEN 1.6::DOUBLE ELSE 1 END DESC, place, term) AS r FROM c GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(r, lambda out, x: CASE WHEN len(out) >= 15 OR len(list_filter(out, lambda o: contains(o.term, x[1].term) OR contains(x[1].term, o.term))) > 0 THEN out ELSE list_concat(out, x) END, CAST([] AS STRUCT(term VARCHAR, n BIGINT)[])) AS k FROM (SELECT doc_id, list_transform(r, lambda x: [x]) AS r FROM l))
SELECT doc_id, x.term AS term, x.n AS count, CAST(nth AS INT) AS nth FROM (SELECT doc_id, unnest(k) AS x, unnest(range(len(k))) AS nth FROM f)""")
def r05_keywords(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    return resume.keywords(spread(docs), "doc_id", "text", ["the", "les", "und"])


_LINES = "list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x))"
_HEADED = lambda p: f"len(list_filter({_LINES}, lambda x: length(x) < 40 AND regexp_matches(x, {v.quoted(p)}, 'i'))) > 0"


_LENGTH = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\r\\f]+'), lambda w: w <> '')) BETWEEN 300 AND 1200"
_BULLETS = f"len(list_filter({_LINES}, lambda x: regexp_matches(x, {v.quoted(lx.RESUME_BULLET)}))) >= 3"
_NUMBERS = f"len(regexp_extract_all(text, {v.quoted(lx.RESUME_NUMBER)})) >= 3"


@register("r09_format_checks", f"SELECT doc_id, regexp_matches(text, {v.quoted(lx.RESUME_EMAIL)}) AS email, regexp_matches(text, {v.quoted(lx.RESUME_PHONE)}) AS phone, " + ", ".join(f"{_HEADED(p)} AS {k}" for k, p in lx.RESUME_HEADINGS.items())
          + f", {_LENGTH} AS length, {_BULLETS} AS bullets, {_NUMBERS} AS numbers FROM documents")
def r09(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in resume.format_checks(F.col("text")).items()])


def _analysis_sql() -> str:
    """The whole breakdown from its definition: shares of lexicon entries, title, years, degree and checks of the text."""
    pairs = [text.entry(x) for x in [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]]
    hard = [p for n, p in pairs if n not in lx.SOFT_SKILLS]
    soft = [(p, lx.SOFT_SKILLS[n]) for n, p in map(text.entry, lx.SKILLS) if n in lx.SOFT_SKILLS]
    asked = lambda p: v.rlike_sql("jd", p)
    total = lambda tests: " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)
    years = lambda x, p, most: f"list_filter(list_transform(regexp_extract_all({x}, {v.quoted('(?i)' + p)}, 1), lambda s: CAST(s AS INT)), lambda y: y > 0 AND y <= {most})"
    level = lambda x: "CASE " + " ".join(f"WHEN {v.rlike_sql(x, p)} THEN {k}" for _, p, k in lx.EDUCATION) + " END"
    checks = [f"regexp_matches(text, {v.quoted(lx.RESUME_EMAIL)})", f"regexp_matches(text, {v.quoted(lx.RESUME_PHONE)})", *[_HEADED(p) for p in lx.RESUME_HEADINGS.values()], _LENGTH, _BULLETS, _NUMBERS]
    levels = ", ".join(f"'{w}'" for w in lx.TITLE_LEVELS)
    points = lambda x, most: f"floor(({x})::DOUBLE * {most} * 10 + 0.5) / 10"
    return _with(f"""
, t AS (SELECT id, title || chr(10) || body AS jd, 'Experience' || chr(10) || body || chr(10) || '2015 - 2019' || chr(10) || '2018 – present' || chr(10) || 'jo@example.com' AS text, {v.title_sql('title')} AS tk FROM L),
x AS (SELECT id, {total(map(asked, hard))} AS h, {total(f"{asked(p)} AND {v.rlike_sql('text', p)}" for p in hard)} AS hi, {total(asked(p) for p, _ in soft)} AS s, {total(f"{asked(p)} AND ({v.rlike_sql('text', p)} OR {v.rlike_sql('text', q)})" for p, q in soft)} AS si,
 list_filter(string_split(tk, ' '), lambda w: length(w) > 1 AND w NOT IN ({levels})) AS w, ' ' || {v.norm_sql('text')} || ' ' AS n, list_min({years('jd', lx.REQUIRED_YEARS, 20)}) AS required, list_max({years('text', lx.CLAIMED_YEARS, 45)}) AS have, {level('jd')} AS ed, {level('text')} AS eh, {total(checks)} AS ok FROM t),
y AS (SELECT *, contains(n, ' ' || array_to_string(w, ' ') || ' ') AND len(w) > 0 AS tm, coalesce(len(list_filter(w, lambda z: contains(n, ' ' || z || ' '))) / nullif(len(w), 0), 0) >= 0.6 AS tp, CASE WHEN required IS NOT NULL THEN coalesce(have >= required, false) END AS xo, CASE WHEN ed IS NOT NULL THEN coalesce(eh >= ed, false) END AS eo, CASE WHEN s > 0 THEN si / s ELSE 1 END AS ws FROM x)
SELECT id, CAST(floor({points('CASE WHEN h > 0 THEN hi / h ELSE ws END', 40)} + {points('ws', 15)} + {points('CASE WHEN tm THEN 1 WHEN tp THEN 0.6 ELSE 0 END', 10)}
 + {points('CASE WHEN coalesce(xo, true) THEN 1 WHEN have IS NOT NULL THEN least(0.8::DOUBLE, have / required) ELSE 0.2 END', 10)} + {points('CASE WHEN coalesce(eo, true) THEN 1 ELSE 0.3 END', 5)} + {points('ok / 8', 20)} + 0.5) AS INT) AS score,
 CAST(CASE WHEN h + s > 0 THEN floor((hi + si) / (h + s) * 100 + 0.5) ELSE 0 END AS INT) AS keyword_match, required, have,
 CAST((hi < h)::INT + (si < s)::INT + (NOT tm)::INT + coalesce(NOT xo, false)::INT + coalesce(NOT eo, false)::INT + 8 - ok AS INT) AS tips FROM y""")


@register("r10_analysis", _analysis_sql())
def r10(spark, sf):
    rows = listings(spark, sf).select("id", "title", F.col("body").alias("posting"), F.concat_ws("\n", F.lit("Experience"), F.col("body"), F.lit("2015 - 2019\n2018 – present\njo@example.com")).alias("resume"))
    return resume.analyze(rows.withColumn("terms", F.array().cast("array<struct<term:string,jd_count:int,in_resume:boolean>>")), 2001).select("id", "score", "keyword_match", "required", "have", F.size("tips").alias("tips"))


@register("v07_recent", "SELECT user_id, event_type, nth FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) WHERE nth <= 3")
def v07(spark, sf):
    (events,) = tables(spark, sf, "events")
    rows = events.select(F.col("user_id").alias("user"), F.col("event_type").alias("q"), F.lit("").alias("city"), F.col("ts").alias("at"), F.col("event_id").alias("pos"))
    return tracker.recent(rows, 3).select(F.col("user").alias("user_id"), F.col("q").alias("event_type"), "nth")


@register("v01_toggle", _with("SELECT id FROM L WHERE (id % 4 = 0) <> (id % 6 = 0)"))
def v01(spark, sf):
    rows = listings(spark, sf).select("id", "title")
    return tracker.toggle(rows.filter("id % 4 = 0"), rows.filter("id % 6 = 0")).select("id")


@register("v03_update", _with("SELECT id, CASE WHEN id % 6 = 0 THEN 'offer' ELSE 'applied' END AS status, id % 6 = 0 AS changed FROM L WHERE id % 4 = 0"))
def v03(spark, sf):
    rows = listings(spark, sf).select("id", F.lit("applied").alias("status"), F.lit(None).cast("string").alias("updated_at"))
    out = tracker.update(rows.filter("id % 4 = 0"), rows.filter("id % 6 = 0").select("id", F.lit("offer").alias("status")), F.lit(NOW))
    return out.select("id", "status", F.col("updated_at").isNotNull().alias("changed"))


@register("w05_daily_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls FROM events GROUP BY ALL")
def w05(spark, sf):
    (events,) = tables(spark, sf, "events")
    return state.daily_usage(events.withColumn("ts", F.col("ts").cast("timestamp")))


@register("w06_slot_usage", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS slot, event_type, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def w06(spark, sf):
    (events,) = tables(spark, sf, "events")
    out = state.slot_usage(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("slot", "yyyy-MM-dd HH").alias("slot"), "event_type", "calls", F.round("value", 4).alias("value"))


@register("k07_feed", _with("SELECT pos, '<item><title>' || replace(title, '&', '&amp;') || ' - ' || company || '</title><link>https://x.example/?a=1&amp;id=' || id || '</link><pubDate>' || strftime(posted_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS item FROM L WHERE list_contains(tags, 'soc analyst') ORDER BY pos LIMIT 60"))
def k07(spark, sf):
    rows = listings(spark, sf).withColumn("apply_url", F.concat(F.lit("https://x.example/?a=1&id="), F.col("id").cast("string")))
    return files.feed_items(rows, ["soc analyst"])


@register("k10_tracker_csv", _with("SELECT '\"' || replace(title, '\"', '\"\"') || '\",\"' || company || '\",\"' || strftime(posted_at, '%Y-%m-%d') || '\"' AS line, id FROM L"))
def k10(spark, sf):
    rows = listings(spark, sf)
    return rows.select(files.tracker_csv(rows, ["title", "company", "posted_at"]).alias("line"), "id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o_salary_page(spark, sf_dir)
