"""Listings made from the star schema, so that every operator has a table to run on: the same SQL for Spark and others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

NOW = "2001-08-02 00:00:00"

TITLES = [
    "Snr. Platform Engr III (Remote)", "Practical Nurse - Part-time", "SOC Analyst L1", "Apprentice Plumber", "Shipping Clerk & Forklift Driver", "Pastry Cook", "Director of Sales", "Payroll Accountant, CMA",
    "Backend Software Developer", "Help Desk Lead (On-site)", "Jr. Site Reliability Eng", "Client Service Rep", "Long-haul Truck Driver", "Primary School Teacher", "Legal Assistant", "SEO Coordinator - Full time",
    "Cloud Engineer II", "Business Analyst Intern", "Registered Nurse Supervisor", "Network Admin", "Hospital Pharmacist", "Night Security Guard", "Project Manager [Temporary]", "Infirmière clinicienne québécoise (hybride)",
]
BODIES = [
    "At least 4+ years of experience with Docker, Ansible and Azure. Secret clearance required. Sponsorship is not offered.",
    "Work from home. Pay $31 - $42/hr. Registered Nurse (RN), CPR and First Aid. Must be a permanent resident.",
    "CrowdStrike, Okta and SIEM; CISM or Security+ helps. 1-2 years working in incident response. Bachelor's degree in engineering.",
    "Red Seal, WHMIS. Class 3 licence. Shift work, hybrid schedule. 2 years experience. We will sponsor welders; welding tests.",
    "C++ and C# on Linux, Node.js, .NET; MySQL or MongoDB. Legally authorized to work in Canada. $70,000 - $95,000 a year",
    "Bilingual: English and French. Customer service and communication skills. Excel, Tableau; forecasting. College diploma.",
    "Busy kitchen; food safety, Food Handler. Seasonal. 12 years in business, leadership, inventory.", "",
]
SOURCES = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "remotive", "himalayas", "canada_job_bank", "usajobs", "adzuna", "jsearch", "jooble", "deep_link"]
# fixed values: priority of each source where duplicates meet
PRIORITY = [7, 7, 7, 7, 7, 7, 3, 3, 6, 6, 4, 4, 3, 0]
KEYWORDS = ["soc analyst", "site reliability engineer", "help desk", "registered nurse", "truck driver", "software developer", "accountant", "cloud engineer"]
ALIASES = {
    "soc analyst": ["security operations analyst"], "site reliability engineer": ["sre", "production engineer"], "help desk": ["helpdesk", "service desk"], "registered nurse": ["rn", "nurse"],
    "truck driver": ["az driver"], "software developer": ["software engineer", "programmer"], "accountant": ["staff accountant", "cpa"],
}


def _pick(values: list, index: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE CAST({index} AS INT) " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


def listings_sql(array: str) -> str:
    """``array``: what makes an array of its arguments."""
    k = "o_orderkey"
    return f"""
SELECT {k} AS id, {k} AS pos, {_pick(TITLES, f"{k} % {len(TITLES)}")} AS title, {_pick(BODIES, f"{k} % {len(BODIES)}")} AS body,
  'Acme ' || CAST(o_custkey % 400 AS STRING) || {_pick([" Inc.", " Ltd", "", " Canada"], f"{k} % 4")} AS company,
  CASE WHEN {k} % 11 = 0 THEN '' ELSE 'City ' || CAST(o_custkey % 50 AS STRING) END AS city,
  CASE WHEN o_orderstatus = 'O' AND {k} % 3 = 0 THEN '' ELSE n_name END AS region,
  CASE WHEN r_name = 'AMERICA' THEN 'CA' ELSE 'US' END AS country, o_orderstatus = 'O' AS is_remote,
  CASE o_orderstatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'onsite' ELSE 'hybrid' END AS work_type,
  {_pick(["full-time", "part-time", "internship", "contract", "temporary"], f"{k} % 5")} AS employment_type, lower(c_mktsegment) AS industry,
  {_pick(["entry", "mid", "senior", "lead", "manager", "executive"], f"{k} % 7")} AS seniority,
  CASE WHEN {k} % 10 = 0 THEN NULL WHEN {k} % 7 = 0 THEN round(o_totalprice / 4000.0 * 0.8) ELSE round(o_totalprice * 0.8) END AS salary_min,
  CASE WHEN {k} % 10 = 0 OR {k} % 13 = 0 THEN NULL WHEN {k} % 7 = 0 THEN round(o_totalprice / 4000.0) ELSE round(o_totalprice) END AS salary_max,
  CASE WHEN r_name = 'AMERICA' THEN 'CAD' ELSE 'USD' END AS currency, CASE WHEN {k} % 7 = 0 THEN 'hourly' ELSE 'yearly' END AS period,
  o_orderdate AS posted_at, {_pick(SOURCES, f"{k} % 14")} AS source, {_pick(PRIORITY, f"{k} % 14")} AS prio,
  {array}({_pick(["Python", "SQL", "Java", "React", "SIEM"], f"{k} % 5")}, {_pick(["Leadership", "Sales", "Welding"], f"{k} % 3")}) AS skills,
  {array}({_pick(["AWS", "Excel", "Jira", "SAP"], f"{k} % 4")}) AS tools, {array}({_pick(["PMP", "CPA", "CISSP"], f"{k} % 3")}) AS certifications,
  CASE {k} % 5 WHEN 0 THEN {array}('clearance') WHEN 1 THEN {array}('sponsorship', 'must-be-eligible') WHEN 2 THEN {array}('no-sponsorship') END AS auth,
  CASE WHEN {k} % 3 = 0 THEN {array}('cloud engineer') WHEN {k} % 24 = 2 THEN {array}('soc analyst', 'help desk') ELSE {array}('accountant') END AS tags
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


YEAR = "(coalesce(salary_max, salary_min) * CASE WHEN period = 'hourly' THEN 2080 ELSE 1 END)"
CAD_SQL = f"CAST(floor(CASE WHEN {YEAR} >= 5000 AND {YEAR} <= 2000000 THEN {YEAR} END * CASE WHEN currency = 'USD' THEN 1.37::DOUBLE ELSE 1 END + 0.5) AS BIGINT)"
DUCK = f"SELECT *, {CAD_SQL} AS yearly_cad FROM ({listings_sql('list_value').replace('AS STRING', 'AS VARCHAR')})"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.identity import yearly_cad

    orders, customer, nation, region = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    orders = spread(orders)
    out = spark.sql(listings_sql("array").replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("JOIN nation ON", "JOIN {nation} ON").replace("JOIN region ON", "JOIN {region} ON"),
                    orders=orders, customer=customer, nation=nation, region=region)
    return out.withColumn("yearly_cad", yearly_cad(F.col("salary_min"), F.col("salary_max"), F.col("currency"), F.col("period")))


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# ---- the same text functions in SQL, for comparison


def norm_sql(x: str) -> str:
    t = f"replace(lower(strip_accents(coalesce({x}, ''))), '&', ' and ')"
    t = f"regexp_replace({t}, '\\([^\\n]*?\\)', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def company_sql(x: str) -> str:
    from ..functions.lexicons import COMPANY_SUFFIXES

    return f"trim(regexp_replace(regexp_replace({norm_sql(x)}, '{COMPANY_SUFFIXES}', '', 'g'), '\\s+', ' ', 'g'))"


def title_sql(x: str) -> str:
    from ..functions.lexicons import TITLE_NOISE, TITLE_WORDS

    t = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\b(full|part)[\\s-]time\\b', '\\1time', 'gi'), '\\bon[\\s-]site\\b', 'onsite', 'gi')"
    case = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TITLE_WORDS.items()) + " ELSE w END"
    noise = ", ".join(f"'{w}'" for w in TITLE_NOISE)
    return f"coalesce(array_to_string(list_filter(list_transform(string_split({norm_sql(t)}, ' '), lambda w: {case}), lambda w: w <> '' AND w NOT IN ({noise})), ' '), '')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rlike_sql(x: str, p: str) -> str:
    """Containment of a fixed pattern. The tail of lexicon patterns has a form without lookahead."""
    return f"regexp_matches({x}, {quoted(p.replace('(?![a-z0-9]|' + chr(92) + '+' + chr(92) + '+|#)', '($|[^a-z0-9#+]|' + chr(92) + '+($|[^+]))'))}, 'i')"


def extract_sql(lexicon: list, x: str, most: int = 8) -> str:
    from ..functions.text import entry

    return "list_slice(list_filter(list_value(" + ", ".join(f"CASE WHEN {rlike_sql(x, p)} THEN {quoted(n)} END" for n, p in map(entry, lexicon)) + f"), lambda x: x IS NOT NULL), 1, {most})"


def rules_sql(rules: list, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {rlike_sql(x, r[1])} THEN {quoted(r[0])}" for r in rules) + " END"


def phrase_sql(normalized: str, phrase: str) -> str:
    return f"contains(' ' || {normalized} || ' ', {quoted(' ' + phrase + ' ')})"
