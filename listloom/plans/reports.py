"""Queries of the whole resume report, with SQL from its definition."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text
from ..operators import resume
from ..storage import spread
from . import views as v
from .catalog import _BULLETS, _HEADED, _LENGTH, _LINES, _NUMBERS, register  # noqa: F401
from .views import tables

STOP = ["the", "les", "und", "and", "for", "with"]
YEAR = 2020


def pairs_sql(array: str) -> str:
    """Each document as a posting under a title, with the next document as the resume: the same SQL for Spark and others."""
    b = lambda k: v._pick(v.BODIES, f"(d.doc_id + {k}) % {len(v.BODIES)}")
    return f"""
SELECT d.doc_id AS pair_id, {v._pick(v.TITLES, f"d.doc_id % {len(v.TITLES)}")} AS title, {b(0)} || chr(10) || coalesce(d.text, '') || chr(10) || {b(3)} AS posting,
  {array}({v._pick(["Python", "SQL", "Sales", "React", "Communication"], "d.doc_id % 5")}) AS skills, {array}({v._pick(["AWS", "Excel", "Jira", "SAP"], "d.doc_id % 4")}) AS tools,
  {array}({v._pick(["PMP", "CPA", "CISSP"], "d.doc_id % 3")}) AS certifications,
  'Experience' || chr(10) || {v._pick(v.TITLES, f"(d.doc_id * 5) % {len(v.TITLES)}")} || chr(10) || {b(1)} || chr(10) || coalesce(e.text, '') || chr(10) || '- 2015 - 2019' || chr(10) || '- 2018 – present' || chr(10) || 'jo@example.com' AS resume
FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1"""


def _count_sql(x: str, p: str) -> str:
    # without lookahead; what a tail takes can't begin the next match, so a word boundary stands for it where it can
    head = p.removesuffix(r"(?![a-z0-9]|\+\+|#)")
    tail = head + (r"($|[^a-z0-9#+]|\+($|[^+]))" if re.search(r"[+#]\)$|\\\+", head) else r"\b")
    return f"len(regexp_extract_all({x}, {v.quoted('(?i)' + tail)}))"


def _hits_sql(labels: list, test) -> str:
    """A list of (in_resume, less, nth, term) of the entries that the posting or the job's lists name."""
    out = []
    for nth, (label, p) in enumerate(labels):
        n = _count_sql("jd", p)
        out.append(f"CASE WHEN {n} > 0 OR list_contains(own, {v.quoted(label)}) THEN struct_pack(i := ({test(label, p)}), less := -greatest({n}, 1), nth := {nth}, term := {v.quoted(label)}) END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


def _found(n: str, t: str) -> str:
    """R04 of one variant in a normalised resume with spaces round it."""
    return f"(contains({n}, ' ' || {t} || ' ') OR (ends_with({t}, 's') AND contains({n}, ' ' || {t}[:-2] || ' ')) OR contains({n}, ' ' || {t} || 's '))"


def _report_sql() -> str:
    pairs = [text.entry(x) for x in [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]]
    hard = [(n, p) for n, p in pairs if n not in lx.SOFT_SKILLS]
    soft = [(n, p) for n, p in map(text.entry, lx.SKILLS) if n in lx.SOFT_SKILLS]
    names = resume.other_names(v.ALIASES)
    variants = "CASE t " + " ".join(f"WHEN {v.quoted(k)} THEN [{', '.join(map(v.quoted, x))}]" for k, x in names.items()) + " ELSE [t] END"
    hay = v.norm_sql("title || ' ' || substr(posting, 1, 6000)")
    roles = "[" + ", ".join(f"CASE WHEN {' OR '.join(v.phrase_sql('h', text.plain(x)) for x in text.variants(k, v.ALIASES))} THEN {v.quoted(k)} END" for k in v.KEYWORDS) + "]"
    breaks = "'[,.;:!?()\\[\\]\\n\\r•|/]+|\\s[-–—]\\s'"
    stop = ", ".join(map(v.quoted, STOP))
    ok = lambda w: f"length({w}) >= 3 AND {w} NOT IN ({stop}) AND NOT regexp_full_match({w}, '\\d+')"
    years = lambda x, p, most: f"list_filter(list_transform(regexp_extract_all({x}, {v.quoted('(?i)' + p)}, 1), lambda s: CAST(s AS INT)), lambda y: y > 0 AND y <= {most})"
    level = lambda x, k: "CASE " + " ".join(f"WHEN {v.rlike_sql(x, p)} THEN {v.quoted(n) if k else m}" for n, p, m in lx.EDUCATION) + " END"
    checks = {"email": f"regexp_matches(text, {v.quoted(lx.RESUME_EMAIL)})", "phone": f"regexp_matches(text, {v.quoted(lx.RESUME_PHONE)})", **{k: _HEADED(p) for k, p in lx.RESUME_HEADINGS.items()}, "length": _LENGTH, "bullets": _BULLETS, "numbers": _NUMBERS}
    n_words = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\r\\f]+'), lambda w: w <> ''))"
    said = {
        "email": "'Give an email address at the top.'", "phone": "'Give a phone number as plain text.'", "experience": "'Add a heading such as Experience.'", "education": "'Add a heading such as Education.'",
        "skills": "'Add a heading such as Skills, with the tools of the posting that you know.'",
        "length": f"{n_words} || CASE WHEN {n_words} < 300 THEN ' words: say more of roles and projects.' ELSE ' words: keep to what matters here.' END",
        "bullets": "'Describe each role in short bullet points.'", "numbers": "'Give results in numbers.'",
    }
    levels = ", ".join(f"'{w}'" for w in [*lx.TITLE_LEVELS, *STOP])
    titled = "CASE tp WHEN '' THEN [''] " + " ".join(f"WHEN {v.quoted(k)} THEN [{', '.join(map(v.quoted, x))}]" for k, x in names.items()) + " ELSE [tp] END"
    points = lambda x, most: f"floor(({x})::DOUBLE * {most} * 10 + 0.5) / 10"
    share = lambda c: f"CASE WHEN len({c}) > 0 THEN len(list_filter({c}, lambda x: x.i)) / len({c}) ELSE 1 END"
    missing = lambda c, k: f"list_transform(list_filter({c}, lambda x: NOT x.i)[1:{k}], lambda x: x.term)"
    told = lambda c: f"array_to_string(list_transform({c}, lambda x: x.term || ':' || (-x.less) || ':' || x.i), '|')"
    return f"""
WITH q AS ({pairs_sql("list_value")}),
b AS (SELECT *, title || chr(10) || posting AS jd, resume AS text, list_concat(list_concat(skills, tools), certifications) AS own, {hay} AS h, ' ' || {v.norm_sql('resume')} || ' ' AS n, {v.title_sql('title')} AS tk FROM q),
f AS (SELECT pair_id, title, n, jd, text, {_hits_sql(hard, lambda _, p: v.rlike_sql('text', p))} AS named, {_hits_sql(soft, lambda k, p: f"{v.rlike_sql('text', lx.SOFT_SKILLS[k])} OR {v.rlike_sql('text', p)}")} AS soft,
 list_filter({roles}, lambda x: x IS NOT NULL) AS roles, list_filter(string_split(tk, ' '), lambda w: length(w) > 1 AND w NOT IN ({levels})) AS w,
 list_min({years('jd', lx.REQUIRED_YEARS, 20)}) AS required, list_max({years('text', lx.CLAIMED_YEARS, 45)}) AS claimed, {level('jd', True)} AS asked_degree, {level('jd', False)} AS ed, {level('text', True)} AS degree, {level('text', False)} AS eh,
 length(posting) < 600 AS short_posting, [{', '.join(f"CASE WHEN NOT ({c}) THEN {said[k]} END" for k, c in checks.items())}] AS ft FROM b),
g AS (SELECT *, list_sort(list_concat(named, list_transform(list_filter(roles, lambda r: NOT list_contains(list_transform(named, lambda x: x.term), r)),
   lambda r, k: struct_pack(i := len(list_filter({variants.replace('CASE t', 'CASE r').replace('ELSE [t]', 'ELSE [r]')}, lambda z: {_found('n', 'z')})) > 0, less := -1, nth := {len(hard)} + k - 1, term := r)))) AS hard,
   array_to_string(w, ' ') AS tp, coalesce(claimed, 5) AS have FROM f),
e AS (SELECT *, list_transform(list_concat(list_concat(list_transform(hard, lambda x: x.term), list_transform(soft, lambda x: x.term)), [title, {', '.join(map(v.quoted, lx.SAID_ANYWAY))}]), lambda z: {v.norm_sql('z')}) AS ex FROM g),
p AS (SELECT pair_id, unnest(regexp_split_to_array(jd, {breaks})) AS t, unnest(range(len(regexp_split_to_array(jd, {breaks})))) AS part FROM b),
ws AS (SELECT pair_id, part, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT pair_id, part, list_filter(string_split({v.norm_sql('t')}, ' '), lambda y: y <> '') AS x FROM p)),
nx AS (SELECT *, lead(w) OVER (PARTITION BY pair_id, part ORDER BY i) AS nx FROM ws),
k AS (SELECT * FROM nx WHERE {ok('w')}),
tt AS (SELECT pair_id, w AS term, part * 4294967296 + 2 * i AS place FROM k UNION ALL SELECT pair_id, w || ' ' || nx, part * 4294967296 + 2 * i + 1 FROM k WHERE {ok('nx')}),
c AS (SELECT tt.pair_id, term, count(*) AS n, min(place) AS place FROM tt GROUP BY tt.pair_id, term HAVING count(*) >= 2),
c2 AS (SELECT c.* FROM c JOIN e USING (pair_id) WHERE len(list_filter(ex, lambda x: contains(x, c.term) OR contains(c.term, x))) = 0),
l AS (SELECT pair_id, list([struct_pack(term := term, n := n)] ORDER BY n * CASE WHEN contains(term, ' ') THEN 1.6::DOUBLE ELSE 1 END DESC, place) AS r FROM c2 GROUP BY pair_id),
z AS (SELECT e.*, list_reduce(coalesce(r, []), lambda out, x: CASE WHEN len(out) >= 15 - len(soft) OR len(list_filter(out, lambda o: contains(o.term, x[1].term) OR contains(x[1].term, o.term))) > 0 THEN out ELSE list_concat(out, x) END, CAST([] AS STRUCT(term VARCHAR, n BIGINT)[])) AS kw FROM e LEFT JOIN l USING (pair_id)),
y AS (SELECT *, list_concat(soft, list_transform(kw, lambda o: struct_pack(i := len(list_filter({variants.replace('CASE t', 'CASE o.term').replace('ELSE [t]', 'ELSE [o.term]')}, lambda z: {_found('n', 'z')})) > 0, less := CAST(-o.n AS INTEGER), nth := 0, term := o.term))) AS words,
  tp <> '' AND len(list_filter({titled}, lambda z: contains(n, ' ' || z || ' '))) > 0 AS tm, coalesce(len(list_filter(w, lambda z: contains(n, ' ' || z || ' '))) / nullif(len(w), 0), 0) >= 0.6 AS share,
  CASE WHEN required IS NOT NULL THEN have >= required END AS xo, CASE WHEN ed IS NOT NULL THEN coalesce(eh >= ed, false) END AS eo, len(list_filter(ft, lambda x: x IS NULL)) AS ok FROM z)
SELECT pair_id, {told('hard')} AS hard, {told('words')} AS words, tm AS title_ok, NOT tm AND share AS title_partial, required, have, asked_degree, degree, short_posting,
 CAST(floor({points(f"CASE WHEN len(hard) > 0 THEN {share('hard')} ELSE {share('words')} END", 40)} + {points(share('words'), 15)} + {points('CASE WHEN tm THEN 1 WHEN share THEN 0.6 ELSE 0 END', 10)}
 + {points('CASE WHEN coalesce(xo, true) THEN 1 ELSE least(0.8::DOUBLE, have / required) END', 10)} + {points('CASE WHEN coalesce(eo, true) THEN 1 ELSE 0.3 END', 5)} + {points('ok / 8', 20)} + 0.5) AS INT) AS score,
 CAST(CASE WHEN len(hard) + len(words) > 0 THEN floor(len(list_filter(list_concat(hard, words), lambda x: x.i)) / (len(hard) + len(words)) * 100 + 0.5) ELSE 0 END AS INT) AS keyword_match,
 array_to_string(list_filter(list_concat([CASE WHEN len({missing('hard', 8)}) > 0 THEN 'Missing skills and tools: ' || array_to_string({missing('hard', 8)}, ', ') END, CASE WHEN len({missing('words', 6)}) > 0 THEN 'Missing keywords: ' || array_to_string({missing('words', 6)}, ', ') END,
  CASE WHEN NOT tm THEN 'Name the title: ' || title END, CASE WHEN NOT xo THEN 'Years asked for: ' || required || '; yours show ' || have END, CASE WHEN NOT eo THEN 'Name the highest degree; asked for: ' || asked_degree END], ft), lambda x: x IS NOT NULL), ' # ') AS tips
FROM y"""


@register("r12_report", _report_sql())
def r12(spark, sf):
    docs = spread(*tables(spark, sf, "documents"))
    rows = spark.sql(pairs_sql("array").replace("FROM documents d LEFT JOIN documents e", "FROM {docs} d LEFT JOIN {docs} e"), docs=docs)
    out = resume.report(rows, YEAR, STOP, v.KEYWORDS, v.ALIASES)
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["term"], x["jd_count"].cast("string"), x["in_resume"].cast("string"))), "|")
    return out.select(
        "pair_id", told("hard").alias("hard"), told("words").alias("words"), F.col("title_match.ok").alias("title_ok"), F.col("title_match.partial").alias("title_partial"), "required", "have", "asked_degree", "degree",
        "short_posting", "score", "keyword_match", F.array_join("tips", " # ").alias("tips"),
    )
