"""Matching resumes with postings (R01-R13). Stop words are a parameter, as lists of that length are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..functions import lexicons as lx
from ..functions.text import beginnings, begun, bound, edged, entry, has, has_phrase, normalize, normalize_title, pattern, plain, variants
from ..storage import small, stored

_EMPTY = "array<string>"
#: A posting of fewer characters says too little for a score to mean much.
SHORT_POSTING = 600


def match_score(wanted: Column, have: Column, tags: Column, roles: Column) -> Column:
    """struct<score, matched, missing>; wanted may repeat."""
    none = F.array().cast(_EMPTY)
    wanted, have = F.coalesce(wanted, none), F.coalesce(have, none)
    matched = F.filter(wanted, lambda w: F.array_contains(have, w))
    missing = F.filter(wanted, lambda w: ~F.array_contains(have, w))
    role = F.when(F.coalesce(F.arrays_overlap(tags, roles), F.lit(False)), 0.2).otherwise(0.0)
    base = F.when(F.size(wanted) > 0, F.size(matched) / F.size(wanted)).otherwise(0.5)
    score = F.least(F.lit(1.0), base * 0.8 + role + F.when(F.size(wanted) > 0, 0.0).otherwise(role))
    return F.struct(F.floor(score * 100 + 0.5).cast("int").alias("score"), matched.alias("matched"), missing.alias("missing"))


def _hit(posting: Column, label: str, p: str, lists: Column | None, fields, low: Column) -> Column:
    """``fields`` of the entry's count in the posting (1 at least) if the posting or ``lists`` name it, else null. ``low`` is
    the posting ``edged``: patterns are only matched where their literal beginnings are found in it."""

    listed = F.coalesce(F.array_contains(lists, label), F.lit(False)) if lists is not None else F.lit(False)

    def of(n: Column) -> Column:
        return F.when((n > 0) | listed, F.struct(*fields(F.greatest(n, F.lit(1)))))

    # most entries end with the first test
    return F.when(begun(low, p) | listed, bound(F.when(begun(low, p), classify.matches(posting, p)), of))


def _ranked(label: str, nth: int, there: Column):
    return lambda n: [there.alias("in_resume"), (-n).alias("less"), F.lit(nth).alias("nth"), F.lit(label).alias("term")]


def _told(label: str, there: Column):
    return lambda n: [F.lit(label).alias("term"), n.alias("jd_count"), there.alias("in_resume")]


def hard_skills(posting: Column, resume: Column, lists: Column | None = None, roles: Column | None = None, norm: Column | None = None, aliases: dict[str, list[str]] | None = None, low: Column | None = None) -> Column:
    """array<struct<term, jd_count, in_resume>>, missing ones first, then by count: lexicon entries named in the
    posting or in the job's own ``lists``, then target ``roles`` (C07) that aren't among them, looked for with their variants in
    ``norm``, the normalised resume."""
    named = [(label, p) for label, p in map(entry, [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS]) if label not in lx.SOFT_SKILLS]

    def of(e: Column) -> Column:
        return F.filter(F.array(*[_hit(posting, label, p, lists, _ranked(label, i, has(resume, p)), e) for i, (label, p) in enumerate(named)]), lambda x: x.isNotNull())

    found = bound(edged(posting), of) if low is None else of(low)
    if roles is not None:
        found = bound(found, lambda there: F.concat(there, F.transform(
            F.filter(roles, lambda r: ~F.array_contains(F.transform(there, lambda x: x["term"]), r)),
            lambda r, i: F.struct(known_in_resume(norm, r, aliases).alias("in_resume"), F.lit(-1).alias("less"), (i + len(named)).alias("nth"), r.alias("term")),
        )))
    return F.transform(F.array_sort(found), lambda x: F.struct(x["term"].alias("term"), (-x["less"]).alias("jd_count"), x["in_resume"].alias("in_resume")))


def soft_skills(posting: Column, resume: Column, lists: Column | None = None, low: Column | None = None) -> Column:
    """R03, in the lexicon's order."""
    def of(e: Column) -> Column:
        hits = [_hit(posting, label, p, lists, _told(label, has(resume, lx.SOFT_SKILLS[label]) | has(resume, p)), e) for label, p in map(entry, lx.SKILLS) if label in lx.SOFT_SKILLS]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    return bound(edged(posting), of) if low is None else of(low)


def in_resume(resume: Column, term: Column) -> Column:
    """As it is, without its last s, or with one more."""
    return has_phrase(resume, term) | (term.endswith("s") & has_phrase(resume, F.regexp_replace(term, "s$", ""))) | has_phrase(resume, F.concat(term, F.lit("s")))


def other_names(aliases: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """Each known term, normalised, with all its variants."""
    every = {x for canon, more in (aliases or {}).items() for x in (canon, *more)}
    return {plain(x): list(filter(None, map(plain, variants(x, aliases)))) for x in sorted(every)}


def variants_of(term: Column, aliases: dict[str, list[str]] | None) -> Column:
    """T07 of a normalised term column: the term and its variants; aliases are a short configuration."""
    known = other_names(aliases)
    if not known:
        return F.array(term)
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, term), F.array(term))


def known_in_resume(resume: Column, term: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """The term or one of its variants."""
    return F.exists(variants_of(term, aliases), lambda v: in_resume(resume, v))


def _counted(text: Column, stop: list[str]) -> Column:
    """R05 of one text: array<struct<term, count, first_pos>>, by runs of equal terms in their order."""
    # normalised words have letters and digits only, and letters sort last
    ok = lambda w: (F.length(w) >= 3) & ~w.isin(stop or [""]) & ((w >= "a") | F.regexp_like(w, F.lit("[a-z]")))

    def of(words: Column, part: Column) -> Column:
        pos = lambda i, k: (part.cast("long") * (1 << 32) + 2 * i.cast("long") + k).alias("pos")

        def said(w: Column, i: Column) -> Column:
            after = F.get(words, i + 1)
            pair = F.when(after.isNotNull() & ok(after), F.struct(F.concat_ws(" ", w, after).alias("term"), pos(i, 1)))
            return F.when(ok(w), F.array(F.struct(w.alias("term"), pos(i, 0)), pair)).otherwise(F.array(F.lit(None).cast("struct<term:string,pos:bigint>")))

        return F.flatten(F.transform(words, said))

    every = F.flatten(F.transform(F.split(text, lx.TERM_BREAKS), lambda t, i: bound(F.split(normalize(t), " "), lambda w: of(w, i))))

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)), lambda i: i.isNotNull())
        return bound(first, lambda f: F.transform(f, lambda i, k: F.struct(
            F.get(s, i)["term"].alias("term"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).cast("long").alias("count"), F.get(s, i)["pos"].alias("first_pos"))))

    return bound(F.sort_array(F.filter(every, lambda x: x.isNotNull())), runs)


def term_counts(postings: DataFrame, key: str, text: str, stop: list[str]) -> DataFrame:
    """Key, term, count, first_pos of words and word pairs; pairs don't cross punctuation. A posting's terms are
    counted where its text is; only those of postings that share a key are shuffled."""
    counted = lambda rows: rows.select(key, F.explode(_counted(F.col(text), stop)).alias("x")).select(key, "x.*")
    again = postings.groupBy(F.col(key).alias("_again")).count().filter("count > 1").select("_again")
    if again.isEmpty():
        return counted(postings)
    again, same = small(again, 100_000), F.col(key).eqNullSafe(F.col("_again"))
    more = counted(postings.join(again, same, "left_semi")).groupBy(key, "term").agg(F.sum("count").alias("count"), F.min("first_pos").alias("first_pos"))
    return counted(postings.join(again, same, "left_anti")).unionByName(more)


def keywords(postings: DataFrame, key: str, text: str, stop: list[str], exclude: list[str] = (), limit: int = 15, rules: DataFrame | None = None) -> DataFrame:
    """Key, term, count, nth: the commonest terms; a term that holds, or is held by, an excluded or a chosen one is
    skipped. ``rules`` (key, exclude: array<string>, most: int) says for each posting what else to exclude and how many to
    choose. A posting's terms stream in their order through a task that keeps the chosen ones only, so no list of a posting's
    terms is made, however many there are."""
    import pandas as pd

    kept = term_counts(postings, key, text, stop).filter("count >= 2")
    never = F.array(*map(F.lit, exclude)).cast(_EMPTY)
    if rules is None:
        kept = kept.withColumns({"exclude": never, "most": F.lit(limit)})
    else:
        kept = kept.join(rules.select(key, F.concat("exclude", never).alias("exclude"), "most"), key)
    kept = kept.filter(~F.exists("exclude", lambda e: e.contains(F.col("term")) | F.col("term").contains(e)))
    weight = F.col("count") * F.when(F.col("term").contains(" "), 1.6).otherwise(1.0)
    ranked = kept.select(key, (-weight).alias("less"), "first_pos", "term", "count", "most").repartition(key).sortWithinPartitions(key, "less", "first_pos")
    kind = dict(postings.dtypes)[key]

    def choose(frames):
        now, chosen = None, []
        for f in frames:
            out = []
            for k, term, n, most in zip(f[key], f["term"], f["count"], f["most"], strict=True):
                if k != now:
                    now, chosen = k, []
                if len(chosen) < most and not any(term in c or c in term for c in chosen):
                    out.append((k, term, n, len(chosen)))
                    chosen.append(term)
            yield pd.DataFrame(out, columns=[key, "term", "count", "nth"])

    return ranked.mapInPandas(choose, f"{key} {kind}, term string, count long, nth int")


def title_match(title: Column, resume: Column, stop: list[str] = (), aliases: dict[str, list[str]] | None = None) -> Column:
    """struct<ok, partial>: the title's words, without those of level, as a phrase or a variant of it; else most of them."""
    words = F.filter(F.split(normalize_title(title), " "), lambda w: (F.length(w) > 1) & ~w.isin([*lx.TITLE_LEVELS, *stop]))

    def of(words: Column, phrase: Column) -> Column:
        ok = has_phrase(resume, phrase)
        if aliases:
            ok = ok | ((phrase != "") & F.exists(variants_of(phrase, aliases), lambda v: has_phrase(resume, v)))
        share = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: has_phrase(resume, w))), F.size(words)), F.lit(0.0))
        return bound(ok, lambda ok: F.struct(ok.alias("ok"), (~ok & (share >= 0.6)).alias("partial")))

    # each once, however often they are used
    return bound(words, lambda w: bound(F.array_join(w, " "), lambda p: of(w, p)))


def word_count(resume: Column) -> Column:
    return F.size(F.filter(F.split(resume, r"\s+"), lambda w: w != ""))


def format_checks(resume: Column, n_words: Column | None = None) -> dict[str, Column]:
    """R09."""
    lines = F.transform(F.split(resume, r"\r?\n"), lambda x: F.trim(x))
    heading = lambda p: F.exists(lines, lambda x: (F.length(x) < 40) & has(x, p))
    return {
        "email": F.regexp_like(resume, F.lit(lx.RESUME_EMAIL)),
        "phone": F.regexp_like(resume, F.lit(lx.RESUME_PHONE)),
        **{k: heading(p) for k, p in lx.RESUME_HEADINGS.items()},
        "length": (word_count(resume) if n_words is None else n_words).between(300, 1200),
        "bullets": F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(lx.RESUME_BULLET)))) >= 3,
        "numbers": F.regexp_count(resume, F.lit(pattern(lx.RESUME_NUMBER))) >= 3,
    }


def format_tips(resume: Column) -> Column:
    """What to do about each check that fails."""
    return _format_tips(format_checks(resume), word_count(resume))


def _format_tips(checks: dict[str, Column], n: Column) -> Column:
    said = {
        "email": F.lit("Give an email address at the top."), "phone": F.lit("Give a phone number as plain text."), "experience": F.lit("Add a heading such as Experience."),
        "education": F.lit("Add a heading such as Education."), "skills": F.lit("Add a heading such as Skills, with the tools of the posting that you know."),
        "length": F.concat(n.cast("string"), F.when(n < 300, " words: say more of roles and projects.").otherwise(" words: keep to what matters here.")),
        "bullets": F.lit("Describe each role in short bullet points."), "numbers": F.lit("Give results in numbers."),
    }
    return F.filter(F.array(*[F.when(~checks[k], v) for k, v in said.items()]), lambda x: x.isNotNull())


def experience(required: Column, have: Column) -> Column:
    """Null if nothing is asked."""
    return F.when(required.isNotNull(), F.coalesce(have >= required, F.lit(False)))


def education(posting: Column, resume: Column) -> Column:
    """R08."""
    asked, got = classify.education(posting)["level"], classify.education(resume)["level"]
    return F.when(asked.isNotNull(), F.coalesce(got >= asked, F.lit(False)))


def _points(share: Column, most: int) -> Column:
    return F.floor(share * most * 10 + 0.5) / 10


def _share(terms: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda x: x["in_resume"])), F.size(terms)), F.lit(1.0))


_TERM = "array<struct<term:string,jd_count:int,in_resume:boolean>>"


def report(pairs: DataFrame, this_year: int, stop: list[str], roles: list[str] = (), aliases: dict[str, list[str]] | None = None, key: str = "pair_id") -> DataFrame:
    """R02-R12, the whole report of each pair (key, title, posting, skills, tools, certifications, resume): hard (terms in
    order, with their counts), words (soft skills, then the posting's own terms), title_match, required and have (years),
    asked_degree and degree, checks, points of each part, score, keyword_match, tips, and short_posting.

    Texts are read once for all that patterns say, which is written down, and once for the posting's terms, whose exclusions
    (hard and soft terms, the title) differ by pair."""
    own = F.concat(*[F.coalesce(F.col(c), F.array().cast(_EMPTY)) for c in ("skills", "tools", "certifications")])
    posting = F.coalesce("posting", F.lit(""))
    texts = pairs.select(key, F.coalesce("title", F.lit("")).alias("title"), posting.alias("posting"), F.concat_ws("\n", F.coalesce("title", F.lit("")), posting).alias("jd"), F.coalesce("resume", F.lit("")).alias("resume"), own.alias("own"))
    jd, cv = F.col("jd"), F.col("resume")
    said = classify.tags(F.col("title"), F.col("posting"), list(roles), aliases or {}) if roles else None
    # used in several places, so it is computed once, before them
    facts = _facts(texts).select(
        key, "title", hard_skills(jd, cv, F.col("own"), said, F.col("_norm"), aliases, F.col("_low")).cast(_TERM).alias("hard"), soft_skills(jd, cv, F.col("own"), F.col("_low")).cast(_TERM).alias("soft"),
        title_match(F.col("title"), F.col("_norm"), stop, aliases).alias("title_match"), parse.required_years(jd).alias("required"), parse.resume_years(cv, F.lit(this_year)).alias("have"),
        *_degrees(), _checks().alias("checks"), "_n", (F.length("posting") < SHORT_POSTING).alias("short_posting"), "_norm",
    )
    facts = stored(facts, "resume-facts")
    named = F.transform(F.concat("hard", "soft"), lambda x: x["term"])
    rules = facts.select(key, F.transform(F.concat(named, F.array("title", *map(F.lit, lx.SAID_ANYWAY))), normalize).alias("exclude"), (lx.KEYWORDS - F.size("soft")).alias("most"))
    terms = keywords(texts, key, "jd", stop, rules=rules)
    listed = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "term", "count"))).alias("terms"))  # at most KEYWORDS
    found = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["count"].cast("int").alias("jd_count"), known_in_resume(F.col("_norm"), x["term"], aliases).alias("in_resume")))
    out = facts.join(listed.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    out = out.withColumn("words", F.concat("soft", F.coalesce(found.cast(_TERM), F.array().cast(_TERM)))).drop("soft", "terms", "_norm")
    return _scored(out)


def _facts(texts: DataFrame) -> DataFrame:
    """``texts`` (jd, resume) with what several facts are read from, computed once."""
    jd, cv = F.col("jd"), F.col("resume")
    degrees = [p for _, p, _ in lx.EDUCATION]
    named = [p for _, p in map(entry, [*lx.SKILLS, *lx.TOOLS, *lx.CERTIFICATIONS])]
    texts = texts.withColumns({"_norm": normalize(cv), "_low": beginnings(edged(jd), [*named, *degrees]), "_low_cv": beginnings(edged(cv), degrees), "_n": word_count(cv)})
    return texts.withColumns({"_degree": classify.education(jd, F.col("_low")), "_has": classify.education(cv, F.col("_low_cv"))})


def _degrees() -> list[Column]:
    return [F.col("_degree.degree").alias("asked_degree"), F.col("_degree.level").alias("_asked"), F.col("_has.degree").alias("degree"), F.col("_has.level").alias("_got")]


def _checks() -> Column:
    return F.struct(*[c.alias(k) for k, c in format_checks(F.col("resume"), F.col("_n")).items()])


def analyze(pairs: DataFrame, this_year: int, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The report of pairs (pair_id, title, posting, resume, terms) whose terms are given. Pairs of equal texts are read once:
    their report is made for one of them, known by its digest, and met by all."""
    read = ["title", "posting", "resume", "terms"]
    known = pairs.withColumn("_same", F.sha2(F.to_json(F.struct(*read)), 256))
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = known.select("_same", *read).distinct().repartition(tasks, "_same")  # few rows, long work
    jd, cv = F.col("jd"), F.col("resume")
    out = _facts(each.withColumn("jd", F.concat_ws("\n", "title", "posting"))).select(
        "_same", "title", hard_skills(jd, cv, low=F.col("_low")).cast(_TERM).alias("hard"), F.concat(soft_skills(jd, cv, low=F.col("_low")).cast(_TERM), F.col("terms").cast(_TERM)).alias("words"),
        title_match(F.col("title"), F.col("_norm"), aliases=aliases).alias("title_match"), parse.required_years(jd).alias("required"), parse.resume_years(cv, F.lit(this_year)).alias("have"),
        *_degrees(), _checks().alias("checks"), "_n",
    )
    told = stored(_scored(out).drop("title"), "resume-reports")
    return known.join(small(told, 20_000), "_same").drop("_same")


def _scored(out: DataFrame) -> DataFrame:
    """R10-R12 from the facts of each pair."""
    exp, edu = experience(F.col("required"), F.col("have")), F.when(F.col("_asked").isNotNull(), F.coalesce(F.col("_got") >= F.col("_asked"), F.lit(False)))
    names = out.schema["checks"].dataType.names
    passed = sum((F.when(F.col("checks")[k], 1).otherwise(0) for k in names), F.lit(0)) / len(names)
    hard = F.when(F.size("hard") > 0, _share(F.col("hard"))).otherwise(_share(F.col("words")))
    years = F.when(exp.isNull() | exp, 1.0).when(F.col("have").isNotNull(), F.least(F.lit(0.8), F.col("have") / F.col("required"))).otherwise(0.2)
    parts = {
        "hard_points": _points(hard, 40), "keyword_points": _points(_share(F.col("words")), 15), "title_points": _points(F.when(F.col("title_match.ok"), 1.0).when(F.col("title_match.partial"), 0.6).otherwise(0.0), 10),
        "experience_points": _points(years, 10), "education_points": _points(F.when(edu.isNull() | edu, 1.0).otherwise(0.3), 5), "format_points": _points(passed, 20),
    }
    out = out.withColumns(parts).withColumn("score", F.floor(sum((F.col(p) for p in parts), F.lit(0.0)) + 0.5).cast("int"))
    every = F.concat("hard", "words")
    matched = F.when(F.size(every) > 0, F.floor(F.size(F.filter(every, lambda x: x["in_resume"])) / F.size(every) * 100 + 0.5)).otherwise(0)
    out = out.withColumns({"keyword_match": matched.cast("int"), "experience_ok": exp, "education_ok": edu})
    advice = _format_tips({k: F.col("checks")[k] for k in names}, F.col("_n"))
    return out.withColumn("tips", F.concat(tips(exp, edu), advice)).drop("_n", "_asked", "_got")


def tips(exp: Column, edu: Column) -> Column:
    """R12."""
    missing = lambda c, n: F.slice(F.transform(F.filter(c, lambda x: ~x["in_resume"]), lambda x: x["term"]), 1, n)
    hard, words = missing("hard", 8), missing("words", 6)
    shown = F.coalesce(F.concat(F.lit("; yours show "), F.col("have").cast("string")), F.lit("; give dates for every role"))
    said = F.array(
        F.when(F.size(hard) > 0, F.concat(F.lit("Missing skills and tools: "), F.array_join(hard, ", "))),
        F.when(F.size(words) > 0, F.concat(F.lit("Missing keywords: "), F.array_join(words, ", "))),
        F.when(~F.col("title_match.ok"), F.concat(F.lit("Name the title: "), F.col("title"))),
        F.when(~exp, F.concat(F.lit("Years asked for: "), F.col("required").cast("string"), shown)),
        F.when(~edu, F.concat(F.lit("Name the highest degree; asked for: "), F.col("asked_degree"))),
    )
    return F.filter(said, lambda x: x.isNotNull())


def tone(score: Column) -> Column:
    """R13."""
    return F.when(score >= 75, "good").when(score >= 50, "warn").otherwise("bad")


def best_matches(listings: DataFrame, score: Column, canada_only: bool = True, most: int = 40) -> DataFrame:
    """Listings that fit at all, best first; a top-k."""
    rows = listings.filter(F.col("country") == "CA") if canada_only else listings
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc("posted_at"), "pos").limit(most)
