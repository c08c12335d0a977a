"""Classification and extraction by ordered patterns, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import begun, bound, edged, entry, has, has_phrase, ngrams, normalize, pattern, plain, told, variants


def _first(text: Column, rules: list) -> Column:
    return bound(edged(text), lambda e: F.coalesce(*[F.when(told(e, text, r[1]), r[0]) for r in rules]))


def industry(title: Column, hint: Column | None = None) -> Column:
    """The first rule that the title meets, else the first that title and hint meet."""
    both = F.concat_ws(" ", title, hint if hint is not None else F.lit(""))
    return F.coalesce(_first(title, lx.INDUSTRY), _first(both, lx.INDUSTRY), F.lit("other"))


def work_type(text: Column, remote: Column | None = None) -> Column:
    """C02."""
    flag = F.coalesce(remote, F.lit(False)) if remote is not None else F.lit(False)
    return F.when(has(text, lx.HYBRID), "hybrid").when(flag | has(text, lx.REMOTE), "remote").otherwise("onsite")


def employment_type(text: Column) -> Column:
    """C03."""
    return F.coalesce(_first(text, lx.EMPLOYMENT), F.lit("full-time"))


def seniority(title: Column, body: Column) -> Column:
    """By title, else by the first number of years in the body; null if neither says."""
    by_title = bound(F.lower(title), lambda t: bound(edged(t), lambda e: F.coalesce(*[F.when(begun(e, p) & has(t, p, False), s) for s, p in lx.SENIORITY])))
    y = F.nullif(F.regexp_extract(body, pattern(lx.YEARS), 1), F.lit("")).cast("int")
    return F.coalesce(by_title, F.when(y <= 1, "entry").when(y <= 4, "mid").when(y <= 8, "senior").when(y > 8, "lead"))


def extract(lexicon: list, text: Column, most: int = 8) -> Column:
    """Labels of the entries found, in the lexicon's order, at most ``most``."""
    found = bound(edged(text), lambda e: F.filter(F.array(*[F.when(told(e, text, p), label) for label, p in map(entry, lexicon)]), lambda x: x.isNotNull()))
    return F.slice(found, 1, most)


def work_auth(text: Column) -> Column:
    """A negative form takes sponsorship away."""
    found = bound(edged(text), lambda e: F.filter(F.array(*[F.when(told(e, text, p), k) for k, p in lx.WORK_AUTH]), lambda x: x.isNotNull()))
    return bound(found, lambda a: F.when(F.array_contains(a, "no-sponsorship"), F.array_remove(a, "sponsorship")).otherwise(a))


def tags(title: Column, text: Column, keywords: list[str], aliases: dict[str, list[str]]) -> Column:
    """Keywords, in order, of which a variant stands as a whole phrase in the title or the text's first 6,000 characters."""
    hay = normalize(F.concat_ws(" ", title, F.substring(F.coalesce(text, F.lit("")), 1, 6000)))

    def of(h: Column) -> Column:
        hits = [F.when(reduce(lambda a, b: a | b, [has_phrase(h, v) for v in filter(None, map(plain, variants(k, aliases)))]), k) for k in keywords]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(hay), of), F.lit(0))


def tags_by_join(rows: DataFrame, key: str, title: Column, text: Column, keywords: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """C07, J08 for hundreds of keywords: key, tags (in the keywords' order) of the rows that have any. The distinct phrases
    of each text, as long as the variants are, meet the table of variants in one join, where ``tags`` would look for each."""
    listed = [(i, k, p) for i, k in enumerate(keywords) for p in filter(None, map(plain, variants(k, aliases)))]
    table = rows.sparkSession.createDataFrame(listed, "nth int, keyword string, phrase string")  # a configuration file
    hay = normalize(F.concat_ws(" ", title, F.substring(F.coalesce(text, F.lit("")), 1, 6000)))
    longest = max((len(p.split()) for _, _, p in listed), default=1)
    phrases = rows.select(key, F.explode(ngrams(hay, longest, 6000)).alias("phrase"))
    found = phrases.join(F.broadcast(table), "phrase").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("nth", "keyword"))).alias("t"))
    return found.select(key, F.transform("t", lambda x: x["keyword"]).alias("tags"))


def portal(url: Column, fallback: Column | None = None) -> Column:
    """struct<portal, direct> of an apply link."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    kind = F.struct(F.lit("").alias("portal"), F.lit(False).alias("direct"))
    out = None
    for p, name, direct in lx.PORTALS:
        value = F.struct(F.lit(name).alias("portal"), F.lit(direct).alias("direct"))
        out = F.when(has(host, p), value) if out is None else out.when(has(host, p), value)
    if fallback is not None:
        out = out.when(fallback.isNotNull(), F.struct(fallback.alias("portal"), F.lit(False).alias("direct")))
    out = out.when(host.isNotNull(), F.struct(F.concat(F.lit("Company site ("), F.regexp_replace(host, r"^www\.", ""), F.lit(")")).alias("portal"), F.lit(True).alias("direct")))
    return out.otherwise(kind.withField("portal", F.lit("Original posting")))


def publisher(name: Column, url: Column, direct: Column) -> Column:
    """The portal of an apply link that a search names; one that is said to be direct, though its host isn't known as the
    employer's own, is shown as the employer's site."""
    own = F.coalesce(direct, F.lit(False))
    by_link = portal(url, F.nullif(name, F.lit("")))
    site = F.concat(F.lit("Company site"), F.coalesce(F.concat(F.lit(" ("), F.nullif(name, F.lit("")), F.lit(")")), F.lit("")))
    return F.when(own & ~by_link["direct"], site).otherwise(by_link["portal"])


def source_portal(source: Column) -> Column:
    """C09."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in lx.SOURCE_PORTALS.items() for x in p]), source)


def education(text: Column, low: Column | None = None) -> Column:
    """struct<degree, level> of the highest degree named, or null. ``low`` is the text ``edged``, where that is at hand."""
    def of(e: Column) -> Column:
        return F.coalesce(*[F.when(told(e, text, p), F.struct(F.lit(n).alias("degree"), F.lit(k).alias("level"))) for n, p, k in lx.EDUCATION])

    return bound(edged(text), of) if low is None else of(low)


def soft_skills(text: Column) -> Column:
    """C11."""
    return F.filter(F.array(*[F.when(has(text, p), k) for k, p in lx.SOFT_SKILLS.items()]), lambda x: x.isNotNull())


def matches(text: Column, p: str) -> Column:
    """C13."""
    return F.regexp_count(text, F.lit(pattern(p)))


def profile(text: Column, keywords: list[str], aliases: dict[str, list[str]]) -> Column:
    """struct<skills, tools, certs, roles> of a resume."""
    return F.struct(
        extract(lx.SKILLS, text, 50).alias("skills"), extract(lx.TOOLS, text, 60).alias("tools"), extract(lx.CERTIFICATIONS, text, 30).alias("certs"),
        tags(F.lit(""), text, keywords, aliases).alias("roles"),
    )
