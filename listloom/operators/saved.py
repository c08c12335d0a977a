"""Saved searches as a reverse index: very many searches against all listings, without a plan or a comparison for each pair
(J12, A27, W10).

A clause of a search can only hold where one of its terms does, and a term only where one of its alternatives does: a phrase
where each of its words is, a bare word (which may be part of a word) where its three-letter pieces are, a keyword where its
tag is. So each clause is filed under the keys of one term: of every alternative the rarest key, and of the terms that whose
keys are the rarest in all. Which keys a word has is found once for each distinct word of all listings, so a listing gives a
row for each of its words and tags, not for each piece; those meet the searches filed under them in one join, and only what
meets is verified, on the whole search. Hits are counted by search and time before they meet the times that are asked for,
by prefix sums, so a search that is asked for from very many times costs no more. Equal searches are one. Searches that only exclude hold for all listings but those that an index of what they
exclude finds, so they are counted by subtraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_phrase
from ..storage import stored
from .search import compile_query

ALTERNATIVE = "struct<tag: boolean, phrase: boolean, text: string>"
SEARCH = f"query string, clauses array<array<array<{ALTERNATIVE}>>>, exclude array<string>"
PIECE = 3
#: No listing has a tag without a name.
NEVER = [[[{"tag": True, "phrase": False, "text": ""}]]]
#: Keys, and rows of sums, that are broadcast; more are joined by a shuffle.
FEW = 1_000_000


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _few(df) else df


def compiled(queries: DataFrame, keywords: list[str] = (), aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """query, clauses (of terms, of alternatives), exclude of each distinct query, by ``search.compile_query``."""
    import pandas as pd

    from ..functions.text import plain

    never = NEVER

    def parse(frames):
        for f in frames:
            out = []
            for q in f["query"]:
                m = compile_query(q or "", keywords, aliases)
                clauses = [[[*([{"tag": True, "phrase": False, "text": t.tag}] if t.tag else []), *({"tag": False, "phrase": t.phrase or " " in v, "text": plain(v)} for v in t.variants)] for t in c] for c in m.clauses]
                # of words without letters, a bare one is in every listing and a phrase in none
                clauses = [[[a for a in t if a["text"]] for t in c if all(a["text"] or a["phrase"] for a in t)] for c in clauses]
                if any(not c for c in clauses):
                    clauses = []
                elif clauses:
                    clauses = [c for c in clauses if all(c)] or never
                out.append((q, clauses, list(m.exclude)))
            yield pd.DataFrame(out, columns=["query", "clauses", "exclude"])

    return queries.select("query").distinct().mapInPandas(parse, SEARCH)


def _hit(hay: Column, tags: Column, a: Column) -> Column:
    return F.when(a["tag"], F.coalesce(F.array_contains(tags, a["text"]), F.lit(False))).when(a["phrase"], has_phrase(hay, a["text"])).otherwise(hay.contains(a["text"]))


def holds(hay: Column, tags: Column, clauses: Column, exclude: Column) -> Column:
    """Q07 with the search as columns."""
    some = F.exists(clauses, lambda c: F.forall(c, lambda t: F.exists(t, lambda a: _hit(hay, tags, a))))
    return ((F.size(clauses) == 0) | some) & ~F.exists(exclude, lambda e: has_phrase(hay, e))


def _pieces(word: Column) -> Column:
    """The three-letter pieces of a word, or the word if it is no longer."""
    return F.when(F.length(word) <= PIECE, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.length(word) - PIECE + 1), lambda i: F.substring(word, i, F.lit(PIECE))))


def _short(word: Column) -> Column:
    """All parts of a word of fewer letters than a piece."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    two = F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array())
    return F.concat(one, two)


def alternative_keys(a: Column) -> Column:
    """What a listing has if an alternative holds there: all of these keys. Of a text without letters, none."""
    words = F.filter(F.split(a["text"], " "), lambda w: w != "")
    spelt = F.transform(words, lambda w: F.concat(F.lit("w"), w))
    return F.when(a["tag"], F.array(F.concat(F.lit("t"), a["text"]))).when(a["phrase"], spelt).otherwise(F.transform(_pieces(a["text"]), lambda p: F.concat(F.lit("p"), p)))


def listing_tokens(hay: Column, tags: Column) -> Column:
    """The distinct words (after a w) and tags (after a t) of a listing."""
    words = F.array_distinct(F.split(F.concat(F.lit("w"), F.replace(hay, F.lit(" "), F.lit(" w"))), " "))
    return F.concat(words, F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("t"), t))))


def token_keys(token: Column) -> Column:
    """All keys that a listing has by a token: itself and, of a word, its pieces and shorter parts."""
    word = F.substring(token, F.lit(2), F.length(token))
    parts = F.transform(F.array_distinct(F.concat(_pieces(word), _short(word))), lambda p: F.concat(F.lit("p"), p))
    return F.when(token.startswith("w") & (word != ""), F.concat(F.array(token), parts)).otherwise(F.array(token))


def filed(searches: DataFrame, met: DataFrame) -> DataFrame:
    """query, key: what each search is filed under. ``searches``: query, part (any number), of: array of terms, each an array of
    alternatives, for each part that must hold; ``met``: key, n (listings that have it)."""
    terms = searches.select("query", "part", F.posexplode("of").alias("term", "alternatives"))
    each = terms.select("query", "part", "term", F.posexplode("alternatives").alias("way", "a")).select("query", "part", "term", "way", F.explode_outer(alternative_keys(F.col("a"))).alias("key"))
    counts = met.withColumnRenamed("key", "_key")
    each = each.join(small(counts), F.col("key") == F.col("_key"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # an alternative without a key is held by every listing, or by none: its term is no good for filing
    rare = each.groupBy("query", "part", "term", "way").agg(F.min(F.struct("n", "key")).alias("k"))
    by_term = rare.groupBy("query", "part", "term").agg(F.sum("k.n").alias("n"), F.bool_or(F.col("k.key").isNull()).alias("none"), F.collect_set("k.key").alias("keys"))  # a key an alternative
    best = by_term.filter(~F.col("none")).groupBy("query", "part").agg(F.min(F.struct("n", "term", "keys")).alias("x"))
    return best.select("query", F.explode("x.keys").alias("key")).distinct()


def _wanted(searches: DataFrame) -> DataFrame:
    """query, part, of: the clauses, and, of searches that only exclude, what they exclude."""
    clauses = searches.filter(F.size("clauses") > 0).select("query", F.posexplode("clauses").alias("part", "of"))
    phrase = lambda e: F.struct(F.lit(False).alias("tag"), F.lit(True).alias("phrase"), e.alias("text"))
    only = searches.filter(F.size("clauses") == 0).select("query", F.posexplode("exclude").alias("part", "e")).select("query", "part", F.array(F.array(phrase(F.col("e")))).alias("of"))
    return clauses.unionByName(only.withColumn("of", F.col("of").cast(f"array<array<{ALTERNATIVE}>>")))


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    return stored(df.withColumn(name, F.monotonically_increasing_id()), label)


def hits(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """no, row, id, posted_at, kept: the listings (``numbered`` by row: id, posted_at, hay, tags) that a search (``compiled``,
    ``numbered`` by no) is filed near and that it holds for (kept); of a search that only excludes, those that it leaves out
    (not kept)."""
    wanted = stored(_wanted(searches.withColumn("query", F.col("no"))), "wanted")
    tokens = lambda *columns: listings.select(*columns, F.explode(listing_tokens(F.col("hay"), F.col("tags"))).alias("token"))
    counts = stored(tokens().groupBy("token").agg(F.count("*").alias("n")), "tokens")
    asked = wanted.select(F.explode(F.flatten(F.transform("of", lambda t: F.flatten(F.transform(t, alternative_keys))))).alias("key")).distinct()
    # only keys that a search asks for; a listing with several tokens of a key counts several times, which only makes it look less rare
    held = stored(counts.select("token", "n", F.explode(token_keys(F.col("token"))).alias("key")).join(small(stored(asked, "asked-keys")), "key"), "token-keys")
    index = stored(filed(wanted, held.groupBy("key").agg(F.sum("n").alias("n"))).withColumnRenamed("query", "no"), "saved-index")
    index = stored(held.join(small(index), "key").select("token", "no").distinct(), "token-index")
    if _few(index):
        near = tokens("*").join(F.broadcast(index), "token")
    else:  # texts aren't shuffled with each of their words
        near = tokens("row").join(index, "token").select("row", "no").distinct().join(listings, "row")
    whole = near.join(small(searches.drop("query")), "no")
    good = holds(F.col("hay"), F.col("tags"), F.col("clauses"), F.col("exclude"))
    whole = whole.select("no", "row", "id", "posted_at", good.alias("kept"), (F.size("clauses") == 0).alias("only")).filter(F.col("kept") != F.col("only"))
    return whole.select("no", "row", "id", "posted_at", "kept").dropDuplicates(["no", "row"])


def later_than(times: DataFrame, since: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, since, n: how many of ``times`` (by, posted_at, n: so many rows) are later than each ``since`` (by, since). Prefix sums
    over ranges: a row a range meets in one task, never all rows."""
    marks = times.select(*by, F.col("posted_at").alias("t"), "n").unionByName(since.select(*by, F.col("since").alias("t"), F.lit(0).cast("long").alias("n")).distinct())
    marks = stored(marks.groupBy(*by, "t").agg(F.sum("n").alias("n")).repartitionByRange(*by, "t").withColumn("r", F.spark_partition_id()), "marks")
    sums = marks.groupBy(*by, "r").agg(F.sum("n").alias("_n"))
    after = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "r", F.coalesce(after, F.lit(0)).alias("after"))
    inside = F.sum("n").over(Window.partitionBy(*by, "r").orderBy(F.desc("t"))) - F.col("n")
    done = marks.withColumn("inside", inside).join(small(stored(sums, "range-sums")), [*by, "r"])
    return done.select(*by, F.col("t").alias("since"), (F.col("after") + F.col("inside")).alias("n"))


def new_counts(listings: DataFrame, sets: DataFrame, keywords: list[str] = (), aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Set, new of every row of ``sets`` (set, query, since): listings posted after ``since`` that the search
    holds for."""
    sets = sets.withColumn("query", F.coalesce("query", F.lit("")))
    searches = numbered(compiled(sets, keywords, aliases), "no", "searches")
    listings = numbered(listings.select("id", "posted_at", "hay", "tags"), "row", "listings")
    asked = stored(sets.select("query", "since").filter("since is not null").distinct().join(small(searches.select("query", "no")), "query"), "asked")
    found = hits(listings, searches).groupBy("no", "posted_at").agg(F.count("*").alias("n"))
    near = later_than(stored(found, "hits"), asked.select("no", "since"), ("no",)).withColumnRenamed("n", "near")
    near = asked.join(near, ["no", "since"]).select("query", "since", "near")
    # an empty search, or one that only excludes, holds for all others
    broad = asked.join(small(searches.filter(F.size("clauses") == 0).select("no")), "no", "left_semi")
    every = later_than(listings.groupBy("posted_at").agg(F.count("*").alias("n")), broad).join(broad, "since").select(F.col("query").alias("_q"), F.col("since").alias("_s"), F.col("n").alias("every"))
    out = sets.join(near, ["query", "since"], "left").join(every, (F.col("query") == F.col("_q")) & (F.col("since") == F.col("_s")), "left")
    seen = F.coalesce("near", F.lit(0))
    return out.select("set", F.when(F.col("every").isNotNull(), F.col("every") - seen).otherwise(seen).alias("new"))
