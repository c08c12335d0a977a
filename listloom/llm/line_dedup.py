"""Operator 7: line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped if an earlier line of the corpus (by document id, then place) lies within one edit of it: equal, or one
character inserted, deleted or replaced. Every line that isn't blank takes part, whatever its length. Where one edit of a
short line makes another word or number of it, ``near_chars`` can be set: lines of fewer characters are then dropped only
if an earlier one equals them.

Equal lines meet first, by two hashes of 64 bits, and leave one representative, so a line that a third of all documents share is one row
from then on. Lines that can have a neighbour are then found without loss: one edit leaves either the first or the second
half of a line as it was, so a line without a companion of a fitting length in one half has none. The others emit the
hashes of their deletion variants. Two kinds of keys link lines: a variant with its place (the lines that share it differ
in that one character, all of them from one another), and a variant equal to a whole line (an insertion). Only the
earliest line of a key is looked for, so no pairs are emitted within a group; the edit distance of each line to its
earliest neighbour is then verified on the texts. Variants are hashed block by block (``BLOCK`` characters), so a line of L
characters costs about L * BLOCK, not L * L, steps.

Defined results: null and empty texts stay as they are; lines keep their order and separators; rows that share an id (or
have none) and their text are one document, those with other texts are documents of their own, by a hash of the text; a
null id comes last; an empty table gives an empty result. Lines are equal if both their hashes (128 bits) and their lengths
are; lines within an edit are compared as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, joined_by_key, small, stored, table

BLOCK = 64
BROADCAST_ROWS = 1_000_000
_LAST = 2**63 - 1


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, row, pos, line of the lines that aren't blank."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return rows.filter(F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]")))


def _hashes(line: Column, n: Column) -> Column:
    return F.struct(F.xxhash64(line, n).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves a line shares with any line within one edit: for the shorter length m of such a pair."""

    def of(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [
            F.struct(m.alias("m"), F.xxhash64(F.lit("p"), m, F.substring(line, F.lit(1), half)).alias("key")),
            F.struct(m.alias("m"), F.xxhash64(F.lit("s"), m, F.right(line, m - half)).alias("key")),
        ]

    return F.array(*of(n), *of(n - 1))


def _variant_keys(line: Column) -> Column:
    """(role, key) of a line: 2 its whole self by block, 1 its deletion variants, 0 the same with their place."""

    def with_blocks(t: Column) -> Column:
        n = F.length(t)
        count = F.ceil(n / BLOCK).cast("int")
        places = F.sequence(F.lit(0), count - 1)
        # each block and one character more; after a deletion all later blocks begin one character later
        longer = F.transform(places, lambda g: F.substring(t, g * BLOCK + 1, F.lit(BLOCK + 1)))
        return bound(longer, lambda b: bound(F.struct(
            b.alias("b"),
            F.transform(b, lambda x: F.xxhash64(F.substring(x, 1, BLOCK))).alias("h0"),
            F.transform(b, lambda x: F.xxhash64(F.substring(x, 2, BLOCK))).alias("h1"),
        ), keys))

    def keys(x: Column) -> Column:
        b, h0, h1 = x["b"], x["h0"], x["h1"]
        last = F.size(b) - 1

        def of(block: Column, g: Column) -> Column:
            before = F.xxhash64(F.slice(h0, F.lit(1), g))
            # a shifted block that has run empty isn't there
            tail = F.filter(F.transform(F.slice(h1, g + 2, F.greatest(last - g, F.lit(0))), lambda h: h), lambda h: h != F.xxhash64(F.lit("")))
            after = F.xxhash64(tail)
            whole_after = F.xxhash64(F.slice(h0, g + 2, F.greatest(last - g, F.lit(0))))
            whole = F.struct(F.lit(2).alias("role"), F.xxhash64(g, before, F.substring(block, 1, BLOCK), whole_after).alias("key"))
            deletable = F.least(F.length(block), F.lit(BLOCK))

            def variants(ends: Column) -> Column:
                return F.flatten(F.transform(
                    F.sequence(F.lit(0), deletable - 1),
                    lambda j: bound(
                        F.xxhash64(g, ends["before"], F.concat(F.substring(block, F.lit(1), j), F.substring(block, j + 2, F.lit(BLOCK + 1))), ends["after"]),
                        lambda key: F.array(F.struct(F.lit(1).alias("role"), key.alias("key")), F.struct(F.lit(0).alias("role"), F.xxhash64(key, j).alias("key"))),
                    ),
                ))

            return F.concat(F.array(whole), bound(F.struct(before.alias("before"), after.alias("after")), variants))

        # a line that fills its blocks is also what the next block leaves when its one character is deleted
        full = F.struct(F.lit(2).alias("role"), F.xxhash64(F.size(b), F.xxhash64(h0), F.lit(""), F.xxhash64(F.slice(h0, 1, 0))).alias("key"))
        return F.concat(F.flatten(F.transform(b, of)), F.when(F.length(F.get(b, last)) == BLOCK, F.array(full)).otherwise(F.slice(F.array(full), 1, 0)))

    return bound(line, with_blocks)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_chars: int = 0) -> DataFrame:
    """doc (the id; a null id is the largest long), row (a hash of the text), pos of every line to drop."""
    line, n = F.col("line"), F.length("line")
    # shorter ones meet equal lines only
    halves = F.when(n >= near_chars, _half_keys(line, n)) if near_chars else _half_keys(line, n)
    all_lines = stored(_lines(docs, doc_id, text).select("doc", "row", "pos", _hashes(line, n).alias("h"), n.alias("n"), halves.alias("halves")), "lines")
    first = F.min(F.struct("doc", "row", "pos")).alias("first")
    distinct = stored(all_lines.groupBy("h", "n").agg(first, F.count("*").alias("copies"), F.first("halves").alias("halves")), "distinct-lines")

    # lines that have a companion of a fitting length in one half
    halves = distinct.select("h", "n", F.explode("halves").alias("k")).select("h", "n", "k.m", "k.key")
    company = halves.groupBy("key").agg(F.count_if(F.col("n") == F.col("m")).alias("n0"), F.count_if(F.col("n") > F.col("m")).alias("n1"))
    company = stored(company.filter((F.col("n0") >= 2) | ((F.col("n0") >= 1) & (F.col("n1") >= 1))).withColumn("sharing", F.col("n0") + F.col("n1")), "company")
    short = F.col("n") == F.col("m")
    # all lines of one template meet under one key
    met = joined_by_key(halves, company, "key", "sharing", 4 * distinct.count(), BROADCAST_ROWS).filter("n0 is not null")
    wanted = met.groupBy("h").agg(
        F.bool_or(short & (F.col("n0") >= 2)).alias("replaced"), F.bool_or(short & (F.col("n1") >= 1)).alias("inserted"), F.bool_or(~short & (F.col("n0") >= 1)).alias("deleted")
    )
    wanted = stored(wanted.filter("replaced or inserted or deleted").join(distinct.select("h", "first"), "h"), "neighbours")
    # one number stands for a text and its place in the order: of a variant nothing else is stored or shuffled
    wanted = stored(wanted.orderBy("first").withColumn("no", F.monotonically_increasing_id()), "numbered")

    # their texts, from the documents, at the place of the representative
    wanted = wanted.select("h", "no", "first.*", "replaced", "inserted", "deleted")
    texts = _lines(docs, doc_id, text).withColumn("h", _hashes(line, n)).join(small(wanted, BROADCAST_ROWS), ["h", "doc", "row", "pos"]).dropDuplicates(["h"])
    texts = stored(texts.select("h", "no", "line", "replaced", "inserted", "deleted"), "neighbour-texts")

    keys = texts.select("no", "replaced", "inserted", "deleted", F.explode(_variant_keys(F.col("line"))).alias("k")).select("*", "k.role", "k.key").drop("k")
    role, no = F.col("role"), F.col("no")
    keys = keys.filter(((role == 0) & F.col("replaced")) | ((role == 1) & F.col("deleted")) | ((role == 2) & F.col("inserted")))
    keys = stored(keys.select("key", "role", "no"), "variants")
    earliest = keys.groupBy("key").agg(*[F.min(F.when(role == r, no)).alias(f"e{r}") for r in (0, 1, 2)], F.max(F.when(role == 0, no)).alias("last"))
    # most keys are of one line and link nothing: only the others meet the variants again
    linking = stored(earliest.filter("e0 < last or (e1 is not null and e2 is not null)").drop("last"), "linking-keys")
    # a variant with its place links its lines to each other; a whole line is linked to the lines it is a variant of
    other = F.when(role == 0, F.col("e0")).when(role == 1, F.col("e2")).otherwise(F.col("e1"))
    linked = keys.join(small(linking, BROADCAST_ROWS), "key").withColumn("other", other).filter(F.col("other") < no)
    linked = linked.groupBy("no").agg(F.min("other").alias("other"))
    a, b = texts.select("no", "h", F.col("line").alias("a")), texts.select(no.alias("other"), F.col("line").alias("b"))
    near = linked.join(a, "no").join(b, "other").filter(F.levenshtein("a", "b", 1) >= 0).select("h", F.lit(True).alias("near"))

    # every line of a dropped text, and every line but the first of an equal text
    groups = distinct.select("h", "first", "copies").join(near, "h", "left").filter((F.col("copies") > 1) | F.col("near"))
    groups = stored(groups.select("h", "first", "copies", F.coalesce("near", F.lit(False)).alias("near")), "repeated")
    hit = joined_by_key(all_lines.select("doc", "row", "pos", "h"), groups, "h", "copies", all_lines.count(), BROADCAST_ROWS)
    return hit.filter(F.col("near") | (F.struct("doc", "row", "pos") != F.col("first"))).select("doc", "row", "pos").distinct()


def without(lines: Column, gone: Column) -> Column:
    """``lines`` joined again without those whose numbers are in ``gone`` (sorted): the runs between them."""

    def runs(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(gone)),
            lambda k: bound(F.coalesce(F.get(gone, k - 1) + 1, F.lit(0)), lambda at: F.slice(x, at + 1, F.coalesce(F.get(gone, k), F.size(x)) - at)),
        )

    return F.array_join(F.flatten(bound(lines, runs)), "\n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_chars: int = 0) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and the numbers (from 0) of the cut lines in ``removed_lines`` (a
    column of that name is replaced)."""
    gone = repeated_lines(docs, doc_id, text, near_chars).groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = stored(gone.withColumnsRenamed({"doc": "_doc", "row": "_row"}), "removed")
    # a row is one struct, so that no name of its columns meets one of those made here
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    both = rows.join(small(gone, BROADCAST_ROWS // 4), (F.col("doc") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.split("text", "\n", -1), F.col("gone")))
    kept = [left.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "removed_lines"]
    return both.select(*kept, F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    return out.select(
        "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), w AS (
  SELECT *, doc_id * 1000000 + pos AS o FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), u AS (
  SELECT line, length(line) AS n, min(o) AS o FROM w GROUP BY line
), m AS (
  SELECT line, o, unnest([n, n - 1]) AS m FROM u
), h AS (
  SELECT line, o, 'p' || m || ':' || left(line, m // 2) AS key FROM m UNION ALL SELECT line, o, 's' || m || ':' || right(line, m - m // 2) FROM m
), near AS (
  SELECT DISTINCT a FROM (
    SELECT a.line AS a, b.line AS b, length(a.line) - length(b.line) AS more FROM h a JOIN h b ON a.key = b.key AND b.o < a.o
    WHERE abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 4  -- counts bytes, of which a character has up to four
  ) WHERE len(list_filter(range(greatest(length(a), length(b))), lambda i: left(a, i) = left(b, i)
      AND substr(a, i + CASE WHEN more < 0 THEN 1 ELSE 2 END) = substr(b, i + CASE WHEN more > 0 THEN 1 ELSE 2 END))) > 0
), r AS (
  SELECT w.doc_id, list_sort(list(pos)) AS gone FROM w JOIN u USING (line) WHERE w.o <> u.o OR line IN (SELECT a FROM near) GROUP BY w.doc_id
)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines,
       md5(coalesce(array_to_string(list_filter(ls, lambda x, i: NOT coalesce(list_contains(gone, i - 1), false)), chr(10)), '')) AS text_md5
FROM d LEFT JOIN r USING (doc_id)
"""
