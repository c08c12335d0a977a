"""Operator 3: quality rules per document and per host.

Each document is measured by four counts and fails the base rules if it is short or repetitive. Failures are then
aggregated by host; every host's failure rate is shrunk towards the others by an empirical beta prior (method of moments
over hosts), and documents of hosts whose shrunk rate is too high are rejected with the host.

Defined results: a null or blank text has no words, so it fails; a null host is a host of its own; with no host, one
host, or hosts of equal rates the prior is a flat Beta(1, 1); repeated rows are documents of their own; an empty table
gives an empty result. Counting repeated windows compares 64-bit hashes of the windows of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, joined_by_key, stored, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
BROADCAST_ROWS = 500_000


def domain(url: Column) -> Column:
    """Host of a URL column, lower-cased, without ``www.``; anything that isn't a URL stands for itself."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), url)


def repeated_words(w: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(ranked: Column) -> Column:
        same = F.transform(
            F.sequence(F.lit(0), F.size(ranked) - 1),
            lambda k: F.when((F.get(ranked, k - 1)["h"] == F.get(ranked, k)["h"]) | (F.get(ranked, k + 1)["h"] == F.get(ranked, k)["h"]), F.get(ranked, k)["i"]),
        )
        same = F.filter(same, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1, i + 2)))))

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(ranked, covered))

    return F.when(F.size(w) < 4, 0).otherwise(bound(w, lambda v: bound(windows(v), count)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn("_w", words(t))
    counted = with_words.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeated_lines(t).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a host: documents, failures, shrunk rate, host_failed.

    The prior is two numbers, from sums over hosts; a hot host is pre-aggregated before the shuffle.
    """
    hosts = measured.groupBy(host.alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    hosts = stored(hosts, "host-counts")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    # Beta(a, b) with the hosts' mean and variance; its strength is a + b
    strength = mean * (1 - mean) / var - 1 if var and mean * (1 - mean) > var else None
    a, b = (strength * mean, strength * (1 - mean)) if strength else (1.0, 1.0)
    shrunk = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_verdicts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` (host, base_failed) with host_rate and kept. A host that very many documents share is broadcast."""
    verdicts = stored(verdicts.select("host", "n_docs", "host_rate", "host_failed"), "hosts")
    total = verdicts.agg(F.sum("n_docs")).first()[0] or 0
    joined = joined_by_key(measured, verdicts, "host", "n_docs", total, BROADCAST_ROWS)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("n_docs", "host_failed")


def apply_host_rules(docs: DataFrame, host: Column | None = None, text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Adds the measures, host_rate and kept to every row of ``docs``; columns of ``docs`` with these names are replaced.
    Texts are measured twice, for the hosts and for the result, and never shuffled but with their rows."""
    # a row is one struct, so that no name of its columns meets one of those made here
    rows = docs.select(F.struct("*").alias("row"), (F.col("source") if host is None else host).alias("host"), F.col(text).alias("text"))
    measured = measures(rows).drop("text")
    verdicts = host_verdicts(measured, F.col("host"), max_rate)
    added = [*MEASURES, "host_rate", "kept"]
    return with_verdicts(measured, verdicts).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op3_host_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # measured once: a narrow table feeds both the host aggregate and the documents' verdicts
    return measured_once(docs).select("doc_id", *MEASURES, "kept", "host", F.round("host_rate", 6).alias("host_rate"))


def measured_once(docs: DataFrame) -> DataFrame:
    """apply_host_rules for a query that needs no text in its result: texts are scanned once, counts are kept."""
    narrow = stored(measures(docs.withColumnRenamed("source", "host")).drop("text"), "host-rules")
    return with_verdicts(narrow, host_verdicts(narrow, F.col("host")))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source
), p AS (
  SELECT avg(f / n) AS mu, var_samp(f / n) AS v FROM h
), ab AS (
  SELECT CASE WHEN v > 0 AND mu * (1 - mu) > v THEN (mu * (1 - mu) / v - 1) * mu ELSE 1.0 END AS a,
         CASE WHEN v > 0 AND mu * (1 - mu) > v THEN (mu * (1 - mu) / v - 1) * (1 - mu) ELSE 1.0 END AS bb FROM p
), hv AS (
  SELECT source, (f + a) / (n + a + bb) AS host_rate FROM h, ab
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rate > 0.5 AS kept, b.source AS host, round(host_rate, 6) AS host_rate
FROM b JOIN hv ON b.source IS NOT DISTINCT FROM hv.source
"""
