"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A test item is found in a document if at least ``threshold`` per cent of its five-word shingles occur there. Items are
partitioned by size (powers of two of their shingle count) and each item is represented by a bottom-k MinHash sketch, the
k smallest hashes of its shingles, where k depends on the partition: k = size - ceil(threshold * size) + 1 of the
partition's largest size. A document that lacks all k of them lacks too many shingles to reach the threshold, so the
search loses nothing, however long the document (signatures of whole documents would: a short item inside a long document
has a Jaccard similarity near 0). Candidates are verified by the exact count of shared shingles.

The search joins documents with the sketches alone; only documents that hold a candidate are read again to verify it, and
texts are never shuffled. Shingles are compared by 64-bit hashes of lower-cased words.

Defined results: null and blank texts and items have no shingle and match nothing; with fewer than five words the whole
sequence is the one shingle, so a short item is found only in a document equal to it; items that share an id, or have none,
are items of their own if their shingles differ, and once if not; so are documents if their texts differ; null ids match
like any others; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, small, stored, table, words

WORDS = 5
THRESHOLD = 80
#: Item shingles are broadcast up to this many rows (about 40 MB as a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: Column, n: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the n-word shingles of a text."""

    def of(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(rolled)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return bound(words(F.lower(text)), of)


def sketched(items: DataFrame, item_id: str, text: str, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """item (a hash of id and shingles), item_id, n_item (shingles), shingle, in_sketch: the shingles of the items, those of
    the size-partitioned sketch marked."""
    s = items.select(F.col(item_id).alias("item_id"), F.array_sort(shingles(F.col(text), n)).alias("s")).filter(F.size("s") > 0)
    s = s.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "s")).dropDuplicates(["item"])
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("s")))).cast("int")
    k = largest - F.ceil(largest * threshold / 100).cast("int") + 1
    return s.select("item", "item_id", F.size("s").alias("n_item"), k.alias("k"), F.posexplode("s").alias("at", "shingle")).select(
        "item", "item_id", "n_item", "shingle", (F.col("at") < F.col("k")).alias("in_sketch")
    )


def found(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row (a hash of the document's text), item_id, n_item, n_shared of every item found in a document."""
    index = stored(sketched(items, item_id, text, n, threshold), "items")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    # the search meets the sketches only
    sketch = index.filter("in_sketch").select("item", "shingle")
    met = rows.select("doc_id", "row", F.explode(shingles(F.col("text"), n)).alias("shingle")).join(small(sketch, BROADCAST_ROWS), "shingle")
    candidates = stored(met.select("doc_id", "row", "item").distinct(), "candidates")
    # candidates are verified by all shingles of both; other documents are not looked at again
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    few = small(candidates.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct(), BROADCAST_ROWS)
    again = rows.join(few, same, "left_semi").select("doc_id", "row", F.explode(shingles(F.col("text"), n)).alias("shingle"))
    shared = again.join(small(index.select("item", "item_id", "n_item", "shingle"), BROADCAST_ROWS), "shingle")
    pairs = small(candidates.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("item").alias("_item")), BROADCAST_ROWS)
    shared = shared.join(pairs, same & (F.col("item") == F.col("_item")), "left_semi")
    counted = shared.groupBy("doc_id", "row", "item").agg(
        F.first("item_id").alias("item_id"), F.first("n_item").cast("long").alias("n_item"), F.count_distinct("shingle").alias("n_shared")
    )
    return counted.filter(100 * F.col("n_shared") >= threshold * F.col("n_item")).drop("item")


def contained(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every item found in a document; a row for each of those that share an id."""
    return found(docs, items, **options).drop("row")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    hits = stored(found(docs, items, **options).select(F.col("doc_id").alias("_hit"), F.col("row").alias("_row")).distinct(), "hits")
    # a row is one struct, so that no name of its columns meets one of those made here
    id_, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_).alias("doc"), F.xxhash64(text).alias("hash"))
    clean = rows.join(small(hits, BROADCAST_ROWS), F.col("doc").eqNullSafe(F.col("_hit")) & (F.col("hash") == F.col("_row")), "left_anti")
    return clean.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_decontaminate(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_shingles(source: str, key: str) -> str:
    return rf"""
  SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
        FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source})
        WHERE len(w) > 0)"""


OP4_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}
), b AS ({_sql_shingles("benchmark", "item_id")}
), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
