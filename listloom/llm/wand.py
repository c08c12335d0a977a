"""Operator 13: ranked lexical search by WAND, a heap for each item and document shard, the heaps merged.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A first pass over the documents
counts terms and keeps, of the terms that the items ask for, the postings (term, occurrences) of each document; from these
come the number of documents, their terms, and how many hold each term. The second pass is the search. A shard is what one
task reads; it takes its documents in blocks and turns the postings of a block into lists by term, each with the maximum
impact that it has in the block. For each item, terms are ordered by maximum impact. The pivot term is the last one without
which the maxima still sum up to the item's heap threshold: documents that hold none of the terms up to it are never looked
at. Of the others those are pivots whose terms' maxima reach the threshold, found for a whole block at once; the rest are
skipped, and only pivots are scored. The heap (the best ``k`` so far) goes on from block to block, so a threshold rises
quickly; the first block of a shard is small. A document that ties with the threshold is scored, as the id decides.

Heaps of shards, ``k`` rows an item and task, are merged in two steps, by groups of shards and then by item. Items are taken
in blocks of about ``QUERY_TERMS`` terms, each with a pass of its own, so what a task is sent is bounded.

Defined results: a null or blank text has no terms and is no document here; an item without terms has no result; rows that
share an id are documents of their own, a null id comes last among equal scores; equal items (id and text) are one, items
that share an id but not the text are searched apart and have ranks of their own; an empty table gives an empty result.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, ship, stored, table, text_bytes, word_hashes, word_spans

K = 10
QUERY_TERMS = 1_000_000
#: Documents in the first block of a shard and in a later one, at most, and postings in a block, about.
FIRST_DOCS, BLOCK_DOCS, BLOCK_POSTINGS = 512, 16_384, 2_000_000
SHARD_GROUPS = 256
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_NO_ID = 2**63 - 1


def term_hashes(column: pa.Array):
    """Of runs of texts: the first and the last row (excluded), hashes of all terms, and where each text's begin."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        own = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(own, offsets[a : b + 1] - offsets[a], _BREAKS)
        yield a, b, word_hashes(own, starts, ends), first


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def queries(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, part (a hash), terms (distinct hashes), times of every item that has terms."""
    kind = items.schema[item_id].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for a, b, hashes, first in term_hashes(batch.column("text")):
                each = [np.unique(hashes[first[d] : first[d + 1]], return_counts=True) for d in range(b - a)]
                offsets = np.cumsum([0, *(len(x) for x, _ in each)])
                lists = [_lists(np.concatenate(x), offsets) for x in ([h.view(np.int64) for h, _ in each], [n.astype(np.int64) for _, n in each])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a), batch.column("part").slice(a, b - a), *lists], names=["item_id", "part", "terms", "times"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct().withColumn("part", F.xxhash64("item_id", "text"))
    return rows.mapInArrow(count, f"item_id {kind}, part long, terms array<long>, times array<long>").filter("size(terms) > 0")


def postings(docs: DataFrame, vocabulary: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms), terms (places in ``vocabulary``, sorted hashes), times of every document that has terms."""

    def count(batches):
        for batch in batches:
            for a, b, hashes, first in term_hashes(batch.column("text")):
                n = np.diff(first)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                keys, times = np.unique(np.repeat(np.arange(b - a), n)[known] * len(vocabulary) + at[known], return_counts=True)
                offsets = np.searchsorted(keys, np.arange(b - a + 1) * len(vocabulary))
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n), _lists((keys % len(vocabulary)).astype(np.int32), offsets), _lists(times.astype(np.int64), offsets)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "times"]).filter(pa.array(n > 0))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Postings of some documents by term, with the impact of each and the maximum impact of each term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.ids = ids
        m = np.array([25 + 75 * x * documents // length for x in n.tolist()], dtype=np.int64)
        order = np.argsort(terms, kind="stable")
        doc, terms, times = np.repeat(np.arange(len(ids)), sizes)[order], terms[order], times[order]
        self.docs, self.impacts = doc, weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.top = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.starts))
        if len(there):
            self.top[there] = np.maximum.reduceat(self.impacts, self.starts[there])

    def of(self, term: int) -> slice:
        return slice(self.starts[term], self.starts[term + 1])

    def pivots(self, terms: np.ndarray, tops: np.ndarray, threshold: int) -> np.ndarray:
        """Documents whose terms' maxima sum up to ``threshold``; ``terms`` by falling ``tops``."""
        rest = np.r_[np.cumsum(tops[::-1])[::-1], 0]  # what the terms from here on can give
        pivot = int(np.searchsorted(-rest, -threshold, side="right"))  # beyond it, they can't reach the threshold
        bound = np.zeros(len(self.ids), np.int64)
        for t, top in zip(terms[:pivot], tops[:pivot], strict=True):
            bound[self.docs[self.of(t)]] += top
        found = np.flatnonzero(bound + rest[min(pivot, len(terms))] >= threshold)
        bound = bound[found]
        for k in range(pivot, len(terms)):
            bound[self._places(terms[k], found)[1]] += tops[k]
            still = bound + rest[k + 1] >= threshold
            found, bound = found[still], bound[still]
        return found

    def _places(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of a term have ``docs``, and which of them they have."""
        held = self.docs[self.of(term)]
        if not len(held):
            return np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return at, held[at] == docs

    def search(self, terms: np.ndarray, times: np.ndarray, heap: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The heap (scores, ids; best first) with the documents of this block."""
        scores, ids = heap
        threshold = int(scores[-1]) if len(scores) == k else 1
        tops = times * self.top[terms]
        order = np.argsort(-tops, kind="stable")
        terms, times, tops = terms[order], times[order], tops[order]
        if tops.sum() < threshold:
            return heap
        found = self.pivots(terms, tops, threshold)
        if not len(found):
            return heap
        score = np.zeros(len(found), np.int64)
        for t, r in zip(terms, times, strict=True):
            at, has = self._places(t, found)
            score[has] += r * self.impacts[self.of(t)][at[has]]
        kept = score >= threshold
        scores, ids = np.r_[scores, score[kept]], np.r_[ids, self.ids[found[kept]]]
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def shard_heaps(index: DataFrame, asked: list, vocabulary: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int, kind: str) -> DataFrame:
    """item, item_id, shard, doc_id, score: the best ``k`` of each shard. ``asked``: (id, terms, times) of each item."""
    items = [(i, np.searchsorted(vocabulary, np.array(terms, np.int64).view(np.uint64)), np.array(times, np.int64)) for i, terms, times in asked]

    def search(batches):
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        waiting, n_docs, n_postings, most = [], 0, 0, FIRST_DOCS

        def close():
            rows = pa.Table.from_batches(waiting)
            lists = {c: rows.column(c).combine_chunks() for c in ("terms", "times")}
            flat = {c: x.flatten().to_numpy() for c, x in lists.items()}
            sizes = lists["terms"].value_lengths().to_numpy()
            block = Block(rows.column("doc_id").fill_null(_NO_ID).to_numpy(), rows.column("n").to_numpy(), flat["terms"], flat["times"], sizes, weights, documents, length)
            for i, (_, terms, times) in enumerate(items):
                heaps[i] = block.search(terms, times, heaps[i], k)

        for batch in batches:
            while batch.num_rows:
                # as many rows as the block still takes
                grown = np.cumsum(batch.column("terms").value_lengths().to_numpy())
                take = max(1, min(most - n_docs, int(np.searchsorted(grown, BLOCK_POSTINGS - n_postings, side="right"))))
                take = min(take, batch.num_rows)
                waiting.append(batch.slice(0, take))
                n_docs, n_postings, batch = n_docs + take, n_postings + int(grown[take - 1]), batch.slice(take)
                if n_docs >= most or n_postings >= BLOCK_POSTINGS:
                    close()
                    waiting, n_docs, n_postings, most = [], 0, 0, BLOCK_DOCS
        if waiting:
            close()
        shard, out = TaskContext.get().partitionId(), {"item": [], "item_id": [], "doc_id": [], "score": []}
        for i, ((name, _, _), (scores, ids)) in enumerate(zip(items, heaps, strict=True)):
            for c, x in (("item", [i] * len(ids)), ("item_id", [name] * len(ids)), ("doc_id", [None if d == _NO_ID else d for d in ids.tolist()]), ("score", scores.tolist())):
                out[c] += x
        out["shard"] = [shard] * len(out["item"])
        types = {"item": pa.int32(), "item_id": item_type, "doc_id": pa.int64(), "score": pa.int64(), "shard": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(index.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)
    return index.mapInArrow(search, f"item int, item_id {kind}, doc_id long, score long, shard int")


def best(heaps: DataFrame, k: int) -> DataFrame:
    """``heaps`` merged: rank (from 1) of the best ``k`` rows of each item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = heaps.withColumn("group", F.pmod("shard", F.lit(SHARD_GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest score above 0 for each item."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_id].dataType.simpleString()
    asked = stored(queries(items, item_id, query), "queries")
    parts = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms)
    out = []
    for part in range(parts):
        rows = asked.filter(F.pmod("part", F.lit(parts)) == part).select("item_id", "terms", "times").collect()  # about query_terms terms
        if not rows:
            continue
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64))
        index = stored(postings(docs, vocabulary, doc_id, text), "postings")
        documents, length = index.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        holding = np.zeros(len(vocabulary), np.int64)
        for t, n in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the items
            holding[t] = n
        weights = np.array([weight(documents, x) for x in holding.tolist()], dtype=np.int64)
        heaps = shard_heaps(index, [tuple(r) for r in rows], vocabulary, weights, documents, length, k, kind)
        out.append(best(stored(heaps, "heaps"), k).drop("item"))
    merged = out[0] if out else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for x in out[1:]:
        merged = merged.unionByName(x)
    return merged


def op13_wand_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
OP13_SQL = f"""
WITH t AS (
  SELECT doc_id, {_TERMS} AS term FROM documents
), d AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d
), b AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY item_id, term
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term
), i AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))) AS impact FROM p JOIN w USING (term) JOIN d USING (doc_id), s
), r AS (
  SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM i JOIN b USING (term) GROUP BY item_id, doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT * FROM k WHERE rank <= 10
"""
