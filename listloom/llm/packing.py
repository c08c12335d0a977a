"""Operator 8: bulk-synchronous best-fit packing of token sequences.

Documents are encoded once, in tasks; only (document, piece, length, checksum) go on. Pieces and the gaps of open
sequences are kept in size order as runs of equal size, at most ``size`` of each, each member known by its rank in its run.
A superstep sweeps the runs of pieces from the largest to the smallest: each proposes itself to the successor gaps, the
tightest that hold it, and ranks resolve conflicts (the first ranks get the gaps, the rest go on to the next run and then
to new sequences). Then the gaps are updated, which may split a run, and the sweep repeats until no piece is left. As
equal sizes are interchangeable, the supersteps move whole intervals of ranks; this state is bounded by ``size``, whatever
the number of documents, and gives each piece just the place that best fit in decreasing order would give it.
The distributed part is all that grows: encoding, ranks within runs (hot lengths are split by a hash of the id, as a third
of all documents may be copies of one length), and the join of (length, rank) with the intervals.

Pieces over ``size`` tokens are cut from the end, so the first piece may be shorter. Defined results: a null text is empty
and has the end id alone; repeated rows are documents of their own; null ids come first; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored, table
from .tokens import default_path, encoder

SIZE = 2048
END_ID = 0
ROWS_PER_BIN = 4096


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, copy (tells repeated rows apart) of every piece."""

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a in range(0, len(keys), 512):
                out = [[], [], [], [], []]
                some = [t or "" for t in texts.slice(a, 512).to_pylist()]
                for key, ids in zip(keys[a : a + 512], encode.encode(some), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    n, at, piece = len(ids) // 4, 0, 0
                    take = n if n <= size else n % size or size
                    while at < n:
                        for column, x in zip(out, (key, piece, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])), strict=True):
                            column.append(x)
                        at, piece, take = at + take, piece + 1, size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def supersteps(counts: dict[int, int], size: int = SIZE) -> list[tuple]:
    """Best fit over runs: (length, first rank, number, first sequence, in each, offset) intervals. Piece number
    first rank + i * in_each + j of that length goes to sequence first + i, at offset + j * length."""
    left = {n: c for n, c in counts.items() if c}
    placed = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap size: runs of [first sequence, number]
    plan: list[tuple] = []
    opened = 0
    for length in sorted(left, reverse=True):  # the sweep; each turn of the loop below is one bulk match of a run
        while left[length]:
            fit = next((g for g in range(length, size) if gaps[g]), None)
            if fit is None:
                each = size // length
                first, number, room = opened, -(-left[length] // each), size
                opened += number
            else:
                first, number = gaps[fit].pop()
                room, each = fit, fit // length
            full, rest = divmod(left[length], each)
            take = min(number, full)
            if take:
                plan.append((length, placed[length], take * each, first, each, size - room))
                gaps[room - each * length].append([first, take])
            n = take * each
            if take < number:
                if rest and full == take:
                    plan.append((length, placed[length] + n, rest, first + take, rest, size - room))
                    gaps[room - rest * length].append([first + take, 1])
                    n, take = n + rest, take + 1
                if take < number:
                    gaps[room].append([first + take, number - take])
            left[length] -= n
            placed[length] += n
    return plan


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank (from 0) among pieces of equal length: small bins are numbered apart and put one after another."""
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", "ids_crc32")]
    sizes = items.groupBy("length").agg(F.count("*").alias("_n")).withColumnRenamed("length", "_l")
    bins = F.pmod(F.xxhash64("doc_id", "piece"), F.ceil(F.col("_n") / ROWS_PER_BIN))
    binned = items.join(F.broadcast(sizes), F.col("length") == F.col("_l")).withColumn("_bin", bins).drop("_n", "_l")
    counts = binned.groupBy("length", "_bin").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("length").orderBy("_bin")) - F.col("_c")
    counts = counts.select(F.col("length").alias("_l"), F.col("_bin").alias("_b"), before.alias("_before"))
    numbered = binned.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_bin").orderBy(*order)) - 1)
    joined = numbered.join(counts, (F.col("length") == F.col("_l")) & (F.col("_bin") == F.col("_b")))
    return joined.withColumn("rank", F.col("_before") + F.col("_rn")).drop("_l", "_b", "_before", "_rn", "_bin")


def place(spark: SparkSession, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset. ``items`` must be stored: it is read several times."""
    # at most ``size`` lengths, and a few intervals for each
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    plan = supersteps(counts, size)
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, *interval in plan:
        by_length[length].append(tuple(interval))
    schema = "_l long, plan array<struct<rank:long,number:long,first:long,each:long,offset:long>>"
    table_ = spark.createDataFrame([(n, sorted(x)) for n, x in by_length.items()], schema)
    joined = ranked(items).join(F.broadcast(table_), F.col("length") == F.col("_l"))
    # the interval that holds the rank
    at = F.get(F.filter("plan", lambda x: (x["rank"] <= F.col("rank")) & (F.col("rank") < x["rank"] + x["number"])), F.lit(0))
    joined = joined.withColumn("_at", at).withColumn("_k", F.col("rank") - F.col("_at.rank"))
    return joined.withColumns({
        "sequence_id": (F.col("_at.first") + F.floor(F.col("_k") / F.col("_at.each"))).cast("long"),
        "offset": (F.col("_at.offset") + F.pmod(F.col("_k"), F.col("_at.each")) * F.col("length")).cast("long"),
    }).drop("_l", "plan", "_at", "_k", "rank")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    items = stored(pieces(docs, tokenizer, size, doc_id, text), "pieces")
    return place(docs.sparkSession, items, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_path())
