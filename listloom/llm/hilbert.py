"""Operator 6: Hilbert-curve ordering and sharding, with DataFrame functions only.

Metadata columns are quantised by their quantiles (numbers by a mergeable sketch, strings by exact ranks of their distinct
values) and mapped to one index on a Hilbert curve. Rows are ranked by (index, tie hash, id) and the ranking is cut into runs of equal length, so that every file covers a
small box in several dimensions and min/max statistics prune it. The law is ``rows``: counts are at most one apart.

The global rank needs no global sort: cells of the curve are counted; cells over ``ROWS_PER_BIN`` rows (a hot source may
fill one) are split by a hash of the id into bins of about that many; bins get offsets by two levels of prefix sums (over
cells, at most 2^(bits * dims) of them, then over the bins of a cell); rows are numbered within their small bin.

Defined results: null metadata counts as below every value, a null text has size 16 and the crc of no bytes; ties in all
dimensions are ordered by a hash of the id and then of the row; repeated rows get slots of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, table

BITS = 3
ROWS_PER_BIN = 4096
SHARDS = 40
#: Cells of distinct strings are broadcast up to this many; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def string_cells(df: DataFrame, column: str, bits: int) -> DataFrame:
    """value, cell: the quantile cell of each distinct value of a string column, by the share of rows below its middle.
    Distinct values are sorted by ranges; sums over ranges (a small table) and then within a range give the ranks."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("value is not null")
    ranges = stored(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()), "values")
    totals = ranges.groupBy("p").agg(F.sum("n").alias("t"))  # a row a range
    before = totals.select(F.col("p").alias("q"), (F.sum("t").over(Window.orderBy("p")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy()).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("value")) - F.col("n") / 2
    ranked = ranges.withColumn("inside", inside).join(before, F.col("p") == F.col("q"))
    return ranked.select("value", F.floor((F.col("before") + F.col("inside")) * 2**bits / F.col("all")).cast("int").alias("cell"))


def cut_points(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[float]]:
    """Quantiles of each numeric column: 2^bits - 1 numbers each, from a mergeable sketch over all rows."""
    if not columns:
        return {}
    shares = [k / 2**bits for k in range(1, 2**bits)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(c) for c in columns]).first()
    return {c: sorted(row[c] or []) for c in columns}


def cell_of(value: Column, cuts: list[float]) -> Column:
    return reduce(lambda s, c: s + F.when(value > c, 1).otherwise(0), cuts, F.lit(0)).cast("int")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits an axis (Skilling's transpose, as a fold over bits)."""
    n = len(axes)
    x0 = F.array(*[a.cast("int") for a in axes])
    # undo excess work: for each bit from the top and each axis, invert or exchange the low bits
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        q, i, p = s["q"], s["i"], s["q"] - 1
        first, here = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(here).bitwiseAND(p)
        invert = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, v.bitwiseXOR(F.when(invert, p).otherwise(swap))).when((j == i) & ~invert, v.bitwiseXOR(swap)).otherwise(v),
        )

    x = F.aggregate(steps, x0, step) if bits > 1 else x0
    # Gray encode
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"),
        x,
        lambda y, i: F.transform(y, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(y, i - 1))).otherwise(v)),
    )

    def finish(y: Column) -> Column:
        last = F.get(y, F.lit(n - 1))
        t = reduce(lambda t, q: t.bitwiseXOR(F.when(last.bitwiseAND(1 << q) != 0, F.lit((1 << q) - 1)).otherwise(0)), range(bits - 1, 0, -1), F.lit(0))
        z = F.transform(y, lambda v: v.bitwiseXOR(t))
        # interleave: bit b of axis i goes to place b * n + (n - 1 - i)
        return reduce(
            lambda a, b: a + b,
            [F.shiftleft(F.shiftright(F.get(z, F.lit(i)), b).bitwiseAND(1).cast("long"), b * n + n - 1 - i) for b in range(bits) for i in range(n)],
        )

    return F.get(F.transform(F.array(gray), finish), F.lit(0))


def with_rank(df: DataFrame) -> DataFrame:
    """``df`` (row, key, hilbert) with rank (long, from 0, gapless): the order by (hilbert, hash of key, hash of row, key),
    without any sort of all rows."""
    spread = F.xxhash64("key", "row")
    cells = df.groupBy(F.col("hilbert").alias("_h")).agg(F.count("*").alias("_n"))
    # at most one row for each cell of the curve
    bin_ = F.pmod(spread, F.greatest(F.lit(1), F.ceil(F.col("_n") / ROWS_PER_BIN)))
    binned = stored(df.join(cells, F.col("hilbert") == F.col("_h")).withColumn("bin", bin_).drop("_n", "_h"), "binned")
    bins = binned.groupBy("hilbert", "bin").agg(F.count("*").alias("_c"))
    in_cell = bins.withColumn("_before", F.sum("_c").over(Window.partitionBy("hilbert").orderBy("bin")) - F.col("_c"))
    totals = bins.groupBy(F.col("hilbert").alias("_h")).agg(F.sum("_c").alias("_t"))
    totals = totals.select("_h", (F.sum("_t").over(Window.orderBy("_h")) - F.col("_t")).alias("_base"))
    offsets = in_cell.join(totals, F.col("hilbert") == F.col("_h")).select(F.col("hilbert").alias("_h2"), F.col("bin").alias("_b2"), (F.col("_base") + F.col("_before")).alias("_off"))
    numbered = binned.withColumn("_rn", F.row_number().over(Window.partitionBy("hilbert", "bin").orderBy(F.xxhash64("key"), spread, "key")) - 1)
    joined = numbered.join(offsets, (F.col("hilbert") == F.col("_h2")) & (F.col("bin") == F.col("_b2")))
    return joined.select("row", "hilbert", (F.col("_off") + F.col("_rn")).alias("rank"))


def shard_by_curve(df: DataFrame, dimensions: list[str], key: str, shards: int, bits: int = BITS) -> DataFrame:
    """Adds hilbert (long), shard (int) and slot (long, gapless from 0 in its shard); columns of these names are replaced.
    Rows: at most one apart."""
    kinds = dict(df.dtypes)
    # a row is one struct, so that no name of its columns meets one of those made here
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)])
    strings = [f"d{i}" for i, d in enumerate(dimensions) if kinds[d] == "string"]
    cuts = cut_points(rows, [f"d{i}" for i, d in enumerate(dimensions) if kinds[d] != "string"], bits)
    for d in strings:
        cells = stored(string_cells(rows, d, bits), "cells").select(F.col("value").alias("_v"), F.col("cell").alias("_cell"))
        rows = rows.join(small(cells, BROADCAST_ROWS), F.col(d) == F.col("_v"), "left").withColumn(d, F.coalesce("_cell", F.lit(0))).drop("_v", "_cell")
    axes = [F.col(f"d{i}") if f"d{i}" in strings else cell_of(F.col(f"d{i}").cast("double"), cuts[f"d{i}"]) for i in range(len(dimensions))]
    ranked = with_rank(rows.select("row", "key", hilbert_index(axes, bits).alias("hilbert")))
    total = df.count()
    # shard k holds ranks ceil(k * total / shards) to ceil((k + 1) * total / shards) - 1
    ranked = ranked.withColumn("shard", F.expr(f"int(rank * {shards}L div {max(total, 1)}L)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("hilbert", "shard", "slot")]
    return ranked.select(*kept, "hilbert", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def op6_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stored(
        docs.select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")),
        "metadata",
    )
    out = shard_by_curve(narrow, ["lang", "source", "size", "doc_id"], "doc_id", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
