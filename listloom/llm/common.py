"""Helpers shared by the corpus operators: tables, the shared folder, byte-level text arrays."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these (fixed by the contracts of the operators).
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where none is set, one process (as in tests) gets a temporary
    one; on a cluster, where executors would write apart, that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="listloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that tasks can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_listloom_shipped", False):
        root = pathlib.Path(__file__).parents[1]
        path = pathlib.Path(tempfile.mkdtemp(prefix="listloom-")) / "listloom_tasks.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in root.rglob("*.py"):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._listloom_shipped = True


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The file system of a shared folder and the path on it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of lineage that survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text):
    """Native array of the words of a text column; null and blank texts give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SEPARATORS))


def bound(value, use):
    """``use(value)`` with ``value`` computed once: as a lambda's variable it isn't repeated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (joins then shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys that more than one in HOT of all rows have are fewer than HOT.
HOT = 10_000


def joined_by_key(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, few: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` on their column ``key``, null meeting null, though very many rows share a key.
    ``groups`` has one row a key, and in ``n`` (an upper bound of) how many of the ``total`` rows have it. Groups of over one
    in HOT of all rows are broadcast, which are fewer than HOT; the others are if they are at most ``few``, else shuffled."""
    groups = groups.withColumnRenamed(key, "_joined").withColumn("_there", F.lit(True))
    hot, same = F.col(n) * HOT > total, F.col(key).eqNullSafe(F.col("_joined"))
    met = rows.join(F.broadcast(groups.filter(hot)), same, "left")
    rest = met.filter("_there is null").select(rows.columns).join(small(groups.filter(~hot), few), same, "left")
    return met.filter("_there").unionByName(rest).drop("_joined", "_there")


def ascii_lower(text):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_totals(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``before`` (the sum of ``value`` of all rows before it) by the columns ``order``.
    Rows are dealt into ranges; only the ranges' sums, a row each, meet in one task."""
    ranges = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select("_of", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "0") for c in ("_n", "_v")])
    inside = Window.partitionBy("_range").orderBy(*order)
    done = ranges.withColumn("place", F.row_number().over(inside) - 1).withColumn("before", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    done = done.join(F.broadcast(sums), F.col("_range") == F.col("_of"))
    return done.withColumns({"place": F.col("place") + F.col("_n0"), "before": F.col("before") + F.col("_v0")}).drop("_range", "_of", "_n0", "_v0")


# ---------------------------------------------------------------- byte arrays inside tasks

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, end to end, and the offsets of each text. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, target: int = 1 << 20):
    """Runs [a, b) of whole documents of about ``target`` bytes; a longer document makes a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + target, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` (words never cross documents), and for each document its first word.
    ``separators``: a flag for each byte."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= starts[1:] | separators[data[1:]]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over random byte values."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
