"""Tables in the folder that all executors share, where an operator has to look at a result before it goes on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, one process (as in tests) gets a temporary folder; on a cluster, whose
    executors would write apart, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    kept = getattr(shared_dir, "folder", None) or "file://" + tempfile.mkdtemp(prefix="listloom-")
    shared_dir.folder = kept
    return kept


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, and apart from what is made of it: a mere column would be copied into
    filters, and into expressions that Spark only interprets. It is exploded, though it is one."""
    return df.withColumn(name, value).withColumn(name, F.explode(F.array(name)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (joins then shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan for work that costs far more than reading: dealt over all cores where its files give fewer tasks
    (a file of one row group is one task, however long its rows take)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
