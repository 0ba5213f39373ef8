"""Session-level helpers shared by all plans: table access, spreading of small inputs, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of fewer splits than the cluster has cores one partition per core.

    A file of a single row group is one task however large the cluster; CPU-bound operators
    would then run on one core. Inputs that already have enough splits are left alone, so at scale
    this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame, *, eager: bool = True) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (tests, a laptop)
    a temporary folder of this machine is used, and only under a local master.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager)


def broadcastable(df: DataFrame, limit_rows: int) -> bool:
    """Whether ``df`` has at most ``limit_rows`` rows, counted without reading further than that."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose text in ``column`` is about ``limit`` bytes at most, one row at least.

    A worker's memory then follows the limit, not how many rows Spark puts in a batch.
    """
    for b in batches:
        if not b.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield b.slice(a, z - a)
