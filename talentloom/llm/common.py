"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one of our own, but only if executors are threads of the driver (as in tests): on a
    cluster a local folder would be another one on each machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-talentloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts the lineage: an executor lost later costs no recomputation of what stands before.
    """
    path = f"{shared_dir(df.sparkSession)}/talentloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that are worked on at a time.
AT_ONCE = 12 << 20


def small(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``at_once`` bytes or one row; empty ones are left out.

    Spark makes batches of a number of rows. With long texts, what is made of a whole batch would outgrow a worker's memory.
    """
    for batch in batches:
        n = batch.num_rows
        parts = min(n, max(1, -(-batch.nbytes // at_once)))
        if parts <= 1:
            if n:
                yield batch
            continue
        sizes = [pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type)]
        ends = np.cumsum(sum(sizes, np.full(n, batch.nbytes // n if not sizes else 64, np.int64)))
        cuts = np.flatnonzero(np.diff(np.append(-1, (ends - 1) // at_once)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function on single batches of bounded size; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def task_number() -> int:
    """The number of the partition that the running task works on."""
    return TaskContext.get().partitionId()


def field_sql(df: DataFrame, name: str) -> str:
    """``name type`` of a column, for a schema string."""
    return f"{name} {df.schema[name].dataType.simpleString()}"


def crc_mod(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus`` (null id: the crc of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def sample_fraction(n: int, most: int) -> float:
    return 1.0 if n <= most else most / n


def in_sample(fraction: float, salt: int, *columns: str):
    """A row is in a sample by a hash of these columns alone: the same rows at each evaluation."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1_000_000)) < int(fraction * 1_000_000)


def copies_in_sample(n, fraction, *shared):
    """How many of ``n`` equal rows are in a sample: n * fraction, rounded up or down by a hash of what they share."""
    at = F.pmod(F.xxhash64(*shared), F.lit(1_000_000)) / 1_000_000
    return F.ceil(n * fraction - at).cast("long")


def keep_rows(df: DataFrame, keep: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """The rows whose texts ``keep`` accepts, with all their columns and no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(keep(batch.column(text).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores put behind until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_names(rows: DataFrame, names: DataFrame, key: str, total: int, large: int = 5_000_000) -> DataFrame:
    """Inner join of rows with names, which has one row a key and ``n``, a count of rows by key.

    ``total`` is no less than the number of rows. Of more than ``large``, keys with over a thousandth of
    them (so at most a thousand keys) are broadcast and their rows stay where they are; all other keys are
    joined as Spark sees fit.
    """
    if total <= large:
        return rows.join(names.drop("n"), key)
    hot = names.filter(F.col("n") > total // 1000).drop("n")
    rest = names.filter(F.col("n") <= total // 1000).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
