"""Helpers that several operators share: tables, stages, splits, Arrow batches, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.session import tune, use_checkpoints

U64 = np.uint64
#: Rows and bytes of an Arrow batch. Long texts make a batch end by its bytes.
BATCH_ROWS, BATCH_BYTES = "2000", str(16 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the text operators: small Arrow batches, AQE, UTC."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows neither computes ``df`` again nor depends on the executors that made it.
    """
    spark = df.sparkSession
    path = f"{use_checkpoints(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def batches(rows: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that a batch holds one row or about ``size`` bytes at most."""
    for batch in rows:
        if batch.num_rows:
            parts = max(1, min(batch.num_rows, -(-batch.nbytes // size)))
            step = -(-batch.num_rows // parts)
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers (in place) whose output bits look independent."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
