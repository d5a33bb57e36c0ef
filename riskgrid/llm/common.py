"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgrid.operators.shared import shared_dir

#: Bytes that an explicit broadcast may carry, and what a 64-bit id takes in one (a row of a hashed relation).
BROADCAST_BYTES = 32 << 20
ID_BYTES = 32
#: Rows that a Python function sees at a time, rows of an Arrow batch, and bytes of a Parquet row group: they bound a task's memory.
AT_ONCE = 256
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROW_GROUP = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives executors, cuts the lineage and is computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, row_bytes: int = ID_BYTES) -> bool:
    """Whether a count finds that ``df`` may be broadcast; it stops counting at the bound."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def perhaps_broadcast(df: DataFrame, row_bytes: int = ID_BYTES) -> DataFrame:
    return F.broadcast(df) if is_small(df, row_bytes) else df


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``, without moving texts if it can.

    The ids are broadcast only if a count finds them within
    ``BROADCAST_BYTES``; beyond that Spark joins both sides by a shuffle on the key.
    """
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(perhaps_broadcast(ids), key, "left_semi")


Columns = dict[str, list]


def short_batches(spark: SparkSession) -> None:
    """Hand texts to Python ``BATCH_ROWS`` rows at a time: Spark's own default of 10,000 can be a gigabyte of long texts. A session that sets its own number keeps it."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def by_rows(df: DataFrame, make: Callable[[], Callable[[Columns], Iterator[dict[str, Any]]]], fields: str, at_once: int = AT_ONCE) -> DataFrame:
    """Rows made by a Python function of few rows at a time, in one pass without a shuffle.

    ``make`` is called once a task; what it returns takes lists of column
    values and yields columns of the result. Values travel as Arrow columns:
    64-bit ids stay exact beside nulls.
    """
    short_batches(df.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                part = batch.slice(a, at_once)
                for out in work({name: part.column(name).to_pylist() for name in part.schema.names}):
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return df.mapInArrow(run, fields)


def crc_of_id(column: str = "doc_id"):
    """Unsigned crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
