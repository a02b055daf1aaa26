"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.sources.files import new_path

#: The white space that separates words, and the pattern of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Tables up to this many bytes may be broadcast; callers check the size first.
BROADCAST_BYTES = 32 << 20


#: Rows of a batch at most, of Arrow's and of the Parquet reader's; whole texts are long.
BATCH_ROWS, READ_ROWS = 1000, 512
# Memory that Arrow frees goes back to the system, since workers live on from stage to stage.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Let the C library return freed memory to the system, where it can; Python workers live on from stage to stage."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most, and the Parquet reader's READ_ROWS."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its counted rows stay within limit; else leave the join to a shuffle.

    df must be cheap to count, such as a materialized table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of a hash of all columns; a null differs from every value, and maps count by their entries as JSON, in order."""
    has_map = {f.name for f in df.schema if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()}
    names = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in has_map else F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(F.lit(seed), *names, *[F.col(f"`{c}`").isNull() for c in df.columns])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, with white space as in WORD_PATTERN."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def row_position(name: str = "_pos") -> list[Column]:
    """Columns with a row's partition and its position there, to be added after a sort within partitions.

    They are stable only once the result is materialized.
    """
    at = F.monotonically_increasing_id()
    return [
        F.shiftright(at, 33).alias("_part"),
        at.bitwiseAND(F.lit((1 << 33) - 1)).alias(name),
    ]
