"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions.lineage import cut, ensure_checkpoint_dir

__all__ = ["BROADCAST_ROWS", "PRE", "SPACE", "checked_join", "cut", "ensure_checkpoint_dir", "let", "likely", "n_words", "put_aside", "put_back", "replace_columns", "small_batches", "trimmed", "words"]

#: Prefix of every working column; an input column of that name is not supported.
PRE = "_lw_"
#: ASCII white space as the contracts define it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 50_000
#: The filter of likely() has 2 to this number of bits (4 MB).
FILTER_BITS = 25
#: Settings for the bytes of an Arrow batch and for the rows that the Parquet reader decodes together, and what they are set to where the session leaves them open.
BATCH_SETTING, ROWS_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
SMALL = {BATCH_SETTING: "4m", ROWS_SETTING: "512"}


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that the operator is about to write (case-insensitive, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def put_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names, which an operator would replace, under working names; put_back() gives them their own ones again."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`").alias(f"{PRE}aside_{i}" if c.lower() in taken else c) for i, c in enumerate(df.columns)])


def put_back(df: DataFrame, like: DataFrame) -> DataFrame:
    """df's columns, in their order, under the names of the columns of like."""
    return df.toDF(*like.columns)


def small_batches(spark: SparkSession) -> None:
    """Read texts, and hand them to Python, in the small lots of SMALL for the rest of the session, unless it has limits of its own.

    Spark's own limits of 4096 rows read and 10000 rows handed over let a lot of texts grow to any size, in arrays that need as much room in one piece. A row isn't split.
    """
    for setting, value in SMALL.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, value)


def trimmed() -> None:
    """Give memory that a worker has freed back to the system: workers outlive their tasks, and allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def words(text: Column) -> Column:
    """ASCII-white-space separated words; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it, also where the optimizer moves the expression elsewhere."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a checkpointed side that is broadcast when its counted size allows it.

    Beyond BROADCAST_ROWS the plain equi-join is left to adaptive execution, which splits skewed partitions.
    """
    small = cut(small)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def likely(keys: DataFrame, column: str, value: Column | None = None) -> Column:
    """Condition on a long column of that name (or another value): false only where it is surely not in that column of keys.

    It keeps rows without a partner from being shuffled for a join and never changes the join's result. The filter has a fixed size of
    2^FILTER_BITS bits, whatever the input's size: when keys has very many rows it lets more through.
    """
    size = 1 << FILTER_BITS
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(size)) + 1
    at = keys.select(place(F.col(column)).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:  # pieces of 4 KB
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def has(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64) - 1
        return pd.Series(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return has(place(F.col(column) if value is None else value))
