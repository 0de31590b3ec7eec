"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacewing.llm.common import PRE, checked_join, cut, replace_columns
from lacewing.llm.components import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at a time.
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit integer: bit i is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased, words are split at ASCII white space, and shingles are joined by blanks, repeated ones counted each time. Fewer
    words than a shingle's are one shingle; no words give zero.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined, k = b" ".join(found), min(shingle, len(found))
    ends = list(accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends]
    n, digest = len(found) - k + 1, xxhash.xxh64_intdigest
    spans = ((starts[at : at + _STEP], ends[at + k - 1 : min(at + _STEP, n) + k - 1]) for at in range(0, n, _STEP))
    return majority(np.array([digest(joined[s : e - 1], SEED) for s, e in zip(begins, stops)], "<u8") for begins, stops in spans)


def majority(lots: Iterable[np.ndarray]) -> int:
    """The SimHash of 64-bit hashes, which come in lots, as a signed number: bit i is 1 if it is set in over half of them."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in lots:
        n += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of a text column as a long; null counts as empty. One pass in Arrow batches, no shuffle."""
    df = replace_columns(df, out_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(text.as_py(), shingle) for text in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.LongType())]))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of the 64 bits, such that for any `radius` bits some mask has none of them.

    Bit i gets a non-zero vector of radius + 1 bits; mask v has the bits whose vector has odd parity with v. At most `radius` vectors leave
    a non-zero v that is even with all of them. As signed 64-bit integers.
    """
    tables = 1 << radius + 1
    vectors = [1 + i % (tables - 1) for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (v & vectors[i]).bit_count() % 2) for v in range(1, tables)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within two differing bits.

    fingerprints: distinct values in the column fp. Each goes into one bucket for each covering mask; any linked pair meets in some
    bucket. In a bucket only the bits outside the mask differ, so its members are put, besides under themselves, under each value that
    one of these bits' change gives: those under one value are within two bits of each other, and those within two bits share a value.
    All of a value are linked to the smallest. So a bucket costs in proportion to its members, however many these are, and no
    pairs are listed. Buckets of one member, nearly all, are dropped first.
    """
    masks = covering_masks()
    table = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("table", "mask")
    put = fingerprints.select("fp", table).select("fp", "table", "mask", F.expr("fp & mask").alias("bucket"))
    shared = put.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("table", "bucket")
    met = checked_join(put, shared, ["table", "bucket"], "left_semi")
    free = {m: [b - (1 << BITS) if b >> (BITS - 1) else b for b in [0, *(1 << i for i in range(BITS) if not m >> i & 1)]] for m in masks}
    changes = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(b) for b in free[m]]))])
    under = met.select("table", "fp", F.explode(F.transform(changes[F.col("mask")], lambda b: F.col("fp").bitwiseXOR(b))).alias("value"))
    centre = under.groupBy("table", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("table", "value", "a")
    return checked_join(under, centre, ["table", "value"], "inner").where("a < fp").selectExpr("a", "fp as b").distinct()


def classes(ids: DataFrame, id_col: str, fp_col: str = "fingerprint") -> DataFrame:
    """(fp, component_id) for each fingerprint of a table (id_col, fp_col), component_id being the smallest id that it reaches.

    Copies are reduced to one row a fingerprint, before the shuffle, so their number doesn't matter. Null ids count as the largest.
    """
    groups = cut(ids.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first")))
    linked = components(links(groups.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    rooted = cut(groups.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return cut(rooted.join(smallest, "root").select("fp", "component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (long) and component_id of every row.

    Null and blank texts have fingerprint zero and are linked like any other; null ids keep their row, and are a component's id only where all of
    its ids are null; repeated rows stay; an empty table gives an empty one; other columns are left out. Texts are read once, and what follows
    is done on (id, fingerprint).
    """
    ids = cut(with_fingerprint(df.select(id_col, text_col), text_col).drop(text_col))
    found = classes(ids, id_col).withColumnRenamed("fp", "fingerprint")
    return ids.join(found, "fingerprint").select(id_col, "fingerprint", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component the row of its smallest id stays, of repeated rows one.

    Columns stay as they are. Rows of one id and fingerprint are reduced before the shuffle, then joined with the chosen ids.
    """
    fp = PRE + "fp"
    ids = cut(with_fingerprint(df.select(id_col, text_col), text_col, fp).select(id_col, fp).distinct())
    chosen = ids.join(classes(ids, id_col, fp).withColumnRenamed("fp", fp), fp).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    chosen = cut(chosen.withColumn(PRE + "n", F.row_number().over(Window.partitionBy("component_id", id_col).orderBy(fp))).where(f"{PRE}n = 1").select(F.col(id_col).alias(PRE + "id"), F.col(fp).alias(PRE + "kept")))
    same = Window.partitionBy(id_col, fp).orderBy(F.col(text_col).asc_nulls_first())
    rows = with_fingerprint(df, text_col, fp).withColumn(PRE + "n", F.row_number().over(same)).where(f"{PRE}n = 1")
    on = F.col(id_col).eqNullSafe(F.col(PRE + "id")) & (F.col(fp) == F.col(PRE + "kept"))
    return rows.join(chosen, on, "left_semi").drop(fp, PRE + "n")
