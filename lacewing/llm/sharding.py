"""Sharding by sampled splitters into shards of near-equal bytes."""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.llm.common import PRE, checked_join, cut, replace_columns

#: Fine ranges per shard; a key with more bytes than a fine range is a range of its own.
FINE = 128
#: Keys sampled, in expectation, per fine range that is to be split; rounds of subdividing at most.
DRAWN, ROUNDS = 8, 8
#: A range is overfull above this many times its share.
OVERFULL = 2.0
#: Rows of a cell, within which rows are numbered, are aimed at between these.
CELL_ROWS = 200, 100_000

_KEY, _RANGE, _CELL = PRE + "key", PRE + "range", PRE + "cell"


def _sample(groups: DataFrame, per_byte: float, rounds: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to their bytes: (key, bytes). Each row of groups is one key, so a hot key is drawn once."""
    chance = F.pmod(F.xxhash64(F.lit(rounds), _KEY), F.lit(1 << 40)) / float(1 << 40)
    drawn = groups.where(chance < F.col("bytes") * per_byte).select(_KEY, "bytes")
    return sorted((r[0], r[1]) for r in drawn.collect())


def _ranges(splitters: list[int]):
    """Range of a key: splitter i begins range i + 1."""
    edges = np.array(splitters, np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return range_of


def _cut_points(drawn: list[tuple[int, int]], share: float, per_byte: float) -> list[int]:
    """Keys at the quantiles of a sample, one share of bytes apart; a key with more than a share begins and ends a range."""
    points, held = set(), 0.0
    for key, size in drawn:
        stands_for = max(size, 1 / per_byte)
        if size > share:
            points |= {key, key + 1}
            held = 0.0
        elif held + stands_for > share:
            points.add(key)
            held = stands_for
        else:
            held += stands_for
    return sorted(p for p in points if p < 1 << 63)


def splitters(groups: DataFrame, total: int, shards: int) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Splitters, and (range, keys, rows, bytes) of each range that has rows, overfull ranges being subdivided.

    groups: one row a key with bytes and rows. The first sample is spread over all bytes; each further one is drawn from the
    overfull ranges of several keys only. Samples and ranges are bounded by the number of shards.
    """
    share = max(total / (shards * FINE), 1.0)
    points, wanted = [], groups
    for rounds in range(ROUNDS):
        per_byte = DRAWN * 2**rounds / share
        points = sorted({*points, *_cut_points(_sample(wanted, per_byte, rounds), share, per_byte)})
        ranged = groups.withColumn(_RANGE, _ranges(points)(_KEY))
        stats = [tuple(r) for r in ranged.groupBy(_RANGE).agg(F.count("*"), F.sum("rows"), F.sum("bytes")).collect()]
        over = [r for r, keys, _, size in stats if size > OVERFULL * share and keys > 1]
        if not over:
            break
        wanted = ranged.where(F.col(_RANGE).isin(over)).drop(_RANGE)
    return points, sorted(stats)


def place(stats: list[tuple[int, int, int, int]], hot: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each range, as (range, -1), and of each cell of a hot one.

    Single keys and hot cells go, largest first, to the shard with least; the other ranges fill up the shards in key order.
    """
    total = sum(size for *_, size in stats)
    split = {r for r, _ in hot}
    lumps = [(size, (r, -1)) for r, keys, _, size in stats if keys == 1 and r not in split]
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, unit in sorted([*lumps, *((size, unit) for unit, size in hot.items())], key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    loads = dict((s, load) for load, s in heap)
    ranges = [(r, size) for r, keys, _, size in stats if keys > 1]
    rest = sum(size for _, size in ranges)
    level = _level(sorted(loads.values()), rest)
    edges, at = [], 0.0
    for s in range(shards):
        at += max(0.0, level - loads[s])
        edges.append(at)
    done = 0
    for r, size in ranges:
        placed[r, -1] = min(bisect_right(edges, done + size / 2), shards - 1)
        done += size
    assert total == rest + sum(loads.values())
    return placed


def _level(loads: list[int], rest: int) -> float:
    """Height to which `rest` fills up the ascending loads."""
    for k in range(1, len(loads) + 1):
        level = (sum(loads[:k]) + rest) / k
        if k == len(loads) or level <= loads[k]:
            return level
    return 0.0


def shard(df: DataFrame, shards: int, key: Column, size: Column, id_col: str = "doc_id") -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 within the shard) so that the shards' sizes are nearly equal.

    key: a hash (long, not null) by which records are ranged; rows of one key stay in one shard unless their bytes are
    more than a shard's share, when they are dealt by a hash of the id. size: bytes of a row, at least 1. Null and repeated ids,
    repeated rows and an empty table are allowed; existing columns shard and slot are replaced. df is read three times:
    cut it first if it is costly.

    Bytes are summed by key before the shuffle; what comes to the driver is bounded by the number of shards. Slots are numbered within cells,
    parts of a range by a hash of the id that hold some 100 000 rows at most, after the counts of the shard's earlier cells.
    """
    df = replace_columns(df, "shard", "slot")
    keyed = df.withColumns({_KEY: key, PRE + "bytes": size})
    groups = cut(keyed.groupBy(_KEY).agg(F.sum(PRE + "bytes").alias("bytes"), F.count("*").alias("rows")))
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    points, stats = splitters(groups, total, shards)
    aim = min(max(rows // (shards * FINE), CELL_ROWS[0]), CELL_ROWS[1])
    share = total / max(shards, 1)
    hot = {r for r, keys, _, size in stats if keys == 1 and size > share}
    cells = {r: max(-(-n // aim), min(n, -(-size * FINE // max(int(share), 1))) if r in hot else 1) for r, _, n, size in stats}
    spark = df.sparkSession
    known = spark.createDataFrame([(r, n) for r, n in cells.items()], f"{_RANGE} int, {PRE}cells bigint")  # one row a range
    ranged = keyed.withColumn(_RANGE, _ranges(points)(_KEY)).join(F.broadcast(known), _RANGE)
    ranged = ranged.withColumn(_CELL, F.pmod(F.xxhash64(F.lit("cell"), F.col(id_col)), F.col(PRE + "cells")).cast("int"))
    filled = cut(ranged.groupBy(_RANGE, _CELL).agg(F.count("*").alias("n"), F.sum(PRE + "bytes").alias("bytes")))
    heated = filled.where(F.col(_RANGE).isin(list(hot))).select(_RANGE, _CELL, "bytes").collect() if hot else []
    placed = place(stats, {(r, c): b for r, c, b in heated}, shards)
    where = spark.createDataFrame([(r, c, s) for (r, c), s in placed.items()], f"{_RANGE} int, {PRE}c int, shard int")
    cell = F.when(F.col(_RANGE).isin(list(hot)), F.col(_CELL)).otherwise(-1) if hot else F.lit(-1)
    filled = filled.withColumn(PRE + "c", cell).join(F.broadcast(where), [_RANGE, PRE + "c"])  # one row a range or hot cell
    before = Window.partitionBy("shard").orderBy(_RANGE, _CELL).rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select(_RANGE, _CELL, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(PRE + "start"))
    within = Window.partitionBy(_RANGE, _CELL).orderBy(_KEY, F.col(id_col))
    out = ranged.join(cut(starts), [_RANGE, _CELL]).withColumn("slot", F.col(PRE + "start") + F.row_number().over(within) - 1)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
