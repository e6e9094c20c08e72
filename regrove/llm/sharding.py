"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records go to their range, overfull ranges are subdivided.

Only DataFrame functions are used. One pass over the records yields a slim table of (key, size); everything up to
the final numbering works on tables whose size is fixed (``RANGES``) or a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, kept_names, longs, packed, rank_in, unit, unpacked

#: Key ranges that the splitters cut, and samples that each is to get.
RANGES, SAMPLES_PER_RANGE = 1024, 64
#: Rows that one leaf of a range may hold before it is subdivided.
LEAF_ROWS = 50_000


def shard_by_size(df: DataFrame, size: Column, key: Column, tie: Column, n_shards: int = 16, *, ranges: int = RANGES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 within the shard).

    Shards get nearly equal sums of ``size`` (not negative; null: 0): they differ by about a thirty-second of a shard, or by one record if that
    is larger. Records of equal ``key`` stay together unless they alone are overfull: more than ``leaf_rows`` rows,
    or more than twice a range's share of all sizes; then they are dealt out by ``tie``. Null keys count as one key.
    Equal rows get slots of their own in any order. No rows: no rows. Input columns named ``shard`` or ``slot`` are
    replaced. Reruns over the same rows give the same shards.
    """
    names = kept_names(df, "shard", "slot")
    rows = df.select(
        packed(df, "shard", "slot").alias("_row"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 12).alias("_key"),
        F.xxhash64(F.lit(12), tie).alias("_tie"),
    )
    total, n = rows.agg(F.sum("_size"), F.count("*")).first()
    total = total or 0
    if total == 0:  # sizes say nothing, so rows count
        rows, total = rows.withColumn("_size", F.lit(1).cast("long")), n
    if n == 0:
        return rows.select(*unpacked(rows, names), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # Splitters: a row is drawn size * rate times in expectation, so quantiles of the draws are quantiles of the size.
    rate = ranges * SAMPLES_PER_RANGE / total
    drawn = rows.select("_key", F.floor(F.col("_size") * rate + unit(F.lit(13), F.col("_key"), F.col("_tie"))).alias("times")).where("times > 0")
    cut = drawn.agg(F.percentile("_key", F.lit([k / ranges for k in range(1, ranges)]), F.col("times"))).first()[0]
    bounds = sorted({int(x) for x in cut or []})
    rows = rows.withColumn("_range", rank_in(F.col("_key"), bounds))
    # What each range holds: at most ``ranges`` rows on the driver.
    held = {r[0]: (r[1], r[2]) for r in rows.groupBy("_range").agg(F.count("*"), F.sum("_size")).collect()}
    share = max(1, total // ranges)
    parts, row_offset, size_offset, at_row, at_size = [], [], [], 0, 0
    for k in range(len(bounds) + 1):
        count, weight = held.get(k, (0, 0))
        parts.append(_parts(count, weight, share, leaf_rows))
        row_offset.append(at_row)
        size_offset.append(at_size)
        at_row, at_size = at_row + count, at_size + weight
    edges = [0, *bounds, 1 << 52]
    nth = F.col("_range") + 1
    low, high = F.element_at(longs(edges[:-1]), nth), F.element_at(longs(edges[1:]), nth)
    parts_of = F.element_at(longs(parts), nth)
    # Overfull ranges are cut into equal widths of the key.
    rows = rows.withColumn("_part", F.least(parts_of - 1, F.floor((F.col("_key") - low).cast("double") / F.greatest(high - low, F.lit(1)) * parts_of)))
    # One key alone may still overfill its part; such parts are few (each holds over 1/RANGES of the sizes or LEAF_ROWS rows).
    again = rows.groupBy("_range", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_w"))
    again = again.where((F.col("_n") > 2 * leaf_rows) | (F.col("_w") > 2 * share)).select("_range", "_part", F.ceil(F.greatest(F.col("_n") / leaf_rows, F.col("_w") / share)).alias("_times"))
    if n / leaf_rows + ranges <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, ["_range", "_part"], "left").withColumn("_sub", F.pmod(F.col("_tie"), F.coalesce("_times", F.lit(1))))
    leaf = ["_range", "_part", "_sub"]
    before = Window.partitionBy("_range").orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    leaves = rows.groupBy(*leaf).agg(F.count("*").alias("_n"), F.sum("_size").alias("_w")).select(
        *leaf,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.element_at(longs(row_offset), nth)).alias("_first"),
        F.least(F.lit(n_shards - 1), F.floor((F.coalesce(F.sum("_w").over(before), F.lit(0)) + F.element_at(longs(size_offset), nth) + F.col("_w") / 2) * n_shards / total)).cast("int").alias("shard"),
    )
    starts = leaves.groupBy("shard").agg(F.min("_first").alias("_start"))  # n_shards rows
    leaves = leaves.join(F.broadcast(starts), "shard")
    inside = Window.partitionBy(*leaf).orderBy("_key", "_tie", "_size")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(leaves, leaf).select(*unpacked(rows, names), "shard", (F.col("_first") - F.col("_start") + F.col("_at")).alias("slot"))


def _parts(count: int, weight: int, share: int, leaf_rows: int) -> int:
    if count <= 2 * leaf_rows and weight <= 2 * share:
        return 1
    return max(1, -(-count // leaf_rows), -(-weight // share))
