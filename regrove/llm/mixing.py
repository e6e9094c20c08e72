"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of token counts, a cut at the budget.

Only DataFrame functions are used, and records themselves are never shuffled. A slim table of sources, sizes and random keys is summed by
bucket of the key; prefix sums of buckets, then of the keys in the one bucket where a source's budget ends, give each
source's cut: a key, up to which records are held once more. Each record is compared with its source's cut where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, hashable, kept_names, packed, unpacked, written

#: Rows of a bucket of one source, and bits of a row's hash that do not tell apart the 1,024 parts of the rows of one key and size.
BUCKET_ROWS, SUB_SHIFT = 20_000, 54
OUT = ("source_size", "target", "taken", "repeats")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets by source from (``_source``, ``_size``): weights repeat over the sources in code point order, null last.

    The targets sum to ``share`` of all sizes; none is above ``most`` times its source's size: the excess is shared
    again by weight (water-filling, solved in closed form over sources ordered by size per weight). One row a source.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    d = sizes.select("_source", "_size", w.alias("_w"), (F.col("_size") * float(most)).alias("_cap"))
    rank = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        "*",
        (F.sum("_size").over(everything) * float(share)).alias("_all"),
        F.sum("_w").over(everything).alias("_weights"),
        F.coalesce(F.sum("_cap").over(rank), F.lit(0.0)).alias("_caps"),
        F.coalesce(F.sum("_w").over(rank), F.lit(0.0)).alias("_ws"),
    )
    d = d.withColumn("_full", F.col("_cap") / F.col("_w") <= (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_ws")))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(everything), F.lit(0.0))
    level = F.try_divide(F.col("_all") - capped("_cap"), F.col("_weights") - capped("_w"))
    return d.withColumn("_level", level).select("_source", F.col("_size").alias("source_size"), F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w")).alias("target"))


def mix(df: DataFrame, source: Column, size: Column, key: Column, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``source_size``, ``target`` (its source's), ``repeats`` (times the mix holds the row) and ``taken`` (repeats * size).

    Within a source rows are ordered by the MD5 of ``key``, then key, size, and a hash of the whole row. The mix repeats the whole source as
    often as the target allows, and of the next round holds the rows whose middle lies within what is left, so that
    the taken sizes miss the target by at most half a record. Null sources are one source, last in order; null sizes
    are 0; a null key is ordered as the empty text; a record of size 0 costs nothing and is held if its place is within the cut; a source
    without any size is held once. Equal rows are counted one by one. No rows: no rows. Input columns named like an output are
    replaced. Reruns give the same mix.
    """
    names = kept_names(df, *OUT)
    out = _mixed(df, OUT, source, size, key, weights, share, most, bucket_rows)
    return out.select(*unpacked(out, names), "source_size", "target", (F.col("repeats") * F.col("_size")).cast("long").alias("taken"), "repeats")


def held(df: DataFrame, source: Column, size: Column, key: Column, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of the mix that ``mix`` describes, each as often as it is repeated, with all columns of ``df`` and no others."""
    out = _mixed(df, (), source, size, key, weights, share, most, bucket_rows).where("repeats > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_copy"))
    return out.select(*unpacked(out, df.columns))


def _mixed(df: DataFrame, drop: tuple[str, ...], source: Column, size: Column, key: Column, weights: tuple[float, ...], share: float, most: float, bucket_rows: int) -> DataFrame:
    """(_row, _size, source_size, target, repeats); _row holds the columns of ``df`` less ``drop``."""
    rows = df.select(
        packed(df, *drop).alias("_row"),
        source.cast("string").alias("_source"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
        key.alias("_id"),
        F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")).alias("_key"),
        F.xxhash64(F.lit(17), *hashable(df)).alias("_tie"),
    )
    # Never null, so that joins and windows share one partitioning.
    rows = rows.withColumn("_name", F.when(F.col("_source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("_source"))))
    slim = written(rows.drop("_row"), "slim")
    n_buckets = max(1, -(-slim.count() // bucket_rows))
    slim = slim.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * n_buckets / float(1 << 32)))
    sums = written(slim.groupBy("_name", "_source", "_bucket").agg(F.sum("_size").alias("_held")), "buckets")
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_held").alias("_size")), weights, share, most)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    name = F.when(F.col("_source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("_source")))
    targets = targets.select(name.alias("_name"), "source_size", "target", whole.alias("_whole"))
    targets = written(targets.withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0)), "targets")
    open_ = targets.where("_rest > 0").select("_name", "_rest")
    # The bucket in which the budget ends: the last that begins within it.
    cut = _last(sums.join(open_, "_name"), ["_bucket"], F.lit(0))
    cut = written(cut.select("_name", "_rest", "_bucket", F.col("_before").alias("_offset")), "cut-bucket")
    inside = slim.join(_small(cut), ["_name", "_bucket"])
    # In it, the key and size, and of rows that agree in these the part of their hashes.
    sub = F.shiftright(F.col("_tie"), SUB_SHIFT).alias("_sub")
    keys = inside.groupBy("_name", "_rest", "_offset", "_key", "_id", F.col("_size").alias("_each"), sub).agg(F.sum("_size").alias("_held"))
    cut = _last(keys, ["_key", "_id", "_each", "_sub"], F.col("_offset"))
    cut = written(cut.select("_name", "_rest", "_key", "_id", "_each", "_sub", F.col("_before").alias("_offset")), "cut-key")
    same = slim.withColumn("_sub", sub).alias("s").join(_small(cut).alias("c"), (F.col("s._name") == F.col("c._name")) & (F.col("s._key") == F.col("c._key")) & F.col("s._id").eqNullSafe(F.col("c._id")) & (F.col("s._size") == F.col("c._each")) & (F.col("s._sub") == F.col("c._sub")))
    ties = same.groupBy("c._name", "c._rest", "c._offset", "c._key", "c._id", "c._each", F.col("s._tie").alias("_tie")).agg(F.count("*").alias("_times"), F.sum("s._size").alias("_held"))
    cut = _last(ties, ["_tie"], F.col("_offset"))
    # Of the equal rows there, those whose middle lies within the rest.
    fit = F.when(F.col("_each") == 0, F.col("_times")).otherwise(F.least(F.col("_times"), F.greatest(F.lit(0), F.floor((F.col("_rest") - F.col("_before")) / F.col("_each") + 0.5))))
    cut = cut.select(F.col("_name").alias("_cut_name"), F.struct("_key", "_id", F.col("_each").alias("_size"), "_tie").alias("_cut"), fit.cast("long").alias("_fit"), F.col("_times").alias("_equal"))
    cuts = targets.join(cut, F.col("_name") == F.col("_cut_name"), "left").select(F.col("_name").alias("_of"), "source_size", "target", "_whole", "_cut", "_fit", "_equal")
    cuts = written(cuts, "cuts")
    out = rows.join(_small(cuts), F.col("_name") == F.col("_of")).withColumn("_at", F.struct("_key", "_id", "_size", "_tie"))
    more = F.coalesce((F.col("_at") < F.col("_cut")) | ((F.col("_at") == F.col("_cut")) & (F.col("_fit") == F.col("_equal"))), F.lit(False)).cast("int")
    repeats = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.col("_whole") + more).cast("int").alias("repeats")
    columns = ["_row", "_size", "source_size", "target"]
    if cuts.where("_fit > 0 and _fit < _equal").isEmpty():
        return out.select(*columns, repeats)
    # Rows that are equal in every column, of which a part fits: one of them stands for all, and its copies are dealt out.
    split = (F.col("_fit") > 0) & (F.col("_fit") < F.col("_equal")) & (F.col("_at") == F.col("_cut"))
    stand = out.where(split).groupBy("_name").agg(F.first(F.struct("_row", "_size", "source_size", "target", "_whole", "_fit", "_equal")).alias("_one")).select("_one.*")
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_equal") - 1) / bucket_rows))
    stand = stand.withColumn("_chunk", F.explode(chunk)).repartition("_chunk").withColumn("_nth", F.explode(F.sequence(F.col("_chunk") * bucket_rows, F.least((F.col("_chunk") + 1) * bucket_rows, F.col("_equal")) - 1)))
    stand = stand.select(*columns, (F.col("_whole") + (F.col("_nth") < F.col("_fit")).cast("int")).cast("int").alias("repeats"))
    return out.where(~F.coalesce(split, F.lit(False))).select(*columns, repeats).union(stand)


def _last(parts: DataFrame, order: list[str], offset: Column) -> DataFrame:
    """Of each source the last part, in order, that begins within the rest, with what was before it (``_before``)."""
    by = Window.partitionBy("_name").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = offset + F.coalesce(F.sum("_held").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).where("_before <= _rest")
    back = Window.partitionBy("_name").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return parts.withColumn("_rank", F.row_number().over(back)).where("_rank = 1").drop("_rank")


def _small(df: DataFrame) -> DataFrame:
    """A written table of a row for each source, broadcast if there are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
