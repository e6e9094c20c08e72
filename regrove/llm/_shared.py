"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a key table is small enough to broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session may do without it and gets a temporary one; on a cluster that raises."""
    sc = spark.sparkContext
    if not (folder := sc.getCheckpointDir()):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="regrove-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir() or folder
    return folder


#: Tables that ``written`` made and ``forget`` has not deleted, in order.
MADE: list[str] = []


def forget(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables that ``written`` made after the first ``since`` of MADE, but those that it returned as ``keep``."""
    held = {getattr(df, "written_to", None) for df in keep}
    for path in [p for p in MADE[since:] if p not in held]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        MADE.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    The files go with ``forget``, or when the driver's JVM closes its file systems. A garbage collection lets Spark's cleaner
    drop the shuffle files of what is now written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/regrove-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now: it works on what the collector found the time before."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch holds, where the session leaves that at its default: a batch is held in the JVM and in Python at once."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that outputs of these names replace (names compare as Spark does, without case)."""
    low = {n.lower() for n in names}
    return df.select([c for c in map(quoted, df.columns) if c.strip("`").lower() not in low])


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def packed(df: DataFrame, *drop: str) -> Column:
    """All columns of ``df`` (less ``drop``) as one struct, so that no working column can clash with them."""
    low = {n.lower() for n in drop}
    keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in low]
    return F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("_"))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` that can be hashed: all but those that hold maps or variants."""
    return [F.col(quoted(n)) for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def unpacked(df: DataFrame, names: list[str], row: str = "_row") -> list[Column]:
    return [F.col(row).getField(n).alias(n) for n in names]


def kept_names(df: DataFrame, *drop: str) -> list[str]:
    low = {n.lower() for n in drop}
    return [c for c in df.columns if c.lower() not in low]


def word_count(text: Column) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, label: str, seed: int, most: int, most_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """(texts, labels 0 or 1) of documents chosen by a hash of the id: at most about ``most``, and ``most_bytes`` of text; in order of id, label and text.

    Documents with more than a quarter of ``most_bytes`` are not chosen.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col(label).cast("int").alias("_label"))
    share = min(1.0, most / max(1, known.count()))
    text = F.col("text").cast("string")
    docs = docs.where(F.octet_length(F.coalesce(text, F.lit(""))) <= most_bytes // 4).select("doc_id", text.alias("text"))

    def chosen(share: float) -> DataFrame:
        lot = unit(F.lit(seed), F.col("doc_id")) < share
        return docs.where(lot).join(known.where(lot), "doc_id")

    size = chosen(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = chosen(share * min(1.0, most_bytes / max(1, size))).orderBy("doc_id", "_label", "text").toArrow()
    return rows.column("text").combine_chunks(), rows.column("_label").to_numpy()


def unit(*cols: Column) -> Column:
    """A number in [0, 1) hashed from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def longs(values: list[int]) -> Column:
    """A constant array of longs, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def rank_in(key: Column, bounds: list, held: Column | None = None) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: a binary search inside the row. ``held``: the bounds as an array, if they are not integers."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = longs(bounds) if held is None else held
    fits = lambda at, step: (at + step <= len(bounds)) & (F.get(held, at + step - 1) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def pack(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def unpack(x: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(x[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()
