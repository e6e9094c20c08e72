"""Document fingerprints by closed syncmers: windows of k tokens whose minimal inner s-token substring lies at an edge.

Whether a window is chosen depends on its own tokens only, so the same passage gives the same anchors wherever it
stands, about 2 / (k - s + 1) of its windows. Before a text stand k - 1 blanks, whose inner substrings count as least, so that
the first windows are anchors and texts shorter than a window have some. Anchors are matched by their positions: those of
two texts that agree in their hash and lie on one diagonal. Only DataFrame functions are used; a text is handled inside its row, without exploding it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import kept_names, packed, quoted, rank_in, unpacked

#: Tokens of a window, and of its inner substrings.
K, S = 8, 2
#: Bits of an anchor's hash.
HASH_BITS = 48
#: Diagonals (position in one text less position in the other) that a band holds; bands overlap by halves.
BAND = 32
#: Rows of one range of ids, and ranges at most: from RANGE_ROWS * MAX_RANGES rows on, ranges grow with the input.
RANGE_ROWS, MAX_RANGES, MAX_OTHER_RANGES = 4096, 10_000, 500


def tokens(text: Column, unit: str = "word") -> Column:
    """Words (runs of anything but ASCII white space) or, with ``unit`` "char", code points; null or blank: none."""
    if unit == "char":
        return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def padded(words: Column, k: int = K) -> Column:
    """The tokens after k - 1 blanks; no tokens: none."""
    return F.when(F.size(words) > 0, F.concat(F.array_repeat(F.lit(""), k - 1), words)).otherwise(words)


def inner_hashes(words: Column, s: int = S) -> Column:
    """A hash of every run of ``s`` tokens; of blanks only: the least number."""
    n = F.size(words) - (s - 1)
    hashed = lambda i: F.when(F.get(words, i + (s - 1)) == "", F.lit(-(1 << 63))).otherwise(F.xxhash64(*[F.get(words, i + j) for j in range(s)]))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), hashed)).otherwise(F.array().cast("array<bigint>"))


def closed_syncmers(inner: Column, k: int = K, s: int = S) -> Column:
    """(at, hash) of each window of ``k`` tokens whose minimal inner hash is its first or its last; ``at``: its last token, from 0."""
    width = k - s + 1
    n = F.size(inner) - (width - 1)
    at = lambda i, j: F.get(inner, i + j)

    def edge(i: Column) -> Column:
        ends = F.least(at(i, 0), at(i, width - 1))
        if width == 2:
            return F.lit(True)
        middle = F.least(*[at(i, j) for j in range(1, width - 1)]) if width > 3 else at(i, 1)
        return ends <= middle

    # Inner hashes s tokens apart, and the last, cover the whole window.
    cover = sorted({*range(0, width, s), width - 1})
    window = lambda i: F.struct(i.alias("at"), F.shiftrightunsigned(F.xxhash64(*[at(i, j) for j in cover]), 64 - HASH_BITS).alias("hash"))
    some = F.transform(F.filter(F.sequence(F.lit(0), n - 1), edge), window)
    return F.when(n > 0, some).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def fingerprint_text(anchors: Column) -> Column:
    """All anchors in order as ``position:hash`` in hexadecimal, comma-separated."""
    return F.array_join(F.transform(anchors, lambda a: F.concat_ws(":", F.hex(a["at"].cast("long")), F.hex(a["hash"]))), ",")


def likeness(both: Column, a: Column, b: Column) -> Column:
    """How many anchors of a and b agree in hash and lie in one band of diagonals, the best, as a part of all.

    ``a`` and ``b``: the first anchor of each hash; ``both``: sorted differences in position of those they share. Two texts without anchors are alike, one without and another are not.
    """
    start = F.struct(*[F.lit(0).alias(n) for n in ("best", "low", "n_low", "high", "n_high")], F.lit(False).alias("any"))

    def step(held: Column, d: Column) -> Column:
        low, high = F.floor(d / BAND).cast("int"), F.floor((d + BAND // 2) / BAND).cast("int")
        n_low = F.when(held["any"] & (held["low"] == low), held["n_low"] + 1).otherwise(1)
        n_high = F.when(held["any"] & (held["high"] == high), held["n_high"] + 1).otherwise(1)
        return F.struct(F.greatest(held["best"], n_low, n_high).alias("best"), low.alias("low"), n_low.alias("n_low"), high.alias("high"), n_high.alias("n_high"), F.lit(True).alias("any"))

    best = F.aggregate(both, start, step, lambda held: held["best"])
    return F.coalesce(F.try_divide(best.cast("double"), (F.size(a) + F.size(b) - best).cast("double")), F.lit(1.0))


def fingerprints(df: DataFrame, texts: dict[str, Column], *, k: int = K, s: int = S, unit: str = "word") -> DataFrame:
    """``df`` with, for each named text, ``<name>_anchors`` (array of at, hash).

    Equal texts have equal anchors; null texts count as empty and have none. Texts of any length stay within
    their row. Repeated rows are handled one by one. Input columns named like an output are replaced.
    """
    outs = [f"{n}_anchors" for n in texts]
    names = kept_names(df, *outs)
    out = _anchored(df.select(packed(df, *outs).alias("_row"), *[c.alias(f"_{n}_text") for n, c in texts.items()]), {o: f"_{n}_text" for o, n in zip(outs, texts)}, k, s, unit)
    return out.select(*unpacked(out, names), *outs)


def _anchored(df: DataFrame, texts: dict[str, str], k: int, s: int, unit: str) -> DataFrame:
    """``df`` with the anchors of each text column, under the names given; step by step, so that no step is computed twice."""
    held = df.columns
    steps = [(lambda c: tokens(c, unit)), (lambda c: padded(c, k)), (lambda c: inner_hashes(c, s)), (lambda c: closed_syncmers(c, k, s))]
    of = dict(texts)
    for n, step in enumerate(steps):
        last = n == len(steps) - 1
        df = df.select(*held, *[step(F.col(of[o])).alias(o if last else f"_{n}_{o}") for o in texts])
        of = {o: f"_{n}_{o}" for o in texts}
    return df


def alike(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with, for each name in ``pairs``, the likeness of two columns of anchors. Input columns named like an output are replaced."""
    names = kept_names(df, *pairs)
    sides = sorted({c for pair in pairs.values() for c in pair})
    out = df.select(packed(df, *pairs).alias("_row"), *[F.array_sort(F.transform(F.col(quoted(c)), lambda a: F.struct(a["hash"].alias("hash"), a["at"].alias("at")))).alias(f"_{c}") for c in sides])
    new = lambda c: F.filter(F.col(f"_{c}"), lambda a, i: (i == 0) | (F.get(F.col(f"_{c}"), i - 1)["hash"] != a["hash"]))
    out = out.select("_row", *[new(c).alias(f"_{c}") for c in sides])
    side = lambda c, n: F.transform(F.col(f"_{c}"), lambda e: F.struct(e["hash"].alias("hash"), F.lit(n).alias("side"), e["at"].alias("at")))
    out = out.select("*", *[F.array_sort(F.concat(side(a, 0), side(b, 1))).alias(f"_{n}_both") for n, (a, b) in pairs.items()])

    def shared(both: Column) -> Column:  # neighbours of equal hash: one of either text
        next_ = lambda i: F.get(both, i + 1)
        at = F.filter(F.sequence(F.lit(0), F.size(both) - 1), lambda i: (F.get(both, i)["side"] == 0) & (F.get(both, i)["hash"] == next_(i)["hash"]))
        return F.when(F.size(both) > 1, F.array_sort(F.transform(at, lambda i: next_(i)["at"] - F.get(both, i)["at"]))).otherwise(F.array().cast("array<int>"))

    out = out.select("_row", *[f"_{c}" for c in sides], *[shared(F.col(f"_{n}_both")).alias(f"_{n}_both") for n in pairs])
    return out.select(*unpacked(out, names), *[likeness(F.col(f"_{n}_both"), F.col(f"_{a}"), F.col(f"_{b}")).alias(n) for n, (a, b) in pairs.items()])


def with_next(df: DataFrame, order: str, text: str, name: str = "next_text", *, anchors: str | None = None, k: int = K, s: int = S, unit: str = "word", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the text of the row that follows in ``order`` (ties by text; null first), after the last that of the first.

    Rows go to ranges of ``order`` and are followed up within each; the first row of each range is handed to the range before,
    so no task sees more than its range. ``order`` may have any numeric type; ids of other types are ranged by a sample of them. An only row is followed by itself. Equal rows follow one another. No rows: no rows.
    ``anchors``: the name of a column for the text's own anchors; the next text's are then in another, with ``next_`` before. Each text is fingerprinted once.
    """
    added = [name, *([anchors, f"next_{anchors}"] if anchors else [])]
    names = kept_names(df, *added)
    slim = [c for c in names if c.lower() != text.lower()]
    ids = df.select(F.col(order).alias("_id"))
    n, low = ids.agg(F.count("*"), F.min("_id")).first()
    if not n:
        kind = "array<struct<at:int,hash:bigint>>"
        return df.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias(name), *[F.lit(None).cast(kind).alias(c) for c in added[1:]])
    m = min(MAX_RANGES, max(1, n // range_rows))
    kind = ids.schema["_id"].dataType
    if isinstance(kind, IntegralType):
        cuts = ids.agg(F.percentile_approx("_id", F.lit([k / m for k in range(1, m)]), F.lit(10 * m)).alias("cuts")).first()[0] if m > 1 else []
        bounds = sorted({int(x) for x in cuts or [] if x > low})
        where = F.coalesce(rank_in(F.col("_id"), bounds), F.lit(0))
    else:
        m = min(m, MAX_OTHER_RANGES)
        drawn = ids.where("_id is not null").sample(min(1.0, 100 * m / n), seed=1).orderBy("_id").collect() if m > 1 else []
        bounds = sorted({drawn[k * len(drawn) // m][0] for k in range(1, m) if drawn} - {low})
        where = F.coalesce(rank_in(F.col("_id"), bounds, F.array(*[F.lit(x).cast(kind) for x in bounds])), F.lit(0)) if bounds else F.lit(0)
    rows = df.select(packed(df, text, *added).alias("_row"), F.col(order).alias("_id"), F.col(text).alias("_text")).withColumn("_range", where)
    # The first of each range, at most MAX_RANGES rows: least id, then least text.
    least = rows.groupBy("_range").agg(F.min("_id").alias("_least"), F.max(F.col("_id").isNull()).alias("_null"))
    first = rows.join(F.broadcast(least), "_range").where(F.when(F.col("_null"), F.col("_id").isNull()).otherwise(F.col("_id") == F.col("_least")))
    first = first.groupBy("_range", "_id").agg(F.min(F.struct(F.col("_text").isNotNull().alias("there"), F.col("_text").alias("text"))).alias("_first"))
    ranges = [r[0] for r in least.select("_range").orderBy("_range").collect()]
    before = {r: ranges[k - 1] for k, r in enumerate(ranges)}  # the last range gets the first row of all
    first = first.select(F.element_at(F.split(F.lit(",".join(str(before.get(k, 0)) for k in range(max(ranges) + 1))), ",").cast("array<int>"), F.col("_range") + 1).alias("_range"), F.col("_first.text").alias("_text"))
    ghosts = first.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), "_text", "_range", F.lit(1).alias("_ghost"))
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    order_by = Window.partitionBy("_range").orderBy("_ghost", F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first())
    leads = [F.lead("_text").over(order_by).alias(name)]
    if anchors:
        # After the exchange that the window needs, so that anchors are not sent.
        both = _anchored(both.repartition("_range"), {anchors: "_text"}, k, s, unit)
        leads += [F.col(quoted(anchors)), F.lead(quoted(anchors)).over(order_by).alias(f"next_{anchors}")]
    out = both.select("_row", "_text", "_ghost", *leads).where("_ghost = 0")
    columns = {c: F.col("_row").getField(c) for c in slim}
    return out.select(*[columns.get(c, F.col("_text")).alias(c) for c in names], *[F.col(quoted(c)) for c in added])
