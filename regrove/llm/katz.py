"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

Texts are kept as blocks of about ``BLOCK_TOKENS`` tokens in a table bucketed by block. Counting is an exchange:
each block sends its distinct n-grams (packed, a binary per part of the key space), each part adds them up and
answers every block with the totals of what it asked for. So shuffles carry a few bytes for each distinct n-gram of a
block (a row holds those that a block and a part share, so there are never more rows than distinct n-grams of blocks), and the blocks
themselves are never shuffled: answers are joined to them by bucket. A token is scored recursively inside its block, from the totals and
the backoff weights of its n-grams. ``fit_katz`` keeps the model as two tables by level and part, with which ``score_katz`` scores any texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _textnp as tn
from ._shared import pack, released, small_batches, unpack, written

BLOCK_TOKENS = 1_000_000
#: Tokens of the input for each part of the key space.
PART_TOKENS = 2_000_000
#: Counts up to this are discounted.
K = 5
END, BEGIN = np.uint64(0xE0D), np.uint64(0xB0B)
#: Mass kept for unseen words where no count of a history is discounted, as a count.
LEAST = 0.5


@dataclass
class Level:
    keys: np.ndarray  # sorted, of the block's distinct n-grams
    of: np.ndarray  # of each token: its n-gram
    history: np.ndarray  # of each n-gram: its history among the n-grams below, or -1 at the beginning of a text
    counts: np.ndarray  # in the block's training texts

    def history_keys(self, below: Level) -> np.ndarray:
        """Keys of the distinct histories; the last is the beginning of a text."""
        return np.append(below.keys, BEGIN)


def levels(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray, order: int) -> list[Level]:
    """The n-grams of a block, n from 1 to ``order``."""
    learned = np.repeat(train, sizes)
    first = np.zeros(len(tokens), bool)
    first[(np.cumsum(sizes) - sizes).astype(int)] = True
    out = [Level(words, tokens, np.full(len(words), -1), np.bincount(tokens[learned], minlength=len(words)))]
    for n in range(2, order + 1):
        below = out[-1]
        before = np.empty(len(tokens), np.int64)
        before[1:] = below.of[:-1]
        before[first] = -1
        codes, of = np.unique((before + 1) * np.int64(len(words)) + tokens, return_inverse=True)
        history, last = codes // len(words) - 1, codes % len(words)
        keys = tn.mixed(below.history_keys(below)[history] * tn.BASE + words[last] + np.uint64(n))
        place = np.argsort(keys, kind="stable")
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        of = rank[of]
        out.append(Level(keys[place], of, history[place], np.bincount(of[learned], minlength=len(keys))))
    return out


def blocks(docs: DataFrame, doc: str, text: str, train: str) -> DataFrame:
    """A row for each block of texts: ids, whether they are learnt from, token counts, distinct words and tokens."""
    kind = dict(docs.select(F.col(doc)).dtypes)[doc]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, learnt, sizes, found, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(found), return_inverse=True)
            lists = [pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type)), pa.array([np.concatenate(learnt)], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([base + made]), *lists, pa.array([pack(words)]), pa.array([pack(tokens.astype(np.int32))])], ["block", "docs", "train", "sizes", "words", "tokens"])

        for batch in batches:
            for a, b, data, offsets in tn.chunks(batch.column(1)):
                w = tn.words(data, offsets)
                n = np.diff(w.first)
                tokens = np.insert(w.hashes(), w.first[1:], END)
                ids.append(batch.column(0).slice(a, b - a))
                learnt.append(np.asarray(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), bool))
                sizes.append((n + 1).astype(np.int32))
                found.append(tokens)
                held += len(tokens)
                if held >= BLOCK_TOKENS:
                    yield block()
                    made += 1
                    ids, learnt, sizes, found, held = [], [], [], [], 0
        if ids:
            yield block()

    schema = f"block long, docs array<{kind}>, train array<boolean>, sizes array<int>, words binary, tokens binary"
    return docs.select(F.col(doc), F.col(text).cast("string"), F.col(train)).mapInArrow(cut, schema)


def opened(row: dict, order: int) -> list[Level]:
    return levels(unpack(row["words"], np.uint64), unpack(row["tokens"], np.int32).astype(np.int64), np.array(row["sizes"], np.int64), np.array(row["train"], bool), order)


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys, by their leading bits; only parts that have some."""
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(parts, prepend=-1)) if len(parts) else np.zeros(0, int)
    for a, b in zip(cuts, [*cuts[1:], len(parts)]):
        yield int(parts[a]), int(a), int(b)


ASK = "level int, part int, block long, keys binary, a binary, b binary, c binary"
TOLD = "level int, part int, block long, a binary, b binary, stats array<double>"
#: Blocks of rows that are for the model and not for a block: counts of counts, and a part's n-grams (in ``stats``' place none).
STATS, KEPT = -1, -2
KEPT_TOLD = TOLD + ", keys binary"
#: Marks of an n-gram in a block.
SPEAKS, SHARED = np.uint8(1), np.uint8(2)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(list(column), kinds[kind]) for (name, kind), column in zip(fields, columns)})


def counts_asked(wanted: range, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = opened(row, wanted[-1])
                for n in wanted:
                    level = held[n - 1]
                    rows = [(n, p, row["block"], pack(level.keys[a:b]), pack(level.counts[a:b].astype(np.int64)), b"", b"") for p, a, b in slices(level.keys, bits)]
                    yield from table_of(rows, ASK).to_batches()

    return ask


def gathered(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys of all rows, of each key of each row: which, where each row's begin): with few copies of the keys at a time."""
    parts = [unpack(r.pop("keys"), np.uint64) for r in rows]
    begins = np.concatenate([[0], np.cumsum([len(k) for k in parts])]).astype(int)
    keys = np.concatenate(parts)
    del parts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], of, begins


def count_part(keep: bool):
    """``keep``: with a row of the part's n-grams that were seen, for the model's table."""

    def count(table: pa.Table) -> pa.Table:
        out = _count_part(table, keep)
        tn.trim()
        return out

    return count


def _count_part(table: pa.Table, keep: bool) -> pa.Table:
    """Totals of a part's n-grams for each block that asked, marks (whether it is the one to speak for an n-gram, and whether others have it too), and counts of counts."""
    rows = sorted(table.select(["level", "part", "block", "keys", "a"]).to_pylist(), key=lambda r: r["block"])
    found, of, begins = gathered(rows)
    counts = np.concatenate([unpack(r.pop("a"), np.int64).astype(np.int32) for r in rows])
    totals = np.bincount(of, counts, minlength=len(found)).astype(np.int64)
    marks = np.where(np.bincount(of, minlength=len(found)) > 1, SHARED, np.uint8(0))[of]
    # The first block that has seen an n-gram speaks for it.
    has = np.flatnonzero(counts > 0)[::-1].astype(np.int32)
    first = np.full(len(found), -1, np.int32)
    first[of[has]] = has
    marks[first[first >= 0]] |= SPEAKS
    del counts, has, first
    out = []
    for r, a, b in zip(rows, begins, begins[1:]):
        out.append((r["level"], r["part"], r["block"], pack(totals[of[a:b]]), pack(marks[a:b]), None, None))
    if keep:
        there = totals > 0
        out.append((rows[0]["level"], rows[0]["part"], KEPT, pack(totals[there]), None, None, pack(found[there])))
    seen = totals[totals > 0]
    stats = [float(len(seen)), float(seen.sum()), *np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1 : K + 2].astype(float).tolist()]
    return table_of([*out, (rows[0]["level"], rows[0]["part"], STATS, None, None, stats, None)], KEPT_TOLD)


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 1 to K from counts of counts 1 to K + 1.

    Where copied texts make these too uneven for discounts between 0 and 1, a straight line through their logarithms
    takes their place; where that is no good either, discounts are absolute.
    """
    n, r = np.asarray(of_counts, float), np.arange(1, K + 2)
    for smooth in (False, True):
        with np.errstate(all="ignore"):
            if smooth:
                n = np.exp(np.polyval(np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1), np.log(r))) if (n > 0).sum() > 1 else n
            tail = (K + 1) * n[K] / n[0]
            d = ((r[1:] * n[1:]) / (r[:-1] * n[:-1]) - tail) / (1 - tail)
        if np.all(np.isfinite(d)) and np.all(d > 0) and np.all(d < 1):
            return d
    n = np.asarray(of_counts, float)
    share = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return (r[:-1] - share) / r[:-1]


@dataclass
class Model:
    """What all blocks share: of each level the discounts; tokens, distinct tokens and mass of unseen ones."""

    order: int
    discount: list[np.ndarray]
    tokens: float
    kinds: float
    unseen: float

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.append(np.append(1.0, self.discount[n - 1]), 1.0)[np.minimum(counts, K + 1)]

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; all unseen words share what the seen ones leave."""
        return np.where(counts > 0, self.discounted(1, counts) / max(1.0, self.tokens), self.unseen)


def model_of(told: DataFrame, order: int) -> Model:
    stats = {r["level"]: np.array([r[f"s{k}"] for k in range(K + 3)]) for r in told.where(F.col("block") == STATS).groupBy("level").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(K + 3)]).collect()}
    discount = [discounts(stats[n][2:] if n in stats else np.zeros(K + 1)) for n in range(1, order + 1)]
    kinds, tokens, *of_counts = stats.get(1, np.zeros(K + 3))
    lost = sum((1 - d) * r * n for r, d, n in zip(range(1, K + 1), discount[0], of_counts))
    model = Model(order, discount, tokens, kinds, lost / tokens if tokens else 1.0)
    if tokens and not lost:  # no word is rare: keep a little
        model.tokens, model.unseen = tokens + LEAST, LEAST / (tokens + LEAST)
    return model


def told_to(right: pa.Table, level: int, kinds: tuple[type, type]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r for r in right.to_pylist() if r["level"] == level), key=lambda r: r["part"])
    return tuple(np.concatenate([unpack(r[c], k) for r in rows]) if rows else np.zeros(0, k) for c, k in zip("ab", kinds))


def evaluated(row: dict, right: pa.Table, model: Model, upto: int, local: bool) -> tuple[list[Level], list[np.ndarray], list[np.ndarray]]:
    """(levels, totals, probability of each n-gram's last word after its history), for n up to ``upto``.

    ``local``: a history that no other block has is weighed here, for all that follows it stands in this block.
    """
    held = opened(row, model.order)
    told = [told_to(right, n, (np.int64, np.uint8)) for n in range(1, model.order + 1)]
    totals = [t for t, _ in told]
    p = [model.words(totals[0])]
    for n in range(2, upto + 1):
        level, below = held[n - 1], held[n - 2]
        past = histories(level, below, told[n - 2][1], local)
        lower = p[n - 2][shorter(level, below)]
        weight, total = np.ones(len(past.keys)), np.zeros(len(past.keys))  # backoff weight; count, negative if none is discounted
        weight[past.asked], total[past.asked] = told_to(right, -n, (np.float64, np.float64))
        if local:
            here = ~past.asked
            sums = [np.bincount(past.of, x, minlength=len(past.keys))[here] for x in spoken(model, n, totals[n - 1], lower, totals[n - 1] > 0)]
            weight[here], total[here] = weighed(*sums)
        weight, total = weight[past.of], total[past.of]
        size = np.abs(total)
        seen = model.discounted(n, totals[n - 1]) / np.maximum(np.where(total < 0, size + LEAST, size), 1e-300)
        p.append(np.where(totals[n - 1] > 0, seen, weight * lower))
    return held, totals, p


def shorter(level: Level, below: Level) -> np.ndarray:
    """Of each n-gram the one below: the same last word after the history without its first word."""
    out = np.zeros(len(level.keys), np.int64)
    out[level.of] = below.of
    return out


def spoken(model: Model, n: int, totals: np.ndarray, lower: np.ndarray, speaks: np.ndarray) -> list[np.ndarray]:
    """What each n-gram adds to its history's count, discounted counts, and probabilities one level below."""
    return [np.where(speaks, x, 0.0) for x in (totals, model.discounted(n, totals), lower)]


def weighed(count: np.ndarray, kept: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, count or less it if none is discounted) of histories: what the discounts leave, over what their unseen words have one level below."""
    bare = (count > 0) & (kept > count * (1 - 1e-12))
    size = np.where(bare, count + LEAST, count)
    with np.errstate(all="ignore"):
        weight = np.where(count > 0, (1 - kept / size) / np.maximum(1 - below, 1e-300), 1.0)
    return weight, np.where(bare, -count, count)


@dataclass
class Past:
    keys: np.ndarray  # sorted, of the block's distinct histories
    of: np.ndarray  # of each n-gram: which
    asked: np.ndarray  # whether its weight is asked for


def histories(level: Level, below: Level, marks: np.ndarray, local: bool) -> Past:
    keys, first, of = np.unique(level.history_keys(below)[level.history], return_index=True, return_inverse=True)
    asked = np.ones(len(keys), bool)
    if local:
        at = level.history[first]
        asked[at >= 0] = (marks[at[at >= 0]] & SHARED) > 0
    return Past(keys, of, asked)


def weights_asked(model: Model, n: int, bits: int, local: bool):
    """Each block speaks for some n-grams: for each history that others may have, the sums of what these add."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            held, totals, p = evaluated(row, right, model, n - 1, local)
            level, below = held[n - 1], held[n - 2]
            speaks = (told_to(right, n, (np.int64, np.uint8))[1] & SPEAKS) > 0
            past = histories(level, below, told_to(right, n - 1, (np.int64, np.uint8))[1], local)
            adds = spoken(model, n, totals[n - 1], p[n - 2][shorter(level, below)], speaks)
            sums = [np.bincount(past.of, x, minlength=len(past.keys))[past.asked] for x in adds]
            keys = past.keys[past.asked]
            out += [(-n, part, row["block"], pack(keys[a:b]), *(pack(s[a:b]) for s in sums)) for part, a, b in slices(keys, bits)]
            del held, totals, p, adds, sums
            tn.trim()
        return table_of(out, ASK)

    return ask


def weigh_part(keep: bool):
    def weigh(table: pa.Table) -> pa.Table:
        out = _weigh_part(table, keep)
        tn.trim()
        return out

    return weigh


def _weigh_part(table: pa.Table, keep: bool) -> pa.Table:
    """Backoff weight and count of each history, for each block that asked."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    found, of, begins = gathered(rows)
    count, kept, below = (np.bincount(of, np.concatenate([unpack(r.pop(c), np.float64) for r in rows]), minlength=len(found)) for c in "abc")
    weight, told = weighed(count, kept, below)
    out = [(r["level"], r["part"], r["block"], pack(weight[of[a:b]]), pack(told[of[a:b]]), None, None) for r, a, b in zip(rows, begins, begins[1:])]
    if keep:
        there = count > 0
        out.append((rows[0]["level"], rows[0]["part"], KEPT, pack(weight[there]), pack(told[there]), None, pack(found[there])))
    return table_of(out, KEPT_TOLD)


def looked_up(asked: np.ndarray, keys: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    """Values of the asked keys; ``other`` for those that are not there."""
    if not len(keys):
        return np.full(len(asked), other, values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other).astype(values.dtype)


def told_by_tables(left: pa.Table, right: pa.Table) -> pa.Table:
    """What blocks ask of a part, answered from the model's tables."""
    rows = right.to_pylist()
    out = []
    keys = unpack(rows[0]["keys"], np.uint64) if rows else np.zeros(0, np.uint64)
    for r in left.to_pylist():
        asked = unpack(r["keys"], np.uint64)
        if r["level"] > 0:
            counts = unpack(rows[0]["a"], np.int64) if rows else np.zeros(0, np.int64)
            out.append((r["level"], r["part"], r["block"], pack(looked_up(asked, keys, counts, 0)), pack(np.full(len(asked), SHARED)), None))
        else:
            weights, counts = (unpack(rows[0][c], np.float64) if rows else np.zeros(0) for c in "ab")
            out.append((r["level"], r["part"], r["block"], pack(looked_up(asked, keys, weights, 1.0)), pack(looked_up(asked, keys, counts, 0.0)), None))
    return table_of(out, TOLD)


def all_asked(order: int, bits: int):
    """Keys of a block's n-grams, and of the histories of each level."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = opened(row, order)
                asked = [(n, level.keys) for n, level in enumerate(held, 1)] + [(-n, histories(held[n - 1], held[n - 2], np.zeros(0, np.uint8), False).keys) for n in range(2, order + 1)]
                for n, keys in asked:
                    yield from table_of([(n, p, row["block"], pack(keys[a:b]), b"", b"", b"") for p, a, b in slices(keys, bits)], ASK).to_batches()

    return ask


def score_block(model: Model, kind: str, local: bool):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for k, row in enumerate(left.select(["block", "train", "sizes", "words", "tokens"]).to_pylist()):
            held, totals, p = evaluated(row, right, model, model.order, local)
            sizes = np.array(row["sizes"], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            counts = totals[0][held[0].of]
            n = model.tokens - (LEAST if model.tokens != int(model.tokens) else 0)
            base = np.log10((counts + 0.1) / (n + 0.1 * (model.kinds + 1)))
            columns = [tn.per_text((counts > 0).astype(float), first).round().astype(np.int64), np.full(len(sizes), int(n)), tn.per_text(base, first), tn.per_text(np.log10(p[-1])[held[-1].of], first)]
            docs = left.column("docs").combine_chunks().slice(k, 1).flatten()
            out.append(pa.table([docs, pa.array(~np.array(row["train"], bool)), pa.array(sizes), *map(pa.array, columns)], SCORES))
            del held, totals, p, counts, base
            tn.trim()
        return pa.concat_tables(out)

    return score


SCORES = ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@dataclass
class Tables:
    """A model: ``ngrams`` (level, part, keys, a: counts) and ``backoffs`` (level -n of the n-grams whose histories they weigh, part, keys, a: weights, b: counts).

    A row for each level and part: keys sorted, in packed arrays; a part holds the keys of one range of hashes.
    """

    model: Model
    bits: int
    ngrams: DataFrame
    backoffs: DataFrame | None


def _blocked(docs: DataFrame, doc: str, text: str, train: str, work: Callable[[DataFrame], object]) -> object:
    """``work`` on the blocks of ``docs`` as a table bucketed by block, which is dropped afterwards."""
    spark = docs.sparkSession
    small_batches(spark)
    name = f"regrove_katz_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = blocks(docs.withColumn(train, F.coalesce(F.col(train), F.lit(False))), doc, text, train)
    cut.write.bucketBy(buckets, "block").sortBy("block").format("parquet").saveAsTable(name)
    try:
        return work(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _by_block(held: DataFrame, answers: DataFrame):  # noqa: ANN202
    return held.groupBy("block").cogroup(answers.groupBy("block"))


def _learnt(held: DataFrame, order: int, keep: bool) -> tuple[Model, int, DataFrame, list[DataFrame], list[DataFrame]]:
    """(model, bits of a part, answers to all blocks, tables of counts and of weights, with the model's rows if they are kept, which asks for the weights of all histories)."""
    spark = held.sparkSession
    n_tokens = held.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = max(0, (max(1, n_tokens // PART_TOKENS) - 1).bit_length())
    kept = []
    # Single words go with pairs; of longer ones there are so many that each length has an exchange of its own.
    for wanted in [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]:
        asked = held.mapInArrow(counts_asked(wanted, bits), ASK)
        kept.append(written(asked.groupBy("level", "part").applyInArrow(count_part(keep), KEPT_TOLD), "counts"))
        del asked
        released(spark)
    told = reduce(DataFrame.union, kept)
    model = model_of(told, order)
    answers = told.where("block >= 0").drop("keys")
    counts = len(kept)
    for n in range(2, order + 1):
        asked = _by_block(held, answers).applyInArrow(weights_asked(model, n, bits, not keep), ASK)
        kept.append(written(asked.groupBy("level", "part").applyInArrow(weigh_part(keep), KEPT_TOLD), "weights"))
        answers = answers.union(kept[-1].where("block >= 0").drop("keys"))
        del asked
        released(spark)
    return model, bits, answers, kept[:counts], kept[counts:]


def _scores(docs: DataFrame, doc: str, model: Model, held: DataFrame, answers: DataFrame, local: bool) -> DataFrame:
    kind = dict(docs.select(F.col(doc)).dtypes)[doc]
    schema = f"doc {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return written(_by_block(held, answers).applyInArrow(score_block(model, kind, local), schema), "scores").withColumnRenamed("doc", doc)


def katz_scores(docs: DataFrame, train: str, *, doc: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by a model of the texts for which ``train`` holds.

    Tokens: words (A-Z as a-z, split at ASCII white space), then one end. Counts up to K are Good-Turing discounted; what seen words leave goes to
    unseen ones in proportion to the next lower order, so that the words of the vocabulary and one unknown word have
    a sum of 1 after every history. ``score`` and ``base_score`` (single tokens with 0.1 added to every count) are log10 of the text's probability. Null and empty texts are an
    end alone; null ``train``: not learnt from. Repeated rows count and are returned each. Without training texts every token is unknown. No rows: no rows.
    """

    def work(held: DataFrame) -> DataFrame:
        model, _, answers, *_ = _learnt(held, order, False)
        return _scores(docs, doc, model, held, answers, True)

    return _blocked(docs, doc, text, train, work)


def fit_katz(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", order: int = 2) -> Tables:
    """The model of all texts of ``docs``, as tables in the shared folder."""

    def work(held: DataFrame) -> Tables:
        model, bits, _, counts, weights = _learnt(held, order, True)
        mine = lambda tables: reduce(DataFrame.union, [t.where(F.col("block") == KEPT).select("level", "part", "keys", "a", "b") for t in tables])
        return Tables(model, bits, mine(counts), mine(weights) if weights else None)

    return _blocked(docs.withColumn("_train", F.lit(True)), doc, text, "_train", work)


def score_katz(docs: DataFrame, tables: Tables, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``katz_scores``, of any texts by a model that ``fit_katz`` made; all are held out."""

    def work(held: DataFrame) -> DataFrame:
        asked = held.mapInArrow(all_asked(tables.model.order, tables.bits), ASK)
        known = tables.ngrams if tables.backoffs is None else tables.ngrams.union(tables.backoffs)
        answers = asked.groupBy("level", "part").cogroup(known.groupBy("level", "part")).applyInArrow(told_by_tables, TOLD)
        return _scores(docs, doc, tables.model, held, written(answers, "answers"), False)

    return _blocked(docs.withColumn("_train", F.lit(False)), doc, text, "_train", work)
