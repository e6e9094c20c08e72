"""N-gram Jaccard join: count-vector R-trees bound overlaps by summed coordinate minima, exact sets verify what survives.

An R-tree over the vectors of all documents would be searched almost whole for each of them, for in so many dimensions its boxes
overlap. So documents first meet in cells: those that share one of their rarest shingles (of n, the first n - ceil(t n)
+ 1 in one common order; sets with a Jaccard of at least t share one of these). Within a cell documents are points, the
counts of their shingles by hashed group, in an R-tree; all candidates come from these trees.

Documents with equal sets are one node throughout. Cells are searched in rounds: at first each point of a large cell only
meets those of its leaf, then components of the links found so far are known and a tree looks for pairs of different
components. A cell with few such pairs gives all of them and is done; of a cell with many, each component gives its likeliest
pair and the cell is searched again once those are verified, in the last round for every pair that is still apart. So the
pairs of a round are in proportion to the points, however large a group of near copies is, and no link between components is lost.

The groups of a point are too few to tell long texts apart. Those have counts by finer groups besides, which bound the overlaps
of the pairs that a tree finds, so that whole sets of unlike texts are not exchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _textnp as tn
from ._shared import BROADCAST_ROWS, MADE, forget, pack, small_batches, unpack, written
from .components import components

#: Hashed groups of shingles: coordinates of a point.
GROUPS = 256
#: Shingles for each fine group at least, of sets with that many for each coordinate of a point; at most so many fine groups.
FINE, MOST_FINE = 2, 1 << 24
#: Bytes of fine counts that a task holds unpacked.
FINE_HELD = 1 << 25
#: Documents of a part of the input, and of all, that must share a shingle before it counts as frequent, and frequent shingles that are told
#: apart at most. They only change the order of shingles, and so how full cells are, never which pairs are found.
LOCAL_FREQUENT, FREQUENT, MOST_FREQUENT = 2, 4, 1 << 20
#: Nodes up to which a cell is one row, from which cells within others are left out.
SMALL = 256
#: Points of one tree; larger cells are dealt into blocks by size, and each pair of blocks that may hold links is a tree of its own.
BLOCK = 16_384
#: Points of a leaf, and children of an inner node.
FANOUT = 16
#: Points up to which a cell is searched whole in the first round; pairs a point for which a cell is done at once; rounds before the last.
WHOLE, FEW, ROUNDS = 64, 2, 2
#: Partners of a node that one task verifies; those of a node with more are dealt out.
PARTNERS = 1000
#: Pairs and nodes that a task remembers, so that it gives each once (a few are given again when it forgets).
REMEMBERED = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; of a text with fewer words, of the whole."""
    w = tn.words(data, offsets)
    h = w.hashes()
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled = rolled * tn.BASE + h[j : j + n]
    rolled = tn.mixed(rolled)
    out = []
    for a, b in zip(w.first, w.first[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in h[a:b]:
                whole = whole * tn.BASE + x
            out.append(tn.mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sent(hashes: np.ndarray) -> bytes:
    """A sorted set as compressed differences."""
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def received(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, np.uint64), dtype=np.uint64)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed halves of a digest; the first names a node, the second tells apart sets that share the first."""
    both = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def frequent_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, documents) of shingles that many documents of one part share; every text is read whole."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = [], set()
        for batch in batches:
            for _, _, data, offsets in tn.chunks(batch.column(0)):
                for s in shingle_sets(data, offsets, size):
                    if len(s) and (d := digest(s)) not in seen:
                        seen.add(d)
                        kept.append(s)
            if sum(map(len, kept)) > 1 << 22:
                yield counted(kept)
                kept = []
        if kept:
            yield counted(kept)

    def counted(kept: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(kept), return_counts=True)
        often = times >= LOCAL_FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["token", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy()[order].astype(np.int32)


def described(docs: DataFrame, doc: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """(doc, hash, node, check, n, prefix, point, fine): a row for each document; the last three once for each node and task, else null.

    ``hash``: of the text; ``node`` and ``check``: the digest of the set, null if it is empty; ``fine``: null of small sets.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, size))
    kind = dict(docs.select(F.col(doc)).dtypes)[doc]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            nodes, sizes, prefixes, points, fines = [], [], [], [], []
            for _, _, data, offsets in tn.chunks(batch.column(2)):
                for s in shingle_sets(data, offsets, size):
                    node = digest(s) if len(s) else (None, None)
                    nodes.append(node)
                    sizes.append(len(s))
                    if node[0] is None or node in seen:
                        prefixes.append(None)
                        points.append(None)
                        fines.append(None)
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    ordered = s
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        common = tokens[at] == s
                        if common.any():
                            ordered = s[np.lexsort((s, np.where(common, times[at], 0)))]
                    prefixes.append(ordered[: prefix_length(len(s), num, den)].view(np.int64))
                    points.append(point_bytes(s))
                    fines.append(fine_bytes(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(points, pa.binary()), pa.array(fines, pa.binary())],
                ["doc", "hash", "node", "check", "n", "prefix", "point", "fine"],
            )
        tn.trim()

    columns = docs.select(F.col(doc), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.col(text).cast("string"))
    return columns.mapInArrow(describe, f"doc {kind}, hash long, node long, check long, n long, prefix array<long>, point binary, fine binary")


def counts_of(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)


def point_bytes(s: np.ndarray) -> bytes:
    """Counts by group, as narrow as the size of the set allows."""
    counts = counts_of(s, GROUPS)
    return counts.astype(np.uint8 if len(s) < 1 << 8 else np.uint16 if len(s) < 1 << 16 else np.uint32).tobytes()


def points_of(blobs: list[bytes]) -> np.ndarray:
    widths = np.array([len(x) // GROUPS for x in blobs], int)
    out = np.zeros((len(blobs), GROUPS), {1: np.uint8, 2: np.uint16, 4: np.uint32}[int(widths.max(initial=1))])
    for width, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32)):
        at = np.flatnonzero(widths == width)
        if len(at):
            out[at] = np.frombuffer(b"".join(blobs[k] for k in at), kind).reshape(-1, GROUPS)
    return out


def fine_bytes(s: np.ndarray) -> bytes | None:
    """Counts by so many groups, a power of two, that each has FINE to 2 * FINE shingles on average; None where GROUPS are enough."""
    groups = min(MOST_FINE, 1 << max(0, (len(s) // FINE).bit_length() - 1))
    return pack(counts_of(s, groups).astype(np.uint32)) if groups > GROUPS else None


def fine_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Summed minima of fine counts, the finer ones folded: at least what the sets share."""
    if len(x) != len(y):
        groups = min(len(x), len(y))
        x, y = (c if len(c) == groups else c.reshape(-1, groups).sum(0, dtype=np.int64) for c in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


class Fine:
    """Fine counts of a cell's points, unpacked when asked for."""

    def __init__(self, blobs: np.ndarray, n: np.ndarray) -> None:
        self.blobs, self.n, self.there = blobs, n, np.array([x is not None for x in blobs], bool)
        self.counts: dict[int, np.ndarray] = {}
        self.held = 0

    def of(self, k: int) -> np.ndarray:
        if k not in self.counts:
            if self.held > FINE_HELD:
                self.counts.clear()
                self.held = 0
            counts = unpack(self.blobs[k], np.uint32)
            self.counts[k] = counts.astype(np.min_scalar_type(counts.max()))
            self.held += self.counts[k].nbytes
        return self.counts[k]

    def reached(self, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(point, point, bound by size) of what a tree over the points ``a`` has found with one over ``b``, less pairs whose fine counts show that they cannot link."""
        for i, j, score in found:
            x, y = a[i], b[j]
            keep, score = np.ones(len(x), bool), np.array(score, float)
            for k in np.flatnonzero(self.there[x] & self.there[y]):
                bound, sizes = fine_overlap(self.of(x[k]), self.of(y[k])), int(self.n[x[k]] + self.n[y[k]])
                keep[k], score[k] = (num + den) * bound >= num * sizes, bound / sizes
            yield x[keep], y[keep], score[keep]


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest``, the first half of it, and ``node``: another one where different sets share that half."""
    sets = rows.where("node is not null").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    twins = written(sets.where("a <> b").select(F.col("node").alias("digest"), F.lit(True).alias("_twin")), "twins")
    rows = rows.withColumn("digest", F.col("node"))
    if twins.isEmpty():
        return rows
    rows = rows.join(twins, "digest", "left")
    return rows.withColumn("node", F.when(F.col("_twin"), F.xxhash64("digest", "check")).otherwise(F.col("digest"))).drop("_twin")


def shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, node) sorted: (least, token, nodes) of tokens that at least two nodes have, a row for up to SMALL of them.

    A token with more nodes has several rows, whose ``least`` (node) is null, so a token with any number of nodes takes no memory.
    """
    token, node, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in _and_end(batches):
        if batch is not None:
            token = np.concatenate([token, np.asarray(batch.column(0))])
            node = np.concatenate([node, np.asarray(batch.column(1))])
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node = token[new], node[new]
        if not len(token):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(cuts[1:], len(token))
        if batch is not None:  # the last token may go on
            whole = len(cuts) - 1
            while ends[-1] - cuts[-1] > 2 * SMALL:  # the last node stays, to be told from its repeats
                at = cuts[-1]
                large = token[at]
                yield _cells([None], [large], [node[at : at + SMALL]])
                keep = np.ones(len(token), bool)
                keep[at : at + SMALL] = False
                token, node = token[keep], node[keep]
                ends[-1] -= SMALL
        else:
            whole = len(cuts)
        pieces = []
        for a, b in zip(cuts[:whole], ends[:whole]):
            if token[a] == large or b - a > SMALL:
                pieces += [(None, token[a], node[k : min(b, k + SMALL)]) for k in range(a, b, SMALL)]
            elif b - a > 1:
                pieces.append((node[a], token[a], node[a:b]))
        if pieces:
            yield _cells(*zip(*pieces))
        at = cuts[whole] if whole < len(cuts) else len(token)
        token, node = token[at:], node[at:]


def _cells(least: Sequence, token: Sequence, nodes: Sequence[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(token, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(nodes))], ["least", "token", "nodes"])


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From small cells (least, token, nodes), those of a least node together and larger ones first: (cell, node) of cells that are within no other.

    A least node is in as many cells as its prefix has shingles, so what is held is bounded by the longest text.
    """
    now, held, kept = None, {}, 0
    for batch in batches:
        cells, nodes = [], []
        flat, offsets = np.asarray(batch.column(2).values), np.asarray(batch.column(2).offsets)
        for k, (least, token) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if least != now:
                now, held, kept = least, {}, 0
            members = flat[offsets[k] + 1 : offsets[k + 1]].tolist()
            within = held.get(members[0], ())
            for x in members[1:]:
                if not within:
                    break
                within = held.get(x, set()) & within if x in held else ()
            if within:
                continue
            for x in members:
                held.setdefault(x, set()).add(kept)
            kept += 1
            cells += [token] * (len(members) + 1)
            nodes += [least, *members]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(nodes, pa.int64())], ["cell", "node"])


def meeting_cells(rows: DataFrame) -> DataFrame:
    """(cell, node) of the cells that are to be searched: of those with the same nodes one, and of small ones none that is within another."""
    # The exchange deals tokens to tasks evenly: frequent ones come last in every prefix.
    tokens = rows.where("prefix is not null").select(F.explode("prefix").alias("token"), "node")
    cells = written(tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(shared_cells, "least long, token long, nodes array<long>"), "cells")
    small = cells.where("least is not null").withColumn("size", -F.size("nodes"))
    small = small.repartition("least").sortWithinPartitions("least", "size").drop("size").mapInArrow(outermost, "cell long, node long")
    large = cells.where("least is null")
    # Equal signatures of 128 bits: the very same nodes.
    signature = lambda seed: F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(F.lit(seed), x)))
    parts = large.select("token", F.size("nodes").alias("n"), signature(0).alias("x0"), signature(1).alias("x1"))
    one = parts.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")).groupBy("n", "x0", "x1").agg(F.min("token").alias("token"))
    large = large.join(one.select("token"), "token", "left_semi").select(F.col("token").alias("cell"), F.explode("nodes").alias("node"))
    return written(small.union(large), "meeting")


def verified(pairs: DataFrame, docs: DataFrame, doc: str, text: str, reps: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are alike enough. ``reps``: (node, digest, check, doc, hash), a document of each node.

    The set of v goes to one task and those of its partners follow it there one by one; many partners are dealt to several tasks.
    """
    hot = pairs.groupBy("v").agg(F.ceil(F.count("*") / PARTNERS).alias("salts")).where("salts > 1")
    dealt = pairs.join(hot, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("salts", F.lit(1))).alias("salt"))
    key = F.struct(F.col("v").alias("key"), "salt")
    routes = dealt.select(F.col("u").alias("node"), key.alias("to")).union(dealt.select("v", key).distinct())
    routes = written(routes.join(reps, "node").groupBy("node", "digest", "check", "doc", "hash").agg(F.collect_list("to").alias("keys")), "routes")
    wanted = F.broadcast(routes) if pairs.count() <= BROADCAST_ROWS else routes
    texts = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    texts = texts.join(wanted, (F.col("_hash") == F.col("hash")) & F.col("_doc").eqNullSafe(F.col("doc"))).select("text", "node", "keys", "digest", "check")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = [s for _, _, data, offsets in tn.chunks(batch.column(0)) for s in shingle_sets(data, offsets, size)]
            keep = []
            for k, (s, node, *halves) in enumerate(zip(sets, *(batch.column(c).to_pylist() for c in (1, 3, 4)))):
                # Copies under one id are sent once; a hash may name several texts.
                if node not in seen and digest(s) == tuple(halves):
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array([sent(sets[k]) for k in keep], pa.binary())], ["node", "keys", "held"])
        tn.trim()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for key, salt, node, blob in zip(*(batch.column(k) for k in (0, 1, 3, 4))):
                key, salt, node, s = key.as_py(), salt.as_py(), node.as_py(), received(blob.as_py())
                if node == key:
                    centre, held = (key, salt), s
                elif (key, salt) == centre:
                    at = np.minimum(np.searchsorted(held, s), len(held) - 1)
                    both = int((held[at] == s).sum())
                    if den * both >= num * (len(s) + len(held) - both):
                        out.append((node, key))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
        tn.trim()

    sets = texts.mapInArrow(to_sets, "node long, keys array<struct<key:long,salt:long>>, held binary")
    sets = sets.select(F.explode("keys").alias("to"), "node", "held").select("to.key", "to.salt", (F.col("node") != F.col("to.key")).alias("other"), "node", "held")
    return sets.repartition("key", "salt").sortWithinPartitions("key", "salt", "other").mapInArrow(compare, "u long, v long").distinct()


class Tree:
    """A packed R-tree over count vectors; of a box its upper corner counts, the sizes its points have, and their component if it is only one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray) -> None:
        known = [component] if len(np.unique(component)) < len(component) else []
        self.order = np.lexsort((*points[:, :4].T, sizes, *known))
        self.levels = [(points[self.order], sizes[self.order], component[self.order], component[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            top, least, low, high = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]

    def join(self, other: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in self, in other, bound by size) of points of different components whose summed coordinate minima reach what sets of their sizes must share.

        A tree joined with itself gives each pair once.
        """
        up = max(len(self.levels), len(other.levels)) - 1
        stack = [(up, np.arange(len(self.level(up)[1])), np.arange(len(other.level(up)[1])))]
        while stack:
            level, a, b = stack.pop()
            (top_a, least_a, low_a, high_a), (top_b, least_b, low_b, high_b) = self.level(level), other.level(level)
            near = (low_a[a][:, None] != high_b[b][None, :]) | (high_a[a][:, None] != low_b[b][None, :])
            if self is other:
                near &= a[:, None] < b[None, :] if level == 0 else a[:, None] <= b[None, :]
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 14):  # so many pairs of boxes at once
                x, y = a[i[k : k + (1 << 14)]], b[j[k : k + (1 << 14)]]
                bound = np.minimum(top_a[x], top_b[y]).sum(1, dtype=np.int64)
                reached = (num + den) * bound >= num * (least_a[x] + least_b[y])
                x, y, bound = x[reached], y[reached], bound[reached]
                if level == 0:
                    yield self.order[x], other.order[y], bound / (least_a[x] + least_b[y])
                else:
                    stack += [(level - 1, self.children(level, p), other.children(level, q)) for p, q in zip(x, y)]

    def children(self, level: int, k: int) -> np.ndarray:
        if level > len(self.levels) - 1:
            return np.arange(len(self.levels[-1][1]))
        return np.arange(k * FANOUT, min((k + 1) * FANOUT, len(self.levels[level - 1][1])))

    def leaves(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ``join``, of the points of one leaf only."""
        points, sizes, component, _ = self.levels[0]
        x, y = np.triu_indices(FANOUT, 1)
        for a in range(0, len(sizes), 64 * FANOUT):
            at = np.arange(a, min(len(sizes), a + 64 * FANOUT), FANOUT)
            i, j = (at[:, None] + x[None, :]).ravel(), (at[:, None] + y[None, :]).ravel()
            there = j < len(sizes)
            there[there] &= component[i[there]] != component[j[there]]
            i, j = i[there], j[there]
            bound = np.minimum(points[i], points[j]).sum(1, dtype=np.int64)
            near = (num + den) * bound >= num * (sizes[i] + sizes[j])
            i, j = i[near], j[near]
            yield self.order[i], self.order[j], bound[near] / (sizes[i] + sizes[j])


class Likeliest:
    """Of pairs that come piece by piece: all while they are few, and of each component the likeliest."""

    def __init__(self, component: np.ndarray, few: float) -> None:
        kinds, self.component = np.unique(component, return_inverse=True)
        self.score, self.pair = np.full(len(kinds), -1.0), np.zeros((len(kinds), 2), np.int64)
        self.all: list[np.ndarray] = []
        self.held, self.few = 0, few

    def add(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        self.held += len(i)
        pairs = np.stack([i, j], 1)
        if self.held <= self.few:
            self.all.append(pairs)
        else:
            self.all = []
        for side in (i, j):
            of = self.component[side]
            order = np.argsort(score, kind="stable")  # of what is written last, the likeliest stays
            best = np.full(len(self.score), -1)
            best[of[order]] = order
            at = np.flatnonzero(best >= 0)
            at = at[score[best[at]] > self.score[at]]
            self.score[at], self.pair[at] = score[best[at]], pairs[best[at]]

    def pairs(self) -> tuple[np.ndarray, bool]:
        """(pairs, whether these are all)."""
        if self.held <= self.few:
            return np.concatenate([np.zeros((0, 2), np.int64), *self.all]), True
        return self.pair[self.score >= 0], False


def tree_pairs(num: int, den: int, first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (cell, low, high, block, node, component, n, point, fine) sorted by the first three: candidate (cell, u, v) of different components.

    A cell that must be searched again gives (cell, null, null) besides.
    """

    def pieces(block: np.ndarray, low: int, high: int, n: np.ndarray, component: np.ndarray, points: np.ndarray, fine: Fine) -> Iterator[tuple[np.ndarray, bool]]:
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(a) or not len(b):
            return
        left = Tree(points[a], n[a], component[a])
        if first and len(n) > WHOLE:
            kept = Likeliest(np.arange(len(n)), -1)
            if low == high:
                for x, y, score in fine.reached(left.leaves(num, den), a, a, num, den):
                    kept.add(x, y, score)
            yield kept.pairs()[0], False
            return
        right = left if low == high else Tree(points[b], n[b], component[b])
        found = fine.reached(left.join(right, num, den), a, b, num, den)
        if last:
            for x, y, _ in found:
                yield np.stack([x, y], 1), True
            return
        kept = Likeliest(component, FEW * len(n))
        for x, y, score in found:
            kept.add(x, y, score)
        yield kept.pairs()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        seen: set[tuple[int, int]] = set()
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                now = [np.asarray(batch.column(k)) for k in range(7)]
                for k in (7, 8):
                    blobs = np.empty(batch.num_rows, object)
                    blobs[:] = batch.column(k).to_pylist()
                    now.append(blobs)
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None:
                continue
            new = np.ones(len(held[0]), bool)
            new[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
            cuts = np.flatnonzero(new)
            if batch is None:
                cuts = np.append(cuts, len(new))
            out: list[tuple] = []
            for x, y in zip(cuts, cuts[1:]):
                cell, low, high, block, node, component, n, blobs, fines = (h[x:y] for h in held)
                for pairs, done in pieces(block, int(low[0]), int(high[0]), n, component, points_of(blobs), Fine(fines, n)):
                    u, v = node[pairs[:, 0]], node[pairs[:, 1]]
                    new_ones = set(zip(np.maximum(u, v).tolist(), np.minimum(u, v).tolist())) - seen
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen |= new_ones
                    out += [(int(cell[0]), *p) for p in new_ones]
                    if not done:
                        out.append((int(cell[0]), None, None))
                    if len(out) > 100_000:
                        yield _rows(out)
                        out = []
            held = None if batch is None else [h[cuts[-1] :] for h in held]
            yield _rows(out)
        tn.trim()

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["cell", "u", "v"])

    return search


def jaccard_components(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc, n_shingles, component_id) of every document; component_id: the least id reachable by links, its own included.

    Words are lower-cased (A-Z) and split at ASCII white space; two documents link when den * (size of the intersection) >= num * (size of the union)
    of their sets of shingles. A text with fewer words than a shingle is one shingle; null, empty and blank texts have none and link with nothing.
    Repeated rows are each returned; documents without an id are linked, but give a component an id only where no other does
    (null then). Texts of any length are read whole. No rows: no rows. Other columns are ignored.
    """
    named = jaccard_groups(docs, doc=doc, text=text, size=size, num=num, den=den)
    return named.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.col("component_id"))


def jaccard_groups(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc, hash, n, component, component_id, first) for every document.

    ``hash``: xxhash64 of the text; ``component``: the same number for all documents of a group, null for a text without words;
    ``first``: whether the row is one with the least (id, hash) of its group (a null id goes last), or has no words.
    """
    small_batches(docs.sparkSession)
    since = len(MADE)
    rows = told_apart(written(described(docs, doc, text, size, num, den), "described"))
    meeting = meeting_cells(rows)
    large = written(meeting.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell"), "large")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")).alias("least")
    reps = written(rows.where("node is not null").groupBy("node").agg(F.first("digest").alias("digest"), F.first("check").alias("check"), least), "reps")
    names = reps.select("node", "digest", "check", "least.doc", "least.hash")
    points = rows.where("prefix is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "point", "fine")))
    points = written(points, "points")
    rows = written(rows.select("doc", "hash", "n", "node"), "rows")
    forget(docs.sparkSession, since, meeting, large, reps, points, rows)  # prefixes and cells, the most of what is held
    known = tried = None
    alive = meeting
    for k in range(ROUNDS + 1):
        found = written(_search(alive, large, known, points, num, den, k == 0, k == ROUNDS), "found")
        pairs = found.where("u is not null").select("u", "v").distinct()
        pairs = written(pairs.join(tried, ["u", "v"], "left_anti") if tried is not None else pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = written(verified(pairs, docs, doc, text, names, size, num, den), "more")
        if not more.isEmpty():
            # What is known stands for the links before.
            links = more if known is None else more.union(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
            known = written(components(links), "components")
        again = written(found.where("u is null").select("cell").distinct(), "again")
        if again.isEmpty():
            break
        alive = meeting.join(again, "cell", "left_semi")
    grouped = reps.withColumn("component", F.col("node"))
    if known is not None:
        grouped = reps.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = grouped.groupBy("component").agg(F.min("least").alias("first"))
    labels = written(grouped.select("node", "component").join(groups, "component").select("node", "component", "first"), "labels")
    named = rows.select("doc", "hash", "n", "node").join(labels, "node", "left")
    one = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("hash") == F.col("first.hash"))
    return named.select("doc", "hash", "n", "component", F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("component_id"), F.when(F.col("component").isNull(), F.lit(True)).otherwise(one).alias("first"))


def _search(meeting: DataFrame, large: DataFrame, known: DataFrame | None, points: DataFrame, num: int, den: int, first: bool, last: bool) -> DataFrame:
    """Candidates (cell, u, v) of different components, from the trees of all cells that hold several, and (cell, null, null) of those to be searched again."""
    placed = meeting.withColumn("component", F.col("node"))
    if known is not None:
        placed = meeting.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("cell")
        placed = placed.join(several, "cell", "left_semi")
    placed = placed.join(points, "node")
    # Sets that link differ in size by a factor of den / num at most, so blocks of a large cell meet those of their own or the next band of sizes.
    placed = placed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int") if den > num else F.lit(0))
    zero = F.lit(0).cast("long")
    in_one = lambda rows: rows.select("cell", zero.alias("low"), zero.alias("high"), zero.alias("block"), "node", "component", "n", "point", "fine")
    if large.isEmpty():
        alive = in_one(placed)
    else:
        bands = placed.join(large, "cell", "left_semi").groupBy("cell", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        bands = written(bands, "bands")
        number = lambda band, sub: band.cast("long") * (1 << 32) + sub
        all_blocks = bands.select("cell", F.col("band").alias("other_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_sub"))
        dealt = placed.join(bands, ["cell", "band"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = dealt.join(all_blocks, "cell").where(F.abs(F.col("band") - F.col("other_band")) <= 1)
        block, other = number(F.col("band"), F.col("sub")), number(F.col("other_band"), F.col("other_sub"))
        dealt = dealt.select("cell", F.least(block, other).alias("low"), F.greatest(block, other).alias("high"), block.alias("block"), "node", "component", "n", "point", "fine")
        alive = in_one(placed.join(large, "cell", "left_anti")).union(dealt)
    return alive.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high").mapInArrow(tree_pairs(num, den, first, last), "cell long, u long, v long")
