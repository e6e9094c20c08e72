"""Benchmark decontamination by the q-gram lemma: count shared character q-grams in overlapping diagonal bands, verify by banded alignment.

A segment of m characters that a text holds with at most e edits shares at least m - q + 1 - q * e of its q-grams with
it, on diagonals (text position less segment position) that spread over at most e. Bands of twice e + 1 diagonals, each
overlapping the next by half, so hold all of them in one band. Bands with enough q-grams, and by the same lemma enough
shorter ones, are aligned.

A q-gram that many segments share would pair each of its places with all of these. Such q-grams are not counted: a segment with c of them
needs c fewer of the others. Segments that need none then (items with a long common stem) are looked for by the lemma of
the shorter q-grams in overlapping windows of the text, all segments at once, and windows of equal content once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _textnp as tn
from ._shared import small_batches, written

#: Characters of a q-gram (items under 40 characters may need shorter ones) and of the shorter ones that are counted next, edits allowed per
#: character, and characters of a segment that longer items are cut into (by halves overlapping).
Q, SHORT, RATE, SEGMENT = 8, 4, 0.1, 256
#: Segments that may share a q-gram that is counted in bands.
OWNERS = 8
#: Characters of benchmark text that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 8_000_000
#: Regions and windows of a text whose verification is remembered while a chunk of texts is worked on.
REMEMBERED = 100_000
STEPS = np.random.default_rng(3).integers(0, 1 << 63, Q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Index:
    """Segments that are looked for by q-grams of one length."""

    q: int
    texts: list[str]  # normalised segments, each once
    items: list[list[int]]  # of each segment: places of its items
    edits: np.ndarray
    needed: np.ndarray  # q-grams in a band, or less than 1 for a segment that is looked for in windows
    keys: np.ndarray  # sorted, of the q-grams that are counted
    owner: np.ndarray
    at: np.ndarray
    filter: np.ndarray  # by the leading bits of a key
    short: list[np.ndarray]  # of each segment: keys of its shorter q-grams
    short_needed: np.ndarray
    windowed: np.ndarray  # segments that are looked for in windows
    window_keys: np.ndarray  # sorted, of their q-grams
    kinds: np.ndarray  # sorted distinct shorter q-grams of these segments
    grams: np.ndarray  # of each of their shorter q-grams: which kind
    begins: np.ndarray  # where each segment's begin


def normalised(text: str | None) -> str:
    """ASCII white space as single blanks, A-Z as a-z."""
    points, _, _ = points_of(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    return points.tobytes().decode("utf-32-le", "surrogatepass").strip(" ")


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised code points, the place each had, places where texts begin among the normalised ones; one more at the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(blank, np.uint32(32), points)
    points += ((points >= 65) & (points <= 90)).astype(np.uint32) * np.uint32(32)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[begins[:-1][np.diff(begins) > 0]] = True
    place = np.flatnonzero(keep)
    return points[place], place, np.searchsorted(place, begins)


def gram_keys(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.zeros(0, np.uint64)
    n = len(points) - q + 1
    keys = np.zeros(n, np.uint64)
    wide = points.astype(np.uint64)
    for j in range(q):
        keys += wide[j : j + n] * STEPS[j]
    return keys * tn.BASE


def as_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def build(texts: list[str | None], rate: float = RATE, segment: int = SEGMENT) -> list[Index]:
    """Indexes of items, one for each length of q-grams; an item of fewer than Q characters matches nothing."""
    found: dict[int, dict[str, list[int]]] = {}
    for k, text in enumerate(map(normalised, texts)):
        cuts = range(0, max(1, len(text) - segment // 2), segment // 2) if len(text) > segment else [0]
        for a in cuts if len(text) >= Q else []:
            a = min(a, max(0, len(text) - segment))
            part = text[a : a + segment]
            q = min(Q, len(part) // (int(len(part) * rate) + 1))  # so that at least one q-gram is needed
            items = found.setdefault(q, {}).setdefault(part, [])
            if not items or items[-1] != k:
                items.append(k)
    return [_index(q, list(parts), list(parts.values()), rate) for q, parts in sorted(found.items())]


def _index(q: int, parts: list[str], items: list[list[int]], rate: float) -> Index:
    sizes = np.array([len(p) for p in parts], int)
    edits = (sizes * rate).astype(int)
    grams = [gram_keys(as_points(p), q) for p in parts]
    keys, owner = np.concatenate(grams), np.repeat(np.arange(len(parts)), [len(g) for g in grams])
    at = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.lexsort((at, owner, keys))
    keys, owner, at = keys[order], owner[order], at[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = new_key | np.concatenate([[True], owner[1:] != owner[:-1]])
    of = np.cumsum(new_key) - 1
    common = (np.bincount(of, first) > OWNERS)[of]
    needed = sizes - q + 1 - q * edits - np.bincount(owner[common], minlength=len(parts))
    windowed = needed < 1
    window_keys = np.unique(keys[windowed[owner]])
    kept = ~common & ~windowed[owner]
    keys, owner, at = keys[kept], owner[kept], at[kept]
    bits = int(np.clip(len(keys) * 32, 1 << 16, 1 << 26)).bit_length()
    held = np.zeros(1 << bits, bool)
    held[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    short = [gram_keys(as_points(p), SHORT) for p in parts]
    places = np.flatnonzero(windowed)
    kinds, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(short[k] for k in places)]), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum([len(short[k]) for k in places])])[:-1].astype(int)
    return Index(q, parts, items, edits, needed, keys, owner, at, held, short, sizes - SHORT + 1 - SHORT * edits, places, window_keys, kinds, of, begins)


def align(pattern: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """(edits, end in text) of the best place of ``pattern`` in ``text`` whose path keeps to ``width`` diagonals from ``low``; ties: the first."""
    far = len(pattern) + len(text) + 1
    step = np.arange(width)
    row = np.where((step + low >= 0) & (step + low <= len(text)), 0, far)
    padded = np.full(len(text) + 2 * (len(pattern) + width) + 2, -1, np.int64)
    shift = len(pattern) + width + 1
    padded[shift : shift + len(text)] = text
    for i, c in enumerate(pattern):  # place in text after i + 1 characters on diagonal d: i + 1 + d
        first = i + low
        same = row + (padded[first + shift : first + shift + width] != c)
        same[:-1] = np.minimum(same[:-1], row[1:] + 1)  # a character of the pattern left out
        there = first + 1 + step
        same[(there < 0) | (there > len(text))] = far
        row = np.minimum.accumulate(same - step) + step  # characters of the text added
    best = int(np.argmin(row))
    return int(row[best]), len(pattern) + low + best


def find(indexes: list[Index], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, stop, edits) of the best place of each item in each text, in code points of the text."""
    points, place, begins = points_of(data, offsets)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for index in indexes:
        keys = gram_keys(points, index.q)
        if len(keys):
            for t, k, a, edits, start, stop in (*_in_bands(index, points, begins, keys, best), *_in_windows(index, points, begins, keys)):
                new = (edits, int(place[a + start] - place[begins[t]]), int(place[a + stop - 1] + 1 - place[begins[t]]))
                for item in index.items[k]:
                    best[t, item] = min(best.get((t, item), new), new)
    return [(t, item, start, stop, edits) for (t, item), (edits, start, stop) in sorted(best.items())]


def _in_bands(index: Index, points: np.ndarray, begins: np.ndarray, keys: np.ndarray, best: dict) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, segment, place of the region, edits, start, stop) by bands of diagonals."""
    if not len(index.keys):
        return
    bits = len(index.filter).bit_length() - 1
    hit = np.flatnonzero(index.filter[(keys >> np.uint64(64 - bits)).astype(np.int64)])
    left, right = np.searchsorted(index.keys, keys[hit], "left"), np.searchsorted(index.keys, keys[hit], "right")
    times = right - left
    hit, left, times = hit[times > 0], left[times > 0], times[times > 0]
    entry = np.repeat(left - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    owner = index.owner[entry]
    half = index.edits[owner] + 1
    band = (np.repeat(hit, times) - index.at[entry] + SEGMENT) // half  # never negative
    span = len(points) + 2 * SEGMENT + 2
    both = np.concatenate([owner * np.int64(span) + band, owner * np.int64(span) + np.maximum(band - 1, 0)])
    found, counts = np.unique(both, return_counts=True)
    found = found[counts >= index.needed[found // span]]
    # The lemma counts q-grams of the segment, so one that the text repeats counts once.
    where = np.flatnonzero(np.isin(both, found))
    pairs = np.unique(both[where] * np.int64(SEGMENT) + np.concatenate([index.at[entry]] * 2)[where])
    found, counts = np.unique(pairs // SEGMENT, return_counts=True)
    found = found[counts >= index.needed[found // span]]
    known: dict[tuple[int, int, bytes], tuple[int, int, int] | None] = {}
    for code in found:
        k, b = int(code // span), int(code % span)
        e = int(index.edits[k])
        low = b * (e + 1) - SEGMENT
        m = len(index.texts[k])
        for t in range(max(0, int(np.searchsorted(begins, low - e, "right")) - 1), len(begins) - 1):
            if begins[t] >= low + 2 * (e + 1) + m + e:
                break
            a, z = max(int(begins[t]), low - e), min(int(begins[t + 1]), low + 2 * (e + 1) + m + e)
            if z - a < m - e or best.get((t, index.items[k][0]), (1,))[0] == 0:
                continue
            key = (k, low - a, points[a:z].tobytes())
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                enough = np.isin(index.short[k], gram_keys(points[a:z], SHORT)).sum() >= index.short_needed[k]
                known[key] = _verify(index.texts[k], points[a:z], low - a - e, 2 * (e + 1) + 2 * e + 1, e) if enough else None
            if known[key]:
                yield t, k, a, *known[key]


def _in_windows(index: Index, points: np.ndarray, begins: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The same, of the segments that are looked for in windows, each twice as long as a segment with its edits, overlapping by half."""
    if not len(index.windowed):
        return
    step = SEGMENT + int(index.edits[index.windowed].max()) + 1
    at = np.minimum(np.searchsorted(index.window_keys, keys), len(index.window_keys) - 1)
    hit = np.flatnonzero(index.window_keys[at] == keys)
    known: dict[bytes, list[tuple[int, int, int, int]]] = {}
    text = np.searchsorted(begins, hit, side="right") - 1
    places = np.unique(np.stack([text, (hit - begins[text]) // step], 1), axis=0)
    for t, n in np.unique(np.concatenate([places, np.maximum(places - [0, 1], 0)]), axis=0):
        a = int(begins[t] + n * step)
        z = min(int(begins[t + 1]), a + 2 * step)
        content = points[a:z].tobytes()
        if content not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[content] = [(int(k), *got) for k in _enough(index, points[a:z]) if (got := _verify(index.texts[k], points[a:z], -int(index.edits[k]), max(1, z - a - len(index.texts[k]) + 2 * int(index.edits[k]) + 1), int(index.edits[k])))]
        for k, edits, start, stop in known[content]:
            yield int(t), k, a, edits, start, stop


def _enough(index: Index, window: np.ndarray) -> np.ndarray:
    """Segments of which enough shorter q-grams stand in the window."""
    there = np.isin(index.kinds, gram_keys(window, SHORT))
    return index.windowed[np.add.reduceat(there[index.grams].astype(np.int64), index.begins) >= index.short_needed[index.windowed]]


def _verify(segment: str, region: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) in the region, or None beyond the edit budget."""
    text = region.tobytes().decode("utf-32-le", "surrogatepass")
    if (at := text.find(segment)) >= 0:
        return 0, at, at + len(segment)
    pattern = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = region.astype(np.int64)
    edits, stop = align(pattern, letters, low, width)
    if edits > most or stop <= 0:
        return None
    # Backwards from the end: where the best place begins.
    _, size = align(pattern[::-1], letters[:stop][::-1], -most, 2 * most + 1)
    return edits, max(0, min(stop - size, stop - 1)), stop


def indexes(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list[Index], pa.Array]]:
    """Indexes of the items and their ids, PASS_CHARS of text each; the items are read in order, and only one pass of them is held."""
    kind = to_arrow_type(benchmark.select(F.col(item)).schema[0].dataType)
    ids, texts, size = [], [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= PASS_CHARS:
            yield build(texts), pa.array(ids, kind)
            ids, texts, size = [], [], 0
    if ids:
        yield build(texts), pa.array(ids, kind)


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc, item, start, stop, edits): each benchmark item that a document holds, whole or by a segment of SEGMENT characters.

    At most RATE edits a character, rounded down, white space and case of A-Z aside; the place with the fewest edits, in code points
    of the document. Items of fewer than Q characters name no passage and are held nowhere, like null ones; null and empty texts hold nothing. Repeated documents
    and equal items are each reported. Ids may have any type. Benchmarks of more than PASS_CHARS take several passes, each written before the next. No rows on either side: no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(doc).alias("doc")).dtypes)["doc"], dict(benchmark.select(F.col(item).alias("item")).dtypes)["item"]
    schema = f"`{doc}` {kind[0]}, `{item}` {kind[1]}, start long, stop long, edits long"

    def one_pass(held: list[Index], names: pa.Array) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((held, names))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, names = shared.value
            for batch in batches:
                rows = [(a + t, *rest) for a, _, data, offsets in tn.chunks(batch.column(1)) for t, *rest in find(held, data, offsets)]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), names.take(columns[1]), *columns[2:]], [doc, item, "start", "stop", "edits"])
            tn.trim()

        return docs.select(F.col(doc), F.col(text).cast("string")).mapInArrow(found, schema)

    return _passes(benchmark, item, text, one_pass, lambda parts: reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs``, all columns, less the rows whose text holds a benchmark item as ``leaks`` finds it."""
    small_batches(docs.sparkSession)
    place = [c.lower() for c in docs.columns].index(text.lower())
    left = docs

    def one_pass(held: list[Index], names: pa.Array) -> DataFrame:
        nonlocal left
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in tn.chunks(batch.column(place)):
                    keep[[a + row[0] for row in find(shared.value, data, offsets)]] = False
                yield batch.filter(pa.array(keep))
            tn.trim()

        left = left.mapInArrow(clean, docs.schema)
        return left

    def after(parts: list[DataFrame]) -> DataFrame:
        return parts[-1] if parts else docs

    def kept(df: DataFrame) -> DataFrame:
        nonlocal left
        left = written(df, "clean")
        return left

    return _passes(benchmark, item, text, one_pass, after, kept)


def _passes(benchmark: DataFrame, item: str, text: str, one_pass: Callable, joined: Callable, keep: Callable = lambda df: written(df, "leaks")) -> DataFrame:
    """The passes one by one: each but the last is written before the next index is built."""
    parts, waiting = [], None
    for found in indexes(benchmark, item, text):
        if waiting is not None:
            parts.append(keep(one_pass(*waiting)))
        waiting = found
    if waiting is not None:
        parts.append(one_pass(*waiting))
    return joined(parts)
