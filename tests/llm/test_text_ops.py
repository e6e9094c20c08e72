"""Decontamination, quality, Katz, Jaccard and toxicity against brute force on small tables."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regrove.llm import _textnp as tn
from regrove.llm import _shared, decontaminate, jaccard, katz, quality, toxicity
from regrove.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    """Prose of few words: copies, near copies, a shared passage, blanks, nulls, a very long one."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    out = [prose(rng.randint(1, 120)) for _ in range(40)]
    out += [f"{prose(30)} {passage}\n{prose(30)}" for _ in range(6)] + [out[3]] * 3 + [out[5].upper().replace("É", "é")]
    for k in range(6):  # a chain of near copies
        w = out[7].split() + prose(60).split() if k == 0 else out[-1].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, None, "", " \t\n", "one", "one  ONE", "a b c d", "a b  c d", prose(30_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "x", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, node string").repartition(3)


def test_words_and_hashes(texts):
    hashes = {}
    for a, b, data, offsets in tn.chunks(pa.array(texts, pa.string()), most=4000):
        w = tn.words(data, offsets)
        for k in range(a, b):
            own = w.hashes()[w.first[k - a] : w.first[k - a + 1]].tolist()
            assert len(own) == len(words(texts[k]))
            for x, h in zip(words(texts[k]), own):
                assert hashes.setdefault(x, h) == h
    assert len(set(hashes.values())) == len(hashes)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_jaccard_join(docs, texts, monkeypatch):
    want = brute_components(texts)
    for small, block, whole, few in ((256, 16_384, 64, 2), (4, 3, 3, 0.2)):
        for name, value in (("SMALL", small), ("BLOCK", block), ("WHOLE", whole), ("FEW", few), ("FANOUT", 16 if small > 4 else 3), ("PARTNERS", 1000 if small > 4 else 2)):
            monkeypatch.setattr(jaccard, name, value)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
        assert got == want


def test_jaccard_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "x y"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()))
    assert got == [(False, 4, 1, 4), (False, 4, 2, 4), (False, 4, 2, 4), (False, 9, 0, 9), (True, 0, 2, 4)]


def test_jaccard_null_ids_and_large_groups(spark):
    """10,000 rows without an id, a group of 3,000 near copies that are hardly alike in pairs, and copies of one text."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = [(None, f"text without id {k % 5000} and some more words {k % 5000}") for k in range(10_000)]
    for k in range(3000):
        w = list(base)
        for at in rng.sample(range(60), 1):
            w[at] = f"x{rng.randrange(400)}"
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, "the same text again and again") for k in range(2000)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).toPandas()
    assert len(got) == len(rows)
    assert (got[got.doc_id.between(5000, 6999)].component_id == 5000).all()
    mine = got[got.doc_id < 3000].sort_values("doc_id")
    texts = [t for k, t in rows if k is not None and k < 3000]
    sets = [shingles(t) for t in texts]
    root = list(range(3000))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    incidence = {}
    for k, s in enumerate(sets):
        for g in s:
            incidence.setdefault(g, []).append(k)
    names = {g: i for i, g in enumerate(incidence)}
    matrix = np.zeros((3000, len(names)), np.float32)
    for k, s in enumerate(sets):
        matrix[k, [names[g] for g in s]] = 1
    shared = matrix @ matrix.T
    n = matrix.sum(1)
    for a, b in zip(*np.nonzero(np.triu(100 * shared >= 75 * (n[:, None] + n[None] - shared), 1))):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert mine.component_id.tolist() == [find(k) for k in range(3000)]


def test_digests_that_agree_by_half(spark, texts, monkeypatch):
    """Different sets with one node between them are told apart."""
    monkeypatch.setattr(jaccard, "digest", lambda s, real=jaccard.digest: (real(s)[0] % 7, real(s)[1]))
    docs = spark.createDataFrame(list(enumerate(texts[:30])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(texts[:30])


def test_outermost_cells():
    cells = [(1, 10, [1, 2, 3, 4]), (1, 11, [1, 2, 5]), (1, 12, [1, 3]), (1, 13, [1, 2, 3]), (1, 14, [1, 4, 5]), (1, 15, [1, 5]), (2, 16, [2, 3, 4]), (2, 17, [2, 3, 4])]
    batches = [jaccard._cells(*zip(*[(a, b, np.array(c)) for a, b, c in sorted(cells, key=lambda x: (x[0], -len(x[2])))]))]
    out = collections.defaultdict(list)
    for b in jaccard.outermost(iter(batches)):
        for c, n in zip(*(b.column(k).to_pylist() for k in (0, 1))):
            out[c].append(n)
    assert dict(out) == {10: [1, 2, 3, 4], 11: [1, 2, 5], 14: [1, 4, 5], 16: [2, 3, 4]}


def test_shared_cells_of_any_size(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = np.random.default_rng(5)
    rows = sorted({(int(t), int(n)) for t, n in zip(rng.geometric(0.2, 400), rng.integers(0, 60, 400))} | {(50, k) for k in range(33)}) * 2
    rows.sort()
    want = collections.defaultdict(set)
    for t, n in rows:
        want[t].add(n)
    for step in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + step]], pa.int64()) for k in (0, 1)], ["token", "node"]) for a in range(0, len(rows), step)]
        got = collections.defaultdict(list)
        for b in jaccard.shared_cells(iter(batches)):
            for least, token, nodes in zip(*(c.to_pylist() for c in b.columns)):
                assert least is None or (least == nodes[0] and 1 < len(nodes) <= 4)
                got[token] += nodes
        assert {t: sorted(n) for t, n in got.items()} == {t: sorted(n) for t, n in want.items() if len(n) > 1}


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(0)
    points = rng.poisson(1.0, (150, jaccard.GROUPS))
    points[75:] = np.maximum(points[:75] + rng.integers(-1, 2, (75, jaccard.GROUPS)) * (rng.random((75, jaccard.GROUPS)) < 0.05), 0)
    sizes = points.sum(1)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    near = 175 * bound >= 75 * (sizes[:, None] + sizes[None])
    for component in (np.arange(150), np.arange(150) // 3, rng.integers(0, 4, 150)):
        tree = jaccard.Tree(points, sizes, component)
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if component[a] != component[b]}
        found = [(int(a), int(b)) for i, j, _ in tree.join(tree, 75, 100) for a, b in zip(i, j)]
        assert {(min(p), max(p)) for p in found} == {p for p in want if p[0] < p[1]} and len(found) == len(set(found))
        half = [jaccard.Tree(points[a : a + 75], sizes[a : a + 75], component[a : a + 75]) for a in (0, 75)]
        found = {(int(a), int(b) + 75) for i, j, _ in half[0].join(half[1], 75, 100) for a, b in zip(i, j)}
        assert found == {p for p in want if p[0] < 75 <= p[1]}
        assert {(min(p), max(p)) for i, j, _ in tree.leaves(75, 100) for p in zip(i.tolist(), j.tolist())} <= want
    assert near[0, 75]


def test_fine_counts_lose_nothing():
    rng = np.random.default_rng(3)
    dropped = 0
    for n in (300, 1023, 1024, 1500, 9000, 40_000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (jaccard.fine_bytes(s) is not None) == (len(s) >= 1024)
        for kept, more in ((1.0, 0.0), (1.0, 1 / 3), (0.75, 0.0), (0.9, 0.04), (0.87, 0.13), (0.8, 0.3), (0.1, 0.9), (0.0, 1.0)):
            other = np.unique(np.concatenate([s[: int(np.ceil(len(s) * kept))], rng.integers(0, 1 << 63, int(n * more)).astype(np.uint64)]))
            both = len(np.intersect1d(s, other))
            x, y = (jaccard.fine_bytes(z) for z in (s, other))
            if x is None or y is None:
                continue
            x, y = (jaccard.unpack(z, np.uint32) for z in (x, y))
            assert x.sum() == len(s) and y.sum() == len(other)
            bound = jaccard.fine_overlap(x, y)
            assert bound == jaccard.fine_overlap(y, x) >= both
            reach = 175 * bound >= 75 * (len(s) + len(other))
            dropped += not reach
            assert not (reach and kept < 0.2)
    assert dropped


def test_jaccard_sends_no_sets_of_unlike_long_texts(spark, monkeypatch):
    """Long texts that share a passage by twos, and near copies of two of them: the coarse counts tell none of them apart."""
    rng = random.Random(4)
    prose = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passages = [prose(100) for _ in range(6)]
    out = [[*prose(4000), *passages[k // 2], *prose(4000)] for k in range(12)]
    for k in (0, 1):
        near = list(out[k])
        for at in rng.sample(range(len(near)), 100):
            near[at] = "changed"
        out.append(near)
    long_texts = [" ".join(w) for w in out]
    sent = []

    def verified(pairs, *rest, real=jaccard.verified):
        sent.extend((r["u"], r["v"]) for r in pairs.collect())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", verified)
    docs = spark.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(long_texts)
    assert got[12][1] == 0 and got[13][1] == 1 and len(sent) == 2


def test_jaccard_holds_neither_prefixes_nor_cells(docs, texts):
    since = len(_shared.MADE)
    out = jaccard.jaccard_components(docs)
    held = {p.rsplit("/", 1)[1].split("-")[1] for p in _shared.MADE[since:]}
    assert "rows" in held and not held & {"described", "cells"}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_components(texts)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    root = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def katz_by_hand(texts, train):
    tokens = [[*words(t), "</end>"] for t in texts]
    one, two = collections.Counter(), collections.Counter()
    for w, learnt in zip(tokens, train):
        if learnt:
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    of = lambda c: katz.discounts([collections.Counter(c.values())[r] for r in range(1, katz.K + 2)])
    d1, d2 = of(one), of(two)
    kept = lambda c, d: c * (d[c - 1] if 1 <= c <= katz.K else 1.0)
    lost = 1 - sum(kept(c, d1) for c in one.values()) / n
    p1 = lambda w: kept(one[w], d1) / n if one[w] else lost
    after = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for (h, w), c in two.items():
        after[h][0] += c
        after[h][1] += kept(c, d2)
        after[h][2] += p1(w)

    def p2(h, w):
        if h not in after:
            return p1(w)
        c, k, s = after[h]
        size = c + katz.LEAST if k > c * (1 - 1e-12) else c
        return kept(two[h, w], d2) / size if two[h, w] else (1 - k / size) / (1 - s) * p1(w)

    rows = [(len(w), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p2(h, x)) for h, x in zip([None, *w], w))) for w in tokens]
    sums = [sum(p2(h, w) for w in [*one, "never seen"]) for h in [None, *list(one)[:30]]]
    return n, rows, sums


def test_katz(docs, texts, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 5000)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 2000)
    learnt = [zlib.crc32(str(k).encode()) % 10 != 0 for k in range(len(texts))]
    n, want, sums = katz_by_hand(texts, learnt)
    assert np.allclose(sums, 1.0)
    got = {r["doc_id"]: r for r in katz.katz_scores(docs.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0), "train").collect()}
    assert len(got) == len(texts)
    for k, (size, known, base, score) in enumerate(want):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learnt[k], size, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_katz_of_order_three(docs, texts):
    """Against recursion on plain counts; the words of the vocabulary and an unknown one sum to 1 after every kind of history."""
    learnt = [k % 4 != 0 for k in range(len(texts))]
    tokens = [[*words(t), "</end>"] for t in texts]
    history = lambda w, n, t: tuple(w[max(0, t - n + 1) : t]) if t >= n - 1 else (None, *w[:t])
    count, after = {n: collections.Counter() for n in (1, 2, 3)}, {n: collections.defaultdict(collections.Counter) for n in (2, 3)}
    for w, use in zip(tokens, learnt):
        for t, x in enumerate(w if use else []):
            count[1][x] += 1
            for n in (2, 3):
                count[n][history(w, n, t), x] += 1
                after[n][history(w, n, t)][x] += 1
    n_all = sum(count[1].values())
    d = {n: katz.discounts([collections.Counter(count[n].values())[r] for r in range(1, katz.K + 2)]) for n in count}
    kept = lambda n, c: c * (d[n][c - 1] if 1 <= c <= katz.K else 1.0)
    lost = 1 - sum(kept(1, c) for c in count[1].values()) / n_all
    weights = {}

    def p(n, h, x):
        if n == 1:
            return kept(1, count[1][x]) / n_all if count[1][x] else lost
        lower = h[1:] if n == 3 and len(h) == 2 else h
        seen = after[n].get(h)
        if not seen:
            return p(n - 1, lower, x)
        if (n, h) not in weights:
            c, k = sum(seen.values()), sum(kept(n, v) for v in seen.values())
            size = c + katz.LEAST if k > c * (1 - 1e-12) else c
            weights[n, h] = size, (1 - k / size) / (1 - sum(p(n - 1, lower, y) for y in seen))
        size, weight = weights[n, h]
        return kept(n, seen[x]) / size if seen[x] else weight * p(n - 1, lower, x)

    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs.withColumn("train", F.col("doc_id") % 4 != 0), "train", order=3).collect()}
    for k, w in enumerate(tokens):
        assert got[k] == pytest.approx(sum(math.log10(p(3, history(w, 3, t), x)) for t, x in enumerate(w)), rel=1e-8), k
    some = [h for h in after[3] if len(h) == 2][:15] + [(None,), ("never", "seen")]
    assert [sum(p(3, h, x) for x in [*count[1], "never seen"]) for h in some] == pytest.approx([1.0] * len(some))


def test_katz_tables_score_other_texts(spark, docs, texts, monkeypatch):
    """A model kept as tables scores its own texts as the model in one go does, and others as if they stood beside them unlearnt."""
    monkeypatch.setattr(katz, "PART_TOKENS", 5000)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 2000)
    both = docs.withColumn("learnt", F.col("doc_id") % 3 != 0)
    for order in (1, 2, 3):
        want = {r["doc_id"]: r for r in katz.katz_scores(both, "learnt", order=order).collect()}
        tables = katz.fit_katz(both.where("learnt"), order=order)
        got = {r["doc_id"]: r for r in katz.score_katz(docs, tables).collect()}
        assert len(got) == len(want) and all(r["held_out"] for r in got.values())
        for k, r in want.items():
            assert got[k]["score"] == pytest.approx(r["score"], rel=1e-9) and got[k]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
            assert (got[k]["n_known"], got[k]["train_tokens"]) == (r["n_known"], r["train_tokens"])
    assert tables.ngrams.columns == ["level", "part", "keys", "a", "b"] and {r["level"] for r in tables.ngrams.collect()} == {1, 2, 3}


def test_katz_orders_and_edges(spark):
    df = spark.createDataFrame([(1, "a b a b c", True), (2, None, True), (3, "a b z", False), (4, "", None)], "doc_id long, text string, train boolean")
    for order in (1, 2, 3):
        rows = {r["doc_id"]: r for r in katz.katz_scores(df, "train", order=order).collect()}
        assert len(rows) == 4 and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows.values())
        assert rows[4]["held_out"] and rows[4]["n_tokens"] == 1 and rows[3]["n_known"] == 3
    assert katz.katz_scores(df.where("false"), "train").count() == 0
    alone = katz.katz_scores(df.where("train = false"), "train").first()
    assert alone["n_known"] == 0 and alone["train_tokens"] == 0


def test_leaks(spark, texts):
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    items = ["".join(rng.choice(letters + "    ") for _ in range(n)) for n in (40, 120, 250, 700)]
    host = texts[10] + " " + texts[11]
    edited = list(items[1])
    for _ in range(9):
        edited[rng.randrange(len(edited))] = "Z"
    rows = [(0, host + " " + items[0].upper() + " " + host), (1, "é " * 50 + "".join(edited) + host), (2, items[2].replace(" ", "\n ") + host), (3, items[3][100:500]), (4, host), (5, None), (6, ""), (6, "x" + items[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "short"), (92, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (0, 92), (1, 1), (2, 2), (3, 3), (6, 0), (6, 92)}
    assert got[0, 0]["edits"] == 0 and 1 <= got[1, 1]["edits"] <= 9
    r = got[1, 1]
    assert abs(r["start"] - 100) <= 9 and abs(r["stop"] - r["start"] - 120) <= 9
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()} == {4, 5, 6}
    assert decontaminate.without_leaks(docs, bench).count() == 3
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), bench).count() == 0


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_and_lemma_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        segment = "".join(rng.choice("abcd ") for _ in range(60))
        edited = list(segment)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(edited))
            edited[k : k + 1] = rng.choice(["", "e", edited[k] + "f"])
        text = "".join(rng.choice("mnop") for _ in range(30)) + "".join(edited) + "".join(rng.choice("mnop") for _ in range(30))
        least = edit_distance_within(decontaminate.normalised(segment), decontaminate.normalised(text))
        data = np.frombuffer(text.encode(), np.uint8)
        found = decontaminate.find(decontaminate.build([segment]), data, np.array([0, len(data)]))
        assert bool(found) == (least <= len(decontaminate.normalised(segment)) // 10) and (not found or found[0][4] == least)


@pytest.mark.parametrize("owners", [8, 0])
def test_items_of_all_lengths_and_with_a_common_stem(owners, monkeypatch):
    """With and without q-grams that count in bands, and whatever the length, what is found is what brute force finds."""
    monkeypatch.setattr(decontaminate, "OWNERS", owners)
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    stem = draw(60)
    items = [draw(n) for n in (3, 7, 8, 9, 10, 12, 15, 19, 20, 22, 25, 30, 31, 39, 40, 61)] + [stem + draw(40) for _ in range(30)]
    indexes = decontaminate.build(items)
    for trial in range(12):
        held = rng.sample(items, 5)
        parts = [draw(20)]
        for x in held:
            x = list(x)
            for _ in range(rng.randint(0, 1 + len(x) // 10)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice(["", "z", x[k] + "y"])
            parts += ["".join(x), draw(20)]
        text = "".join(parts)[: 600 + trial]
        data = np.frombuffer(text.encode(), np.uint8)
        found = {item: edits for _, item, _, _, edits in decontaminate.find(indexes, data, np.array([0, len(data)]))}
        least = {k: edit_distance_within(x, text) for k, x in enumerate(items) if len(x) >= 8}
        assert found == {k: e for k, e in least.items() if e <= len(items[k]) // 10}


def test_common_stems_do_not_multiply():
    """Thousands of items with one stem against a long text of that stem: bounded by the text, not by the pairs."""
    rng = random.Random(10)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    stem = draw(66)
    indexes = decontaminate.build([stem + draw(54) + str(k) for k in range(3000)])
    text = (stem + " ") * 4000 + stem + indexes[-1].texts[7][66:]
    data = np.frombuffer(text.encode(), np.uint8)
    began = time.monotonic()
    found = decontaminate.find(indexes, data, np.array([0, len(data)]))
    assert [f[4] for f in found] == [0] and time.monotonic() - began < 60


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "before the very passage that leaks here behind")], "doc_id smallint, text string")
    bench = spark.createDataFrame([(2.5, "the very passage that leaks here")], "item_id double, text string")
    for kind in ("double", "smallint", "string", "decimal(10,2)", "date", "binary"):
        item = F.lit("2020-01-01").cast("date") if kind == "date" else F.col("item_id").cast("string").cast("binary") if kind == "binary" else F.col("item_id").cast(kind)
        named = bench.select(item.alias("item_id"), "text")
        assert decontaminate.leaks(docs, named).first()["item_id"] == named.first()["item_id"]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 10)
    docs = spark.createDataFrame([(k, f"some words {k} and then passage number {k} of the benchmark, and more") for k in range(4)] + [(9, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"passage number {k} of the benchmark") for k in range(1, 4)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect() if r["edits"] == 0} == {1, 2, 3}
    assert decontaminate.without_leaks(docs, bench).where("doc_id = 9").count() == 1


def labelled(spark, bad, n=160):
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        rows.append((k, " ".join(bad(w, rng)) if k % 4 == 0 else " ".join(w), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5000, 0), (3, None)], "doc_id long, label int"), {k: y for k, _, y in rows}


def test_quality_classifier(spark):
    docs, labels, want = labelled(spark, lambda w, rng: [x + "!!" for x in w])
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = quality.fit(docs, labels, usable, label="label")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [k for k in want if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == want[k] for k in held]) > 0.95
    assert 0 <= got[1000] <= 1 and got[1000] == got[1001]
    again = quality.fit(docs, labels, usable, label="label")
    assert np.array_equal(model.vectors, again.vectors)
    assert quality.score(docs.where("false"), quality.train([], np.zeros(0))).count() == 0


def test_quality_features_and_score_by_hand(texts):
    """Words, pairs and n-grams of every text, counted in plain Python; the folded score is the softmax of the averaged vectors."""
    rng = np.random.default_rng(1)
    size = 1 << quality.BUCKETS_LOG2
    model = quality.Model(rng.normal(size=(size, quality.DIM)).astype(np.float32), rng.normal(size=(2, quality.DIM)).astype(np.float32), rng.normal(size=2).astype(np.float32))
    parts, constant = model.folded()
    some = [t for t in texts if t is None or len(t) < 3000]
    for a, b, data, offsets in tn.chunks(pa.array(some, pa.string()), most=2000):
        bucket, doc = quality.features(data, offsets)
        for k in range(a, b):
            raw = (some[k] or "").encode()
            w = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
            padded = b" " + re.sub(rb"[\x20\x09-\x0D]", b" ", raw) + b" "
            grams = sum(b" " not in padded[i + 1 : i + n - 1] for n in quality.GRAMS for i in range(len(padded) - n + 1))
            mine = bucket[doc == k - a]
            assert len(mine) == len(w) + max(0, len(w) - 1) + grams
            mean = model.vectors[mine].mean(0) if len(mine) else np.zeros(quality.DIM)
            logits = model.output @ mean + model.bias
            p = np.exp(logits - logits.max())
            folded = parts[mine].mean() + constant if len(mine) else constant
            assert tn.sigmoid(folded) == pytest.approx(p[1] / p.sum(), rel=1e-3)


def test_very_long_texts(spark):
    """A text of 400,000 characters beside short ones, in every operator that reads whole texts in Python."""
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    item = " ".join(rng.choice(vocabulary) for _ in range(15))
    docs = spark.createDataFrame([(1, long), (2, f"{long} {item}"), (3, "short"), (4, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [2]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    scores = {r["doc_id"]: r for r in katz.katz_scores(docs.withColumn("train", F.col("doc_id") != 2), "train").collect()}
    assert scores[2]["n_tokens"] == 60_016 and scores[1]["n_known"] == 60_001
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, label int")
    for module, out in ((quality, lambda m: quality.score(docs, m)), (toxicity, lambda m: toxicity.tag(docs, m))):
        model = module.fit(docs, labels, F.lit(True), label="label")
        assert all(0 <= r["score"] <= 1 for r in out(model).collect())


def test_toxicity(spark):
    insults = ["gruk", "blarf", "zornik"]
    docs, labels, want = labelled(spark, lambda w, rng: [*w[:4], rng.choice(insults) + ",", *w[4:], rng.choice(insults).upper()])
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, labels, usable, label="label")
    rows = {r["doc_id"]: r for r in toxicity.tag(docs, model, keep_text=True).collect()}
    held = [k for k in want if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(rows[k]["score"] >= 0.5) == want[k] for k in held]) > 0.95
    spans = {rows[k]["text"][s["start"] : s["stop"]].lower() for k in held if want[k] for s in rows[k]["spans"]}
    assert spans and all(any(i in s for i in insults) for s in spans)
    assert rows[1000]["spans"] == [] and rows[1000]["score"] == rows[1001]["score"] < 0.5
    empty = toxicity.train([], np.zeros(0))
    assert toxicity.tag(docs.where("false"), empty).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    moves, start = rng.normal(size=(2, 2)), 0.3
    scores = rng.normal(size=(5, 1))
    ahead, back = toxicity.forward_backward(scores, np.ones(5, int), moves, start)
    weight = np.zeros((5, 2))
    for path in np.ndindex(*(2,) * 5):
        total = start * path[0] + sum(scores[t, 0] * path[t] for t in range(5)) + sum(moves[path[t], path[t + 1]] for t in range(4))
        for t in range(5):
            weight[t, path[t]] += math.exp(total)
    assert np.allclose((ahead + back)[:, 0], np.log(weight[:, 1] / weight[:, 0]))
