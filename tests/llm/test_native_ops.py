"""Mixing, sharding, fingerprints, url filters and chat formatting on small tables."""

import collections

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from regrove.llm import chat, linkgraph, mixing, sharding, syncmers


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", (k * 37) % 50 + (5000 if k == 17 else 0), f"text {k if k > 400 else 1}") for k in range(1200)]
    rows += [(2000 + k, None, 3, "text 1") for k in range(20)] + [(None, "hot", None, None), (7, "hot", 5, "again"), (7, "hot", 5, "again"), (3000, "none", 0, "")]
    return spark.createDataFrame(rows, "doc_id long, source string, size long, text string").withColumns({"shard": F.lit("clash"), "taken": F.lit("clash"), "_row": F.lit("kept")})


@pytest.mark.parametrize("leaf", [50_000, 20])
def test_shards(sized, leaf):
    out = sharding.shard_by_size(sized, F.col("size"), F.col("text"), F.col("doc_id"), 8, ranges=64, leaf_rows=leaf)
    rows = out.collect()
    assert len(rows) == sized.count() and "_row" in out.columns
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"] or 0
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(held.values()) / 8
    assert all(abs(held[k] - mean) < 5100 for k in range(8))
    again = sharding.shard_by_size(sized, F.col("size"), F.col("text"), F.col("doc_id"), 8, ranges=64, leaf_rows=leaf)
    key = lambda rs: sorted((str(r["doc_id"]), r["text"] or "", r["shard"]) for r in rs)
    assert key(rows) == key(again.collect())


def test_shards_of_nothing_and_of_empty_records(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_size(empty, F.lit(1), F.col("text"), F.col("doc_id")).count() == 0
    zero = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = sharding.shard_by_size(zero, F.lit(0), F.col("doc_id"), F.col("doc_id"), 4, ranges=16).collect()
    assert len(rows) == 100 and len({r["shard"] for r in rows}) == 4


def water_filled(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full}
        rest = left - sum(target.values())
        target |= {s: rest * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(sized):
    sizes = collections.Counter()
    for r in sized.collect():
        sizes[r["source"]] += r["size"] or 0
    want = water_filled(sizes, (5, 2, 1), 1.5, 2.0)
    for bucket in (20_000, 50):
        rows = mixing.mix(sized, F.col("source"), F.col("size"), F.col("doc_id"), bucket_rows=bucket).collect()
        taken, most = collections.Counter(), collections.Counter()
        for r in rows:
            assert r["taken"] in {k * (r["size"] or 0) for k in (0, 1, 2)} and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["taken"]
            most[r["source"]] = max(most[r["source"]], r["size"] or 0)
        assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in want)
    mixed = mixing.mix(sized, F.col("source"), F.col("size"), F.col("doc_id"))
    kept = mixing.held(sized, F.col("source"), F.col("size"), F.col("doc_id"))
    assert kept.count() == mixed.agg(F.sum("repeats")).first()[0] and kept.columns == sized.columns
    assert kept.where("source = 'none'").count() == 1
    assert mixing.mix(sized.where("false"), F.col("source"), F.col("size"), F.col("doc_id")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
    return signed(seed)


def test_mix_splits_equal_rows(spark):
    """A budget that ends among rows that agree in key and size, or in every column, is met all the same."""
    rows = [(None, "a", 10, "same")] * 101 + [(None, "b", 10, f"text {k}") for k in range(101)] + [(None, "c", 0, "")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, repeats string")
    for bucket in (20_000, 7):
        mixed = mixing.mix(df, F.col("source"), F.col("size"), F.col("doc_id"), weights=(1,), bucket_rows=bucket)
        got = mixed.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert {r["source"]: r["n"] for r in got} == {"a": 101, "b": 101, "c": 5}
        assert all(abs(r["taken"] - r["target"]) <= 5 for r in got)
        rows_of = lambda m: sorted(map(str, m.collect()))
        assert rows_of(mixed) == rows_of(mixing.mix(df.repartition(3), F.col("source"), F.col("size"), F.col("doc_id"), weights=(1,), bucket_rows=bucket))
        held = mixing.held(df, F.col("source"), F.col("size"), F.col("doc_id"), weights=(1,), bucket_rows=bucket)
        assert held.columns == df.columns and held.count() == mixed.agg(F.sum("repeats")).first()[0]


def syncmers_by_hand(text, k, s):
    w = (text or "").split()
    if not w:
        return []
    w = [""] * (k - 1) + w
    inner = [-(1 << 63) if w[i + s - 1] == "" else xx(*w[i : i + s]) for i in range(len(w) - s + 1)]
    width, out = k - s + 1, []
    for i in range(len(inner) - width + 1):
        window = inner[i : i + width]
        if min(window) in (window[0], window[-1]):
            cover = sorted({*range(0, width, s), width - 1})
            out.append((i, (xx(*(inner[i + j] for j in cover)) & ((1 << 64) - 1)) >> (64 - syncmers.HASH_BITS)))
    return out


TEXTS = [None, "", " \n", "one", "a b c", "a b c d e f g h i j", "x y " * 40, " ".join(map(str, range(3000))), " ".join(map(str, range(500, 3500)))]


@pytest.mark.parametrize("k, s", [(8, 2), (4, 2), (6, 2), (3, 1), (3, 2)])
def test_closed_syncmers(spark, k, s):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("own_anchors", F.lit("clash"))
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(df, {"own": F.col("text")}, k=k, s=s).collect()}
    for n, t in enumerate(TEXTS):
        assert [(a["at"], a["hash"]) for a in rows[n]["own_anchors"]] == syncmers_by_hand(t, k, s)
    if k == 8:
        assert 0.2 < len(rows[7]["own_anchors"]) / 3000 < 0.37


def alike_by_hand(a, b):
    first = [dict(reversed([(h, at) for at, h in syncmers_by_hand(t, syncmers.K, syncmers.S)])) for t in (a, b)]
    diffs = [first[1][h] - first[0][h] for h in first[0] if h in first[1]]
    half = syncmers.BAND // 2
    best = max([0, *collections.Counter(d // syncmers.BAND for d in diffs).values(), *collections.Counter((d + half) // syncmers.BAND for d in diffs).values()])
    either = len(first[0]) + len(first[1]) - best
    return best / either if either else 1.0


def test_anchors_match_by_position(spark):
    a, b = TEXTS[7], TEXTS[8]
    texts = [*TEXTS, b + " " + a, "one two", a.replace(" 1500 ", " changed "), "x y " * 39 + "z"]
    df = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "i long, j long, x string, y string").withColumn("like", F.lit("clash"))
    both = syncmers.fingerprints(df, {"x": F.col("x"), "y": F.col("y")})
    got = {(r["i"], r["j"]): r["like"] for r in syncmers.alike(both, {"like": ("x_anchors", "y_anchors")}).collect()}
    for (i, j), like in got.items():
        assert like == pytest.approx(alike_by_hand(texts[i], texts[j])), (i, j)
        assert like == pytest.approx(1.0) or (texts[i] or "").split() != (texts[j] or "").split()
    assert got[7, 8] > 0.65 and got[7, 11] > 0.97 and got[3, 10] > 0.3 and got[3, 4] == 0 and got[1, 3] == 0


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"w{k * k % 97}" for k in range(60))
    df = spark.createDataFrame([(0, passage), (1, f"other words before {passage} and behind")], "doc_id long, text string")
    a, b = ([(x["at"], x["hash"]) for x in r["own_anchors"]] for r in syncmers.fingerprints(df, {"own": F.col("text")}).orderBy("doc_id").collect())
    assert {(at + 3, h) for at, h in a if at >= syncmers.K - 1} <= set(b)


@pytest.mark.parametrize("range_rows", [4096, 3])
def test_next_text(spark, range_rows):
    ids = [5, 3, 9, -4, 100, 7, 8, 20, 21, 22]
    df = spark.createDataFrame([(k, f"t{k}" if k != 8 else None) for k in ids], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(df, "doc_id", "text", range_rows=range_rows).collect()}
    order = sorted(ids)
    assert got == {k: (f"t{n}" if n != 8 else None) for k, n in zip(order, order[1:] + order[:1])}
    named = df.select(F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("doc_id"), "text").where("doc_id > 'n'")
    by_name = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(named, "doc_id", "text", range_rows=range_rows).collect()}
    names = sorted(by_name)
    texts = {r["doc_id"]: r["text"] for r in named.collect()}
    assert len(names) == len(ids) and by_name == {k: texts[n] for k, n in zip(names, names[1:] + names[:1])}
    one = df.where("doc_id = 5")
    assert syncmers.with_next(one, "doc_id", "text").first()["next_text"] == "t5"
    assert syncmers.with_next(df.where("false"), "doc_id", "text").count() == 0


def test_urls(spark):
    rules = [linkgraph.Rule("block", "com/en/"), linkgraph.Rule("allow", "example.com/en/7"), linkgraph.Rule("block", "bad.org/")]
    link = lambda *to: "".join(f'<a HREF = "https://{t}/x">' for t in to)
    rows = [
        (0, "https://A.Example.COM/en/7?q=/en/", link("friend.net")), (1, "http://x.com/en/", ""), (2, "http://x.com/fr/", None), (3, "http://notexample.com/en/7", None), (4, None, None), (5, "no scheme", ""),
        (6, "http://bad.org/", link("bad.org")), (7, "http://farm.net/", link("bad.org", "BAD.org")), (8, "http://friend.net/#a?b", link("other.net")), (9, "http://h?x/en/", ""), (9, "http://h?x/en/", ""), (10, "http://org/en", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit("clash"))
    got = {r["page_id"]: r for r in linkgraph.judge_urls(pages, rules).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1]["verdict"] == "block" and got[1]["rule"] == "com/en/" and got[3]["rule"] == "com/en/"
    assert got[2]["rule"] is None and got[2]["verdict"] == "block"  # the host of a blocked page
    assert (got[4]["host"], got[4]["path"], got[4]["verdict"]) == ("", "", "allow") and got[5]["host"] == ""
    assert got[7]["verdict"] == "block" and got[7]["distrust"] > got[7]["trust"]  # points at a blocked host
    assert got[8]["verdict"] == "allow" and got[8]["trust"] > 0 and got[8]["path"] == "/"  # a trusted host points at it
    assert (got[9]["host"], got[9]["path"]) == ("h", "") and linkgraph.judge_urls(pages, rules).count() == len(rows)
    assert linkgraph.judge_urls(pages.where("false"), rules).count() == 0
    ties = [linkgraph.Rule("allow", "com/fr/"), linkgraph.Rule("block", "com/fr/")]
    assert [linkgraph.judge_urls(pages.where("page_id = 2"), x).first()["verdict"] for x in (ties, ties[::-1])] == ["allow", "block"]  # the first given wins


def test_more_linked_than_crawled_hosts(spark, monkeypatch):
    monkeypatch.setattr(linkgraph, "BROADCAST_ROWS", 3)
    links = "".join(f'<a href="http://linked{k}/">' for k in range(50))
    pages = spark.createDataFrame([(0, "http://good/", links), (1, "http://other/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in linkgraph.judge_urls(pages, [linkgraph.Rule("allow", "good/")]).collect()}
    assert got[0]["trust"] > 0 and got[1]["trust"] == 0 and len(got) == 2


def test_plans_do_not_grow_with_rounds(spark):
    e = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("t", "a")], "kind string, host string")
    plan = lambda n: linkgraph.personalised_rank(e, seeds, rounds=n)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert plan(6) == plan(2)


def test_rank_against_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("kind", F.lit("t"))
    got = {r["host"]: r["rank"] for r in linkgraph.personalised_rank(e, spark.createDataFrame([("t", "a"), ("t", "d")], "kind string, host string"), rounds=8).collect()}
    seed = {"a": 0.5, "d": 0.5}
    rank = dict(seed)
    for _ in range(8):
        new = collections.Counter()
        for h, p in rank.items():
            out = [(d, w) for s, d, w in edges if s == h]
            for d, w in out:
                new[d] += 0.85 * p * w / sum(x for _, x in out)
        flow = sum(new.values())
        for h, p in seed.items():
            new[h] += p * (1 - flow)
        rank = dict(new)
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


def converged(edges, seeds):
    hosts = sorted({h for s, d, _ in edges for h in (s, d)} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    a, seed = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for s, d, w in edges:
        a[at[d], at[s]] += 0.85 * w / sum(x for u, _, x in edges if u == s)
    for h in seeds:
        seed[at[h]] = 1 / len(seeds)
    x = np.linalg.solve(np.eye(len(hosts)) - a + np.outer(seed, a.sum(0)), seed)
    return dict(zip(hosts, x))


def test_rank_converges(spark):
    edges = [(f"h{k:02}", f"h{k + 1:02}", 1.0) for k in range(20)] + [("h20", "h00", 1.0), ("h20", "sink", 2.0), ("x", "y", 1.0), ("y", "x", 1.0), ("x", "h05", 0.1)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("kind", F.lit("t"))
    got = {r["host"]: r["rank"] for r in linkgraph.personalised_rank(e, spark.createDataFrame([("t", "h00"), ("t", "x")], "kind string, host string"), tolerance=1e-3).collect()}
    want = converged(edges, ["h00", "x"])
    assert set(got) == set(want) and sum(abs(got[h] - want[h]) for h in want) <= 1e-3


def test_distrust_reaches_hosts_far_from_a_blocked_one(spark):
    """A chain of 20 hosts leads to the blocked one, among 400 hosts: those after more than 8 links are blocked as well."""
    rows = [(k, f"http://c{k}/", f'<a href="http://c{k - 1}/">') for k in range(21)] + [(k, f"http://other{k}/", None) for k in range(21, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in linkgraph.judge_urls(pages, [linkgraph.Rule("block", "c0/")]).collect()}
    want = converged([(f"c{k - 1}", f"c{k}", 1.0) for k in range(1, 21)], ["c0"])
    assert all(got[k]["distrust"] == pytest.approx(want[f"c{k}"], abs=1e-5) for k in range(21))
    assert [k for k in got if got[k]["verdict"] == "block"] == [k for k in range(21) if k == 0 or want[f"c{k}"] > 1 / 400] and got[12]["verdict"] == "block"


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a\\\nb<|<|", "ends with <", "é\r\n\\n"])
def test_template_round_trip(text):
    turns = [("user", text), ("assistant", text), ("odd\nrole\\<|", text), ("", "")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns and formatted.count("<|im_start|>") == 4
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_reply_trees(spark):
    #      1 - 2 - 4        7 - 8 (another tree, a missing parent), and a lone 9
    #        \ 3 - 5 - 6
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 2, "user", "x", 0.0), ("t", 5, 3, "user", None, 3.0), ("t", 6, 5, "assistant", "end", None), ("u", 7, 99, "user", "hi", 0.0), ("u", 8, 7, None, "yo", 0.0), ("v", 9, None, "user", "", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(df).collect()}
    assert set(got) == {("t", 4), ("t", 6), ("u", 8), ("v", 9)}
    assert chat.parse(got["t", 6]["text"]) == [("user", "q"), ("assistant", "good"), ("user", ""), ("assistant", "end")] and got["t", 6]["rank"] == 1
    assert chat.parse(got["u", 8]["text"]) == [("user", "hi"), ("", "yo")] and got["t", 4]["rank"] == 2
    assert {r["leaf"] for r in chat.format_trees(df, best=1).collect()} == {6, 8, 9}
    long = spark.range(300).select(F.lit("w").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    assert [t for _, t in chat.parse(chat.format_trees(long).first()["text"])] == [str(k) for k in range(300)]
    assert chat.format_trees(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(spark.createDataFrame([("t", 1, 2, "u", "a", 0.0), ("t", 2, 1, "u", "b", 0.0)], df.drop("leaf").schema)).collect()


def test_threads(spark):
    rows = [(1, 2, "b", "late"), (1, 1, "a", "early"), (1, 2, "a", None), (None, 1, "u", "x")]
    tree = chat.as_tree(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), F.col("conv"), [F.col("turn")])
    got = {r["tree"]: r["text"] for r in chat.format_trees(tree).collect()}
    assert chat.parse(got[1]) == [("a", "early"), ("a", ""), ("b", "late")]
    assert chat.parse(got[None]) == [("u", "x")]
