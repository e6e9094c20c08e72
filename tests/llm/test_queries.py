"""Every registered query of the subpackage on a small folder, its columns recomputed in plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from test_native_ops import alike_by_hand, syncmers_by_hand, water_filled
from test_text_ops import brute_components, edit_distance_within, words

from regrove.llm import chat, queries, syncmers

INSULTS = ["gruk", "blarf", "zornik"]


def crc(k, m):
    return zlib.crc32(str(k).encode()) % m


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(30)
    vocabulary = ["".join(rng.choice("aeiounrstlé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for k in range(1, 181):
        w = prose(rng.randint(15, 70)).split()
        toxic, quality = int(k % 4 == 0), int(k % 3 != 0)
        if toxic:
            w[2:2] = [rng.choice(INSULTS), rng.choice(INSULTS).upper() + "!"]
        if not quality:
            w = [x + "$$" if rng.random() < 0.4 else x for x in w]
        docs.append((k, " ".join(w)))
        labels.append((k, quality, toxic))
    items = [prose(12) for _ in range(3)]
    docs += [(200, docs[0][1]), (201, docs[0][1].upper().replace("É", "é")), (202, docs[5][1] + " more"), (203, None), (204, ""), (205, " \t\n"), (206, "one"), (207, "一二三 😀 " * 4), (208, prose(9000)), (209, docs[0][1])]
    docs += [(300 + k, f"{prose(8)} {x} {prose(4)}") for k, x in enumerate(items)]
    sources = {k: ["web", "web", "web", "book", "", None][k % 6] for k, _ in docs}
    pages = [(0, "http://a.example.com/en/7/x?q"), (1, "https://B.com/en/"), (2, "http://b.com/de/"), (3, "http://notcom/en/"), (4, "http://x.net/de/1"), (5, "http://example.net/de/8"), (6, "http://org/es/#z"), (7, None), (8, "no url"), (9, "ftp://q.org?x=/es/"), (9, "http://fresh.site/"), (10, "http://pointer.site/a://b")]
    html = {9: '<a href="http://b.com/x">', 10: "<a href='//B.com/y'>"}
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\n<|im_end|>"), (2, 3, "assistant", None), (2, 1, "system", "\\"), (3, 0, "user", ""), (3, 1, "assistant", "é" * 3000), (3, 2, "assistant", "again")]
    return docs, labels, items, sources, pages, html, talks


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    docs, labels, items, sources, pages, html, talks = tables
    path = tmp_path_factory.mktemp("queries")
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    put([(k, t, "en", sources[k], len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put(labels, "doc_id long, quality int, toxic int", "labels")
    put([*enumerate(items), (7, None)], "item_id long, text string", "benchmark")
    put([(k, u, html.get(k)) for k, u in pages], "page_id long, url string, html string", "pages")
    put(talks, "conv_id long, turn int, role string, text string", "conversations")
    return str(path)


def rows_of(spark, folder, name, key="doc_id"):
    found = queries.queries()[name](spark, folder).collect()
    out = {r[key]: r.asDict(recursive=True) for r in found}
    assert len(out) == len(found) or key != "doc_id"
    return out


def test_decontaminate(spark, folder, tables):
    docs, _, items = tables[:3]
    low = lambda t: " ".join(words(t))
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op1_decontaminate(spark, folder).collect()}
    short = [(k, t) for k, t in docs if len(t or "") < 5000]
    want = {(k, i): e for k, t in short for i, x in enumerate(items) if (e := edit_distance_within(low(x), low(t))) <= len(low(x)) // 10}
    assert found == want and {k for k, _ in found} == {300, 301, 302}


@pytest.mark.parametrize("name, place, modulus, rest", [("op2_quality", 1, 3, 1), ("op8_toxicity", 2, 5, 0)])
def test_classifiers(spark, folder, tables, name, place, modulus, rest):
    got = rows_of(spark, folder, name)
    docs, labels = dict(tables[0]), {r[0]: r[place] for r in tables[1]}
    assert set(got) == set(docs)
    for k, r in got.items():
        assert r["held_out"] == (crc(k, modulus) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert got[1]["score"] == pytest.approx(got[200]["score"], rel=1e-12) == pytest.approx(got[209]["score"], rel=1e-12) and got[203]["score"] == got[204]["score"]
    held = [k for k in labels if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == labels[k] for k in held) / len(held) > 0.85


def test_language_model(spark, folder, tables):
    got = rows_of(spark, folder, "op3_katz")
    tokens = {k: [*words(t), "</end>"] for k, t in tables[0]}
    counts = collections.Counter(x for k, w in tokens.items() if crc(k, 10) for x in w)
    n, v = sum(counts.values()), len(counts)
    for k, w in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(k, 10) == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert got[209]["score"] > got[209]["base_score"]  # a text that the model has seen


def test_mix(spark, folder, tables):
    docs, sources = tables[0], tables[3]
    got = rows_of(spark, folder, "op4_mix")
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in docs}
    sizes = collections.Counter()
    for k in size:
        sizes[sources[k]] += size[k]
    target = water_filled(sizes, (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        before, whole = 0, int(target[s] // sizes[s])
        rest = target[s] - whole * sizes[s]
        for k in sorted((k for k in size if sources[k] == s), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()):
            r = got[k]
            assert (r["size"], r["source_size"]) == (size[k], sizes[s]) and r["target"] == pytest.approx(target[s])
            assert r["taken"] == size[k] * (whole + (rest > 0 and before + size[k] / 2 <= rest))
            before += size[k]


def test_jaccard(spark, folder, tables):
    docs = sorted(tables[0])
    got = rows_of(spark, folder, "op5_jaccard")
    ids = [k for k, _ in docs]
    want = {ids[k]: (n, ids[c]) for k, (n, c) in brute_components([t for _, t in docs]).items()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want


def test_shards(spark, folder, tables):
    got = rows_of(spark, folder, "op6_shard")
    slots, held = collections.defaultdict(list), collections.Counter()
    for k, t in tables[0]:
        raw, r = (t or "").encode(), got[k]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r["size"] for r in got.values())
    assert all(abs(held[s] - sum(held.values()) / 16) <= longest for s in range(16))
    assert len({got[k]["shard"] for k in (1, 200, 209)}) == 1  # equal texts


def test_fingerprints(spark, folder, tables):
    docs = sorted(tables[0])
    got = rows_of(spark, folder, "op7_syncmers")
    line = lambda t: ",".join(f"{at:X}:{h:X}" for at, h in syncmers_by_hand(t, syncmers.K, syncmers.S))
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        t, after, r = t or "", after or "", got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        ascii_space = re.sub(r"[^\x20\x09-\x0D]+", lambda m: m[0], t)
        assert r["fingerprint"] == line(ascii_space) and r["edited_fingerprint"] == line(edited)
        assert r["near_edited"] == pytest.approx(alike_by_hand(t, edited)) and r["near_next"] == pytest.approx(alike_by_hand(t, after))
    prose = [k for k, _ in docs if k < 180]
    assert all(got[k]["near_edited"] > got[k]["near_next"] for k in prose)


def test_urls(spark, folder, tables):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    got = collections.defaultdict(list)
    for r in queries.op9_urls(spark, folder).collect():
        got[r["page_id"]].append(r)
    assert sum(map(len, got.values())) == len(tables[4])
    verdicts = {}
    for k, url in tables[4]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(p), v, p) for v, p in rules if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith("/" + p.split("/", 1)[1])]
        r = next(x for x in got[k] if x["host"] == host and x["path"] == path)
        assert r["rule"] == (max(fit)[2] if fit else None)
        verdicts[k, host] = r["verdict"]
        if fit:
            assert r["verdict"] == max(fit)[1]
    assert verdicts[2, "b.com"] == "block"  # the host of a blocked page
    assert got[10][0]["distrust"] > 0 == got[8][0]["distrust"]  # points at it
    assert verdicts[8, ""] == "allow"


def test_urls_get_the_words_of_the_contract(spark, tmp_path):
    """Each rule, the longer one within another, and a blocked page beside an allowed one of its host."""
    want = {"http://b.com/en/": ("com/en/", "block"), "http://a.example.com/en/7": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"), "http://x.net/de/1": ("net/de/", "allow"), "http://net/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://q.org/es/": ("org/es/", "block")}
    pages = [(k, url, None) for k, url in enumerate(want)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op9_urls(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_chat(spark, folder, tables):
    talks = collections.defaultdict(list)
    for c, turn, role, text in tables[6]:
        talks[c].append((turn, role, text or ""))
    talks[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    got = rows_of(spark, folder, "op10_chat", "conv_id")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in talks.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(chat.render(turns)[0]))
    assert set(got) == set(talks)


def test_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op10_chat" else 0), name
