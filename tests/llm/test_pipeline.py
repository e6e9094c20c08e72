"""The pipeline's stages against brute force on a small folder: null, empty and repeated ids and texts, clashing names, no rows."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regrove.llm import _textnp as tn
from regrove.llm import mixing, toxicity

from test_text_ops import edit_distance_within, shingles, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, _copy int, taken int, shard string, _hash long, hash string, component int"
INSULTS = ["gruk", "blarf", "zornik"]


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts, labels = [], []
    for k in range(160):
        w = prose(rng.randint(12, 60)).split()
        if toxic := k % 5 == 0:
            w[3:3] = [rng.choice(INSULTS), rng.choice(INSULTS)]
        texts.append((k, " ".join(w)))
        labels.append((k, int(toxic), 1))
    items = [prose(14) for _ in range(4)]
    clean = [t for k, t in texts if k % 5]
    near = clean[3].split()
    near[-1] = "changed"
    texts += [(200, clean[0]), (201, clean[0]), (202, " ".join(near)), (203, clean[5].upper())]  # copies and near copies
    texts += [(210, prose(20)), (210, clean[7]), (210, prose(20))]  # one id, one of its texts a copy
    texts += [(220, texts[2][1])] * 2 + [(None, prose(25)), (None, clean[9])] + [(None, prose(18))] * 3
    texts += [(230 + k, f"{prose(10)} {x.title()} {prose(5)}") for k, x in enumerate(items)]
    texts += [(240, None), (241, ""), (241, ""), (242, " \n"), (243, "one"), (244, prose(4000))]
    rows = [(i, t, "en", ["hot", "hot", "b", None][k % 4], len(t or ""), f"clash {k}", "clash", k, k, "s", 7, "h", k) for k, (i, t) in enumerate(texts)]
    path = tmp_path_factory.mktemp("folder")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (7, None, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None), (10, "tiny")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


@pytest.fixture(scope="module")
def stages(spark, folder, pipeline):
    """What each stage is given and returns."""
    docs, out = spark.read.parquet(f"{folder[0]}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, folder[0]).persist()
        out[name] = (docs, found)
        docs = found
    return out


def key(rows):
    return collections.Counter(map(str, (tuple(r) for r in rows)))


def test_stage_names_and_columns(stages, pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for name, (_, out) in stages.items():
        assert out.columns == names if name != "sharding" else set(out.columns) == {*names, "slot"}


def test_toxic_documents_go(spark, folder, stages):
    docs, out = stages["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder[0]}/labels.parquet"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)
    want = []
    for r in docs.collect():
        (_, _, data, offsets), *_ = tn.chunks(pa.array([r["text"]], pa.string()))
        tok = toxicity.tokens(data, offsets)
        if tn.sigmoid(toxicity.summary(toxicity.marginals(tok, model), tok.first) @ model.law)[0] < 0.5:
            want.append(r)
    assert key(out.collect()) == key(want)
    kept = [bool(set(INSULTS) & set(words(r["text"]))) for r in out.collect()]
    assert not any(kept) and len(kept) >= 130


def test_one_of_each_group_stays(stages):
    docs, out = stages["n-gram Jaccard join"]
    rows = docs.collect()
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k) if sets[k] else ("blank", k)].append(r)
    kept = out.collect()
    have = key(kept)
    left = collections.Counter(have)
    for members in groups.values():
        mine = [m for m in members if left[str(tuple(m))] > 0]
        assert mine, "a group is lost"
        least = min((m["doc_id"] is None, m["doc_id"] or 0) for m in members)
        one = [m for m in mine if (m["doc_id"] is None, m["doc_id"] or 0) == least]
        assert one
        left[str(tuple(one[0]))] -= 1
    assert not +left, "more than one of a group"
    assert sum(r["doc_id"] == 210 for r in kept) == 2  # the copy under a repeated id goes, the others stay


def test_documents_with_passages_go(folder, stages):
    docs, out = stages["benchmark decontamination"]
    low = lambda t: " ".join(words(t))
    want = [r for r in docs.collect() if not any(edit_distance_within(low(x), low(r["text"])) <= len(low(x)) // 10 for x in folder[1])]
    assert key(out.collect()) == key(want) and docs.count() - len(want) == 4


def test_mix_keeps_rows_whole(stages):
    docs, out = stages["mixing sources to target weights"]
    size = lambda r: len(words(r["text"]))
    have, given = key(out.collect()), key(docs.collect())
    assert set(have) <= set(given) and all(have[r] <= 2 * given[r] for r in have)
    from test_native_ops import water_filled

    sizes, most, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in out.collect():
        taken[r["source"]] += size(r)
    target = water_filled(sizes, (5, 2, 1), 1.5, 2.0)
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    repeats = mixing.mix(docs.select("doc_id", "text", "source"), F.col("source"), F.size(F.expr("regexp_extract_all(coalesce(text, ''), '[^ \\n]+', 0)")), F.col("doc_id"))
    assert out.count() == repeats.agg(F.sum("repeats")).first()[0]


def test_shards_hold_all_rows(stages, pipeline):
    docs, out = stages["sharding"]
    rows = out.collect()
    names = [c for c in docs.columns if c != "shard"]
    assert key(out.select(*names).collect()) == key(docs.select(*names).collect())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(pipeline.N_SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
    longest = max(len((r["text"] or "").encode()) + 1 for r in rows)
    mean = sum(size.values()) / pipeline.N_SHARDS
    assert all(abs(size[k] - mean) <= longest + mean / 4 for k in slots)


def test_the_pipeline_is_its_stages(spark, folder, stages, pipeline):
    names = [c for c in stages["sharding"][1].columns if c not in ("shard", "slot")]
    whole = pipeline.run(spark, folder[0])
    assert set(whole.columns) == {*names, "shard", "slot"}
    assert key(whole.select(*names).collect()) == key(stages["sharding"][1].select(*names).collect())


def test_no_documents(spark, folder, tmp_path, pipeline):
    spark.read.parquet(f"{folder[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_documents_without_ids(spark, folder, tmp_path, pipeline):
    rows = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id is not null and doc_id < 40").withColumn("doc_id", F.lit(None).cast("long"))
    rows.union(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.drop_near_copies(spark, docs, str(tmp_path)).count() == rows.count()
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_a_run_leaves_only_its_last_table(spark, folder, pipeline):
    from regrove.llm import _shared

    before = len(_shared.MADE)
    pipeline.run(spark, folder[0]).count()
    left = [p.rpartition("/")[2] for p in _shared.MADE[before:]]
    assert [n.removeprefix("regrove-").rpartition("-")[0] for n in left] == ["mixing-sources-to-target-weights"]
