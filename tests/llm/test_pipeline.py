"""The five stages against plain versions of their decisions, and the whole pipeline."""

import numpy as np
import xxhash

import corpus_pipeline as cp
from plain import brute_components, is_leak, plain_features, plain_mix, plain_score
from plumbline.llm import jaccard, quality, sharding
from plumbline.llm.common import written


def test_stages(spark, table):
    """Each stage, over what the one before kept, against a plain version: trees walked row by row, all pairs of shingle sets, all alignments, the mix by hand, placement by hash."""
    docs = spark.read.parquet(f"{table}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{table}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    before, after = {}, {}
    for name, stage in cp.STAGES:
        before[name] = docs.collect()
        if name == "quality classifier":
            model = quality.train(docs, labels)
        docs = written(stage(spark, docs, table), "stage")
        after[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == names
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    name = "quality classifier"
    assert ids(after[name]) == sorted(r["doc_id"] for r in before[name] if plain_score(model, plain_features(r["text"])) >= 0.7)
    name = "n-gram Jaccard join"
    found = brute_components({r["doc_id"]: (r["text"] or "").encode() for r in before[name]}, cp.NEAR_WORDS, cp.NEAR_PERCENT)
    assert ids(after[name]) == sorted(i for i, (_, first) in found.items() if i == first) and len(after[name]) < len(before[name])
    name = "benchmark decontamination"
    assert ids(after[name]) == sorted(r["doc_id"] for r in before[name] if not any(is_leak(r["text"], x) for x in items)) and len(after[name]) < len(before[name])
    name = "mixing sources to target weights"
    want = plain_mix([(r["doc_id"], r["source"], r["text"]) for r in before[name]])
    assert ids(after[name]) == sorted(i for _, i in want)
    place = {}
    for at, i in want:
        place.setdefault(i, []).append(at)
    got = [place[r["doc_id"]].pop(0) for r in after[name]]  # the positions, in the order of the rows
    assert all(b - a > -1e-4 for a, b in zip(got, got[1:]))
    name = "sharding"
    owner = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)], sharding.TABLE_SIZE)
    assert sorted(tuple(r)[: len(names)] for r in after[name]) == sorted(tuple(r) for r in before[name])
    for r in after[name]:
        h = xxhash.xxh64(str(r["doc_id"]).encode(), seed=42).intdigest()
        slot = (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
    assert sorted(tuple(r) for r in cp.run(spark, table).collect()) == sorted(tuple(r) for r in after[name])


def test_near_copies_by_five_words(spark, docs):
    words = [f"w{i}" for i in range(1000)]
    copy = [f"x{i}" if i % 47 == 20 else w for i, w in enumerate(words)]  # 21 of 1,000 words: 0.81 by five words, 0.84 by four
    kept = cp.keep_first_copy(spark, docs([(1, " ".join(words)), (2, " ".join(copy))]), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_published_parts_at_any_percent():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 85, 95):
        for n in (1, 5, 40, 127, 130, 255, 900, 1000):
            u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            _, t = jaccard.reach(len(u), percent)
            gone = next(g for g in range(t, -1, -1) if 100 * (len(u) - g // 2) >= percent * (len(u) + g - g // 2))
            new = rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)
            v = np.unique(np.concatenate([rng.permutation(u)[gone // 2 :], new]))
            assert len(np.intersect1d(jaccard.published(u, percent), jaccard.published(v, percent)))
