"""Results against brute force, round trips and held-out accuracy."""

import hashlib
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plain import brute_components, is_leak, plain_features, plain_score
from plumbline.llm import common, jaccard, leaks, lines, mixing, passages, perplexity, quality, rules, sharding, suffixes, tokens
from plumbline.llm.common import BitFilter, components, stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(spark, table):
    return {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()}


# ---------------------------------------------------------------- classifier


def test_classifier_beats_the_base_rate_on_held_out_documents(spark, middle):
    got = quality.op1_quality_classifier(spark, middle).toPandas()
    truth = spark.read.parquet(f"{middle}/labels.parquet").toPandas()
    assert got["score"].between(0, 1).all() and len(got) == spark.read.parquet(f"{middle}/documents.parquet").count()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got["doc_id"], got["held_out"]))
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    m = got[got["held_out"]].merge(truth, on="doc_id")
    base = max(m["quality"].mean(), 1 - m["quality"].mean())
    accuracy = (m["predicted"] == m["quality"]).mean()
    assert len(m) > 50 and accuracy > base + 0.5 * (1 - base)


def test_scores_equal_a_plain_walk(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{table}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.op1_quality_classifier(spark, table).collect():
        assert abs(r["score"] - plain_score(model, plain_features(text[r["doc_id"]]))) < 1e-9


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == (y[1500:] > 0)).mean() > 0.95


def test_one_class_gives_a_constant():
    assert np.allclose(quality.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((3, 2))), 1.0, atol=1e-5)


# ---------------------------------------------------------------- rules


def test_shared_lines_deplete_a_document(spark, docs):
    boiler = "\n".join(f"shared {k} line with several words that many documents of a host hold {k}" for k in range(8))
    own = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(40)]
    rows = [(i, boiler + "\n" + own[i] if i else boiler, "h") for i in range(40)] + [(100, boiler, "other")]
    got = {r["doc_id"]: r for r in rules.quality_rules(docs(rows)).collect()}
    assert got[1]["removed_words"] > 0 and not got[0]["kept"] and got[100]["removed_words"] == 0
    assert not got[1]["base_failed"]


# ---------------------------------------------------------------- sharding


def test_lookup_table_follows_turns():
    names, size = ["a", "b", "c"], 13
    prefer = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        o, s = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefer.append([(o + k * s) % size for k in range(size)])
    owner: dict[int, int] = {}
    while len(owner) < size:
        for i in range(3):
            free = next((p for p in prefer[i] if p not in owner), None)
            if free is not None and len(owner) < size:
                owner[free] = i
    assert sharding.lookup_table(names, size) == [owner[i] for i in range(size)]


def test_every_row_lies_where_its_hash_says(spark, table):
    owner = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)], sharding.TABLE_SIZE)
    rows = sharding.op3_sharding(spark, table).collect()
    assert len(rows) == spark.read.parquet(f"{table}/documents.parquet").count()
    for r in rows:
        h = xxhash.xxh64(str(r["doc_id"]).encode(), seed=42).intdigest()
        slot = (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, owner[slot])


def test_removing_a_shard_moves_little():
    a = np.array(sharding.lookup_table([f"s{i}" for i in range(10)], 10007))
    b = np.array(sharding.lookup_table([f"s{i}" for i in range(9)], 10007))
    assert np.bincount(a).max() - np.bincount(a).min() <= 1
    assert (a != b)[a < 9].mean() < 0.1


def test_round_trip_of_written_shards(spark, docs, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    sharding.write_shards(docs(rows), str(tmp_path / "out"), shards=4, size=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 12)


def test_a_shard_is_written_by_as_many_tasks_as_it_needs(spark, docs, tmp_path):
    sharding.write_shards(docs([(7, f"text {i}") for i in range(400)]), str(tmp_path / "out"), shards=2, size=101, rows_per_task=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 400 and back.select("shard").distinct().count() == 1 and back.select(F.input_file_name()).distinct().count() > 1


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets_and_repeats_at_most_twice(spark, table):
    got = mixing.op4_source_mix(spark, table).toPandas()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), biggest=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["biggest"]).all()
    assert (got["taken"] <= 2 * got["size"]).all()


def test_curriculum_is_sorted_and_follows_its_schedule(docs):
    rows = [(i, "a b c d e", f"s{i % 2}") for i in range(400)]
    early, late = ((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))
    out = mixing.curriculum(docs(rows), weights=(1, 1), schedules=(early, late), share=1.0).collect()
    first = [r["source"] for r in out[: len(out) // 4]]
    assert len(out) == 400 and first.count("s0") > 0.7 * len(first)
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


# ---------------------------------------------------------------- lines


def test_a_full_filter_is_built_anew(spark, docs):
    few, many = docs([(i, "first line") for i in range(3)]), docs([(i, "\n".join(f"line {k}" for k in range(400))) for i in range(10, 13)])
    before = lines.count_references(few)
    after = lines.insert(before, many)
    grown = lines.update_filters(lines.build_filters(before, 1, 3), before, after, 1, 3).collect()
    keys = np.array([(r["k1"], r["k2"]) for r in after.collect()]).view(np.uint64)
    assert len(grown) == 1 and len(keys) == 401
    assert lines.CuckooFilter.from_bytes(bytes(grown[0]["filter"])).contains(keys[:, 0], keys[:, 1]).all()


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(1)
    k = rng.integers(0, 1 << 62, (3000, 2)).astype(np.uint64)
    f = lines.CuckooFilter(3000)
    for a, b in k:
        f.insert(int(a), int(b))
    assert f.contains(k[:, 0], k[:, 1]).all()
    other = rng.integers(0, 1 << 62, (20000, 2)).astype(np.uint64)
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.01
    for a, b in k[:1500]:
        assert f.delete(int(a), int(b))
    assert lines.CuckooFilter.from_bytes(f.to_bytes()).contains(k[1500:, 0], k[1500:, 1]).all()
    assert f.contains(k[:1500, 0], k[:1500, 1]).mean() < 0.01


def test_deletion_reverses_insertion(spark, docs):
    a = docs([(i, "same\nown %d" % i) for i in range(12)])
    b = docs([(i, "same\nother\nother\nlate %d" % i) for i in range(50, 65)])
    before = lines.count_references(a)
    after = lines.insert(before, b)
    assert {tuple(r) for r in lines.delete(after, b).collect()} == {tuple(r) for r in before.collect()}
    shards = 4
    kept = lambda t: {(r["shard"], sum(np.frombuffer(bytes(r["filter"]), np.uint16) > 0)) for r in lines.build_filters(t, shards).collect()}
    grown = lines.update_filters(lines.build_filters(before, shards), before, after, shards)
    assert {(r["shard"], sum(np.frombuffer(bytes(r["filter"]), np.uint16) > 0)) for r in grown.collect()} == kept(after)


# ---------------------------------------------------------------- tokens


def test_token_counts_equal_a_plain_search(spark, docs):
    ranked = ["▁", "▁ab", "a", "b", "c", "abc", "bc", "▁a", "é", "cab"]
    v = tokens.Vocabulary.from_pieces(ranked)
    cost = {p.encode(): int(round(np.log(r + 2.0) * 1e6)) for r, p in enumerate(ranked)}
    byte = int(round((np.log(len(ranked) + 2.0) + 1) * 1e6))

    def brute(word):
        x = "▁".encode() + word
        best = [(0, 0)] + [None] * len(x)
        for i in range(1, len(x) + 1):
            options = [(best[i - 1][0] + byte, best[i - 1][1] + 1)]
            options += [(best[j][0] + cost[x[j:i]], best[j][1] + 1) for j in range(i) if x[j:i] in cost]
            best[i] = min(options)
        return best[-1][1]

    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list("abcéz"), rng.integers(1, 9))) for _ in range(20))) for i in range(30)]
    for r in tokens.count_tokens(docs(rows), v).collect():
        w = WORD.findall(dict(rows)[r["doc_id"]].encode())
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(map(brute, w)))


def plain_tokens(ranked):
    """A plain search over one word at a time; pieces with a mark stand at a word's start alone."""
    cost, mark = {}, "▁".encode()
    for r, p in enumerate(ranked):
        cost.setdefault(p.encode(), int(round(np.log(r + 2.0) * 1e6)))
    byte, reach = int(round((np.log(len(ranked) + 2.0) + 1) * 1e6)), max(map(len, cost))

    def count(word):
        x = mark + word
        best = [(0, 0)] + [None] * len(x)
        for i in range(1, len(x) + 1):
            options = [(best[i - 1][0] + byte, best[i - 1][1] + 1)]
            options += [(best[j][0] + cost[x[j:i]], best[j][1] + 1) for j in range(max(0, i - reach), i) if x[j:i] in cost and (mark not in x[j:i] or (j == 0 and mark not in x[3:i]))]
            best[i] = min(options)
        return best[-1][1]

    return count


def test_token_counts_over_a_public_vocabulary(spark, docs, table):
    sentencepiece = pytest.importorskip("sentencepiece")
    if not os.path.exists(tokens.QUERY_VOCABULARY):
        pytest.skip("no vocabulary")
    m = sentencepiece.SentencePieceProcessor(model_file=tokens.QUERY_VOCABULARY)
    own = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    count = plain_tokens([m.id_to_piece(i) for i in sorted(own, key=lambda i: (-m.get_score(i), i))])
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{table}/documents.parquet").orderBy("doc_id").collect() if len(r["text"]) < 2000][:40]
    odd = [(-1, "日本語の長い行" * 300), (-2, "aGVsbG8gd29ybGQ" * 200 + " tail"), (-3, "x▁y ▁ ▁▁"), (-4, "a" * 700 + "é" * 700)]
    for r in tokens.count_tokens(docs(real + odd), tokens.load_vocabulary(tokens.QUERY_VOCABULARY)).collect():
        w = WORD.findall(dict(real + odd)[r["doc_id"]].encode())
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(map(count, w)))


@pytest.mark.parametrize("size", [1, 255, 256, 257, 5000, 1 << 16, (1 << 16) + 3])
def test_a_long_word_counts_as_its_chain(size):
    """Words of every length against the trie's way of counting, which knows no windows."""
    rng = np.random.default_rng(size)
    data = rng.integers(97, 100, size).astype(np.uint8)
    v = tokens.Vocabulary.from_pieces(["▁", "▁ab", "a", "b", "abc", "bca", "cabbc", "▁abcabc"])
    prefix = tokens.prefix_hash(data)
    if size <= 5000:
        assert tokens.chain_count(prefix, 0, size, v) == tokens.trie_counts(prefix, np.array([0]), np.array([size]), v)[0]
    whole, tokens.WINDOW = tokens.chain_count(prefix, 0, size, v), 100
    try:
        assert tokens.chain_count(prefix, 0, size, v) == whole
    finally:
        tokens.WINDOW = 1 << 16


# ---------------------------------------------------------------- repeats


def sorted_suffixes(path, limit, **options):
    sorter = suffixes.InducedSorter(str(path), limit, **options)
    sorter.sort()
    got = list(sorter.suffixes())
    sorter.close()
    none = [np.zeros(0, int)]
    return np.concatenate([a for a, _ in got] or none).tolist(), np.concatenate([c for _, c in got] or none).tolist(), sorter.spills


#: Chunk, bucket, chain and base sizes: as they are, and so small that every way of a queue is taken.
SIZES = [{}, {"BASE": 2, "CHUNK": 7, "LOAD": 5, "FAN": 3, "WAVES": 2}, {"BASE": 4, "CHUNK": 16, "LOAD": 30, "FAN": 8, "WAVES": 24}, {"BASE": 2, "CHUNK": 7, "LOAD": 200, "FAN": 3, "WAVES": 6}]


@pytest.mark.parametrize("case", range(80))
def test_induced_sorting(case, tmp_path, monkeypatch):
    rng = np.random.default_rng(case)
    for name, value in SIZES[case % 4].items():
        monkeypatch.setattr(suffixes, name, value)
    n, k = int(rng.integers(0, 300)), int(rng.choice([1, 2, 3, 5, 200]))
    t = (rng.integers(0, k, n) + 40).astype(np.uint8)
    if case % 3 == 0 and n:
        t = np.tile(t[: max(1, n // 4)], 4)
    t.tofile(tmp_path / "t")
    order, common, _ = sorted_suffixes(tmp_path / "t", 20, memory=int(rng.choice([60, 1 << 20])))
    b = t.tobytes()
    assert sorted(order) == list(range(len(b)))
    cut = [b[i : i + 20] for i in order]
    assert cut == sorted(cut)
    for i in range(1, len(order)):
        x, y = cut[i - 1], cut[i]
        assert common[i] == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


def test_chains_are_ordered_by_few_sorts(tmp_path, monkeypatch):
    """Two chains of 500 entries of one key that tie at every link."""
    queue, sorts, plain = suffixes.Queue(str(tmp_path), 4, 1200, fan=2), [], np.argsort
    queue.push(np.array([0, 0]), np.array([500, 1000]))
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))

    def induced(at):
        source = np.flatnonzero(at % 501 > 0)
        return np.ones(len(source), dtype=np.int64), at[source] - 1, source

    keys, at = queue.take(induced)
    assert at.tolist() == [x for i in range(500) for x in (500 - i, 1000 - i)] + [0]
    assert keys.tolist() == [0, 0] + [1] * 999 and len(sorts) < 30
    queue.close()


def test_a_shard_far_larger_than_its_memory(tmp_path, monkeypatch):
    """Half a megabyte with repeats through queues of 16 kB and pieces of 1,024 entries: disk is used, and memory stays below the length of the shard."""
    for name, value in {"BASE": 256, "CHUNK": 1024, "LOAD": 1024, "FAN": 64}.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = np.random.default_rng(9)
    n, size = 1 << 19, 40
    t = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), n)
    t[300_000:300_900] = t[1000:1900]
    t.tofile(tmp_path / "t")
    data, twice, seen, last = t.tobytes(), np.zeros(n, dtype=bool), 0, None
    tracemalloc.start()
    sorter = suffixes.InducedSorter(str(tmp_path / "t"), size, str(tmp_path), memory=1 << 14)
    sorter.sort()
    for at, lcp in sorter.suffixes():
        assert len(at) <= 1024
        seen += len(at)
        assert last is None or data[last : last + size] <= data[at[0] : at[0] + size]
        last = int(at[-1])
        twice[at[lcp >= size]] = True
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sorter.close()
    assert sorter.spills > 100 and seen == n and peak < n
    assert (twice[1000:1861] | twice[300_000:300_861]).all()


def brute_repeats(t, length=200):
    """doc_id -> (bytes, removed, spans, digest)."""
    seen, out = Counter(x[i : i + length] for x in t.values() for i in range(len(x) - length + 1)), {}
    for key, x in t.items():
        gone = np.zeros(len(x) + 1, dtype=int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cover = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~cover])
        out[key] = len(x), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) > 0).sum()), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("hot_kinds", [3, passages.HOT_KINDS])
def test_passages_with_private_edges(spark, docs, hot_kinds):
    """One passage in forty documents, between their own words, some cut short: crowded anchors and sorted ones give the same."""
    rng = np.random.default_rng(7)
    own = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage = own(900)
    rows = []
    for i in range(40):
        a, z = int(rng.integers(0, 300)), int(rng.integers(500, 900))
        rows.append((i, own(int(rng.integers(0, 400))) + passage[a:z] + ("é" if i % 5 == 0 else "") + own(int(rng.integers(0, 400)))))
    rows += [(100 + i, passage[100:400] * 2) for i in range(3)] + [(200, "z" * 1500), (201, None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.remove_repeats(docs(rows), hot_kinds).collect()}
    assert got == brute_repeats({i: (x or "").encode() for i, x in rows})


def test_repeats_equal_brute_force(spark, table):
    want = brute_repeats(texts(spark, table))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.op7_suffix_dedup(spark, table).collect()} == want


@pytest.mark.parametrize("case", range(20))
def test_stretches_deal_each_window_once_to_its_anchor(case):
    rng = np.random.default_rng(case)
    data = rng.integers(97, 97 + int(rng.choice([1, 2, 26])), int(rng.integers(30, 900))).astype(np.uint8)
    off = np.unique(np.concatenate(([0, len(data)], rng.integers(0, len(data), int(rng.integers(0, 4))))))

    def windows(longest):
        row, a, b, anchor, _ = passages.segments(data, off, 30, 6, longest)
        return sorted((i, int(r), int(h)) for r, x, y, h in zip(row, a, b, anchor) for i in range(x, y + 1))

    assert windows(int(rng.integers(30, 120))) == windows(1 << 20)


def test_a_text_longer_than_a_stretch(spark, docs):
    rng = np.random.default_rng(1)
    long = rng.integers(97, 123, passages.STRETCH_BYTES + 50_000).astype(np.uint8).tobytes().decode()
    at = passages.STRETCH_BYTES - 1000
    rows = [(1, long), (2, "#" * 100 + long[at : at + 2000] + "%" * 100)]
    got = {r["doc_id"]: r for r in passages.remove_repeats(docs(rows)).drop("kept").collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2)] == [(2000, 1), (2000, 1)]
    assert got[2]["kept_sha256"] == hashlib.sha256(b"#" * 100 + b"%" * 100).hexdigest()


# ---------------------------------------------------------------- language model


def test_scores(spark, table):
    t = {i: WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in x)) + [None] for i, x in texts(spark, table).items()}
    c = Counter(w for i, x in t.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    rows = perplexity.op8_lm_scoring(spark, table).collect()
    for r in rows:
        x = t[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(c[w] > 0 for w in x), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) < 1e-6
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_model(t, train):
    """Scores of the documented model with exact counts, rounded down to levels, in plain Python. t: doc_id -> tokens with an end."""
    c, pairs = Counter(), Counter()
    for i in train:
        c.update(t[i])
        pairs.update(zip([None, *t[i][:-1]], t[i]))
    n, v = sum(c.values()), len(c)
    floor = {k: max(x for x in perplexity.LEVELS.tolist() if x <= q) for k, q in pairs.items()}
    out = {}
    for i, x in t.items():
        told, total = [], 0.0
        for before, w in zip([None, *x[:-1]], x):
            p1, f = (c[w] + 0.5) / (n + 0.5 * (v + 1)), floor.get((before, w), 0)
            l = perplexity.CONFIDENCE[sum(told[-perplexity.WINDOW :])] if c[before] else 0.0  # noqa: E741
            total += np.log10(l * min(f / c[before], 1.0) + (1 - l) * p1 if l else p1)
            told.append(f > 0 and c[before] * c[w] / max(n, 1) < perplexity.CHANCE)
        out[i] = total
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 1 << 15, "fan_bits": 2}])
def test_scores_equal_a_plain_model(spark, table, options):
    """Through one level of the exchange, and through several. Only the filter's false positives may differ, which raise a probability."""
    t = {i: WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in x)) + [None] for i, x in texts(spark, table).items()}
    want = plain_model(t, [i for i in t if zlib.crc32(str(i).encode()) % 5 != 1])
    rows = perplexity.score_documents(spark.read.parquet(f"{table}/documents.parquet"), **options).collect()
    off = [abs(r["score"] - want[r["doc_id"]]) / max(1, abs(want[r["doc_id"]])) for r in rows]
    assert len(rows) == len(t) and max(off) < 0.01 and sum(x > 1e-9 for x in off) < 0.1 * len(off)


def test_log_bloom_rounds_counts_down():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 20, 500).astype(np.uint64))
    counts = np.arange(1, 501)
    f = perplexity.LogBloom(perplexity.LogBloom.slab(keys, counts, 20), 0, 20)
    got = f.count(keys)
    assert (got <= counts).mean() > 0.99 and (got * 1.5 >= counts).all()


def test_a_slab_grows_with_its_pairs():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64))
    bits = perplexity.LogBloom.slab(keys, np.ones(len(keys), dtype=np.int64), 12)
    f = perplexity.LogBloom(bits, 0, len(bits).bit_length() + 2)
    assert (f.count(keys) >= 1).all()  # single occurrences too
    assert (f.count(keys + np.uint64(1 << 63)) > 0).mean() < 0.01


# ---------------------------------------------------------------- leaks


def test_short_items_match_whole(spark, docs):
    items = spark.createDataFrame([(1, "red green blue"), (2, "north south east west up")], "item_id bigint, text string")
    rows = [(1, "one red green blue two"), (2, "a north south east west up b"), (3, "north south east west down"), (4, "red green")]
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs(rows), items).collect()} == {(1, 1), (2, 2)}


def test_edited_copies_are_found_and_others_left(spark, docs):
    rng = np.random.default_rng(5)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, 40))) for i in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(vocab, 150))
        if i < 6:
            copy = items[i][1].split()
            copy[10], copy[25] = "changed", "edited"
            del copy[30]
            w[50:50] = [x.upper() + "!" for x in copy]
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.leaks(docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(6)}
    assert leaks.clean(docs(rows), bench).count() == 54


def test_seeds_find_what_aligning_all_pairs_finds(spark, docs):
    """Copies with more and more words replaced, dropped and added, against the alignment of every document with every item."""
    rng = np.random.default_rng(8)
    vocab = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(12, 60))))) for i in range(12)]
    rows = []
    for i in range(120):
        w = list(rng.choice(vocab, int(rng.integers(20, 120))))
        if i % 2:
            copy = []
            for x in items[i % 12][1].split():
                u = rng.random()
                share = 0.02 * (i % 17)
                copy += [] if u < share / 3 else [x, "extra"] if u < 2 * share / 3 else ["other"] if u < share else [x + "!!!!!!" if u > 0.95 else x]
            w[10:10] = copy
        rows.append((i, " ".join(w)))
    want = set()
    for i, text in rows:
        want |= {(i, j) for j, item in items if is_leak(text, item)}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= want and len(want) > 40 and len(got) >= 0.9 * len(want)


def test_long_items_do_not_widen_the_passages_of_short_ones(spark, docs):
    words = [f"k{i}" for i in range(3000)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[500:2500]))], "item_id bigint, text string")
    own = [f"o{i}" for i in range(4000)]
    rows = [(1, " ".join(own[:2000] + words[:30] + own[2000:])), (2, " ".join(own[:100] + words[500:2500] + own[100:200]))]
    got = leaks.leaks(docs(rows), items).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in got} == {(1, 1, 1.0), (2, 2, 1.0)}
    assert {r["end_word"] for r in got} == {2029, 2099}


def test_punctuation_is_stripped_whole():
    from plumbline.llm.common import pieces

    out = []
    for text in ("word", "!!!!!!!word??????", "((((((((word", "-------"):
        _, _, data, off = next(pieces(pa.array([text])))
        out.append(leaks.tokens(data, off)[0][0])
    assert out[0] == out[1] == out[2] != out[3]


def test_alignment_score():
    a = np.arange(10, dtype=np.uint64)
    b = np.concatenate((np.array([50, 51], np.uint64), a[:4], np.array([99], np.uint64), a[4:]))
    score, end = leaks.align([b, a[:0]], [a, a])
    assert score.tolist() == [19, 0] and end[0] == 12


# ---------------------------------------------------------------- Jaccard join


def near_copies():
    rng = np.random.default_rng(11)
    rows, base = {}, [f"v{i}" for i in rng.integers(0, 500, 300)]
    for i in range(120):
        n = int(rng.integers(1, 40)) if i % 2 else 300
        w = list(base[:n])
        for _ in range(int(rng.integers(0, 12))):
            w[int(rng.integers(0, n))] = f"x{rng.integers(0, 9999)}"
        rows[i] = " ".join(w).encode()
    return rows


def test_components_equal_brute_force(spark, docs, table):
    for t in (near_copies(), texts(spark, table)):
        want = brute_components(t)
        frame = docs([(i, x.decode()) for i, x in t.items()])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(frame).collect()}
        assert got == want


@pytest.mark.parametrize("block", [60, 1 << 14])
def test_a_shared_passage_and_copies_of_copies(spark, docs, monkeypatch, block):
    """Documents that share a third of their text without linking, chains of copies, and families cut into many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", block)
    monkeypatch.setattr(jaccard, "STAR_ROWS", 3)
    monkeypatch.setattr(jaccard, "HOT_SETS", 4)
    rng = np.random.default_rng(12)
    passage, rows = [f"p{i}" for i in range(40)], {}
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(int(rng.integers(30, 120)))]
        rows[i] = own + passage
    chain = [f"c{i}" for i in range(120)]
    for i in range(60, 90):
        chain = list(chain)
        chain[int(rng.integers(0, 120))] = f"n{i}"
        rows[i] = chain
    family = [f"f{i}" for i in range(100)]
    for i in range(90, 150):
        w = list(family)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 100))] = f"e{rng.integers(0, 10**6)}"
        rows[i] = w
    t = {i: " ".join(w).encode() for i, w in rows.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs([(i, x.decode()) for i, x in t.items()])).collect()}
    assert got == brute_components(t)


def test_published_parts_meet():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        top, _ = jaccard.reach(len(u))
        v = u.copy()
        for _ in range(int(rng.integers(0, 1 + len(u) // 12))):
            v = np.append(np.delete(v, rng.integers(0, len(v))), np.uint64(rng.integers(0, 1 << 63))) if len(v) > 1 else v
        v = np.unique(v)
        common = len(np.intersect1d(u, v))
        if 100 * common >= 85 * (len(u) + len(v) - common):
            hot = rng.permutation(np.concatenate([k for x in (u, v) for k, _ in jaccard.part_keys(x)]))[: int(rng.integers(0, 60))]
            for late in (None, hot):  # whichever keys come last
                assert len(np.intersect1d(jaccard.published(u, hot=late), jaccard.published(v, hot=late)))


def test_one_of_each_group_stays(docs):
    t = " ".join(f"w{i}" for i in range(100))
    kept = jaccard.first_of_each_group(docs([(5, t), (3, t), (9, t + " end"), (4, "other words are here today"), (4, "other words are here today"), (None, t)]))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 4), (True, 0)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def some_copies():
    """(doc_id, text): thirty texts and a near copy of each, all four times."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 120)) for _ in range(30)]
    texts += [t + " and an end" for t in texts]
    return [(1000 * k + i, t) for k in range(4) for i, t in enumerate(texts)]


def test_copies_in_several_tasks_publish_their_keys_once(spark, docs, monkeypatch):
    rows, real = [], jaccard.stored

    def spy(df, name):
        out = real(df, name)
        if name == "keys":
            rows.append((out[0].count(), out[0].distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "stored", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs(some_copies()).repartition(4)).collect()}
    assert got == {i: i % 1000 % 30 for i, _ in some_copies()}
    assert rows[0][0] == rows[0][1] > 0


def test_groups_are_the_same_in_slices(spark, docs, monkeypatch):
    made, real = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: made.append(name) or real(df, name))
    monkeypatch.setattr(common, "SLICE_BYTES", 1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs(some_copies())).collect()}
    assert got == {i: i % 1000 % 30 for i, _ in some_copies()}
    assert [made.count(x) for x in ("shared-keys", "stars", "found")] == [common.MOST_SLICES] * 3


# ---------------------------------------------------------------- tables


def test_shuffles_go_when_their_table_is_written(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, option = shuffles(), spark.conf.get(key, None)
    rows = spark.range(20_000).select(F.xxhash64(F.col("id") % 5_000).alias("k"))
    table, _ = stored(rows.groupBy("k").count(), "counts")
    assert BitFilter.build(rows, "k", 20).contains(np.array([r["k"] for r in table.collect()])).all()
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(key, None) == option and table.count() == 5_000
