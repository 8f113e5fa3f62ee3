"""Every operator and stage on nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import jaccard, leaks, lines, mixing, passages, perplexity, quality, rules, sharding, tokens

PIECES = ["▁", "▁one", "o", "n", "e", "t", "w", "▁t", "wo", "a", "word"]
SIX = "one two three four five six"


def tables(spark):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 1), (4, 1), (None, 1), (8, None), (1, 0)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, SIX), (2, None), (None, "x"), (1, SIX)], "item_id bigint, text string")
    return labels, bench


def run(name, spark, df):
    vocabulary = tokens.Vocabulary.from_pieces(PIECES)
    labels, bench = tables(spark)
    return {
        "quality": lambda: quality.score_documents(df, quality.train(df, labels), ["doc_id"]),
        "rules": lambda: rules.quality_rules(df),
        "sharding": lambda: sharding.assign_shards(df).select("doc_id", "slot", "shard"),
        "mixing": lambda: mixing.positions(df),
        "lines": lambda: lines.drop_lines(df, lines.count_references(df), 2),
        "tokens": lambda: tokens.count_tokens(df, vocabulary),
        "passages": lambda: passages.remove_repeats(df),
        "perplexity": lambda: perplexity.score_documents(df),
        "leaks": lambda: leaks.leaks(df, bench),
        "jaccard": lambda: jaccard.similar_groups(df),
    }[name]()


def stage(name, spark, df):
    labels, bench = tables(spark)
    return {
        "accepted": lambda: quality.accepted(df, labels, 0.0),
        "first_of_each_group": lambda: jaccard.first_of_each_group(df),
        "clean": lambda: leaks.clean(df, bench),
        "curriculum": lambda: mixing.curriculum(df, share=1.0),
        "place": lambda: cp.place(spark, df, ""),
    }[name]()


ALL = ("quality", "rules", "sharding", "mixing", "lines", "tokens", "passages", "perplexity", "leaks", "jaccard")
STAGES = ("accepted", "first_of_each_group", "clean", "curriculum", "place")
CLASHES = ("size", "target", "position", "slot", "shard", "n", "sid", "key", "cluster", "score", "__score", "__text", "__gone", "__leak", "__n", "rank", "salt", "row", "group", "kept", "drops", "spans", "words", "held_out", "bucket", "n_words", "h", "u", "v", "fold", "host", "class", "a.b", "UPPER", "rows")


def wide(df):
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES})


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ALL)
def test_extra_columns_change_nothing(spark, odd, name):
    assert rows_of(run(name, spark, wide(odd))) == rows_of(run(name, spark, odd))


@pytest.mark.parametrize("name", STAGES)
def test_stages_carry_extra_columns(spark, odd, name):
    full = wide(odd)
    got = stage(name, spark, full)
    kept = [c for c in full.columns if name != "place" or c not in ("slot", "shard")]
    assert got.columns == kept + (["slot", "shard"] if name == "place" else [])
    found = got.collect()
    own = len(odd.columns)
    for r in found:
        extra = dict(zip(got.columns, r))
        assert all(extra[c] == f"<{c}>" for c in kept[own:])
    plain = [tuple(r)[:own] for r in stage(name, spark, odd).collect()]
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)[:own]) for r in found)


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, odd, name):
    assert run(name, spark, odd.where("false")).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_an_empty_table(spark, odd, name):
    assert stage(name, spark, odd.where("false")).count() == 0


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_values_of_odd_rows(spark, odd):
    """odd: null ids with null text and with six words; null, empty and blank texts; 30,000 words; doc 6 twice with the text of doc 8."""
    got = by_id(run("tokens", spark, odd))
    assert sorted(r["n_words"] for r in got[None]) == [0, 6] and [got[i][0]["n_words"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 30_000, 1]
    assert got[5][0]["n_tokens"] == 1 and len(got[6]) == 2 and got[6][0] == got[6][1]
    got = by_id(run("rules", spark, odd))
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for i in (1, 2, 3) for r in got[i]) and got[4][0]["n_words"] == 30_000
    got = by_id(run("lines", spark, odd))
    assert [(r["n_lines"], r["n_dropped"]) for r in got[6]] == [(1, 1)] * 2 and got[1][0]["kept_text"] == "" and got[3][0]["n_lines"] == 2
    assert got[7][0]["kept_text"] == "Éa ß 語 x\n\nEa"
    got = by_id(run("passages", spark, odd))
    assert [got[i][0]["n_bytes"] for i in (1, 2, 3, 5)] == [0, 0, 4, 3] and got[6][0]["n_removed"] == 0
    assert got[1][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    got = by_id(run("perplexity", spark, odd))
    assert [got[i][0]["n_tokens"] for i in (1, 2, 3, 5)] == [1, 1, 1, 2] and sorted(r["n_tokens"] for r in got[None]) == [1, 7]
    got = by_id(run("jaccard", spark, odd))
    assert [got[i][0]["component_id"] for i in (1, 2, 5, 6, 8)] == [1, 2, 5, 6, 6] and [got[i][0]["n_shingles"] for i in (1, 3, 5, 6)] == [0, 0, 1, 3]
    assert {(r["doc_id"], r["item_id"]) for r in run("leaks", spark, odd).collect()} == {(6, 1), (8, 1)}
    got = by_id(run("quality", spark, odd))
    assert all(0 <= r["__score"] <= 1 for x in got.values() for r in x) and len(got[None]) == 2
    got = by_id(run("sharding", spark, odd))
    assert got[None][0]["slot"] == got[None][1]["slot"] and got[6][0] == got[6][1]
    sizes = sorted(r["size"] for r in run("mixing", spark, odd).collect())
    assert sizes == [0, 0, 0, 0, 1, 5, 6, 6, 6, 6, 30_000]


def test_stages_keep_what_they_should(spark, odd):
    assert sorted(str(r["doc_id"]) for r in stage("first_of_each_group", spark, odd).collect()) == ["1", "2", "3", "4", "5", "6", "7", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in stage("clean", spark, odd).collect()) == ["1", "2", "3", "4", "5", "7", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in stage("accepted", spark, odd).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())


def test_long_lines_and_words(spark, docs):
    """A line and a word of a megabyte."""
    line = " ".join(f"w{i % 5000}" for i in range(170_000))
    word = "ab" * 500_000
    df = docs([(1, line), (2, word), (3, line + "\n" + word), (4, "short " + word)])
    vocabulary = tokens.Vocabulary.from_pieces(["▁", "ab", "a"])
    got = by_id(tokens.count_tokens(df, vocabulary))
    assert got[2][0]["n_tokens"] == 500_001 and got[4][0]["n_words"] == 2
    got = by_id(lines.drop_lines(df, lines.count_references(df), 2))
    assert [got[i][0]["n_dropped"] for i in (1, 2, 3, 4)] == [1, 1, 2, 0]
    got = by_id(rules.quality_rules(df, min_docs=2, min_share=0.0))
    assert got[3][0]["n_words"] == 170_001 and got[3][0]["removed_words"] == 170_001 and got[2][0]["word_chars"] == 1_000_000
    got = by_id(passages.remove_repeats(df))
    assert [got[i][0]["n_removed"] for i in (2, 4)] == [1_000_000, 1_000_000]
    got = by_id(perplexity.score_documents(df))
    assert got[1][0]["n_tokens"] == 170_001 and got[2][0]["n_tokens"] == 2
    got = by_id(jaccard.similar_groups(df))
    assert got[3][0]["component_id"] == 1 and got[4][0]["component_id"] == 4
