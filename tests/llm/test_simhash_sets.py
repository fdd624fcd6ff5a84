"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import simhash_sets


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(texts):
    """Ids that stay: the smallest of each component of pairs of 5-word Jaccard 0.8 or more."""
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited_texts(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    notice = [word() for _ in range(25)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 250))] + (notice if rng.random() < 0.5 else [])
        for edits in range(6):
            copy = list(base)
            for _ in range(edits * rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [*texts, "", None, " ", "one", "ONE", "one two", "a b c d e f g h", "a b c d e f g h i"]


@pytest.mark.parametrize("sample", [1, 16])
def test_stage_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash_sets, "SAMPLE", sample)
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = [r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect()]
    assert len(left) == len(set(left)) and set(left) == survivors(texts)


def test_stage_keeps_null_ids_and_columns(spark):
    docs = spark.createDataFrame([(None, "x y z", 1), (2, "x y z", 2), (3, "x y z", 3), (3, "other", 4)], "doc_id long, text string, k int")
    left = corpus_pipeline.remove_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(r["k"] for r in left.select(F.col("k")).collect()) == [1, 2]


def test_ring_never_loses_a_linked_pair(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, linked = [], []
    for n in (1, 2, 9, 63, 64, 65, 130, 700, 3000):
        for changed in (0, n // 20, n // 9, n // 4, n):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            b = np.unique(np.concatenate((a[changed:], rng.integers(-(1 << 62), 1 << 62, changed // 2))))
            common, both = len(np.intersect1d(a, b)), len(a) + len(b)
            rows.append((simhash_sets.ring(a).tolist(), simhash_sets.ring(b).tolist(), both // 9))
            linked.append(9 * common >= 4 * both)
    found = spark.createDataFrame(rows, "a array<long>, b array<long>, budget long").coalesce(1)
    got = [r["near"] for r in found.select(simhash_sets.in_ring(F.col("a"), F.col("b"), F.col("budget")).alias("near")).collect()]
    assert all(g for g, is_linked in zip(got, linked, strict=True) if is_linked) and sum(got) < sum(linked) + 6


@pytest.mark.parametrize("chunk", [3, 1024])
def test_crowded_keys_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash_sets, "FEW", 2)
    monkeypatch.setattr(simhash_sets, "CHUNK", chunk)
    texts = edited_texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_sets.drop_similar(docs).collect()} == survivors(texts)


@pytest.mark.parametrize("picked", [0, 1 << 20])
def test_all_texts_are_judged_where_many_are_wanted(spark, monkeypatch, picked):
    monkeypatch.setattr(simhash_sets, "PICKED", picked)
    texts = edited_texts(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_sets.drop_similar(docs).collect()} == survivors(texts)


def test_similar_texts_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, "n"), (2, "a b c", 2, "m")], "doc_id long, text string, Node int, ring string")
    assert [tuple(r) for r in simhash_sets.drop_similar(docs).collect()] == [(1, "a b c", 1, "n")]
    assert simhash_sets.similar_texts(docs.limit(0)).count() == 0
