"""Scores of many pairs of fields of several parties at a time are those of one pair, and few pairs are scored alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.functions import batched, parties, similarity, thai
from linkloom.functions.names import parties_of, party_name
from linkloom.functions.similarity import Metrics, Rules, composite
from linkloom.operators import scoring

ODD = ["", ",", "mr., mr.", "สยาม, siam", "siam, bangkok", "a, b & c", "x" * 600 + ", y", "(a, b) c, d", "one 12, two 7", "siam one, charoen", "technology, group", "twelve 12, twelve"]


def fields(count, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ed", "nd", "ha", "at", "en"]) for _ in range(rng.choice([1, 1, 2, 3])))
    party = lambda: " ".join(word() if rng.random() < 0.95 else str(rng.randrange(20)) for _ in range(rng.choice([1, 2, 4, 9, 25])))
    return [rng.choice([", ", " & ", "/"]).join(party() for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(count)]


def weighed(names):
    rng = random.Random(7)
    vocabulary = [{t for part in (x, *map(party_name, parties_of(x.raw))) for t in part.tokens} for x in names]
    worth = {t: rng.choice([0.1, 0.29, 0.3, round(rng.random(), 3)]) for t in sorted(set().union(*vocabulary))[::-1] if rng.random() < 0.95}
    return [{t: worth[t] for t in sorted(own) if t in worth} for own in vocabulary]


@pytest.mark.parametrize("rules", [Rules(), Rules(name_weight=0.5, date_weight=0.5, overlap_cap=0.4, overlap_floor=0.7), Rules(Metrics(phonetic=False, corpus_idf=False)), Rules(Metrics(trigram=False))])
@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("chunk", [500_000, 40])
def test_scores_are_those_of_one_pair(monkeypatch, rules, weighted, chunk):
    monkeypatch.setattr(parties, "TOGETHER", chunk)
    monkeypatch.setattr(parties, "FILTERED", chunk // 2)
    rng = random.Random(3)
    names = [party_name(x) for x in fields(60) + ODD]
    weights = weighed(names)
    weights[3] = dict(list(weights[3].items())[1:])  # a token that the corpus has, but not with this name
    weights[4] = {t: 0.5 for t in weights[4]}
    left, right = (np.array([rng.randrange(len(names)) for _ in range(500)]) for _ in range(2))
    days = [rng.choice([None, 0, 2, -9, 400]) for _ in left]
    found = parties.composites(names, left, right, days, rules, weights if weighted else None)
    for a, b, d, got in zip(left.tolist(), right.tolist(), days, found, strict=True):
        known = weights[a] | weights[b]
        assert got == composite(names[a], names[b], d, rules, (lambda t, known=known: known.get(t, 1.0)) if weighted else None), (names[a], names[b])


def test_no_pairs():
    assert parties.composites([], np.zeros(0, np.int64), np.zeros(0, np.int64), []) == []


def test_few_pairs_are_scored_alone(monkeypatch):
    """Of a batch as a run gives it, no field of several parties is, and not all its parties are compared in full."""
    alone, edited = [], []
    single, many = similarity.name_score, parties.similarities
    monkeypatch.setattr(similarity, "name_score", lambda *x: alone.append(x) or single(*x))
    monkeypatch.setattr(parties, "similarities", lambda texts, a, b, both, *x: edited.extend(a.tolist() if both else ()) or many(texts, a, b, both, *x))
    texts = [f"{x}, {y}" for x, y in zip(fields(60, 1), fields(60, 2), strict=True)]
    names = [party_name(x) for x in texts]
    weights = weighed(names)
    left, right = (np.repeat(np.arange(60), 20), np.tile(np.arange(20), 60))
    values = [pa.array(range(1200)), *(pa.array([texts[i] for i in x]) for x in (left, right)), pa.array([None] * 1200, pa.int32())]
    values += [pa.array([list(weights[i].items()) for i in x], pa.map_(pa.string(), pa.float64())) for x in (left, right)]
    batch = pa.RecordBatch.from_arrays(values, ["place", "source_name", "dest_name", "days", "source_weights", "dest_weights"])
    rows = pa.Table.from_batches(scoring._scored(Rules(), ["place"], True)(iter([batch]))).to_pylist()
    assert [r["place"] for r in rows] == list(range(1200)) and not alone
    every = sum(len(parties_of(texts[i])) * len(parties_of(texts[j])) for i, j in zip(left.tolist(), right.tolist(), strict=True))
    assert 1200 <= len(edited) < every / 2


def test_kernels_of_many_lengths():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde éกขA😀ij1v ") for _ in range(rng.choice([1, 2, 5, 30, 63, 64, 65, 128, 129, 300]))) for _ in range(200)]
    left, right = (np.array([rng.randrange(200) for _ in range(1500)]) for _ in range(2))
    like, near = batched.similarities(texts, left, right, True)
    for a, b, x, y in zip(left.tolist(), right.tolist(), like.tolist(), near.tolist(), strict=True):
        assert (x, y) == (similarity.jaro_winkler(texts[a], texts[b]), similarity.levenshtein_similarity(texts[a], texts[b]))


def test_skeletons():
    assert [thai.skeleton(x) for x in ("", " a va!", "Charoen 7 Phokphand", "éa ja", "İa")] == ["", "aw", "chrn7phkphnd", "éch", "i"]
