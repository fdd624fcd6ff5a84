"""Scores of many pairs of names at a time are those of one pair, and few pairs are left to be scored alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.functions import together
from linkloom.functions.names import STORED, party_name, rebuilt
from linkloom.functions.similarity import NAME_REASONS, Metrics, Rules, name_score
from linkloom.functions.vocabulary import ALIASES
from linkloom.operators import scoring
from linkloom.plans import engine, labelled

ODD = ["", "mr.", "สยาม", "siam cement", "บริษัท สยาม จำกัด", "Siam Siam 12", "a a b 7", "a b", "12 7", "İstanbul ﬁn", "x" * 600, "one two three four five six seven", "Somchai Jaidee", "สมชาย ใจดี", "𝒳y z"]
ONLY = [Metrics(**{m: False}) for m in Metrics._fields] + [Metrics(*[False] * 7, True), Metrics(*[False] * 5, True, False, True)]


def made(count, odd=ODD):
    rng = random.Random(3)
    names = [party_name(x) for a, b, *_ in labelled.pairs(count) for x in (a, b)] + [party_name(x) for x in odd]
    worth = {t: round(rng.random(), 3) for x in names for t in x.tokens}
    weights = [{t: worth[t] for t in x.tokens} for x in names]
    return rng, names, weights


@pytest.mark.parametrize("rules", [Rules(), Rules(name_weight=0.5, date_weight=0.5, overlap_cap=0.4, overlap_floor=0.7), *(Rules(m) for m in ONLY)])
@pytest.mark.parametrize("weighted", [True, False])
def test_scores_are_those_of_one_pair(rules, weighted):
    rng, names, weights = made(60)
    for i in range(0, len(names), 9):  # a token that the corpus lacks, and one that weighs something else
        weights[i] = {t: w for t, w in list(weights[i].items())[1:]}
        weights[i - 1] = {t: 0.5 for t in weights[i - 1]}
    left, right = (np.array([rng.randrange(len(names)) for _ in range(700)] + list(x)) for x in (range(0, 120, 2), range(1, 120, 2)))
    found = together.name_scores(names, left, right, rules, weights if weighted else None)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        known = weights[a] | weights[b]
        want = name_score(names[a], names[b], rules, (lambda t, known=known: known.get(t, 1.0)) if weighted else None)
        assert [x[i].item() for x in found[:8]] == list(want[:8]), (names[a], names[b])
        assert [r for j, r in enumerate(NAME_REASONS) if found.said[i] >> j & 1] == want.reasons


def test_no_pairs():
    assert [len(x) for x in together.name_scores([], np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0] * 9


def test_few_pairs_are_scored_alone(monkeypatch):
    """Of a batch as a run gives it, only pairs across scripts and of the dictionary are."""
    alone = []
    monkeypatch.setattr(together, "name_score", lambda *x: alone.append(x) or name_score(*x))
    rng, names, weights = made(2000, [])
    left, right = ([rng.randrange(len(names)) for _ in range(2000)] for _ in range(2))
    values = [pa.array(range(2000)), *(pa.array([names[i].raw for i in x]) for x in (left, right))]
    values += [pa.array([list(weights[i].items()) for i in x], pa.map_(pa.string(), pa.float64())) for x in (left, right)]
    batch = pa.RecordBatch.from_arrays(values, ["place", "source_name", "dest_name", "source_weights", "dest_weights"])
    rows = pa.Table.from_batches(scoring._named(Rules(), ["place"], True)(iter([batch]))).to_pylist()
    crossing = sum(r["cross_script"] for r in rows)
    assert len(rows) == 2000 and 0 < crossing <= len(alone) <= crossing + 20


def test_pairs_are_gathered_by_the_rarest_token(spark):
    """A task has the pairs of neighbouring rarest tokens, and a token of many names goes to several tasks."""
    weights = lambda i: {"common": 0.1, "a" if i < 300 else f"b{i % 7}": 0.9}
    pairs = spark.createDataFrame([(i, i + k, f"n{i}", weights(i)) for i in range(600) for k in range(5)], "source_key long, dest_key long, source_name string, source_weights map<string,double>")
    got = [[(max(r["source_weights"].items(), key=lambda x: x[1])[0], r["source_key"]) for r in part] for part in engine._gathered(pairs).rdd.glom().collect() if part]
    assert [x for part in got for x in part] == sorted(x for part in got for x in part) and sum(map(len, got)) == 3000
    assert sum(any(rare == "a" for rare, _ in part) for part in got) > 1
    assert all(len({rare for rare, _ in part}) <= 4 for part in got)


def test_labelled_corpus_is_made_once(spark):
    left, right, truth = labelled.inputs(spark, 20)
    for df in (left, right, truth):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert left.count() == right.count() == 20 and truth.count() == 12


def test_names_are_rebuilt():
    for x in made(60)[1]:
        assert rebuilt(x.raw, *(" ".join(x.numbers) if f == "numbers" else getattr(x, f) for f in STORED)) == x


@pytest.mark.parametrize("aliases", [ALIASES, {**ALIASES, "brown": "clark trading"}])
def test_stored_names_change_no_score(spark, monkeypatch, aliases):
    """Runs with names stored or normalised again give the same; names are stored where the aliases are the usual ones."""
    rows = [x.select("ordinal", "customer_name", "transaction_date") for x in labelled.inputs(spark, 300)[:2]]
    run = lambda: sorted(map(str, engine.match(*rows, aliases=aliases).results.drop("created_at").collect()))
    asked = []
    gathered = engine._gathered
    monkeypatch.setattr(engine, "_gathered", lambda pairs: asked.append("source_cleaned" in pairs.columns) or gathered(pairs))
    found = run()
    monkeypatch.setattr(engine, "stored", lambda rows, side, named: named)
    assert found == run() and asked == [aliases == ALIASES, False]
