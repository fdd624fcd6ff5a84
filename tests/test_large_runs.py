"""Metrics of many pairs together, search in blocks, and a labelled corpus made in tasks, against plain forms of them."""

import random

from linkloom.functions import batched, similarity
from linkloom.functions.names import party_name
from linkloom.operators import blocking
from linkloom.plans import catalog, labelled


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (c != d))
    return row[-1]


def test_metrics_of_many_pairs():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcdสม") for _ in range(rng.choice([1, 5, 63, 64, 65, 140])))
    pairs = list({(text(), text()) for _ in range(200)})
    jaro, edits = {}, {}
    batched.fill(jaro, edits, [(a, b, True) for a, b in pairs])
    for a, b in pairs:
        if a != b:
            assert jaro[a, b] == similarity.jaro_winkler(a, b) and edits[a, b] == 1 - plain_distance(a, b) / max(len(a), len(b)) == similarity.levenshtein_similarity(a, b)


def test_prepared_composites_are_the_same():
    rows = labelled.pairs(60)
    pairs = [(party_name(a), party_name(b + ", " + a)) for a, b, *_ in rows]
    plain = [similarity.composite(a, b, 3) for a, b in pairs]
    assert [similarity.composite(a, b, 3) for a, b in similarity.prepared(pairs, 50)] == plain


def test_blocks_find_the_same(spark, monkeypatch):
    left, right = catalog.part_names(spark, "/root/testdata/sf0.001")
    found = [sorted(tuple(r) for r in blocking.best(left, right, 7, 40)[0].collect())]
    monkeypatch.setattr(blocking, "BLOCK_KEYS", 1500)
    found.append(sorted(tuple(r) for r in blocking.best(left, right, 7, 40)[0].collect()))
    forms = [blocking.forms(x) for x in (left, right)]
    wanted = {(r["source_id"], r["dest_id"]): r["hits"] for r in blocking.hits(*map(blocking.keys, forms), 40).collect()}
    got = {(r["source_name"], r["dest_name"]): r["hits"] for r in blocking.best_names(*forms, 7, 40).collect()}
    assert found[0] == found[1] and got.items() <= wanted.items() and {s for s, _ in got} == {s for s, _ in wanted}


def test_labelled_blocks(spark, monkeypatch):
    monkeypatch.setattr(labelled, "BLOCK", 16)
    rows = labelled.pairs(40)
    left, right, truth = labelled.inputs(spark, 40)
    assert left.rdd.getNumPartitions() == 3 and len(rows) == 40
    assert [r["customer_name"] for r in left.orderBy("ordinal").collect()] == [a for a, *_ in rows] and truth.count() == 24
