"""Exact dedup, SimHash, mixing, WARC, Merkle: small cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, merkle, mixing, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sample(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "ä", "on"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", ". "]) for _ in range(n)]
    return texts + [rng.choice(texts).replace(" ", rng.choice([" ", "\t", " \n"])) for _ in range(n)] + ["", None, " ", "\n\t"]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("block", [16, 16384])
def test_exact_dedup_against_brute_force(spark, block):
    texts = sample(40)
    found = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(documents(spark, texts), block=block).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i)
    assert len(found) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_of_odd_tables(spark):
    empty = documents(spark, ["a"]).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    twins = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, "long " * 9000, "w")], "doc_id long, text string, name string")
    rows = exact_dedup.exact_duplicates(twins).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == [(1, 3), (1, 3), (1, 3), (2, 1)] and sum(r["kept"] for r in rows) == 2
    clash = twins.select("*", F.lit(1).alias("KEY"), F.lit("?").alias("kept"), F.lit("b").alias("Text"))
    assert exact_dedup.exact_duplicates(clash).count() == 4
    kept = exact_dedup.drop_duplicates(twins)
    assert kept.columns == twins.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, differ=3):
    """Smallest index reachable over links, by index."""
    least = list(range(len(prints)))
    while True:
        new = [min(least[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= differ) for i in range(len(prints))]
        new = [least[x] for x in new]
        if new == least:
            return least
        least = new


def test_simhash_against_brute_force(spark):
    texts = sample(30, 3) + ["A B", "a b", "one", "", "!" * 5000]
    long = " ".join(f"w{i}" for i in range(400))
    texts += [long, long + " more", long.replace("w7 ", "x "), "c " * 70_000]
    prints = [fingerprint(t) for t in texts]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == reachable(prints)


@pytest.mark.parametrize("few", [1, 64])
def test_simhash_links_connect_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(9)]
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    mine = [roots.get(p, p) for p in signed]
    theirs = reachable(prints)
    assert {(a, b) for a, b in zip(mine, theirs, strict=True)}.__len__() == len(set(theirs)) == len(set(mine))


def test_simhash_of_odd_tables(spark):
    assert simhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "x"), (None, "x"), (3, None)], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in simhash.near_duplicates(rows).collect()) == ["3", "None", "None"]


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        lengths = np.unique(rng.integers(0, 40, 5))
        counts = rng.integers(1, 5, len(lengths))
        items = np.repeat(lengths, counts)
        sums = {0}
        for x in items:
            sums |= {s + int(x) for s in sums}
        budget = int(rng.integers(0, items.sum() + 3))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert int((taken * lengths).sum()) == max(s for s in sums if s <= budget)
    exact = mixing.fit_budget([3, 5, 7], [40, 40, 40], 311)
    assert (exact * [3, 5, 7]).sum() == 311
    for _ in range(30):  # budgets beyond the knapsack's table are met too where lengths are many
        lengths = np.unique(rng.integers(1, 3000, 200))
        counts = rng.integers(1, 50, len(lengths))
        budget = int((lengths * counts).sum() * rng.random())
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken <= counts).all() and (taken * lengths).sum() == budget


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 1.5, 2) == [20.0, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.water_fill([0, 10], [3, 1], 1.5, 2) == [0.0, 15.0]
    assert mixing.water_fill([], [], 1.5, 2) == []


def test_mixing(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 30) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a", "b", "ä", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    rows = mixing.mix_sources(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    total = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in set(sources)}
    order = ["a", "b", "ä", None]
    wanted = dict(zip(order, mixing.water_fill([total[s] for s in order], [3, 1, 2, 3], 1.5, 2), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(wanted[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in order) and len(rows) == len(texts)
    assert mixing.apply_mix(docs).count() == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc(spark):
    big = "é" * 600
    pages = spark.createDataFrame(
        [(1, "u1", big), (2, "u2\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "z" * 200_000)],
        "page_id long, url string, html string",
    )
    path = warc.write_archive(pages)
    rows = {r["record"]: r for r in warc.read_records(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None),
    }
    assert rows[1]["payload_bytes"] == 1200 and rows[1]["sha1"] == rows[1]["stated"] == hashlib.sha1(big.encode()).hexdigest()
    assert warc.read_payloads(spark, path).count() == 4
    records = {r["record"]: bytes(r["bytes"]) for r in warc.original_records(spark, path).collect()}
    assert records[2].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and records[2].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert records[1].split(b"\r\n\r\n")[1] == b"" and b"Content-Length: 0" in records[1]
    assert warc.read_records(spark, warc.write_archive(pages.limit(0))).count() == 0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_merkle(spark):
    texts = ["One. Two.\nThree four five.\n\nSix!\n", "", None, "a" * 3000 + "ü" * 700, "x", "One. Two.\nThree four five.\n\nSix!\n"]
    ids = [3, 10, -4, 700, 701, 5000]
    rows = {r["doc_id"]: r for r in merkle.edit_likeness(documents(spark, texts, ids=ids)).collect()}
    order = sorted(range(6), key=lambda i: ids[i])
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % 6]] or ""
        r = rows[ids[i]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited(text, after).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited(text, after))
    assert rows[3]["fingerprint"] == rows[5000]["fingerprint"] != rows[701]["fingerprint"]
    assert merkle.edit_likeness(documents(spark, ["a"]).limit(0)).count() == 0
    one = merkle.edit_likeness(documents(spark, ["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


def test_merkle_locates_edits(spark):
    rows = spark.createDataFrame([("a\nb\n\nc\nd\n", "a\nb\n\nc\ne\n")], "x string, y string")
    tree = lambda c: merkle.sections(merkle.tree(F.col(c)))
    found = rows.select(merkle.differing_paragraphs(tree("x"), tree("y")).alias("d"), (merkle.root(tree("x")) == merkle.root(tree("y"))).alias("same")).first()
    assert [tuple(d) for d in found["d"]] == [(1, 1)] and not found["same"]


def test_merkle_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "aa"), (1, "bb"), (None, "cc")], "doc_id long, text string")
    assert merkle.edit_likeness(rows).count() == 3
