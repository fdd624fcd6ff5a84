"""Digests, sketches and likeness of the tree against plain code."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from linkloom.llm import merkle

sha = lambda raw: hashlib.sha256(raw).hexdigest()


def plain_tree(text):
    """Leaves (bytes) by section and paragraph."""

    def leaves(paragraph):
        sentences = [s for s in re.split(r"(?<=[.!?;|] )", paragraph)]
        out = []
        for s in sentences:
            raw = s.encode()
            out += [raw[i : i + 240] for i in range(0, max(1, len(raw)), 240)]
        return out

    return [[leaves(p) for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n\n)(?=[^\n])", text)]


def plain_root(text):
    joined = lambda items: sha("".join(items).encode())
    return joined([joined([joined([sha(x) for x in p]) for p in s]) for s in plain_tree(text)])


def leaves_of(text):
    return Counter(x for s in plain_tree(text) for p in s for x in p if x)


def plain_likeness(a, b):
    x, y = leaves_of(a), leaves_of(b)
    size = lambda c: sum(len(k) * n for k, n in c.items())
    return 2 * size(x & y) / (size(x) + size(y)) if x or y else 1.0


def sample():
    rng = random.Random(7)
    word = lambda: rng.choice(["one", "two", "drei", "vier é", "five.", "six! ", "seven\n", "\n\n", "x" * 90, "; "])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(14)]
    return [*texts, texts[0] + texts[1], texts[2][: len(texts[2]) // 2] + texts[3], "", "same\n" * 50 + "one\ntwo\n", "same\n" * 50 + "three\n" * 4, "one\none\nsame\n" * 3, "é" * 700]


def looked_at(spark, texts):
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    sketch = lambda c: merkle.sketch(merkle.tree(F.col(c)))
    return pairs.select("a", "b", merkle.likeness(sketch("a"), sketch("b")).alias("near")).collect()


def test_roots_and_likeness_against_plain_code(spark):
    texts = sample()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", merkle.root(merkle.sections(merkle.tree(F.col("t")))).alias("root")).collect():
        assert r["root"] == plain_root(r["t"])
    for r in looked_at(spark, texts):
        assert abs(r["near"] - plain_likeness(r["a"], r["b"])) < 1e-12, (r["a"], r["b"])


def test_long_texts_have_short_fingerprints_and_near_likeness(spark):
    rng = random.Random(1)
    lines = [f"line {rng.random()}\n" for _ in range(6000)]
    a, b = "".join(lines[:4000]), "".join(lines[2000:])
    found = {(r["a"], r["b"]): r["near"] for r in looked_at(spark, [a, b])}
    assert found[a, a] == 1.0 and abs(found[a, b] - plain_likeness(a, b)) < 0.12
    docs = spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in merkle.edit_likeness(docs).collect()}
    assert all(len(r["fingerprint"]) < 70 + 20 * merkle.SKETCH for r in rows.values())
    assert abs(rows[1]["near_next"] - plain_likeness(a, b)) < 0.12


def test_edits_against_plain_likeness(spark):
    texts = sample()
    rows = {r["doc_id"]: r for r in merkle.edit_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert abs(rows[i]["near_edited"] - plain_likeness(text, changed)) < 1e-12 and abs(rows[i]["near_next"] - plain_likeness(text, after)) < 1e-12
        assert rows[i]["edited_fingerprint"].split(":")[0] == plain_root(changed)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a. b", "x", "y"), (2, "c", "x", "y")], "doc_id long, text string, Text string, sketch string")
    assert merkle.edit_likeness(docs).count() == 2 and merkle.fingerprint_documents(docs).count() == 2
