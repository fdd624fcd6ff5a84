"""Scores of the suffix tree against a plain one, in one block and in several."""

import math
import random
import zlib
from collections import Counter

import pytest

from linkloom.llm import suffix_tree


def plain_scores(texts, held):
    """Scores by dictionaries: states by count and gain, Witten-Bell estimates, the longest state of each position."""
    depth, lower = suffix_tree.DEPTH, bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    parts = [b" ".join((t or "").encode().translate(lower).split()) + b"\n" for t in texts]
    places = [[((b"\n" * depth + p)[i : i + depth], p[i]) for i in range(len(p))] for p in parts]
    count = [Counter() for _ in range(depth + 1)]
    for ps, h in zip(places, held, strict=True):
        if not h:
            for c, s in ps:
                for d in range(depth + 1):
                    count[d][c[depth - d :], s] += 1
    total = sum(count[0].values())
    prob = [{(b"", s): (count[0][b"", s] + 0.1) / (total + 25.6) for s in range(256)}]
    free, states = [{}], [{}]
    for d in range(1, depth + 1):
        of: dict = {}
        for (c, s), n in count[d].items():
            of.setdefault(c, {})[s] = n
        p_d, free_d, kept = {}, {}, {}
        for c, next_ in of.items():
            n = sum(next_.values())
            if n < suffix_tree.STATE_FROM and d > 1:
                continue
            use = {s: m for s, m in next_.items() if m >= suffix_tree.MOVE_FROM or d == 1}
            free_d[c] = (n - sum(use.values()) + len(next_)) / (n + len(next_))
            gain = 0.0
            for s, m in use.items():
                below = prob[d - 1][c[1:], s]
                p_d[c, s] = m / (n + len(next_)) + free_d[c] * below
                gain += m * math.log(p_d[c, s] / below)
            kept[c] = d == 1 or gain >= suffix_tree.GAIN * len(next_)
        prob.append(p_d)
        free.append(free_d)
        states.append(kept)
    for d in range(depth, 1, -1):
        for c, yes in states[d].items():
            if yes:
                states[d - 1][c[1:]] = True

    def score(c, s):
        out = 0.0
        for d in range(depth, 0, -1):
            own = c[depth - d :]
            if states[d].get(own):
                if (own, s) in prob[d]:
                    return out + math.log10(prob[d][own, s])
                out += math.log10(free[d][own])
        return out + math.log10(prob[0][b"", s])

    return [sum(score(c, s) for c, s in ps) for ps in places]


@pytest.mark.parametrize("block", [40, 3_000_000])
def test_scores_against_a_plain_tree(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_tree, "BLOCK", block)
    rng = random.Random(6)
    words = ["the", "of", "and", "thing", "Other", "singing", "bread", "ünï", "x", "q"]
    texts = [" ".join(rng.choices(words, weights=[9, 8, 7, 5, 4, 3, 3, 2, 1, 1], k=rng.randint(0, 40))) for _ in range(120)] + ["", None, "zzz " * 300]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    rows = suffix_tree.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_scores(texts, held), abs=1e-6)


def test_what_is_kept_grows_with_the_corpus(spark):
    rng = random.Random(1)
    syllables = ["ka", "ru", "mo", "ti", "sen", "pol", "dra", "vex", "li", "ost"]
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60))
    sizes = []
    for n in (40, 400):
        docs = spark.createDataFrame([(text(),) for _ in range(n)], "text string")
        grams = docs.mapInArrow(suffix_tree._counts, "gram long, word binary, n long").filter("gram IS NOT NULL").groupBy("gram").sum("n").toDF("gram", "n")
        blocks = suffix_tree.Blocks(grams)
        sizes.append((blocks.states.count(), blocks.moves.count()))
    assert sizes[1][0] > 2 * sizes[0][0] and sizes[1][1] > 2 * sizes[0][1]
