"""Licences: notices as they stand in files, cosines against brute force, inheritance by directory."""

import math
import random
from collections import Counter

import pytest

from linkloom.llm import licences

FILLER = "some other words stand here and there, as in any text at all; "


def commented(text, width, mark):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out, line = [*out, line], ""
        line += " " + w
    return "\n".join(mark + x for x in [*out, line])


def plain_best(matcher, text):
    """The highest cosine over all windows of all templates."""
    ws, found, longest = licences.words(text), (0.0, None), 0
    weight = lambda w: matcher.weight[matcher.place.get(w, -1)]
    for name, template in licences._TEMPLATE_WORDS:
        t = {w: n * weight(w) for w, n in Counter(template).items()}
        length = min(len(template), len(ws))
        for i in range(max(1, len(ws) - length + 1) if ws else 0):
            v = {w: n * weight(w) for w, n in Counter(ws[i : i + length]).items()}
            cosine = sum(x * t.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values()))
            if cosine > found[0] + 1e-9 or abs(cosine - found[0]) <= 1e-9 and len(template) > longest:
                found, longest = (cosine, name), len(template)
    return found if found[0] >= licences.ACCEPT else (0.0, None)


def test_best_against_brute_force():
    rng = random.Random(3)
    parts = [t for _, t in licences.TEMPLATES] + [FILLER * 3, "the license of the program", "x y z", "version 3 of the public license"]
    texts = ["", "...", "MIT", "license"]
    for _ in range(60):
        chosen = [rng.choice(parts).split() for _ in range(rng.randint(1, 3))]
        for ws in chosen:
            for _ in range(rng.randint(0, len(ws) // 3)):
                ws[rng.randrange(len(ws))] = rng.choice(["other", "word", "software", "the"])
        texts.append(" ".join(w for ws in chosen for w in ws))
    matcher = licences.Matcher(1000, {"the": 900, "of": 800, "software": 30, "license": 12, "here": 400, "words": 3})
    for text, (score, name) in zip(texts, matcher.best(texts), strict=True):
        wanted = plain_best(matcher, text)
        assert score == pytest.approx(wanted[0], abs=1e-9) and name == wanted[1], text


@pytest.mark.parametrize("mark", ["# ", " * ", "// ", ""])
def test_wrapped_notices(mark):
    matcher = licences.Matcher(1000, {"the": 900, "of": 800, "and": 850, "in": 700})
    texts = [FILLER * 4 + "\n" + commented(t, 60, mark) + "\n" + FILLER * 4 for _, t in licences.TEMPLATES]
    assert [name for _, name in matcher.best(texts)] == [name for name, _ in licences.TEMPLATES]
    for text, name in [
        ("// SPDX-License-Identifier: GPL-3.0-or-later\nint main() {}", "GPL-3.0"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"), ("MIT License\n\nCopyright (c) 2020 Somebody\n\n", "MIT"),
        ("license to thrill everyone around here today", None), ("we read the licence before we drove", None),
    ]:
        assert matcher.best([text])[0][1] == name, text


def test_scan(spark):
    files = spark.createDataFrame(
        [
            (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.txt", "nothing"), (3, "p/a/b/y.txt", "This work is licensed under the GNU General Public License, version 3."),
            (4, "q/z.txt", None), (5, "p/a/b/LICENSE", "Foo\nLicensed under CC BY-NC 4.0.\nbar " + "word " * 5000), (6, "p/a/b/c/d.txt", "license to thrill everyone around here today"), (7, None, ""),
            (8, "r/t.txt", "filler words here " * 40 + "Licensed under the Apache License, Version 2.0. " + "and more words " * 40), (2, "p/a/x.txt", "nothing"),
        ],
        "id long, path string, text string",
    )
    rows = {r["id"]: (r["licence"], r["origin"], r["licence_path"]) for r in licences.scan(files).collect()}
    assert rows == {
        1: ("MIT", "own", "p/LICENSE"), 2: ("MIT", "inherited", "p/LICENSE"), 3: ("GPL-3.0", "own", "p/a/b/y.txt"), 4: (None, "none", None), 5: ("CC-BY-NC-4.0", "own", "p/a/b/LICENSE"),
        6: ("CC-BY-NC-4.0", "inherited", "p/a/b/LICENSE"), 7: (None, "none", None), 8: ("Apache-2.0", "own", "r/t.txt"),
    }
    assert licences.scan(files).count() == 9 and licences.scan(files.limit(0)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "Released under the MIT License.", "s", "x", 1)], "doc_id long, text string, source string, TEXT string, folder int")
    files = licences.document_paths(docs)
    assert files.first()["path"] == "s/0/0/LICENSE-7" and licences.scan(files.selectExpr("*", "1 AS own"), id_col="doc_id").first()["licence"] == "MIT"
