"""SentencePiece, suffix tree, language identification, tool calls, licences, pipeline."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from linkloom.llm import common, language, mixing, pieces, queries, suffix_tree, tool_calls
from linkloom.llm.common import stash
from test_simhash_sets import survivors

MODEL = queries.model_path()


@pytest.fixture(scope="module")
def tables():
    with open(MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n=800):
    rng = random.Random(1)
    parts = ["a", "aa", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ก", "中", "😀", "1", "00", "==", "----", "\x00", "import", " def", "()", "    ", "ß", "www.", "ﬁ", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "a" * 3000, "ab" * 2000, " " * 999, "0" * 77, "<s>", "<0x41>"]


def test_pieces_equal_the_library(tables, library):
    texts = odd_texts()
    mine, theirs = pieces.encode(tables, texts), library.encode(texts, num_threads=1)
    assert mine == theirs
    assert [pieces.decode(tables, i) for i in mine] == [library.decode(i) for i in theirs]


def test_piece_digests(spark, library):
    texts = [*odd_texts(60), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.token_digests(docs, MODEL).collect():
        ids = library.encode(texts[r["doc_id"]] or "", num_threads=1)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.token_digests(docs.limit(0), MODEL).count() == 0
    full = pieces.encode_documents(docs, MODEL).filter("doc_id < 5").collect()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]].replace("▁", " ") for r in full)


def test_memo_of_long_texts(tables, library):
    text = " ".join(f"w{i}" for i in range(500))
    memo = pieces.Memo(tables, limit=50)
    ids = library.encode(text)
    assert pieces._long(memo, pieces.words_of(text)) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def corpus(n=200, seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Thing", "other", "singing", "bread", "x"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(n)] + ["", None, "Ünï  code\n", "y" * 5000]


def test_suffix_tree_columns(spark):
    texts = corpus()
    rows = {r["doc_id"]: r for r in suffix_tree.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lower = {i: i + 32 for i in range(65, 91)}
    words = [(t or "").translate(lower).split() + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(words):
        r = rows[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    ordinary = [r for r in rows.values() if r["doc_id"] < 200]
    assert sum(r["score"] for r in ordinary) / sum(r["n_tokens"] for r in ordinary) > -3


def test_suffix_tree_is_a_distribution():
    texts = [t.encode() for t in corpus() if t]
    window, _, _ = suffix_tree._windows(texts)
    grams, counts = np.unique(window, return_counts=True)
    moves, states = [], []
    for d in range(suffix_tree.DEPTH + 1):
        g, n = suffix_tree._tallied(grams & ((1 << (8 * (d + 1))) - 1), counts)
        moves.append((g, n))
        s, total = suffix_tree._tallied(g >> 8, n)
        states.append((s, total, suffix_tree._tallied(g >> 8, np.ones(len(g), np.int64))[1]))
    tree = suffix_tree.Tree(moves, states).freeze()
    for context in (b"\n\n\n\n\n", b" the ", b"zzzzz", b"singi"):
        after = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert (10 ** tree.score(after)).sum() == pytest.approx(1.0, abs=1e-6)
    with_text = tree.score(window).sum()
    assert with_text > np.log10(1 / 256) * len(window)


def test_suffix_tree_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert suffix_tree.score_documents(rows.limit(0)).count() == 0
    assert suffix_tree.score_documents(rows.union(rows)).count() == 2
    only_held = spark.createDataFrame([(i, "a") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {r["n_known"] for r in suffix_tree.score_documents(only_held).collect()} == {0}


def test_gradients_by_differences():
    net = language.Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = [w.astype(np.float64) for w in net.w]
    data = np.frombuffer(b"abcabacab", np.uint8).reshape(3, 3).T
    inside = np.array([[True, True, True], [True, True, True], [True, False, True]])
    target = np.array([0, 2, 1])

    def loss():
        logp = net.log_probabilities(data, inside)
        return -logp[target, :, np.arange(3)].T[inside].mean()

    grads = net.gradients(data, inside, target)
    rng = np.random.default_rng(0)
    for w, g in zip(net.w, grads, strict=True):
        places = [tuple(i) for i in np.argwhere(g != 0)]
        for at in [places[k] for k in rng.integers(len(places), size=4)]:
            kept, step = w[at], 1e-3
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.03, abs=2e-4)


def plain_log_probabilities(net, text):
    """The network's output at each position of a text, one position after the other, in double precision."""
    wf, wb, uf, ub, wo, bo = (w.astype(np.float64) for w in net.w)
    h_n = net.hidden

    def states(data, w, u):
        h, out = np.zeros(h_n), []
        for byte in data:
            x, a = w[byte], h @ u
            z, r = (1 / (1 + np.exp(-(x[k : k + h_n] + a[k : k + h_n]))) for k in (0, h_n))
            n = np.tanh(x[2 * h_n :] + r * a[2 * h_n :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    both = np.hstack((states(text, wf, uf), states(text[::-1], wb, ub)[::-1]))
    logits = both @ wo + bo
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def test_pooled_means_against_a_plain_network():
    """Whole texts of any length: windows join up, and what lies before the margin hardly matters."""
    rng = random.Random(4)
    words = {"en": "the of and ring tion".split(), "fr": "le aux ment é ou".split(), "de": "der ung ich sch ü".split()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    net = language.train([text(k, 80).encode() for k in words for _ in range(10)], [k for k in words for _ in range(10)], steps=60)
    texts = [t.encode() for t in ("", "a", text("en", 3), text("fr", 90), text("de", 400), text("en", 130) + text("fr", 500))]
    found = language.pooled(net, texts)
    assert not found[0].any()
    for t, row in zip(texts[1:], found[1:], strict=True):
        # a text of one window is exact but for single precision; beyond, a margin stands for all that lies before it
        assert row == pytest.approx(plain_log_probabilities(net, t).mean(axis=0), rel=1e-3 if len(t) > language.CORE else 1e-5, abs=1e-5)
    sizes = [0, 1, language.CORE, language.CORE + 1, 5 * language.CORE + 7]
    of, start, end, core, stop = language.windows(sizes)
    assert np.bincount(of, stop - core, len(sizes)).tolist() == sizes and (stop[:-1] == core[1:]).all()
    assert (end - start <= language.CORE + 2 * language.MARGIN).all()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 !!", "en", "s", 0), (10_003, "", None, "s", 0), (10_004, "the " * 200_000, None, None, 0)], docs.schema)
    rows = language.identify(docs.union(extra)).collect()
    found = {r["doc_id"]: r for r in rows}
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (10_001, 10_002, 10_003)) and found[10_004]["lang_pred"] == "en"
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(rows).collect()} == {"und"}
    assert language.identify(rows.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "abc def", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(one).collect()} == {"en"}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("c", "add", '{"b": 2, "a": 1}'), ("b", "add", '{"a": "x"}'), ("a", "nope", "{}"), ("x", "add", "no json"), ("y", "add", None), (None, "add", '{"a":1,"b":1}')],
        "call_id string, name string, arguments string",
    )
    results = spark.createDataFrame([("c", "3"), ("c", "2"), ("z", "?")], "call_id string, result string")
    needs = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("a", "gone"), ("a", None)], "call_id string, needs string")
    number = {"type": "integer", "minimum": 0}
    schemas = {"add": {"type": "object", "properties": {"a": number, "b": number}, "required": ["a", "b"], "additionalProperties": False}}
    rows = {r["call_id"]: r for r in tool_calls.format_calls(calls, results, needs, schemas).collect()}
    assert {k: r["level"] for k, r in rows.items()} == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, None: None}
    assert (rows["c"]["result"], rows["c"]["n_results"], rows["c"]["valid"]) == ("2", 2, True)
    assert rows["c"]["json"] == '{"arguments":{"a":1,"b":2},"id":"c","name":"add","result":"2"}'
    assert rows["b"]["errors"] == ["$.b: missing", "$.a: not of type integer"] and rows["a"]["errors"] == ["unknown tool nope"]
    assert rows["x"]["errors"] == ["$: not JSON"] and rows["y"]["errors"] == ["$: not of type object"]
    assert tool_calls.orphans(calls, results).collect()[0]["call_id"] == "z"
    assert tool_calls.format_calls(calls.limit(0), results.limit(0), needs.limit(0), schemas).count() == 0


def test_violations():
    schema = {"type": "array", "items": {"enum": ["a", "b"]}}
    assert tool_calls.violations(["a", "c"], schema) == ["$[1]: not in enum"]
    assert tool_calls.violations(True, {"type": "integer"}) and not tool_calls.violations(1, {"type": "number"})
    assert tool_calls.violations("abc", {"maxLength": 2}) == ["$: too long"]
    assert json.loads(tool_calls.canonical({"b": "é\n", "a": [1]})) == {"a": [1], "b": "é\n"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    wanted = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    mine = sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))
    theirs = sorted(tuple(map(str, r)) for r in wanted.project(", ".join(columns)).fetchall())
    assert mine == theirs


def test_pipeline(spark, library):
    """Each stage over what the one before it has kept, against plain code; then the whole run, which must agree and leave one table."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(900_001, None, "en", "s", 0), (900_002, "12 34 !", None, "s", 0), (900_003, docs.first()["text"] + " ", None, "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def after(name):
        kept = stash(stages[name](spark, docs, folder), name)
        assert kept.columns == names
        return kept, Counter(r["doc_id"] for r in kept.collect()), {r["doc_id"]: r["text"] for r in docs.collect()}

    docs, left, before = after("language")
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if any(c.isalpha() for c in r["text"])}
    assert not {900_001, 900_002} & set(left) and len(labelled & set(left)) >= 0.98 * len(labelled) and max(left.values()) == 1
    docs, left, before = after("exact_dedup")
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert left == Counter(first.values())
    docs, left, before = after("near_dedup")
    ids = sorted(before)
    assert left == Counter(ids[k] for k in survivors([before[i] for i in ids]))
    rows = docs.collect()
    mixed = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    docs, left, before = after("mixing")
    assert left == Counter({i: taken // size for i, (size, taken) in mixed.items() if taken}) and len(mixed) == len(rows)
    size, total = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}, Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    order = sorted(total)
    wanted = mixing.water_fill([total[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    source = {r["doc_id"]: r["source"] for r in rows}
    for s, target in zip(order, wanted, strict=True):
        base, sums = int(target // total[s]), 1  # bit k: some documents have k words together
        for i in size:
            sums |= sums << size[i] if source[i] == s else 0
        best = max(k for k in range(round(target) - base * total[s] + 1) if sums >> k & 1)
        assert sum(size[i] * n for i, n in left.items() if source[i] == s) == base * total[s] + best
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = stages["sentencepiece"](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in out) == left and all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]])) for r in out)


def test_pipeline_leaves_one_table_and_carries_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.selectExpr("*", "1 AS _lang", "'x' AS `Size`", "2 AS root").write.parquet(str(tmp_path / "documents.parquet"))
    root = common.own_folder(spark).removeprefix("file:").replace("//", "/")
    there = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [x.split("-")[1] for x in set(os.listdir(root)) - there] == ["mixing"]
