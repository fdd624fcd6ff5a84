"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words, joined by single spaces and closed by an end. A
context is the last ``DEPTH`` symbols or fewer. A context is a state of the tree if ``STATE_FROM`` positions
or more have it and its next-symbol distribution diverges from that of its own suffix by enough nats to pay
for its parameters; the suffixes of a state are states too, as are all single symbols. Distributions are smoothed
by Witten-Bell interpolation down to the root, which gives every byte some mass. A position is scored from
the longest suffix that is a state.

All training texts are counted, and the thresholds are numbers of positions, so states and transitions grow
with the corpus. They are dealt to blocks by the last two symbols of the context, which a context of two or
more symbols shares with all its suffixes but one: a block of at most ``BLOCK`` transitions (or one pair of
symbols) is a tree by itself, and the driver collects and broadcasts one after the other. Each scores the
positions after its own symbols, in a pass over the texts; a corpus whose tree fits in a block needs one.
The unigram base shares the words in two: those with a share of
``P_WORD`` or more, at most 1 / P_WORD, are broadcast; all others go through a join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucket_of_id, pick, resident, sized_parts, slices, small_batches, stash
from .hashing import IntTable

DEPTH = 5
#: Positions that a context needs to be a state, and that a transition needs to have a probability of its own.
STATE_FROM, MOVE_FROM = 16, 3
#: Transitions of a block.
BLOCK = 3_000_000
P_WORD = 1e-6
#: Nats that a state must gain for each of its next symbols.
GAIN = 2.0
END = b"\n"
HELD_OUT = 10

_SLICE = 1 << 20
_HELD = 400_000  # distinct windows and words that a task holds before it passes them on


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """The window (context and symbol) at every position, each text's number of positions, its words."""
    words = [t.translate(LOWER).split() for t in texts]
    parts = [b" ".join(w) + END for w in words]
    pad = END * (DEPTH - 1)
    flat = np.frombuffer(END + b"".join([pad + p for p in parts]), np.uint8)
    # each text begins after DEPTH ends: its padding and the end of the text before
    sizes = np.array([len(p) for p in parts], np.int64)
    first = 1 + np.cumsum(sizes + DEPTH - 1) - sizes
    window = np.zeros(len(flat) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        window <<= 8
        window |= flat[i : len(flat) - DEPTH + i]
    at = np.repeat(first - DEPTH - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return window[at], sizes, words


def _tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows and words of training texts with their counts, summed over what the task has read."""

    def out(grams: np.ndarray, n: np.ndarray, words: Counter) -> Iterator[pa.RecordBatch]:
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.nulls(len(grams), pa.binary()), pa.array(n)], ["gram", "word", "n"])
        if words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["gram", "word", "n"])

    grams, n, words = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
    for batch in batches:
        column = batch.column(0)
        sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
        for a, b in slices(sizes, _SLICE):
            texts = [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
            window, _, split = _windows(texts)
            window.sort()
            first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            new = np.diff(np.append(first, len(window)))
            grams, n = _tallied(np.concatenate((grams, window[first])), np.concatenate((n, new)))
            words.update(chain.from_iterable(split))
            words[END] += len(texts)
            if len(grams) > _HELD or len(words) > _HELD:
                yield from out(grams, n, words)
                grams, n, words = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
    yield from out(grams, n, words)


class Tree:
    """States and transitions of the tree, as arrays for lookups by the batch."""

    def __init__(self, moves: list[tuple[np.ndarray, np.ndarray]], states: list[tuple[np.ndarray, np.ndarray, np.ndarray]], gain: float = GAIN):
        """By depth, each sorted by its first array: moves, the frequent windows of context and symbol with
        their counts; states, the frequent contexts with all their positions and distinct symbols. What is
        frequent has frequent suffixes, so each move's suffix is among the moves one depth above."""
        count = np.zeros(256)
        count[moves[0][0]] = moves[0][1]
        root = (count + 0.1) / (count.sum() + 25.6)
        above, above_p = np.arange(256), root
        kept, place, prob, free = [], [], [], []
        for d in range(1, DEPTH + 1):
            contexts, positions, distinct = states[d]
            grams, n = moves[d]
            at = np.searchsorted(contexts, grams >> 8)
            below = above_p[np.searchsorted(above, grams & ((1 << (8 * d)) - 1))]
            seen = np.bincount(at, n, len(contexts))
            rest = (positions - seen + distinct) / (positions + distinct)
            p = n / (positions + distinct)[at] + rest[at] * below
            kept.append(np.bincount(at, n * np.log(p / below), len(contexts)) >= gain * distinct)
            place.append(at)
            prob.append(p)
            free.append(rest)
            above, above_p = grams, p
        kept[0][:] = True
        for d in range(DEPTH, 1, -1):  # suffixes of states are states
            suffix = states[d][0][kept[d - 1]] & ((1 << (8 * (d - 1))) - 1)
            kept[d - 2][np.searchsorted(states[d - 1][0], suffix)] = True
        self.root, self.depths = np.log10(root), []
        for d in range(DEPTH):
            use = kept[d][place[d]]
            self.depths.append((moves[d + 1][0][use], np.log10(prob[d][use]), states[d + 1][0][kept[d]], np.log10(free[d][kept[d]])))

    def freeze(self) -> Tree:
        """Lookup tables, made where they are used."""
        self.tables = [(IntTable(g), p, IntTable(c), q) for g, p, c, q in self.depths]
        return self

    def score(self, window: np.ndarray) -> np.ndarray:
        """log10 probability of every window's last symbol from its longest suffix state."""
        out = np.zeros(len(window))
        left = np.arange(len(window))
        for d in range(DEPTH, 0, -1):
            grams, logs, contexts, free = self.tables[d - 1]
            part = window[left] & ((1 << (8 * (d + 1))) - 1)
            at = grams.find(part)
            hit = at >= 0
            out[left[hit]] += logs[at[hit]]
            left, part = left[~hit], part[~hit] >> 8
            state = contexts.find(part)
            back = state >= 0
            out[left[back]] += free[state[back]]
        out[left] += self.root[window[left] & 255]
        return out


def _last_two(gram: Column) -> Column:
    """The last two symbols of the context that a window ends in."""
    return F.shiftrightunsigned(gram, 8).bitwiseAND(F.lit(0xFFFF))


class Blocks:
    """The frequent transitions and contexts of a corpus, dealt to blocks that each make a tree."""

    def __init__(self, grams: DataFrame):
        """grams: windows and their counts (gram, n)."""
        masks = F.array(*(F.struct(F.lit(d).alias("d"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("g")) for d in range(DEPTH + 1)))
        moves = stash(grams.select(F.inline(masks), "n").groupBy("d", "g").agg(F.sum("n").alias("n")), "moves")
        states = moves.groupBy("d", F.shiftrightunsigned("g", 8).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
        self.states = stash(states.filter((F.col("n") >= STATE_FROM) | (F.col("d") < 2)), "states")
        self.moves = stash(moves.filter((F.col("n") >= MOVE_FROM) | (F.col("d") < 2)), "frequent")
        sizes = np.zeros(1 << 16, np.int64)
        for r in self.moves.filter("d > 1").groupBy(_last_two(F.col("g")).alias("two")).agg(F.count("*").alias("n")).collect():
            sizes[r["two"]] = r["n"]
        #: block of each pair of symbols, in their order
        self.of = np.zeros(1 << 16, np.int32)
        for block, (a, b) in enumerate(slices(sizes.tolist(), BLOCK)):
            self.of[a:b] = block
        self.count = int(self.of.max()) + 1

    def tree(self, block: int) -> Tree:
        """The tree of a block; the driver gets its rows alone."""
        pairs = np.flatnonzero(self.of == block)
        low, high = int(pairs[0]), int(pairs[-1])
        own = lambda two: (F.col("d") < 2) | two.between(low, high)
        states = self.states.filter(own(F.col("g").bitwiseAND(F.lit(0xFFFF)))).toArrow()
        moves = self.moves.filter(own(_last_two(F.col("g")))).toArrow()

        def by_depth(rows: pa.Table, *names: str) -> list[tuple]:
            depth, columns = rows["d"].to_numpy(), [rows[c].to_numpy() for c in names]
            at = [np.flatnonzero(depth == d) for d in range(DEPTH + 1)]
            at = [x[np.argsort(columns[0][x])] for x in at]
            return [tuple(c[x] for c in columns) for x in at]

        by_state, by_move = by_depth(states, "g", "n", "k"), by_depth(moves, "g", "n")
        for d in range(1, DEPTH + 1):
            g, n = by_move[d]
            use = np.isin(g >> 8, by_state[d][0])
            by_move[d] = g[use], n[use]
        return Tree(by_move, by_state)


def _summed(tree: Tree, own: np.ndarray | None, window: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The score of each text over the positions that are the tree's own, all if ``own`` is None."""
    if own is None:
        score = tree.score(window)
    else:
        at = np.flatnonzero(own[(window >> 8) & 0xFFFF])
        score = np.zeros(len(window))
        score[at] = tree.score(window[at])
    return np.add.reduceat(score, np.concatenate(([0], np.cumsum(length)[:-1])))


def _further(model):
    """row, score of texts by a further block."""
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = resident(("suffix tree", tag), lambda: (model.value[0].freeze(), model.value[1]))
        for part, texts in sized_parts(batches, 0, _SLICE):
            window, length, _ = _windows(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(_summed(tree, own, window, length))], ["row", "more"])

    return run


def _scores(model):
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, own = resident(("suffix tree", tag), lambda: (model.value[0].freeze(), model.value[1].get, model.value[2]))
        for batch in batches:
            column = batch.column(0)
            sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
            for a, b in slices(sizes, _SLICE):
                texts = [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                window, length, split = _windows(texts)
                score = _summed(tree, own, window, length)
                flat = list(chain.from_iterable(w + [END] for w in split))
                counts = np.array([len(w) + 1 for w in split])
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))
                logs = np.fromiter(map(known, flat, repeat(math.nan)), np.float64, len(flat))
                rare = np.isnan(logs)
                base = np.add.reduceat(np.where(rare, 0, logs), first)
                at = np.flatnonzero(rare)
                bounds = np.concatenate(([0], np.cumsum(np.add.reduceat(rare.astype(np.int64), first)))).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(bounds), pa.array([flat[i] for i in at], pa.binary()))
                known_n = counts - np.diff(bounds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2, 3)), pa.array(counts, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base), pa.array(score), words], ["doc_id", "held_out", "row", "n_tokens", "common", "common_base", "score", "rare"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The tree and the unigram base learn from the rows whose crc32(id as text) modulo 10 is not 0; the
    others are held out. A null text counts as empty, that is one end; a null id as empty text. Repeated
    rows count and are scored each. Without training rows every probability is that of the smoothing.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select("text", "doc_id", (bucket_of_id("doc_id", HELD_OUT) == 0).alias("held_out"))
    train = docs.filter("NOT held_out").select("text")
    tallies = train.mapInArrow(_counts, "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))
    tallies = stash(tallies, "tallies")
    words = tallies.filter("word IS NOT NULL").select("word", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = totals["n"], totals["v"]
    grams = tallies.filter("gram IS NOT NULL").select("gram", "n")
    blocks = Blocks(grams)
    tree = blocks.tree(0)
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    if blocks.count > 1:  # the passes that follow must find the same rows
        docs = stash(docs, "texts")
    scale = math.log10(n_train + 0.1 * (vocabulary + 1))
    common = words.filter(F.col("n") >= max(1, math.ceil(P_WORD * n_train))).toArrow()
    logs = np.log10(common["n"].to_numpy() + 0.1) - scale
    known = dict(zip((bytes(w) for w in common["word"].to_pylist()), logs.tolist(), strict=True))
    own = [blocks.of == b if blocks.count > 1 else None for b in range(blocks.count)]
    model = docs.sparkSession.sparkContext.broadcast((tree, known, own[0]))
    kind = dict(docs.dtypes)["doc_id"]
    scored = stash(docs.mapInArrow(_scores(model), f"doc_id {kind}, held_out boolean, row long, n_tokens long, common long, common_base double, score double, rare array<binary>"), "scored")
    for b in range(1, blocks.count):
        more = docs.sparkSession.sparkContext.broadcast((blocks.tree(b), own[b]))
        further = stash(docs.select("text", "row").mapInArrow(_further(more), "row long, more double"), "further")
        scored = stash(scored.join(further, "row").withColumn("score", F.col("score") + F.col("more")).drop("more"), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    less = words.filter(F.col("n") < max(1, math.ceil(P_WORD * n_train)))
    logged = F.log10(F.coalesce("n", F.lit(0)) + 0.1) - F.lit(scale)
    rest = rare.join(less, "word", "left").groupBy("row").agg(F.sum(logged).alias("rare_base"), F.count("n").alias("known"))
    both = scored.drop("rare").join(rest, "row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("common") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("common_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )
