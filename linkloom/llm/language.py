"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position of a text, white space too, gets log-probabilities of all languages from the states of
both directions, which run on across words. A text is cut into cores of ``CORE`` bytes; the network reads
each with ``MARGIN`` bytes of the text on both sides, so that a state has seen as many bytes at least, or
the end of the text, before the first position that counts. A document's log-probabilities are the mean
over all its positions, made to sum to 1. Training is backpropagation through time in numpy, with Adam, on
stretches of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, pick, place, slices, small_batches, vacate

CORE, MARGIN = 448, 32
HIDDEN = 16
#: Labelled rows that training samples, in equal parts by language, and characters it takes of each.
TRAIN_ROWS, TRAIN_CHARS = 1600, 1500
MAX_LANGUAGES = 1000
#: Steps of training, stretches in each, their bytes, and the rate of the first step.
STEPS, BATCH, STRETCH, RATE = 1000, 128, 32, 0.02
FOLDS, TEST_FOLD = 4, 2
UNKNOWN = "und"

#: Bytes of texts that are laid end to end, and numbers that a run of windows may hold for each kind of state.
_SLICE, _NUMBERS = 1 << 21, 1 << 22


class Network:
    """Weights by direction: input by byte (with the biases), recurrent; then the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = [draw(256, 3 * hidden), draw(256, 3 * hidden), draw(hidden, 3 * hidden), draw(hidden, 3 * hidden), draw(2 * hidden, len(labels)), np.zeros(len(labels), np.float32)]

    def _direction(self, steps: np.ndarray, inside: np.ndarray, way: int, keep: list | None) -> np.ndarray:
        """States of one direction. steps: bytes by time and row. keep: gets what the way back needs.

        A gate is (1 + tanh(x / 2)) / 2; the halves are in the weights here, and most steps work in place.
        """
        h_n, w, u = self.hidden, self.w[way], self.w[2 + way]
        w_gates, w_new = w[:, : 2 * h_n] * 0.5, np.ascontiguousarray(w[:, 2 * h_n :])
        u_gates, u_new = u[:, : 2 * h_n] * 0.5, u[:, 2 * h_n :] * 0.5
        h = np.zeros((steps.shape[1], h_n), w.dtype)
        out = np.empty((*steps.shape, h_n), w.dtype)
        full = inside.all(axis=1)
        steps = steps.astype(np.intp)
        for t in range(len(steps)):
            double = w_gates.take(steps[t], axis=0)  # twice the gates z and r
            double += h @ u_gates
            np.tanh(double, out=double)
            double += 1
            half = h @ u_new
            n = w_new.take(steps[t], axis=0)
            n += half * double[:, h_n:]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, double[:, :h_n] * 0.5, double[:, h_n:] * 0.5, n, half * 2))
            h = np.subtract(h, n, out=out[t])
            h *= double[:, :h_n]
            h *= 0.5
            h += n
            if not full[t]:
                h *= inside[t][:, None]
        return out

    def log_probabilities(self, steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Log-probability of each label at every position (label, time, row).

        steps: bytes by time and row; inside: which of them belong to the row. A state outside is zero.
        """
        if not self.labels:
            return np.zeros((0, *steps.shape), np.float32)
        return self._forward(steps, inside, None)[0]

    def _forward(self, steps: np.ndarray, inside: np.ndarray, keep: list | None):
        fwd = self._direction(steps, inside, 0, None if keep is None else keep[0])
        bwd = self._direction(steps[::-1], inside[::-1], 1, None if keep is None else keep[1])[::-1]
        h_n, out = self.hidden, self.w[4].T
        logits = out[:, :h_n] @ fwd.reshape(-1, h_n).T  # labels first, as sums over a short last axis are slow
        logits += out[:, h_n:] @ bwd.reshape(-1, h_n).T
        logits += self.w[5][:, None]
        logits -= logits.max(axis=0)
        logits -= np.log(np.exp(logits).sum(axis=0))
        return logits.reshape(-1, *steps.shape), fwd, bwd

    def gradients(self, steps: np.ndarray, inside: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions inside, by backpropagation through time."""
        keep: list = [[], []]
        logp, fwd, bwd = self._forward(steps, inside, keep)
        d = np.exp(logp)
        d[target, :, np.arange(len(target))] -= 1
        d *= inside / inside.sum()
        h_n = self.hidden
        flat = d.reshape(len(d), -1)
        grads = [np.zeros_like(w) for w in self.w]
        grads[4][:] = (flat @ np.concatenate((fwd, bwd), axis=2).reshape(-1, 2 * h_n)).T
        grads[5][:] = flat.sum(axis=1)
        dstates = (flat.T @ self.w[4].T).reshape(*steps.shape, 2 * h_n)
        for way in (0, 1):
            turn = slice(None, None, 1 if way == 0 else -1)
            order, within = steps[turn], inside[turn]
            given = dstates[turn, :, way * h_n : (way + 1) * h_n]
            u = self.w[2 + way]
            dh = np.zeros((steps.shape[1], h_n), u.dtype)
            for t in range(len(order) - 1, -1, -1):
                h, z, r, n, an = keep[way][t]
                dh = (dh + given[t]) * within[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r), axis=1)
                grads[2 + way] += h.T @ da
                np.add.at(grads[way], order[t], np.concatenate((dz, dr, dn), axis=1))
                dh = dh * z + da @ u.T
        return grads


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, batch: int = BATCH, stretch: int = STRETCH, rate: float = RATE, seed: int = 7) -> Network:
    """A network fitted to stretches of labelled texts, each language with the same weight."""
    labels = sorted(set(langs))
    net = Network(labels, seed=seed)
    found = {k: [t for t, lang in zip(texts, langs, strict=True) if lang == k and t] for k in labels}
    sources = [(i, np.frombuffer(b"".join(found[k]), np.uint8), np.cumsum([len(t) for t in found[k]])) for i, k in enumerate(labels) if found[k]]
    if len(labels) < 2 or not sources:
        return net
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    each = max(1, batch // len(sources))
    target = np.repeat([i for i, _, _ in sources], each)
    for step in range(1, steps + 1):
        parts = []
        for _, flat, ends in sources:
            at = rng.integers(len(flat), size=each)
            text = np.searchsorted(ends, at, "right")
            begin = np.maximum(np.minimum(at, ends[text] - stretch), np.concatenate(([0], ends))[text])
            places = begin + np.arange(stretch)[:, None]
            parts.append((flat[np.minimum(places, len(flat) - 1)], places < ends[text]))
        grads = net.gradients(*(np.concatenate(x, axis=1) for x in zip(*parts, strict=True)), target)
        now = rate * (1 - step / (steps + 1))
        for w, g, m, v in zip(net.w, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def windows(sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Windows over texts of these sizes laid end to end: number of the text, start, end, start and end of the core."""
    sizes = np.asarray(sizes, np.int64)
    counts = -(-sizes // CORE)
    text = np.repeat(np.arange(len(sizes)), counts)
    low = (np.cumsum(sizes) - sizes)[text]
    high = low + sizes[text]
    core = low + (np.arange(len(text)) - (np.cumsum(counts) - counts)[text]) * CORE
    stop = np.minimum(core + CORE, high)
    return text, np.maximum(core - MARGIN, low), np.minimum(stop + MARGIN, high), core, stop


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """For each text the mean log-probability of each label over all its positions, 0 for an empty one."""
    sizes = [len(t) for t in texts]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    text, start, end, core, stop = windows(sizes)
    out = np.zeros((len(texts), len(net.labels)))
    order = np.argsort(end - start, kind="stable")  # windows of about the same length run together
    rows = max(1, _NUMBERS // ((CORE + 2 * MARGIN) * max(net.hidden, len(net.labels))))
    for a in range(0, len(order), rows):
        run = order[a : a + rows]
        places = start[run] + np.arange((end - start)[run].max())[:, None]
        logp = net.log_probabilities(flat[np.minimum(places, len(flat) - 1)], places < end[run])
        counts = (places >= core[run]) & (places < stop[run])
        np.add.at(out, text[run], np.einsum("tr,ltr->rl", counts.astype(np.float32), logp))
    return out / np.maximum(sizes, 1)[:, None]


def _predict(model, text_at: int, letter_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        net = model.value
        labels = np.array([*net.labels, UNKNOWN], object)
        for batch in batches:
            column = batch.column(text_at)
            sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
            means = [np.zeros((0, len(net.labels)))]
            for a, b in slices(sizes, _SLICE):
                means.append(pooled(net, [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]))
            mean = np.concatenate(means)
            share = np.exp(mean - mean.max(axis=1, keepdims=True, initial=-np.inf))
            share /= share.sum(axis=1, keepdims=True)
            letter = np.array(batch.column(letter_at).to_pylist(), bool) & bool(net.labels)
            best = np.where(letter, share.argmax(axis=1) if net.labels else 0, len(net.labels))
            # rounded, as sums in single precision depend on the rows beside a text in their last digits
            score = np.where(letter, share.max(axis=1, initial=0), 0.0).round(4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:letter_at], pa.array(labels[best], pa.string()), pa.array(score)], [*batch.schema.names[:letter_at], "_lang", "_score"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Network:
    """A network from at most ``train_rows`` labelled rows of the training folds, about as many of each language.

    Rows are chosen by a hash of their id; of a longer text ``TRAIN_CHARS`` characters at a hashed place
    are used. The driver collects that bounded sample alone. Rows without text or language teach nothing.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of_id("doc_id", FOLDS) != TEST_FOLD))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Network([])
    each = max(1, train_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, each / n))) for k, n in sorted(counts.items())))
    start = F.pmod(F.xxhash64(F.lit(12), F.col("doc_id").cast("string")), F.greatest(F.lit(1), F.char_length("text") - TRAIN_CHARS + 1)).cast("int") + 1
    chosen = rows.filter(draw < shares[F.col("lang")]).select("lang", F.substring("text", start, F.lit(TRAIN_CHARS)).cast("binary").alias("text"), draw.alias("draw"))
    found = sorted((r["lang"], r["draw"], bytes(r["text"])) for r in chosen.limit(2 * train_rows + MAX_LANGUAGES).collect())
    return train([t for _, _, t in found], [k for k, _, _ in found])


def label(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns _lang and _score beside its own; one pass without a shuffle."""
    small_batches(docs.sparkSession)
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = place(docs, text_col)
    letter = F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"{c} {t}" for c, t in flat.dtypes) + ", _lang string, _score double"
    out = flat.withColumn("letter", letter).mapInArrow(_predict(model, at, len(names)), schema)
    return out.toDF(*names, "_lang", "_score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    held_out: crc32(id as text) modulo 4 is 2; such rows teach nothing. A null text or one without a
    letter, whatever its length, gets ``und`` and the score 0, as does every text if no row has a
    language. Repeated rows get equal results; a null id counts as empty text for the fold.
    """
    net = fit(docs, id_col, text_col, lang_col)
    rows = pick(docs, doc_id=id_col, text=text_col)
    out = label(rows, net)
    return out.select("doc_id", (bucket_of_id("doc_id", FOLDS) == TEST_FOLD).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
