"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a weight and a target; the targets share a multiple of all words and stop at ``cap``
times the source's size. A source first takes each document as often as its target holds the whole
source. For the budget that remains, documents are counted by exact length, a bounded knapsack finds how
many documents of each length fill it, and those are selected by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORDS, pick, place, positions, stash

#: Words of budget that are left to the exact knapsack after the proportional fill.
DP_BUDGET = 8192
#: Documents of one source and length that are ranked together, on average.
RANKED = 256


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes; none above ``cap`` times its size.

    What is cut off at a cap is shared again by weight among the others until none is above.
    """
    out = [0.0] * len(sizes)
    left, budget = list(range(len(sizes))), share * sum(sizes)
    while left:
        total = sum(weights[i] for i in left)
        full = [i for i in left if budget * weights[i] / total >= cap * sizes[i]]
        if not full:
            for i in left:
                out[i] = budget * weights[i] / total
            break
        for i in full:
            out[i] = cap * float(sizes[i])
        budget -= sum(out[i] for i in full)
        left = [i for i in left if i not in set(full)]
    return out


def fit_budget(lengths: Iterable[int], counts: Iterable[int], budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each distinct length to take so that their words come near to ``budget`` from below.

    Up to 2 ``dp_budget`` words a bounded knapsack finds the best sum there is. For a larger budget a
    proportional part of every length is taken first and the large lengths fill up to ``dp_budget``; the
    knapsack then finds the best sum for the rest from what is left of each length.
    """
    lengths, counts = np.asarray(list(lengths), np.int64), np.asarray(list(counts), np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    use = np.flatnonzero(lengths > 0)
    # whole-number arithmetic, as a product of counts and budget may pass 2**53
    if budget > 2 * dp_budget:
        taken[use] = [int(c) * budget // total for c in counts[use]]
    rest = budget - int((lengths * taken).sum())
    order = use[np.argsort(-lengths[use], kind="stable")]
    for keep in (dp_budget, 0):
        for i in order:
            if rest <= 2 * dp_budget:
                break
            n = min(int(counts[i] - taken[i]), max(0, (rest - keep) // int(lengths[i])))
            taken[i] += n
            rest -= n * int(lengths[i])
    reach, first, items = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int32), []
    reach[0] = True
    for i in order:
        size, free = int(lengths[i]), int(counts[i] - taken[i])
        free, part = min(free, rest // size), 1
        while free > 0 and not reach[rest]:
            n = min(part, free)
            step = n * size
            new = np.zeros(rest + 1, bool)
            new[step:] = reach[: rest + 1 - step]
            new &= ~reach
            first[new] = len(items)
            items.append((i, n, step))
            reach |= new
            free, part = free - n, part * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n, step = items[first[at]]
        taken[i] += n
        at -= step
    return taken


def _plan(targets: dict[str, tuple[int, float]]):
    """Of one source's counts by length: base (times every document is taken) and extra (documents taken once more)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = targets[pdf["key"].iloc[0]]
        base = int(target // size) if size else 0
        pdf = pdf.sort_values("size", ignore_index=True)
        extra = fit_budget(pdf["size"], pdf["n"], round(target) - base * size)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "n": pdf["n"], "base": base, "extra": extra})

    return fit


#: Rows of counts by source and length up to which they are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_LENGTHS = 500_000


def _sized(docs: DataFrame) -> tuple[Column, Column]:
    """Key of the source and size in words of rows (doc_id, text, source)."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return key.alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("size")


def _at(seed: int) -> tuple[Column, Column]:
    """A row's hash and, for a group of ``n``, its bucket."""
    at = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    return at, F.pmod(at, F.ceil(F.col("n") / RANKED))


def _dealt(docs: DataFrame, weights, share: float, cap: float, seed: int, id_col: str, text_col: str, source_col: str, max_sources: int) -> DataFrame:
    """doc_id, key, size, source_size, target, n, base, extra, at, bucket per row: what its group takes and its place in the group."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = stash(docs.select("doc_id", *_sized(docs)), "sizes")
    counts = stash(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "lengths")
    rows = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = sorted(rows, key=lambda r: (r["key"] == "n", r["key"]))
    fit = water_fill([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    targets = {r["key"]: (r["size"], t) for r, t in zip(rows, fit, strict=True)}
    sources = spark.createDataFrame([(k, s, float(t)) for k, (s, t) in targets.items()], "key string, source_size long, target double")
    plan = stash(counts.groupBy("key").applyInPandas(_plan(targets), "key string, size long, n long, base long, extra long"), "plan")
    at, bucket = _at(seed)
    dealt = sized.join(plan.join(sources, "key"), ["key", "size"])
    return stash(dealt.withColumns({"at": at, "bucket": bucket}), "dealt")


def _ranked(dealt: DataFrame) -> DataFrame:
    """``dealt`` with once_more: whether the row is among the first ``extra`` of its group, in the order of bucket, hash and id."""
    group = ["key", "size", "bucket"]
    held = dealt.groupBy(*group, "extra").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = held.withColumn("take", F.col("extra") - F.coalesce(before, F.lit(0))).select(*group, "take")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("at", "doc_id"))
    ranked = dealt.repartition(*group).withColumn("rank", rank)
    return ranked.join(cut, group).withColumn("once_more", F.col("rank") <= F.col("take"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    size: words of the text, 0 if it is null or empty. Sources in code-point order, null last, have the
    weights in turn. taken: words that the mix takes of the row, a multiple of size up to ``cap`` times.
    Rows are chosen by a hash of seed and id, so reruns agree; rows that repeat an id tie and are taken
    one after the other. A source without words has the target 0. Only the totals of the sources, at most
    ``max_sources`` rows, come to the driver; more sources raise an error.
    """
    dealt = _dealt(docs, weights, share, cap, seed, id_col, text_col, source_col, max_sources)
    times = F.col("base") + F.col("once_more").cast("int")
    return _ranked(dealt).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """``docs`` as the mix takes them, with all their columns: a row once for each time ``mix_sources`` takes it.

    The rows taken once more are the first of their source and length in a fixed order, so the last of
    them stands for all: each row is held against that one, and texts need no shuffle. Rows that repeat an
    id tie and are taken together.
    """
    dealt = _dealt(docs, weights, share, cap, seed, id_col, text_col, source_col, max_sources)
    last = F.max(F.when(F.col("once_more"), F.struct("bucket", "at", "doc_id"))).alias("last")
    limits = _ranked(dealt).groupBy("key", "size").agg(F.max("n").alias("n"), F.max("base").alias("base"), last)
    limits = stash(limits, "limits")
    if limits.count() <= BROADCAST_LENGTHS:
        limits = F.broadcast(limits)
    rows = positions(docs)
    named = rows.withColumns({new: F.col(f"_{place(docs, old)}") for new, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))})
    key, size = _sized(named)
    at, bucket = _at(seed)
    found = named.withColumns({"key": key, "size": size}).join(limits, ["key", "size"])
    more = F.coalesce(F.struct(bucket.alias("bucket"), at.alias("at"), F.col("doc_id")) <= F.col("last"), F.lit(False))
    times = F.when(F.col("size") > 0, F.col("base") + more.cast("int")).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    found = found.withColumn("times", times).filter("times > 0").withColumn("copy", copies)
    return found.select(*rows.columns).toDF(*docs.columns)
