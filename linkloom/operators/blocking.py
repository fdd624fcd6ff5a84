"""Candidate search: an equi-join of keys, summed by pair, and the best few per source.

Keys and their weights per occurrence on either side: token 3 (two bytes or more), phonetic key 4, trigram
of the cleaned name 1, trigram of the romanised skeleton 1. With 1,000 destinations or more, keys that
occur in destinations more often than the cutoff are left out, so no key joins more than the cutoff's rows
on that side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MatchConfig
from ..functions import columns as C
from ..llm.common import slices, vacate

WEIGHTS = {"token": 3, "phonetic": 4, "trigram": 1, "romanized": 1}
CUTOFF_FROM = 1000


def cutoff(destinations: int, config: MatchConfig = MatchConfig()) -> int | None:
    """The most occurrences of a key that is used; None: all are."""
    return min(int(destinations * config.max_posting_ratio), config.max_postings) if destinations >= CUTOFF_FROM else None


def keys(named: DataFrame, romanized: bool = True) -> DataFrame:
    """id, ordinal, kind, key, tf of records with the fields of a normalised name."""

    def of_kind(kind: str, items: Column) -> Column:
        return F.transform(items, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    tokens = F.filter("tokens", lambda t: F.octet_length(t) >= 2)
    phonetic = F.when(F.col("phonetic_key") != "", F.array("phonetic_key")).otherwise(F.array().cast("array<string>"))
    parts = [of_kind("token", tokens), of_kind("phonetic", phonetic), of_kind("trigram", C.trigrams(F.col("cleaned")))]
    if romanized:
        skeleton = F.when(F.col("romanized") != "", C.trigrams(F.col("romanized"))).otherwise(F.array().cast("array<string>"))
        parts.append(of_kind("romanized", skeleton))
    carried = [c for c in ("id", "ordinal", "of") if c in named.columns]
    every = named.select(*carried, F.inline(F.concat(*parts)))
    return every.groupBy(*carried, "kind", "key").agg(F.count("*").alias("tf"))


#: Characters whose trigrams are counted at a time.
CHARACTERS = 2_000_000


def _grams(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Trigrams of padded texts: which text has them, the trigram, how often."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(text[:-2] == text[2:])
    grams, at = np.unique(flat[inside] << 42 | flat[inside + 1] << 21 | flat[inside + 2], return_inverse=True)
    cells, times = np.unique(text[inside] * max(1, len(grams)) + at, return_counts=True)
    low = (1 << 21) - 1
    spelt = pa.array([chr(g >> 42) + chr(g >> 21 & low) + chr(g & low) for g in grams.tolist()], pa.string())
    return cells // max(1, len(grams)), spelt.take(pa.array(cells % max(1, len(grams)), pa.int64())), times


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with id, of, words (lists by kind) and padded texts by kind: id, of, kind, key, tf."""
    for batch in batches:
        texts = {k: batch.column(k).to_pylist() for k in ("trigram", "romanized") if k in batch.schema.names}
        for lo, hi in slices([sum(len(t[i] or "") for t in texts.values()) for i in range(batch.num_rows)], CHARACTERS):
            part = batch.slice(lo, hi - lo)
            for kind in batch.schema.names[2:]:
                if kind in texts:
                    row, key, times = _grams([t or "" for t in texts[kind][lo:hi]])
                else:
                    found = [Counter(x or ()) for x in part.column(kind).to_pylist()]
                    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                    key, times = pa.array([t for x in found for t in x], pa.string()), np.array([n for x in found for n in x.values()], np.int64)
                own = [part.column(i).take(pa.array(row, pa.int64())) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([kind] * len(row), pa.string()), key, pa.array(times, pa.int64())], ["id", "of", "kind", "key", "tf"])
    vacate()


def keys_of_forms(named: DataFrame, romanized: bool = True) -> DataFrame:
    """What ``keys`` gives for ``forms``, each of which is a row: counted in Arrow batches, without a shuffle of all keys."""
    padded = lambda c: F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    rows = named.select(
        "id", F.col("of").cast("long").alias("of"), F.filter("tokens", lambda t: F.octet_length(t) >= 2).alias("token"),
        F.when(F.col("phonetic_key") != "", F.array("phonetic_key")).alias("phonetic"), padded(F.col("cleaned")).alias("trigram"),
        *([F.when(F.col("romanized") != "", padded(F.col("romanized"))).alias("romanized")] if romanized else []),
    )
    rows = rows.repartition(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return rows.mapInArrow(_counted, "id long, of long, kind string, key string, tf long")


def key_frequencies(dest_keys: DataFrame) -> DataFrame:
    """kind, key, freq: occurrences over all destinations; a column ``of`` says how many of them a row stands for."""
    times = F.col("of") if "of" in dest_keys.columns else F.lit(1)
    return dest_keys.groupBy("kind", "key").agg(F.sum(F.col("tf") * times).alias("freq"))


def hits(source_keys: DataFrame, dest_keys: DataFrame, limit: int | None) -> DataFrame:
    """source_id, dest_id, dest_ordinal, hits: weights times occurrences on both sides, summed."""
    if limit is not None:
        usable = key_frequencies(dest_keys).filter(F.col("freq") <= limit).select("kind", "key")
        dest_keys = dest_keys.join(usable, ["kind", "key"])
    left = source_keys.select(F.col("id").alias("source_id"), "kind", "key", F.col("tf").alias("tf_s"))
    right = dest_keys.select(F.col("id").alias("dest_id"), F.col("ordinal").alias("dest_ordinal"), "kind", "key", F.col("tf").alias("tf_d"))
    worth = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")]
    joined = left.join(right, ["kind", "key"])
    return joined.groupBy("source_id", "dest_id", "dest_ordinal").agg(F.sum(worth * F.col("tf_s") * F.col("tf_d")).alias("hits"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` destinations with the most hits per source; of equal ones those that come first."""
    order = Window.partitionBy("source_id").orderBy(F.desc("hits"), "dest_ordinal")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


FIELDS = ("cleaned", "tokens", "phonetic_key", "romanized")


def forms(rows: DataFrame) -> DataFrame:
    """The distinct names of records: their fields, id and ordinal (that of the first record) and of, the number of records.

    A column ``of`` says how many records a row stands for.
    """
    times = F.col("of") if "of" in rows.columns else F.lit(1)
    found = rows.groupBy(*FIELDS).agg(F.min("ordinal").alias("ordinal"), F.sum(times).alias("of"))
    return found.withColumn("id", F.col("ordinal").cast("long"))


#: Keys of names that a block of either side has, about; pairs of keys that a task holds at a time.
BLOCK_KEYS, AT_A_TIME = 400_000, 3_000_000


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids in order, and of each of their keys: which id has it, its code and its worth."""
    table = table.sort_by("id").combine_chunks()
    lists = table.column("codes").combine_chunks()
    ids = table.column("id").to_numpy()
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    codes = lists.flatten().to_numpy()
    worth = table.column("worth").combine_chunks().flatten().to_numpy()
    return ids, np.repeat(np.arange(len(ids)), sizes), codes, worth


def _first(hits: np.ndarray, at: np.ndarray, sources: int, k: int) -> np.ndarray:
    """Of the hits of each source, whether they are among its ``k`` largest, or as many as the last of those."""
    most = int(hits.max())
    bits = most.bit_length()
    ordered = np.sort(at << bits | most - hits)
    starts = np.searchsorted(at, np.arange(sources + 1))
    last = np.minimum(starts[:-1] + k, starts[1:]) - 1
    return hits >= most - (ordered[last[at]] & (1 << bits) - 1)


def _summed(at: np.ndarray, to: np.ndarray, worth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of worth for each pair of ``at`` and ``to`` (below n), in order."""
    pair = at * n + to
    bits = int(worth.max()).bit_length()
    if int(pair.max()).bit_length() + bits < 63:  # one sort of numbers that hold both
        both = np.sort(pair << bits | worth)
        pair, worth = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(pair, kind="stable")
        pair, worth = pair[order], worth[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[starts] // n, pair[starts] % n, np.add.reduceat(worth, starts)


def _found(k: int):
    """Of two blocks: source_id, dest_id, hits of each source's ``k`` best and the ties of the last, without those that ``k`` records lie before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, at, codes, worth = _flat(left)
            dest_ids, to, dest_codes, dest_worth = _flat(right)
            of = np.minimum(right.sort_by("id").column("of").to_numpy(), k)
            order = np.argsort(dest_codes, kind="stable")
            to, dest_codes, dest_worth = to[order], dest_codes[order], dest_worth[order]
            begin = np.searchsorted(dest_codes, codes)
            many = np.searchsorted(dest_codes, codes, "right") - begin
            upto = np.cumsum(many)
            each = np.append(np.searchsorted(at, np.arange(len(ids))), len(at))  # where the keys of each source begin
            lo = 0
            while lo < len(ids):
                done = upto[each[lo] - 1] if each[lo] else 0
                hi = len(ids) if not len(at) or upto[-1] - done <= AT_A_TIME else max(lo + 1, int(at[np.searchsorted(upto, done + AT_A_TIME)]))
                own = slice(each[lo], each[hi])
                n = many[own]
                if total := int(n.sum()):
                    place = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(total)
                    s, d, hits = _summed(np.repeat(at[own] - lo, n), to[place], np.repeat(worth[own], n) * dest_worth[place], len(dest_ids))
                    kept = _first(hits, s, hi - lo, k)
                    s, d, hits = s[kept], d[kept], hits[kept]
                    order = np.lexsort((-hits, s))
                    s, d, hits = s[order], d[order], hits[order]
                    fresh = np.append(True, s[1:] != s[:-1])
                    level = np.flatnonzero(fresh | np.append(True, hits[1:] != hits[:-1]))  # where other hits begin
                    before = np.cumsum(of[d]) - of[d]
                    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                    begun = level[np.searchsorted(level, np.arange(len(s)), "right") - 1]
                    kept = before[begun] - before[first] < k
                    out.append((ids[s[kept] + lo], dest_ids[d[kept]], hits[kept]))
                lo = hi
        columns = [np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("source_id", "dest_id", "hits"), columns, strict=True)))

    def freed(left: pa.Table, right: pa.Table) -> pa.Table:
        found = run(left, right)
        vacate()
        return found

    return freed


def coded(usable: DataFrame) -> DataFrame:
    """kind, key, code: a number for each key, another one for each."""
    for salt in range(8):
        out = usable.withColumn("code", F.xxhash64(F.lit(salt), "kind", "key"))
        if out.groupBy("code").count().filter("count > 1").isEmpty():
            return out
    raise ValueError("keys share numbers")


def best_names(sources: DataFrame, destinations: DataFrame, k: int, limit: int | None, romanized: bool = True) -> DataFrame:
    """source_name, dest_name, hits: of distinct names (``forms``), for each the ``k`` with the most hits, of equal ones the first.

    Those that can't have one of the ``k`` best records are left out. Blocks of sources meet blocks of
    destinations, so that a task's work is bounded, however often a key occurs.
    """
    left, right = keys_of_forms(sources, romanized), keys_of_forms(destinations, romanized).persist(StorageLevel.MEMORY_AND_DISK)
    usable = key_frequencies(right)
    if limit is not None:  # the keys beyond it are few and have most rows, which no shuffle needs to see
        usable = usable.persist(StorageLevel.MEMORY_AND_DISK)
        common = F.broadcast(usable.filter(F.col("freq") > limit).select("kind", "key"))
        left, right = (x.join(common, ["kind", "key"], "left_anti") for x in (left, right))
        usable = usable.filter(F.col("freq") <= limit)
    usable = coded(usable.select("kind", "key").persist(StorageLevel.MEMORY_AND_DISK))
    worth = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")].cast("long")

    def rows(of: DataFrame, value: Column) -> DataFrame:
        carried = [c for c in ("of",) if c in of.columns]
        each = of.join(usable, ["kind", "key"]).groupBy("id", *carried).agg(F.collect_list(F.struct("code", value.alias("worth"))).alias("x"))
        return each.select("id", *carried, F.col("x.code").alias("codes"), F.col("x.worth").alias("worth")).persist(StorageLevel.MEMORY_AND_DISK)

    left, right = rows(left.drop("of"), worth * F.col("tf")), rows(right, F.col("tf").cast("long"))
    many = [df.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] // BLOCK_KEYS + 1 for df in (left, right)]
    many[0] = max(many[0], 16 // many[1])  # work for some tasks
    dealt = lambda df, mine, other, a, b: df.withColumns({a: F.pmod(F.xxhash64("id"), F.lit(mine)), b: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))})
    left, right = dealt(left, many[0], many[1], "s", "d"), dealt(right, many[1], many[0], "d", "s")
    both = [df.withColumn("block", F.col("s").cast("int") * F.lit(many[1]) + F.col("d").cast("int")).drop("s", "d").groupBy("block") for df in (left, right)]
    found = both[0].cogroup(both[1]).applyInArrow(_found(k), "source_id long, dest_id long, hits long")
    first = Window.partitionBy("source_id").orderBy(F.desc("hits"), "dest_id")
    found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    return found.select(F.col("source_id").alias("source_name"), F.col("dest_id").alias("dest_name"), "hits")


def best_records(names: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """source_name, dest_id, dest_ordinal, hits, place and further columns of ``records`` (dest_name, dest_id, dest_ordinal): the ``k`` best."""
    first = Window.partitionBy("dest_name").orderBy("dest_ordinal")
    heads = records.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k).drop("at")
    order = Window.partitionBy("source_name").orderBy(F.desc("hits"), "dest_ordinal")
    return names.join(heads, "dest_name").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("dest_name")


def best(sources: DataFrame, destinations: DataFrame, k: int, limit: int | None, romanized: bool = True) -> tuple[DataFrame, DataFrame]:
    """source_id, dest_id, dest_ordinal, hits, place: the ``k`` best destinations of every source; and the ids of those sources.

    Keys are joined once for each pair of distinct names. Of a source's best names the first ``k`` by hits,
    then by first record, hold its best records, of which each name has no more than its first ``k``.
    """
    left, right = forms(sources), forms(destinations)
    names = best_names(left, right, k, limit, romanized).persist(StorageLevel.MEMORY_AND_DISK)
    named = lambda rows, of, side: rows.join(of.select(*FIELDS, F.col("id").alias(f"{side}_name")), list(FIELDS)).select(f"{side}_name", F.col("id").alias(f"{side}_id"), F.col("ordinal").alias(f"{side}_ordinal"))
    found = best_records(names, named(destinations, right, "dest"), k)
    records = named(sources, left, "source").select("source_id", "source_name")
    pairs = records.join(found, "source_name").select("source_id", "dest_id", "dest_ordinal", "hits", "place")
    return pairs, records.join(names.select("source_name").distinct(), "source_name", "left_semi").select("source_id")


def of_names(left: DataFrame, right: DataFrame, records: DataFrame, n_destinations: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """What ``candidates`` finds, for each distinct name of the sources once: source_name instead of source_id.

    ``left`` and ``right`` are ``forms``; records: dest_name, dest_id, dest_ordinal and columns that are carried along.
    """
    k = config.max_candidates_per_src
    if n_destinations <= k:
        few = records.drop("dest_name").withColumns({"hits": F.lit(0).cast("long"), "place": F.row_number().over(Window.orderBy("dest_ordinal"))})
        return left.select(F.col("id").alias("source_name")).crossJoin(F.broadcast(few))
    names = best_names(left, right, k, cutoff(n_destinations, config), config.metrics.romanized).persist(StorageLevel.MEMORY_AND_DISK)
    found = best_records(names, records, k)
    cleaned = records.join(right.select(F.col("id").alias("dest_name"), "cleaned"), "dest_name").withColumnsRenamed({"dest_id": "id", "dest_ordinal": "ordinal"})
    carried = [c for c in records.columns if c not in ("dest_name", "dest_id", "dest_ordinal")]
    lost = prefix_fallback(left, cleaned, names.select(F.col("source_name").alias("source_id")), k, carried).withColumnRenamed("source_id", "source_name")
    return found.unionByName(lost)


def prefix_fallback(sources: DataFrame, destinations: DataFrame, found: DataFrame, k: int, carried: list[str] = []) -> DataFrame:
    """For sources without a hit: the first ``k`` destinations whose name begins with the same three characters."""
    prefix = F.substring(F.lower("cleaned"), 1, 3)
    lost = sources.filter(F.octet_length("cleaned") >= 3).join(found.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    lost = lost.select(F.col("id").alias("source_id"), F.substring("cleaned", 1, 3).alias("prefix"))
    first = Window.partitionBy("prefix").orderBy("ordinal")
    heads = destinations.select(F.col("id").alias("dest_id"), "ordinal", prefix.alias("prefix"), *carried).join(lost.select("prefix").distinct(), "prefix", "left_semi")
    heads = heads.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    return lost.join(heads, "prefix").select("source_id", "dest_id", F.col("ordinal").alias("dest_ordinal"), F.lit(0).cast("long").alias("hits"), "place", *carried)


def candidates(sources: DataFrame, destinations: DataFrame, n_destinations: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """source_id, dest_id, dest_ordinal, hits, place: what is scored.

    With no more destinations than a source may have candidates, which bounds them, all are candidates.
    """
    k = config.max_candidates_per_src
    if n_destinations <= k:
        few = destinations.select("id", "ordinal").orderBy("ordinal").limit(k).collect()
        all_of_them = F.array(*(F.struct(F.lit(r["id"]).alias("dest_id"), F.lit(r["ordinal"]).alias("dest_ordinal"), F.lit(0).cast("long").alias("hits"), F.lit(i).alias("place")) for i, r in enumerate(few, 1)))
        return sources.select(F.col("id").alias("source_id"), F.inline(all_of_them))
    found, matched = best(sources, destinations, k, cutoff(n_destinations, config), config.metrics.romanized)
    return found.unionByName(prefix_fallback(sources, destinations, matched, k))
