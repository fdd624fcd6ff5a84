"""The near-duplicate operator for a similarity of shingle sets: pigeonring filtering of parity fingerprints.

A text's shingles are its runs of five lower-cased words, as 64-bit hashes in a set. Two sets link at a
Jaccard similarity of 4/5 or more, that is if they differ in a ninth of both sizes at most. The 64 bits of
``simhash`` have no distance that such pairs keep to, so the fingerprint here is one that has: bit ``b`` is
the parity of the shingles whose hash ends in ``b``. Each shingle that only one set has flips one bit, so
fingerprints differ in no more bits than their sets in shingles; sets of other sizes are compared on the
shorter ring, as halves of a fingerprint fold by exclusive or.

Candidates come from prefixes: with one order of shingles for all texts, linked sets of n and m shingles
have one in common among the first n - ceil(4n/5) + 1 of the one and so for the other. Candidates must pass
the ring: from some segment of 64 bits on, chains of 1 to 4 consecutive segments differ in no more than
their share of the budget; then the full Hamming check; what is left is judged by its sets. No step loses a
linked pair. The order puts shingles last that a sample shows to be frequent; it decides the cost alone.

A key's smallest set is judged against all others first; what that connects needs no more pairs, so of a
large group of copies only those in other components are paired. Where more than ``FEW`` sets share a key and
are not all connected, they are not paired either: chunks of them return spanning forests of their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, pick, place, positions, sized_parts, small_batches, stash, vacate
from .simhash import SEED, components

SHINGLE = 5
#: Sets of a key up to which those of different components are paired; sets and shingles of a chunk beyond that.
FEW, CHUNK, CHUNK_SHINGLES = 512, 1024, 1 << 17
#: Consecutive segments of 64 bits that the ring looks at before the full check.
CHAIN = 4
#: Frequent shingles: SEEN or more of a sample of one text in SAMPLE, the first FREQUENT by count.
SAMPLE, SEEN, FREQUENT = 16, 5, 1 << 20
#: Ids up to which only their texts are cut into shingles again to be judged; beyond, all texts are and a join picks.
PICKED = 1 << 20

_STEP = 1 << 17
_SLICE = 1 << 21


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than five form one, no words none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    digest, space = xxhash.xxh64_digest, b" ".join
    width = min(SHINGLE, len(words))
    out = []
    for a in range(0, len(words) - width + 1, _STEP):
        part = words[a : a + _STEP + width - 1]
        hashes = b"".join([digest(space(s), SEED) for s in zip(*(part[k:] for k in range(width)), strict=False)])
        out.append(np.frombuffer(hashes, ">i8").astype(np.int64))
    return np.unique(np.concatenate(out))


def ring(hashes: np.ndarray) -> np.ndarray:
    """The parity fingerprint of a set as 64-bit segments: as many bits as it has shingles, to the next power of two."""
    bits = max(64, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = (np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary())


def _sets(wanted):
    """Digest and set of the texts whose id's hash, the second column, is wanted; of all texts if ``wanted`` has no value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for part, texts in sized_parts(batches, 0, _SLICE):
            if wanted.value is not None:
                hashes = part.column(1).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted.value, hashes), max(len(wanted.value) - 1, 0))
                texts = [t for t, hit in zip(texts, wanted.value[at] == hashes if len(wanted.value) else [False] * len(texts), strict=True) if hit]
            sets = [shingles(t) for t in texts]
            if sets:
                yield pa.RecordBatch.from_arrays([_digests(sets), _lists(sets)], ["digest", "shingles"])

    return run


def _prefixes(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        last = frequent.value
        for part, texts in sized_parts(batches, 0, _SLICE):
            sets = [shingles(t) for t in texts]
            first = []
            for s in sets:
                keep = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                at = np.minimum(np.searchsorted(last, s), max(len(last) - 1, 0))
                late = last[at] == s if len(last) else np.zeros(len(s), bool)
                first.append(np.concatenate((s[~late], s[late]))[:keep])
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1), _digests(sets), n, _lists(first), _lists([ring(s) for s in sets])], ["doc_id", "digest", "n", "prefix", "ring"])

    return run


def _folded(segments: Column, n: Column) -> Column:
    """A fingerprint of ``n`` segments or twice as many on a ring of ``n``."""
    halves = F.zip_with(F.slice(segments, F.lit(1), n), F.slice(segments, n + 1, n), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(segments) > n, halves).otherwise(segments)


def in_ring(a: Column, b: Column, budget: Column) -> Column:
    """Whether two fingerprints may belong to sets that differ in ``budget`` shingles at most: chains first, then all bits."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(_folded(a, n), _folded(b, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x)

    def passes(d: Column) -> Column:
        m = F.size(d)
        twice = F.concat(d, d)
        chain = lambda i: F.forall(F.sequence(F.lit(1), F.least(m, F.lit(CHAIN))), lambda k: total(F.slice(twice, i, k)) * m <= budget * k)
        return F.exists(F.sequence(F.lit(1), m), chain) & (total(d) <= budget)

    return F.get(F.transform(F.array(differ), passes), F.lit(0))


def _id_hash(column: str) -> Column:
    return F.xxhash64(F.lit(5), F.col(column).cast("string"))


def _judged(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of some nodes, from their texts."""
    wanted = stash(sets.join(nodes, "node").select("node", "digest", _id_hash("least").alias("id")), "wanted")
    ids = wanted.select("id").limit(PICKED + 1).toArrow()["id"].to_numpy()
    only = docs.sparkSession.sparkContext.broadcast(np.unique(ids) if len(ids) <= PICKED else None)
    found = docs.select("text", _id_hash("doc_id").alias("id")).mapInArrow(_sets(only), "digest binary, shingles array<long>")
    return stash(found.join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "shingles"), "judged")


def _linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes those with a similarity of 4/5 or more."""
    end = lambda side: sets.select(F.col("node").alias(side), F.col("ring").alias(f"r{side}"), F.col("n").alias(f"n{side}"))
    budget = F.floor((F.col("na") + F.col("nb")) / 9)
    near = pairs.join(end("a"), "a").join(end("b"), "b").filter(in_ring(F.col("ra"), F.col("rb"), budget))
    pairs = stash(near.select("a", "b"), "pairs")
    found = _judged(docs, sets, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    side = lambda end: found.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}"))
    common = F.size(F.array_intersect("sa", "sb"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b")
    return stash(judged.filter(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "linked")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the sets of one or two chunks, from their inverted index."""
    nodes, sets = pdf["node"].to_numpy(), pdf["shingles"].tolist()
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    postings, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(ids))))
    ends = np.cumsum(sizes)
    left = np.ones(len(sets), bool)
    a, b = [], []
    for first in range(len(sets)):
        front = [first] if left[first] else []
        left[first] = False
        while front:
            at = front.pop()
            own = ids[ends[at] - sizes[at] : ends[at]]
            common = np.bincount(np.concatenate([postings[starts[k] : starts[k + 1]] for k in own]), minlength=len(sets))
            near = np.flatnonzero(left & (9 * common >= 4 * (sizes + sizes[at])))
            left[near] = False
            a += [nodes[at]] * len(near)
            b += nodes[near].tolist()
            front += near.tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _forests(docs: DataFrame, sets: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever is linked among nodes that share a crowded key.

    Nodes that crowded keys connect are a cluster. Linked sets differ in size by a quarter at most, so each
    node is compared in its own class of sizes and in the next, which is dealt to chunks of bounded size;
    each pair of chunks returns a spanning forest of its links, so no pairs are written, however large the
    cluster is.
    """
    first = stash(crowded.groupBy("key").agg(F.min("node").alias("a")), "first")
    edges = crowded.join(first, "key").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    clusters = stash(components(stash(edges, "crowded")), "clusters").join(sets.select("node", "n"), "node")
    size = F.floor(F.log(F.col("n")) / math.log(1.25) + 1e-9)
    clusters = stash(clusters.select("root", "node", "n", F.explode(F.array(size, size + 1)).alias("size")), "classes")
    chunks = F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK)).cast("int").alias("chunks")
    sizes = stash(clusters.groupBy("root", "size").agg(chunks, F.count("*").alias("of")).filter("of > 1").drop("of"), "chunks")
    asked = clusters.join(sizes, ["root", "size"])
    dealt = asked.join(_judged(docs, sets, clusters.select("node").distinct()), "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("root", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    return stash(dealt.groupBy("root", "size", "i", "j").applyInPandas(_forest, "a long, b long").distinct(), "forests")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, the smallest id that links lead to, itself included.

    Words lie between ASCII white space. A null text has no words; texts without words are copies of each
    other. component_id is null if there is no id in the component.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, text=text_col, doc_id=id_col)
    kind, context = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sets(context.broadcast(None)), "digest binary, shingles array<long>")
    counted = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)
    frequent = counted.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()["s"].to_numpy()
    last = context.broadcast(np.sort(frequent))
    rows = stash(docs.mapInArrow(_prefixes(last), f"doc_id {kind}, digest binary, n long, prefix array<long>, ring array<long>"), "prefixes")
    sets = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "prefix", "ring")))
    sets = stash(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    every = sets.select("node", "n", F.explode("prefix").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("of"), F.min(F.struct("n", "node")).alias("small")).filter("of > 1").drop("of")
    # written, so that the join has no aggregate in its stage and Spark can split a frequent key; so below
    keyed = stash(every.join(stash(shared, "shared"), "key"), "keyed")
    near = lambda m, n: 5 * F.least(m, n) >= 4 * F.greatest(m, n)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = keyed.filter((F.col("small.node") != F.col("node")) & near(F.col("small.n"), F.col("n")))
    stars = stash(stars.select(*pair("small.node", "node")).distinct(), "stars")
    links = _linked(docs, sets, stars)

    roots = stash(components(links), "roots")
    keyed = keyed.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", F.xxhash64("node")))
    keyed = stash(keyed, "rooted")
    most = keyed.groupBy("key", "root").agg(F.count("*").alias("of")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("of").alias("nodes"), F.max_by("root", "of").alias("major"))
    keyed = stash(keyed.join(stash(most.filter("roots > 1").drop("roots"), "most"), "key"), "apart")
    crowded = keyed.filter(F.col("nodes") > FEW).select("key", "node")
    keyed = keyed.filter(F.col("nodes") <= FEW)
    one = keyed.filter("root <> major").select("key", "node", "n", "root")
    two = keyed.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    rest = one.join(two, "key").filter((F.col("root") != F.col("root2")) & near(F.col("n"), F.col("n2"))).select(*pair("node", "node2")).distinct()
    links = links.unionByName(_linked(docs, sets, rest.join(stars, ["a", "b"], "left_anti")))
    if not crowded.isEmpty():
        links = links.unionByName(_forests(docs, sets, crowded))

    roots = stash(components(links), "roots")
    rooted = sets.select("digest", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", F.xxhash64("node")))
    rooted = stash(rooted.drop("node"), "rooted")
    least = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = stash(rooted.join(least, "root").select("digest", "component_id"), "found")
    return rows.select("doc_id", "digest").join(found, "digest").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns. A null id stays."""
    near = similar_texts(docs, id_col, text_col)
    gone = stash(near.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    key = F.col(f"_{place(docs, id_col)}")
    return positions(docs).join(gone, key == F.col("gone"), "left_anti").toDF(*docs.columns)
