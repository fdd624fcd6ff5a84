"""SimHash near-duplicates by pigeonring filtering.

A text's 64-bit fingerprint has a bit where over half of its shingles' hashes have it. Two fingerprints
link at ``DIFFER`` = 3 or fewer differing bits. The bits form a ring of four segments of 16. Of a linked
pair's ring, by the pigeonring principle, some start has chains of 1, 2, 3 and 4 consecutive segments whose
cumulative differences stay within 0, 1, 2 and 3: the proportional budgets. So from that start the first
segment agrees, the second differs in one bit at most and the next two together in two; of their four
bytes two agree, in one of five ways. Start, way and those 32 bits are the key of an equi-join. Its pairs
must satisfy the whole chain before the full Hamming check.

Distinct fingerprints are searched, never their copies. Keys that few fingerprints share are paired in a
join. A key that many share is dealt to pairs of chunks, of which each returns a spanning forest of its
links instead of all of them; connectivity, which is what components need, is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, pick, place, positions, slices, small_batches, stash

DIFFER = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a key up to which they are paired in a join, and of a chunk beyond that.
FEW, CHUNK = 64, 256
#: Bytes of the second and third segment of a chain that agree: positions 0-1 are the second's, 2-3 the third's.
WAYS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))

_STEP = 1 << 17


def fingerprint(text: bytes, width: int = SHINGLE) -> bytes:
    """The 8 bytes of a text's fingerprint, most significant first; zero for a text without words."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(8)
    if len(words) < width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest, space = xxhash.xxh64_digest, b" ".join
    ones, total = np.zeros(64, np.int64), len(words) - width + 1
    for a in range(0, total, _STEP):
        part = words[a : a + _STEP + width - 1]
        hashes = b"".join([digest(space(s), SEED) for s in zip(*(part[k:] for k in range(width)), strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        for b in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
            ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > total).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
        out = []
        for a, b in slices(sizes, 1 << 22):
            out += [fingerprint(t or b"") for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
        values = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits) per row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def _byte(fp: Column, start: int, k: int) -> Column:
    """Byte ``k`` of the two segments after ``start``."""
    return F.shiftrightunsigned(_segment(fp, start + 1 + k // 2), 8 - 8 * (k % 2)).bitwiseAND(F.lit(0xFF))


def keys(fp: Column) -> Column:
    """The join keys of a fingerprint: start and way, the first segment, the bytes that agree."""
    out = []
    for start in range(4):
        for way, (j, k) in enumerate(WAYS):
            tag = F.lit((start * len(WAYS) + way) << 32)
            out.append(tag + F.shiftleft(_segment(fp, start), 16) + F.shiftleft(_byte(fp, start, j), 8) + _byte(fp, start, k))
    return F.array(*out)


def in_ring(a: Column, b: Column) -> Column:
    """Whether some start of the ring has chains of 1 to 4 segments within their budgets."""
    diff = [F.bit_count(_segment(a.bitwiseXOR(b), i)) for i in range(4)]
    starts = []
    for i in range(4):
        chain, ok = diff[i], diff[i] == 0
        for length in range(2, 5):
            chain = chain + diff[(i + length - 1) % 4]
            ok = ok & (chain <= length * DIFFER // 4)
        starts.append(ok)
    return starts[0] | starts[1] | starts[2] | starts[3]


def _passes(differ: np.ndarray) -> np.ndarray:
    """Whether differences of fingerprints pass the ring, as ``in_ring`` has it, and then the full Hamming check."""
    segments = np.bitwise_count(differ.view(np.uint16).reshape(-1, 4)).astype(np.int8)
    # by the principle every pair within the distance has such a start in either direction of the ring, so the bytes' order in memory is no matter
    ok = np.zeros(len(differ), bool)
    for start in range(4):
        chain, passes = np.zeros(len(differ), np.int8), np.ones(len(differ), bool)
        for length in range(1, 5):
            chain += segments[:, (start + length - 1) % 4]
            passes &= chain <= length * DIFFER // 4
        ok |= passes
    ok[ok] = np.bitwise_count(differ[ok]) <= DIFFER
    return ok


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the fingerprints of one or two chunks."""
    fps = np.unique(pdf["fp"].to_numpy())
    left = np.ones(len(fps), bool)
    a, b = [], []
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            at = front.pop()
            near = np.flatnonzero(left)
            near = near[_passes((fps[near] ^ fps[at]).view(np.uint64))]
            left[near] = False
            a += [fps[at]] * len(near)
            b += fps[near].tolist()
            front += near.tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that connect whatever is connected."""
    keyed = fps.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    # written, so that the join has no aggregate in its stage and Spark can split a frequent key; so below
    shared = stash(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    crowded = stash(keyed.join(shared, "key"), "crowded")
    few = crowded.filter(F.col("n") <= FEW).select("key", "fp")
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    ca, cb = F.col("a"), F.col("b")
    close = (ca < cb) & in_ring(ca, cb) & (F.bit_count(ca.bitwiseXOR(cb)) <= DIFFER)
    pairs = a.join(b, "key").filter(close).select("a", "b").distinct()
    many = crowded.filter(F.col("n") > FEW).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = many.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    forest = many.groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long")
    return stash(pairs.unionByName(forest).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of the links (a, b): equal roots within a connected component.

    Each round every node joins its smallest neighbour, and the links are those between what has become of
    their ends. Nodes are numbered by a hash without collisions, so a round removes a share of them
    whatever the shape. Rounds cut their lineage; nothing comes to the driver but whether links are left.
    """
    edges = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("va"), F.col("b").alias("vb"))
    names = edges.select(F.col("va").alias("node"), F.col("a").alias("at")).unionByName(edges.select(F.col("vb").alias("node"), F.col("b").alias("at")))
    roots = stash(names.distinct(), "roots")
    edges = stash(edges.select("a", "b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stash(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("b")).select("at", F.least("at", "b").alias("to")), "step")
        roots = stash(roots.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at")), "roots")
        to = lambda end: step.select(F.col("at").alias(end), F.col("to").alias(f"{end}_to"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = stash(edges.filter("a <> b").distinct(), "edges")
    return roots.select("node", F.col("at").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Text: lower-case A-Z, words between ASCII white space, shingles of three words with repeats; fewer
    words form one shingle, none the fingerprint zero, which links like any other. A null text has no
    words. component_id is the smallest id that links lead to, itself included; null if there is no id in
    the component. Rows that repeat an id take part as documents of their own.
    """
    rows = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp")))
    rooted = stash(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"), "rooted")
    linked, alone = rooted.filter("root IS NOT NULL"), rooted.filter("root IS NULL")
    least = stash(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = linked.join(least, "root").select("fp", "component_id").unionByName(alone.select("fp", F.col("least").alias("component_id")))
    return rows.join(stash(found, "found"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns. A null id stays."""
    near = near_duplicates(docs, id_col, text_col)
    gone = stash(near.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    key = F.col(f"_{place(docs, id_col)}")
    return positions(docs).join(gone, key == F.col("gone"), "left_anti").toDF(*docs.columns)
