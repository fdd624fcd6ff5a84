"""Exact duplicate removal by deterministic block naming.

A normalised text is cut into fixed-size blocks of bytes. The distinct blocks are sorted and numbered, so
each has an integer name that no other content shares; adjacent names are then paired and the distinct
pairs named in the same way, until each document is one name. Two texts are equal exactly when level and
name are: the names stand for contents, not for hashes of them.

Only rows that can have a copy are named. A hash of length and block hashes, gathered in narrow rows,
settles every row whose hash nobody shares; that leaves the texts of true copies (and of the odd
collision, which naming then tells apart).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pick, place, positions, stash

BLOCK_BYTES = 16384


def _prepared(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, bytes (the normalised text), n_blocks, key (hash of length and block hashes)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = docs.select("doc_id", text.cast("binary").alias("bytes"))
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int"))
    hashes = F.expr(f"transform(sequence(0, n_blocks - 1), i -> xxhash64(substring(bytes, i * {block} + 1, {block})))")
    return rows.withColumn("key", F.xxhash64(F.octet_length("bytes"), hashes))


def _named(items: DataFrame) -> DataFrame:
    """The distinct rows of ``items`` with an integer name each, in sorted order within hash partitions."""
    distinct = items.distinct().sortWithinPartitions(*items.columns)
    return stash(distinct.withColumn("name", F.monotonically_increasing_id()), "names")


def _gathered(rows: DataFrame) -> DataFrame:
    """doc_id, sha, names: each row's names in the order of their positions. Repeated rows count once."""
    names = F.array_sort(F.collect_set(F.struct("pos", "name")))
    return stash(rows.groupBy("doc_id", "sha").agg(F.transform(names, lambda x: x["name"]).alias("names")), "level")


def name_texts(texts: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, sha, level, name for rows (doc_id, sha, bytes, n_blocks); equal bytes have equal level and name."""
    cut = F.expr(f"transform(sequence(0, n_blocks - 1), i -> substring(bytes, i * {block} + 1, {block}))")
    blocks = texts.select("doc_id", "sha", F.posexplode(cut).alias("pos", "block"))
    names = _named(blocks.select("block"))
    rows = _gathered(blocks.join(names, "block").select("doc_id", "sha", "pos", "name"))
    level, done = 0, None
    while True:
        single = rows.filter(F.size("names") == 1).select("doc_id", "sha", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        done = single if done is None else done.unionByName(single)
        rest = rows.filter(F.size("names") > 1)
        if rest.isEmpty():
            return done
        pair = F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] AS a, coalesce(get(names, 2 * i + 1), -1L) AS b))")
        pairs = rest.select("doc_id", "sha", F.posexplode(pair).alias("pos", "pair")).select("doc_id", "sha", "pos", "pair.a", "pair.b")
        names = _named(pairs.select("a", "b"))
        rows = _gathered(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "pos", "name"))
        level += 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space. A null
    text counts as empty. Of equal texts the row with the smallest id stays; a null id comes last. Of rows
    that repeat both id and text exactly one is kept. An empty table gives an empty result; columns other
    than the two named are ignored, whatever they are called.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    sha = F.sha2("bytes", 256).alias("sha")
    rows = stash(_prepared(docs, block).select("doc_id", sha, "key", F.monotonically_increasing_id().alias("row")), "rows")
    shared = stash(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    texts = stash(_prepared(docs, block).join(shared, "key", "left_semi").select("doc_id", sha, "bytes", "n_blocks"), "texts")
    idents = name_texts(texts, block).select(F.col("doc_id").alias("i_doc"), F.col("sha").alias("i_sha"), "level", "name")
    marked = rows.join(idents, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("sha") == F.col("i_sha")), "left")
    marked = stash(marked.select("doc_id", "sha", "row", "level", "name"), "marked")
    copies, alone = marked.filter("name IS NOT NULL"), marked.filter("name IS NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    # written, so that the join below has no aggregate in its stage and Spark can split a frequent name
    groups = stash(copies.groupBy("level", "name").agg(first, F.count("*").alias("n")), "groups")
    copies = copies.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return copies.unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Ids are expected to be unique, as a row is found again by its id and text; of rows that repeat both,
    one stays.
    """
    verdict = exact_duplicates(docs, id_col, text_col)
    gone = stash(verdict.filter("NOT kept").select(F.col("doc_id").alias("gone"), F.col("keep_id").alias("stays"), "text_sha256"), "gone")
    same_id = F.col("gone").eqNullSafe(F.col("stays"))
    others = stash(gone.filter(~same_id).select("gone").distinct(), "others")
    twins = stash(gone.filter(same_id).select("gone", "text_sha256").distinct(), "twins")
    rows, names = positions(docs), docs.columns
    key, text = f"_{place(docs, id_col)}", f"_{place(docs, text_col)}"
    kept = rows.join(others, F.col(key).eqNullSafe(F.col("gone")), "left_anti")
    if twins.isEmpty():
        return kept.toDF(*names)
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256)
    same = F.col(key).eqNullSafe(F.col("gone")) & (sha == F.col("text_sha256"))
    one = kept.withColumn("sha", sha).join(twins, F.col(key).eqNullSafe(F.col("gone")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    one = one.dropDuplicates([key, "sha"]).drop("sha")
    return kept.join(twins, same, "left_anti").unionByName(one).toDF(*names)
