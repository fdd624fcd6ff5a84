"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions only.

A section ends with a blank line, a paragraph with a line end, a piece with a sentence or after 240 bytes.
A piece's digest is the SHA-256 of its bytes, a paragraph's that of its pieces' digests, a section's that of
its paragraphs' digests, the root's that of its sections' digests; splitting loses no character and every
digest covers whole digests, so roots are equal exactly when texts are.

A fingerprint is the root and a sketch of the tree's leaves: a code for each distinct leaf (32 bits from
its digest and 8 bits for its length) with the number of leaves that have it, the ``SKETCH`` smallest codes
at most. Likeness is the share of bytes in common leaves (twice the common over the sum of both), each
common as often as both texts have it: over all leaves where both sketches are whole, else over the codes up
to the smaller end of both sketches, which are a sample by hash of both trees' leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, stash

PIECE_BYTES = 240
#: Distinct leaves in a fingerprint at most, so that its length is bounded whatever the text's is.
SKETCH = 256


def tree(text: Column) -> Column:
    """The leaves by section and paragraph: digest and number of bytes of each."""

    def leaves(paragraph: Column) -> Column:
        return F.flatten(F.transform(F.split(paragraph, r"(?<=[.!?;|] )"), cut))

    def cut(sentence: Column) -> Column:
        raw = sentence.cast("binary")
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / PIECE_BYTES)).cast("int"))
        piece = lambda i: F.substring(raw, i * PIECE_BYTES + 1, F.lit(PIECE_BYTES))
        return F.transform(at, lambda i: F.struct(F.sha2(piece(i), 256).alias("digest"), F.octet_length(piece(i)).alias("n")))

    parts = F.split(text, r"(?<=\n\n)(?=[^\n])")
    return F.transform(parts, lambda s: F.transform(F.split(s, r"(?<=\n)"), leaves))


def sections(leaves: Column) -> Column:
    """Of a tree: its sections, each an array of its paragraphs' digests."""
    return F.transform(leaves, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(F.transform(p, lambda x: x["digest"]), ""), 256)))


def root(section_array: Column) -> Column:
    """Digest at the top of the tree."""
    digests = F.transform(section_array, lambda s: F.sha2(F.array_join(s, ""), 256))
    return F.sha2(F.array_join(digests, ""), 256)


def sketch(leaves: Column) -> Column:
    """Of a tree: codes of distinct leaves in ascending order with their numbers, ``SKETCH`` at most, and whether that is all."""
    codes = F.transform(F.flatten(F.flatten(leaves)), lambda x: F.shiftleft(F.xxhash64(x["digest"]).bitwiseAND(F.lit(0xFFFFFFFF)), 8).bitwiseOR(x["n"].cast("long")))

    def counted(c: Column) -> Column:
        # where each run of equal codes starts
        starts = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))
        return _bound(starts, lambda at: numbered(c, at))

    def numbered(c: Column, starts: Column) -> Column:
        entry = lambda at, j: F.struct(F.get(c, at).alias("code"), (F.coalesce(F.get(starts, j + 1), F.size(c)) - at).alias("of"))
        return F.struct(F.transform(F.slice(starts, 1, SKETCH), entry).alias("leaves"), (F.size(starts) <= SKETCH).alias("whole"))

    return _bound(F.sort_array(codes), counted)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves of two sketches, by bytes: 1 for equal ones, 0 for none in common; two empty texts are equal."""
    far, zero = F.lit(1 << 62).cast("long"), F.lit(0).cast("long")
    end = lambda s: F.when(s["whole"], far).otherwise(F.element_at(s["leaves"], -1)["code"])
    side = lambda s, n: F.transform(s["leaves"], lambda x: F.struct(x["code"].alias("code"), F.lit(n).alias("side"), x["of"].alias("of")))
    state = lambda code, of, common, total: F.struct(code.alias("code"), of.alias("of"), common.alias("common"), total.alias("total"))

    def shared(pair: Column) -> Column:
        last = pair["last"]

        def step(s: Column, x: Column) -> Column:
            weight = F.when(x["code"] <= last, x["code"].bitwiseAND(F.lit(255))).otherwise(zero)
            both = F.when((s["code"] == x["code"]) & (x["side"] == 1), F.least(s["of"], x["of"])).otherwise(F.lit(0))
            return state(x["code"], x["of"], s["common"] + both * weight, s["total"] + x["of"] * weight)

        start = state(F.lit(-1).cast("long"), F.lit(0), zero, zero)
        return F.aggregate(pair["both"], start, step, lambda s: F.when(s["total"] == 0, F.lit(1.0)).otherwise(2.0 * s["common"] / s["total"]))

    # by code, a leaf of ``a`` comes right before that of ``b``
    merged = lambda s: F.struct(F.sort_array(F.concat(side(s["a"], 0), side(s["b"], 1))).alias("both"), F.least(end(s["a"]), end(s["b"])).alias("last"))
    return _bound(_bound(F.struct(a.alias("a"), b.alias("b")), merged), shared)


def fingerprint(root_digest: Column, leaf_sketch: Column) -> Column:
    """The root and the sketch as one string: hexadecimal codes, with their numbers where these are not 1."""
    entry = lambda x: F.concat(F.hex(x["code"]), F.when(x["of"] > 1, F.concat(F.lit("x"), x["of"].cast("string"))).otherwise(F.lit("")))
    rest = F.when(leaf_sketch["whole"], F.lit("")).otherwise(F.lit("+"))
    return F.concat(root_digest, F.lit(":"), F.array_join(F.transform(leaf_sketch["leaves"], entry), "."), rest)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Where two section arrays differ: (section, paragraph) numbers from 0 of ``a`` whose branch is not the same in ``b``.

    Equal sections are skipped as a whole, as their digests agree.
    """

    def of_section(s: Column, i: Column) -> Column:
        other = F.coalesce(F.get(b, i), F.array().cast("array<string>"))
        odd = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ~F.get(s, j).eqNullSafe(F.get(other, j)))
        return F.when(s == other, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(odd, lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))

    return F.flatten(F.transform(a, of_section))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sections, sketch, root, fingerprint per row of ``docs``. A null text counts as empty; rows stay as they are."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    out = docs.select("doc_id", tree(F.coalesce("text", F.lit(""))).alias("tree"))
    out = out.select("doc_id", sections(F.col("tree")).alias("sections"), sketch(F.col("tree")).alias("sketch"))
    out = out.withColumn("root", root(F.col("sections")))
    return out.withColumn("fingerprint", fingerprint(F.col("root"), F.col("sketch")))


def _next_ids(docs: DataFrame) -> DataFrame:
    """prev_id, doc_id, half: for each id the id before it (for the first: the last) and half that one's characters.

    Ids are dealt to ranges and written with their range's number; each range finds its neighbours by
    itself and the ends are joined through one row a range.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    ids = stash(ids.repartitionByRange(F.col("doc_id").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ids")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    ends = ids.groupBy("range").agg(F.max(order).alias("last"))
    before = F.coalesce(F.lag("last").over(Window.orderBy("range")), F.max("last").over(Window.partitionBy()))
    ends = ends.select("range", before.alias("before"))
    own = F.lag(order).over(Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_last()))
    found = ids.withColumn("own", own).join(ends, "range")
    prev = F.coalesce("own", "before")
    return stash(found.select(prev["doc_id"].alias("prev_id"), "doc_id", F.floor(prev["n"] / 2).cast("int").alias("half")), "next")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the next document's start takes the place of the second half.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty. A null id comes last, the first document follows the last, and
    a single document follows itself. Rows may repeat an id: the next document is then the one of the next
    larger id with the smallest text.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the id as a text that is never null: both joins read one exchange of (key, text)
    key_of = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    kind = dict(docs.dtypes)["doc_id"]
    after = _next_ids(docs).select(key_of("prev_id").alias("prev_key"), key_of("doc_id").alias("key"), "half")
    docs = docs.select(key_of("doc_id").alias("key"), "text")
    heads = docs
    if docs.groupBy("key").count().filter("count > 1").limit(1).count():
        heads = docs.groupBy("key").agg(F.min("text").alias("text"))
    heads = heads.join(after, "key").select("prev_key", F.expr("substring(text, 1, half)").alias("head"), sketch(tree(F.col("text"))).alias("sketch"))
    # the sketch goes through the shuffle as two plain arrays
    part = lambda field: F.transform("sketch.leaves", lambda x: x[field]).alias(f"next_{field}")
    heads = heads.select(F.col("prev_key").alias("key"), "head", part("code"), part("of"), F.col("sketch.whole").alias("next_whole"))
    both = docs.join(heads, "key")
    leaves = F.zip_with("next_code", "next_of", lambda code, of: F.struct(code.alias("code"), of.alias("of")))
    both = both.withColumn("next_sketch", F.struct(leaves.alias("leaves"), F.col("next_whole").alias("whole")))
    both = both.withColumn("doc_id", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).cast(kind))
    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 2), substring(head, 1, int(char_length(text) div 2)))")
    both = both.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "next_sketch")
    sha = F.sha2("edited", 256).alias("edited_sha256")
    both = both.select("doc_id", "n_chars", sha, tree(F.col("text")).alias("tree"), tree(F.col("edited")).alias("edited_tree"), "next_sketch")
    top = lambda c: root(sections(F.col(c)))
    both = both.select(
        "doc_id", "n_chars", "edited_sha256", "next_sketch", top("tree").alias("root"), top("edited_tree").alias("edited_root"),
        sketch(F.col("tree")).alias("sketch"), sketch(F.col("edited_tree")).alias("edited_sketch"),
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("root"), F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
