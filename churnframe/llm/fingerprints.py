"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame
expressions only.

A document's paragraphs are its lines; a line of more than ``LONG`` characters
is cut into pieces where its content says so: after a sentence whose last word
ends in a letter of the first half of the alphabet, about every second one.  So
an edit changes the pieces that it touches, in a text of one line too.  The
paragraphs are hashed to 64-bit digests; the set of them is its content.  A sketch has three equal sub-tables; a digest goes to one cell
of each.  A cell holds how many digests it got, their XOR and the XOR of their
check hashes.  Two sketches of one size subtract cell by cell: what both hold
cancels.  A cell of count +1 or -1 whose check fits its XOR is pure and gives
one digest of the difference; taking it out of its other cells (peeling) frees
more, until all cells are empty.  If cells remain, the sketch was too small.

The fingerprint is the sketch of ``BASE_CELLS`` cells, cell by cell in hex.
Likeness of two documents: 1 - (differing digests) / (digests of both).  The
base sketches are tried first.  Pairs that don't peel retry larger: their
digests are dealt by a hash into parts of about ``PART`` digests, each part
gets sketches of its own (room for all its digests), and parts that still fail
double with other hash functions.  Cost is linear in the number of paragraphs,
also for very long texts, and no row grows beyond a part.

Defined results: NULL text is empty; the empty text has one empty paragraph;
a long line without such a sentence is one paragraph; repeated paragraphs
count once, so likeness 1 means equal sets of them, and equal texts have equal fingerprints; rows with equal id and text are one
document for "next" (each gets the same answer), equal ids with different
texts follow each other by the text's hash, NULL ids come last; a single
document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnframe.llm import common as C

LONG = 400  # characters of a line that is not cut
CUT = r"(?<=[a-mA-M][.!?])\s+"
BASE_CELLS = 18
PART = 12
ROUNDS = 12  # peeling rounds; each takes out every pure cell
TRIES = 6  # sizes tried for a part


# -------------------------------------------------------------- sketch algebra


def digests(text: Column) -> Column:
    """The set of paragraph digests."""
    pieces = lambda line: F.when(F.char_length(line) > LONG, F.split(line, CUT, -1)).otherwise(F.array(line))
    paragraphs = F.flatten(F.transform(F.split(text, "\n", -1), pieces))
    return F.array_distinct(F.transform(paragraphs, lambda paragraph: F.xxhash64(paragraph)))


def _check(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(1000 + seed))


def _places(keys: Column, cells: Column, seed: int) -> Column:
    """Each digest with its check hash and its three cells."""
    third = F.floor(cells / 3).cast("int")

    def one(key: Column) -> Column:
        cell = lambda j: (F.pmod(F.xxhash64(key, F.lit(10 * seed + j)), third) + third * j).cast("int")
        return F.struct(
            key.alias("k"), _check(key, seed).alias("c"), cell(0).alias("a"), cell(1).alias("b"), cell(2).alias("d")
        )

    return F.transform(keys, one)


def _xor(items: Column, name: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda x, p: x.bitwiseXOR(p[name]))


def _indexes(cells: Column) -> Column:
    return F.sequence(F.lit(0), cells - 1)


def _in_cell(p: Column, i: Column) -> Column:
    return (p["a"] == i) | (p["b"] == i) | (p["d"] == i)


def sketch(keys: Column, cells: Column, seed: int = 0) -> Column:
    """array<struct<n, k, c>> of ``cells`` (a multiple of 3)."""

    def build(places: Column) -> Column:
        def cell(i: Column) -> Column:
            own = F.filter(places, lambda p: _in_cell(p, i))
            # one pass over the cell's digests
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
            add = lambda s, p: F.struct(
                (s["n"] + 1).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c")
            )
            return F.aggregate(own, zero, add)

        return F.transform(_indexes(cells), cell)

    return _let(_places(keys, cells, seed), build)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")
        ),
    )


def peel(difference: Column, cells: Column, seed: int = 0) -> Column:
    """struct<cells, found>: what is left, and the digests recovered."""
    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(
                F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"], seed))),
                lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")),
            )
        )

        def take(pure: Column) -> Column:
            def places(pure: Column) -> Column:
                signs = F.transform(pure, lambda p: p["n"])
                return F.zip_with(
                    _places(F.transform(pure, lambda p: p["k"]), cells, seed),
                    signs,
                    lambda p, n: F.struct(p["k"].alias("k"), p["c"].alias("c"), p["a"].alias("a"), p["b"].alias("b"), p["d"].alias("d"), n.alias("n")),
                )

            def without(listed: Column) -> Column:
                def cell(c: Column, i: Column) -> Column:
                    out = lambda s, p: F.struct(
                        (s["n"] - p["n"]).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c")
                    )
                    return F.aggregate(F.filter(listed, lambda p: _in_cell(p, i)), c, out)

                return F.struct(
                    F.transform(state["cells"], cell).alias("cells"),
                    F.concat(state["found"], F.transform(pure, lambda p: p["k"])).alias("found"),
                )

            return F.when(F.size(pure) == 0, state).otherwise(_let(places(pure), without))

        return _let(pure, take)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def emptied(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))


def as_text(cells: Column) -> Column:
    """The sketch as a string: count, XOR and check of every cell, in hex."""
    return F.concat_ws("", F.transform(cells, lambda c: F.concat_ws("", F.hex(c["n"].cast("long")), F.lit(":"), F.hex(c["k"]), F.lit(":"), F.hex(c["c"]), F.lit(";"))))


# ------------------------------------------------------------------ likeness


def differing(parts: DataFrame) -> DataFrame:
    """``parts`` (columns a, b) with ``n``, the number of differing digests, by
    sketches with room for all digests, doubled while they don't peel.  Only a
    part on which every size fails (no case known) is compared directly."""
    out = parts.withColumn("n", F.lit(None).cast("int"))
    for seed in range(1, TRIES + 1):
        # the size is a column of its own: inside nested lambdas it must not be
        # a lambda variable, whose expressions are not evaluated anew per row
        cells = (3 * F.ceil((F.size("a") + F.size("b")) * (0.3 * 2**seed) + 2)).cast("int")
        out = out.withColumn("cells", cells)
        made = lambda column: sketch(F.col(column), F.col("cells"), seed)  # noqa: B023, E731
        rest = F.when(F.col("n").isNull(), peel(subtract(made("a"), made("b")), F.col("cells"), seed))
        out = out.withColumn("rest", rest)
        peeled = F.when(emptied(F.col("rest.cells")), F.size("rest.found"))
        out = out.withColumn("n", F.coalesce("n", peeled)).drop("rest", "cells")
    direct = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    return out.withColumn("n", F.coalesce("n", direct))


def differing_in_parts(pairs: DataFrame) -> DataFrame:
    """``pairs``: pair, a, b (digest sets).  Result: pair, n."""
    signed = lambda column, sign: F.transform(column, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))
    parts = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / PART)).cast("int")
    one = pairs.select("pair", parts.alias("parts"), F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("d"))
    part = F.pmod(F.xxhash64(F.col("d.k"), F.lit(77)), F.col("parts")).alias("part")
    only = lambda sign: F.collect_list(F.when(F.col("d.s") == sign, F.col("d.k")))
    dealt = one.groupBy("pair", part).agg(only(1).alias("a"), only(-1).alias("b"))
    dealt = differing(dealt)
    return dealt.groupBy("pair").agg(F.sum("n").alias("n"))


def base_differing(a: Column, b: Column) -> Column:
    """Number of differing digests by the base sketches; NULL if they fail."""
    size = F.lit(BASE_CELLS)
    rest = peel(subtract(sketch(a, size), sketch(b, size)), size)
    return _let(rest, lambda r: F.when(emptied(r["cells"]), F.size(r["found"])))


# ------------------------------------------------------------- next documents


def next_documents(keys: DataFrame) -> DataFrame:
    """``keys``: doc_id, text_hash (distinct) and more.  Adds ``next_id`` and
    ``next_hash``: the following document by descending doc_id, the last one
    followed by the first.  Rows are ordered by ranges; only one row per range
    (the number of shuffle partitions) is windowed as a whole."""
    spark = keys.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = C.materialise(placed.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    key = F.struct("doc_id", "text_hash")
    follows = F.lead(key).over(Window.partitionBy("part").orderBy("place"))
    heads = placed.groupBy("part").agg(F.min_by(key, "place").alias("head"))
    whole = Window.orderBy("part")
    first = F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(whole), first).alias("after"))
    # one row per range: a bounded broadcast
    joined = placed.withColumn("follows", follows).join(F.broadcast(heads), "part")
    follows = F.coalesce("follows", "after")
    return joined.select(
        *keys.columns, follows["doc_id"].alias("next_id"), follows["text_hash"].alias("next_hash")
    )


# ------------------------------------------------------------------- operator


def _id_key(column: Column) -> Column:
    """An id as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("#"), column.cast("string")), F.lit(""))


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the edited text's SHA-256), the sketches of
    text and edited text (array of cells), near_edited and near_next."""
    C.ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(C.quoted(text_col)).cast("string"), F.lit(""))
    texts = docs.select(F.col(C.quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    n_chars = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keys = texts.groupBy("doc_id", "text_hash").agg(F.first(n_chars).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    before = next_documents(keys)

    # whole texts are shuffled once, by their own key, repeated rows merged
    # before: what a document lends to the one before it is cut there, and what
    # it keeps waits there (both uses read the same three columns, so Spark
    # runs that shuffle once)
    dealt = texts.select(_id_key(F.col("doc_id")).alias("key"), "text_hash", "text")
    dealt = dealt.groupBy("key", "text_hash").agg(F.first("text").alias("text"))
    before = before.select(
        "doc_id",
        "copies",
        _id_key(F.col("doc_id")).alias("to_key"),
        F.col("text_hash").alias("to_hash"),
        half.alias("lend"),
        _id_key(F.col("next_id")).alias("key"),
        F.col("next_hash").alias("text_hash"),
    )
    lent = dealt.join(before, ["key", "text_hash"]).select(
        F.col("to_key").alias("key"),
        F.col("to_hash").alias("text_hash"),
        "doc_id",
        "copies",
        F.substring("text", F.lit(1), F.col("lend")).alias("lent"),
        digests(F.col("text")).alias("next"),
    )
    both = dealt.join(lent, ["key", "text_hash"]).withColumn("n_chars", n_chars)
    stays = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    both = both.select(
        "doc_id", "copies", "n_chars", F.concat(stays, "lent").alias("edited"), digests(F.col("text")).alias("own"), "next"
    )
    rows = both.select(
        F.monotonically_increasing_id().alias("place"),
        "doc_id",
        "copies",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        digests(F.col("edited")).alias("edited"),
        "next",
    )
    rows = C.materialise(rows)
    rows = C.materialise(
        rows.withColumn("n_edited", base_differing(F.col("own"), F.col("edited")).cast("long")).withColumn(
            "n_next", base_differing(F.col("own"), F.col("next")).cast("long")
        )
    )

    pair = lambda kind, other: rows.where(f"n_{kind} IS NULL").select(
        F.struct("place", F.lit(kind).alias("kind")).alias("pair"), F.col("own").alias("a"), F.col(other).alias("b")
    )
    retried = differing_in_parts(pair("edited", "edited").unionByName(pair("next", "next")))
    found = lambda kind: F.max(F.when(F.col("pair.kind") == kind, F.col("n"))).alias(f"more_{kind}")
    retried = retried.groupBy(F.col("pair.place").alias("place")).agg(found("edited"), found("next"))
    rows = rows.join(retried, "place", "left")

    def near(kind: str) -> Column:
        return 1.0 - F.coalesce(f"n_{kind}", f"more_{kind}") / (F.size("own") + F.size(kind))

    # a row for each copy again
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    size = F.lit(BASE_CELLS)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch(F.col("own"), size).alias("sketch"),
        sketch(F.col("edited"), size).alias("edited_sketch"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = compare_versions(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
