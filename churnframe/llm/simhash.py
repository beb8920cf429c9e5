"""SimHash near-duplicates by anchor-point covering.

A document's 4-word shingles (A-Z lower-cased, repeats counted) are hashed
with XXH64; a fingerprint bit is 1 if more than half of the hashes set it.
Fingerprints at 4 or fewer differing bits are linked.

Anchors: the 64 bits are cut into blocks of 22, 21 and 21 bits.  Two linked
fingerprints differ in at most one bit of some block (4 < 2 * 3).  In each
block the anchors are the words of a covering code - the perfect Hamming code
on 15 bits (covering radius 1) times all values of the remaining bits.  Each
fingerprint goes to every anchor within radius + 1 = 2 bits, where it is
``home`` at the one anchor within the radius that corrects it.  A linked pair
therefore meets at both home anchors of that block, and comparing each home
fingerprint with all of its anchor's fingerprints, on all 64 bits, is exact.
About 45 copies per distinct fingerprint, whatever the data.

Skew: equal fingerprints are one row, so copies cost nothing.  Within an
anchor a breadth-first search drops what it has reached, so a tight group is
scanned once and gives one link per member, not all pairs.  An anchor of more
than ``ANCHOR_ROWS`` fingerprints is cut into parts by a hash of the
fingerprint, and each pair of (home part, part) is a tile of its own: no task
holds more than two parts of one anchor, and every home still meets every
fingerprint of its anchor.

Defined results: NULL and word-free texts have fingerprint zero and link like
any other; fewer than four words hash as one sequence; ties (exactly half) give
bit 0; repeated rows share a component; a NULL doc_id takes the component of
its fingerprint and never names one (NULL if there is no other id); extra
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
CODE_BITS = 15
ANCHOR_ROWS = 32_768
RADIUS, BLOCK_BITS = 1, 1  # covering radius; differing bits in the closest block


# ------------------------------------------------------------ fingerprints


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as an unsigned integer."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, size: int, carry: list[str] | None) -> DataFrame:
    """``row``, ``text_hash`` and ``fp`` (the fingerprint's 64 bits as a long)."""

    def make():
        def work(batch):
            prints = [fingerprint(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            return {"fp": np.array(prints, dtype=np.uint64).view(np.int64)}

        return work

    text = C.utf8(text_col)
    df = docs.select(C.packed(docs, carry), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return C.map_batches(df, make, [C.field("fp", "long")], ("text",))


# ------------------------------------------------------------------ anchors


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit value: XOR of the 1-based positions set."""
    out = np.zeros(1 << CODE_BITS, np.int64)
    for bit in range(CODE_BITS):
        out[(np.arange(1 << CODE_BITS) >> bit) & 1 == 1] ^= bit + 1
    return out


def _flips(bits: int, reach: int) -> list[np.ndarray]:
    """Per syndrome, the flips of at most ``reach`` of ``bits`` bits that lead
    to an anchor; the first one leads home."""
    masks = [0]
    for _ in range(reach):
        masks = sorted({*masks, *(m | 1 << b for m in masks for b in range(bits))}, key=lambda m: (m.bit_count(), m))
    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    low = (1 << CODE_BITS) - 1
    syndrome = _syndromes()
    for m in masks:
        out[syndrome[m & low]].append(m)
    # home flips only code bits: the empty flip or the one that corrects
    return [np.array(sorted(x, key=lambda m: (m.bit_count(), m > low, m)), dtype=np.int64) for x in out]


def _anchor_rows(distinct: DataFrame) -> DataFrame:
    """(anchor, fp, home): every fingerprint at every anchor within reach."""
    schema = T.StructType([C.field("anchor", "long"), C.field("fp", "long"), C.field("home", "boolean")])

    def make():
        syndromes = _syndromes()
        flips = [_flips(bits, RADIUS + BLOCK_BITS) for _, bits in BLOCKS]

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    fp = whole.column("fp").slice(at, 4096).to_numpy()
                    for k, (low, bits) in enumerate(BLOCKS):
                        value = ((fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                        found = syndromes[value & ((1 << CODE_BITS) - 1)]
                        for s, masks in enumerate(flips[k]):
                            rows = np.flatnonzero(found == s)
                            if len(rows):
                                anchors = (value[rows, None] ^ masks) | (k << 32)
                                home = np.zeros(anchors.shape, bool)
                                home[:, 0] = True
                                yield {
                                    "anchor": anchors.ravel(),
                                    "fp": np.repeat(fp[rows], len(masks)),
                                    "home": home.ravel(),
                                }

        return run

    return C.emit_rows(distinct, make, schema)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    # unsigned: the bit count of a negative number is that of its absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most


def bucket_links(fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor that connect every home fingerprint with all that
    are within ``most`` bits of it, directly or through other homes."""
    a, b = [], []
    homes = np.flatnonzero(home)
    waiting = np.zeros(len(fp), bool)
    waiting[homes] = True
    others = np.flatnonzero(~home)
    for first in homes:
        if not waiting[first]:
            continue
        waiting[first] = False
        queue, rest, near_homes = [first], others, homes[waiting[homes]]
        while queue:
            u = queue.pop()
            hit = _near(fp[u], fp[near_homes], most)
            reached = near_homes[hit]
            waiting[reached] = False
            near_homes = near_homes[~hit]
            queue.extend(reached.tolist())
            leaf = _near(fp[u], fp[rest], most)
            reached = np.concatenate([reached, rest[leaf]])
            rest = rest[~leaf]
            if len(reached):
                a.append(np.full(len(reached), fp[first]))
                b.append(fp[reached])
    empty = np.zeros(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchors, rows sorted by anchor."""
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), first)
    out_a, out_b = [], []
    # few homes: compare each with the whole anchor, vectorised over anchors
    small = (homes > 0) & (homes <= 3) & (size > 1)
    group = np.repeat(np.arange(len(first)), size)
    h = np.flatnonzero(home & small[group])
    if len(h):
        step = max(1, (1 << 20) // int(size[group[h]].max()))
        for at in range(0, len(h), step):
            own = h[at : at + step]
            n = size[group[own]]
            left = np.repeat(own, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[own]], n)
            hit = _near(fp[left], fp[right], most) & (left != right)
            out_a.append(fp[left[hit]])
            out_b.append(fp[right[hit]])
    for g in np.flatnonzero((homes > 3) & (size > 1)):
        part = slice(first[g], first[g] + size[g])
        a, b = bucket_links(fp[part], home[part], most)
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    return np.concatenate(out_a), np.concatenate(out_b)


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows`` with the rows of a large anchor dealt to its tiles; ``anchor``
    is then a number of the tile, which no other anchor has."""
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ANCHOR_ROWS)
    hot = C.materialise(sizes.select("anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows
    dealt = rows.join(hot, "anchor", "left")
    part = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    none = F.array().cast("array<struct<home_part:int,part:int,home:boolean>>")
    entry = lambda i, j, home: F.struct(i.alias("home_part"), j.alias("part"), F.lit(home).alias("home"))
    as_home = F.when(F.col("home"), F.transform(every, lambda j: entry(part, j, True))).otherwise(none)
    as_other = F.transform(every, lambda i: entry(i, part, False))
    cold = dealt.where("parts IS NULL").select("anchor", "fp", "home")
    tiles = dealt.where("parts IS NOT NULL").select("anchor", "fp", F.explode(F.concat(as_home, as_other)).alias("t"))
    # anchors are below 2^34: the part numbers go above
    number = F.col("anchor") + F.shiftleft((F.col("t.home_part") + 1).cast("long"), 34) + F.shiftleft(F.col("t.part").cast("long"), 49)
    return cold.unionByName(tiles.select(number.alias("anchor"), "fp", "t.home"))


def links(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """u, v: links that connect all fingerprints within ``most`` bits."""
    if most > MAX_BITS:
        raise ValueError(f"the anchors cover at most {MAX_BITS} differing bits")
    rows = _tiled(_anchor_rows(distinct))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "anchor").sortWithinPartitions("anchor")
    schema = T.StructType([C.field("u", "long"), C.field("v", "long")])

    def make():
        def run(batches):
            held: list = []
            for batch in batches:
                cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "fp", "home")]
                last = cols[0][-1] if len(cols[0]) else None
                if last is None:
                    continue
                cut = int(np.searchsorted(cols[0], last))  # the last anchor may go on
                if cut or (held and held[-1][0][0] != last):
                    done = [*held, [c[:cut] for c in cols]]
                    a, b = _links(*(np.concatenate(x) for x in zip(*done)), most)
                    yield {"u": a, "v": b}
                    held = []
                held.append([c[cut:].copy() for c in cols])
            if held:
                a, b = _links(*(np.concatenate(x) for x in zip(*held)), most)
                yield {"u": a, "v": b}

        return run

    return C.emit_rows(rows, make, schema)


# ----------------------------------------------------------------- operator


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, text_hash, fp of every row; fp, root of every fingerprint; and
    of every root its ``component_id`` and ``kept`` (the smallest doc_id with
    its smallest text_hash; NULL if no row has a doc_id)."""
    C.prepare(docs.sparkSession)
    made = fingerprints(docs, text_col, size, [id_col])
    made = C.materialise(made.select(F.col(f"row.{C.quoted(id_col)}").alias("doc_id"), "text_hash", "fp"))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    least = C.materialise(made.groupBy("fp").agg(F.min(row).alias("kept")))
    roots = components(links(least.select("fp"), most))
    # fingerprints without a link are their own root
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "kept", F.coalesce("root", "fp").alias("root"))
    named = C.materialise(named)
    smallest = named.groupBy("root").agg(F.min("kept").alias("kept"))
    smallest = C.materialise(smallest.select("root", "kept", F.col("kept.doc_id").alias("component_id")))
    return made, named.select("fp", "root"), smallest


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    most: int = MAX_BITS,
) -> DataFrame:
    """doc_id, fp (long) and component_id of every row."""
    made, named, smallest = _grouped(docs, id_col, text_col, size, most)
    by_print = C.materialise(named.join(smallest, "root").select("fp", "component_id"))
    return made.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    most: int = MAX_BITS,
) -> DataFrame:
    """Of each component the row with the smallest doc_id (then text hash), one
    row if it is repeated; rows without a doc_id all stay.  Different texts of
    one doc_id are different rows."""
    kept = _grouped(docs, id_col, text_col, size, most)[2].where("kept IS NOT NULL").select("kept.*")
    key = F.col(C.quoted(id_col))
    rows = docs.where(key.isNotNull()).select(
        key.alias("doc_id"), F.xxhash64(C.utf8(text_col)).alias("text_hash"), C.packed(docs)
    )
    # repeated rows go map-side, before the join can gather them
    rows = rows.dropDuplicates(["doc_id", "text_hash"]).join(kept, ["doc_id", "text_hash"], "left_semi")
    return rows.select("row.*").unionByName(docs.where(key.isNull()))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays."""
    return one_of_each(docs)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
