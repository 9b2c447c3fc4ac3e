"""Near-duplicate embeddings by random-hyperplane sign hashing with exact verification.

Vectors are posted in several tables under the signs of their projections on random hyperplanes. A
posting holds the vector's number and a sketch of 128 further signs, not the vector. Within a
table's bucket all sketches are compared; only rows with a partner whose sketch is near enough for
the threshold go on with their vectors, and are then compared exactly, in double precision, as
matrix products; a pair that meets in several tables counts only in the first of them. A bucket of
any size is dealt out as pairs of bounded chunks, so no task holds it whole, and a block emits one
row per vector (its number of links and a spanning link), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from ..plans.graph import connected_components

#: Rows of one chunk of a bucket.
CHUNK = 1024
#: Signs in a sketch.
SKETCH = 128
SEED = 2


def table_count(bits: int, threshold: float, miss: float = 1e-9) -> int:
    """Tables needed so that a pair at the threshold meets in one of them but for a chance of ``miss``."""
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def sketch_reach(threshold: float, miss: float = 1e-12) -> int:
    """Most signs of a sketch in which a pair at the threshold differs, but for a chance of ``miss``."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    tail, k = 1.0, -1
    while tail > miss and k < SKETCH:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, count))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay as they are, and
    squares of very large or small components stay finite."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power)


def signs(vectors: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """((rows, tables) bucket numbers, (rows, 2) sketches) of scaled vectors."""
    above = (vectors @ hyperplanes(vectors.shape[1], tables * bits + SKETCH)) > 0
    sketch = np.packbits(above[:, tables * bits :], axis=1).view(np.int64)
    return above[:, : tables * bits].reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)), sketch


def _signed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """``classes`` with their buckets in all tables (``keys``, packed) and their sketch."""
    label = classes.schema["label"].dataType.simpleString()
    names = ["label", "rep", "copies", "embedding", "keys", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                    vec = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    buckets, sketch = signs(scaled(vec), tables, bits)
                    keys = pa.array([k.astype("<i4").tobytes() for k in buckets], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, keys, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names)

    vector = classes.schema["embedding"].dataType.simpleString()
    return classes.select(*names[:4]).mapInArrow(run, f"label {label}, rep long, copies long, embedding {vector}, keys binary, s1 long, s2 long")


def _postings(signed: DataFrame, tables: int) -> DataFrame:
    """(tab, bucket, rep, s1, s2): each class under its bucket of every table, a hash of (table, label,
    components, signs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, tables)
                rep, s1, s2, group = (np.repeat(b.column(k).to_numpy(), tables) for k in (0, 2, 3, 4))
                tab = np.tile(np.arange(tables, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tab, group, keys.ravel(), rep, s1, s2)], ["tab", "group", "key", "rep", "s1", "s2"])

    group = F.xxhash64(F.size("embedding"), "label")
    each = signed.select("rep", "keys", "s1", "s2", group.alias("group")).mapInArrow(run, "tab int, group long, key int, rep long, s1 long, s2 long")
    return each.select("tab", F.xxhash64("tab", "group", "key").alias("bucket"), "rep", "s1", "s2")


def _blocks(rows: DataFrame, columns: list[str], partitions: int, compare, schema: str) -> DataFrame:
    """``compare`` of the rows (a table of ``columns``) of each ``block``, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                yield from compare(pa.Table.from_batches(held).combine_chunks())
            held.clear()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if key[lo] != last:
                    yield from flush()
                    last = key[lo]
                held.append(b.slice(lo, hi - lo))
        yield from flush()

    return rows.select("block", *columns).repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows to compare with each other: the two sides, or one with itself; None if a side is missing."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if (side == 2).any():  # a chunk with itself
        a = b = np.flatnonzero(side == 2)
    return (a, b) if len(a) and len(b) else None


def _near(postings: DataFrame, reach: int, partitions: int) -> DataFrame:
    """(block, tab, side, rep): postings with a partner in their block whose sketch differs in ``reach``
    signs at most."""
    sized = postings.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK)
    hot = materialize(sized.select("bucket", F.ceil(F.col("rows") / F.lit(CHUNK)).cast("int").alias("chunks")), "hot-buckets")
    dealt = postings.join(hot, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") > F.col("other"), 1).otherwise(0)
    block = F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    dealt = dealt.select(block.alias("block"), (F.col("tab") * 4 + side).alias("place"), "rep", "s1", "s2")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, place = t["rep"].to_numpy(), t["place"].to_numpy()
        s1, s2 = (t[k].to_numpy().view(np.uint64) for k in ("s1", "s2"))
        pair = _sides(place & 3)
        if pair is None:
            return
        a, b = pair
        hit = np.zeros(len(rep), bool)
        step = max(1, (1 << 20) // len(b))
        for lo in range(0, len(a), step):
            x = a[lo : lo + step]
            apart = np.bitwise_count(s1[x][:, None] ^ s1[b]).astype(np.uint8) + np.bitwise_count(s2[x][:, None] ^ s2[b])
            close = (apart <= reach) & (rep[x][:, None] != rep[b])
            hit[x] |= close.any(axis=1)
            hit[b] |= close.any(axis=0)
        if hit.any():
            out = t.filter(pa.array(hit)).select(["block", "place", "rep"])
            yield from out.to_batches()

    return _blocks(dealt, ["place", "rep", "s1", "s2"], partitions, compare, "block long, place int, rep long")


def _links(label: np.ndarray, tab: int, rep: np.ndarray, copies: np.ndarray, keys: np.ndarray, vec: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links found first here between rows ``a`` and ``b``: (number of vectors linked, smallest class each
    row is tied to in this block). Classes are ranked by their rep, so that the smallest one of a group
    is the root of its links."""
    vec = scaled(vec)
    norm = np.sqrt((vec * vec).sum(axis=1))
    cosine = (vec[a] @ vec[b].T) / (norm[a][:, None] * norm[b][None, :])
    i, j = np.nonzero((cosine >= threshold) & (label[a][:, None] == label[b]))
    if a is b:
        upper = i < j
        i, j = i[upper], j[upper]
    i, j = a[i], b[j]
    if tab and len(i):
        new = np.ones(len(i), bool)
        for t in range(tab):
            new &= keys[i, t] != keys[j, t]
        i, j = i[new], j[new]
    count = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    order = np.argsort(rep, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(rep))
    root = rank.copy()
    while len(i):
        old = root.copy()
        np.minimum.at(root, i, old[j])
        np.minimum.at(root, j, root[i])
        root = root[order[root]]
        if (old == root).all():
            break
    return count.astype(np.int64), rep[order[root]]


def _compared(near: DataFrame, signed: DataFrame, threshold: float, tables: int, partitions: int) -> DataFrame:
    """(rep, n, root) from all blocks: the rows that were near by sketch, with their vectors."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        place = t["place"].to_numpy()
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = t["embedding"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for tab in np.unique(place >> 2):
            for dim in np.unique(size):  # one table and size, but for equal hashes of buckets
                some = np.flatnonzero((size == dim) & (place >> 2 == tab))
                pair = _sides(place[some] & 3)
                if pair is None:
                    continue
                g = t.take(pa.array(some))
                vec = g["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                keys = np.frombuffer(b"".join(g["keys"].to_pylist()), "<i4").reshape(-1, tables)
                rep = g["rep"].to_numpy()
                n, root = _links(label[some], int(tab), rep, g["copies"].to_numpy(), keys, vec, *pair, threshold)
                keep = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(n[keep]), pa.array(root[keep])], ["rep", "n", "root"])

    rows = near.join(signed.drop("s1", "s2"), "rep")
    return _blocks(rows, ["place", "rep", "label", "copies", "embedding", "keys"], partitions, compare, "rep long, n long, root long")


def near_duplicate_embeddings(vectors: DataFrame, threshold: float = 0.98, bits: int | None = None, partitions: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, they have as many components and
    their cosine in double precision is ``threshold`` at least. Null, empty or zero vectors and
    those with null or non-finite components link with nothing. Rows with equal label and vector
    are one class, compared once and counted with its copies. ``bits`` per table follows the
    number of classes and the number of tables follows ``bits``, so that buckets stay small and a
    pair at the threshold is missed with a chance of 1e-9. Rows may share a vec_id or lack one: each
    is a vector of its own, and a component goes by the smallest id in it, if it has any.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", fit)
    rows = rows.withColumns({"h1": F.when(F.col("fit"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("fit"), F.xxhash64(F.lit(7), "embedding", "label"))})
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("fit").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.min("row").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    one = rows.join(classes.select("rep", "copies"), rows.row == F.col("rep")).select("label", "rep", "copies", "embedding")
    if bits is None:
        bits = min(24, max(8, int(math.log2(max(1, classes.count()) / 256))))
    tables = table_count(bits, threshold)
    signed = materialize(_signed(one, tables, bits), "signed")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = materialize(_near(_postings(signed, tables), sketch_reach(threshold), partitions), "near")
    found = materialize(_compared(near, signed, threshold, tables, partitions), "found")
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    grouped = classes.join(labels, F.col("rep") == F.col("node"), "left").withColumn("g", F.coalesce("component", "rep"))
    least = grouped.groupBy("g").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(counts, "rep", "left").join(least, "g")
    named = named.select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.select("vec_id", "h1", "h2", "fit").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
