"""MinHash near-duplicates by an inverted join on signature coordinates.

A document posts itself under each (coordinate, value) pair of its signature. Two documents whose
signatures agree in at least ``matches`` of ``coordinates`` places share a posting list, and also
one among the ``coordinates - matches + 1`` rarest lists of either (prefix filter): only those are
joined. The longer lists are never merged; what they would add is counted by probing the two
signatures (skip). Pairs above the threshold are confirmed on the full shingle sets.

Large groups of near copies cost links in proportion to their size: a long list compares its
members with its most central one only. What is then still in different components of a long list
meets in an exact prefix join on the shingles themselves, where the places of a pair's first common
shingle bound its overlap, so that a group's members pair up only where a link is possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from ..plans.graph import connected_components
from .textops import LOWER, Spans, mix64, slices, string_parts, words

COORDINATES = 64
#: At a similarity of 0.8 fewer matches than this have a chance of about 3e-6.
MATCHES = 36
#: Posting lists of up to this length compare all their pairs.
SHORT_LIST = 8
_SEEDS = np.random.default_rng(5).integers(1, 2**63, (2, 256), dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    data, offs = string_parts(batch.column(batch.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    hashes = Spans(data).hash(starts, ends)
    rolled = hashes.copy()
    for k in range(1, width):
        rolled[:-k] = mix64(rolled[:-k] + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k:]
    rolled = mix64(rolled)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n = hi - lo
        if n >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            whole = np.uint64(n)
            for h in hashes[lo:hi]:
                whole = mix64(np.array([whole], np.uint64) + np.uint64(0x632BE59BD9B4E019))[0] ^ h
            yield mix64(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def minhash(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Least value of each hash function over the set, as unsigned 32-bit numbers."""
    out = np.full(coordinates, 0xFFFFFFFF, np.uint64)
    step = max(1, (1 << 18) // coordinates)
    for at in range(0, len(s), step):
        h = (s[at : at + step, None] * (_SEEDS[0, :coordinates] | np.uint64(1)) + _SEEDS[1, :coordinates]) >> np.uint64(32)
        np.minimum(out, h.min(axis=0), out=out)
    return out.astype(np.uint32)


#: A null doc_id in keys of joins; rows are told apart by their text's hash besides.
_NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``k`` and ``h``, which tell rows of different ids or texts apart."""
    return docs.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "h": F.xxhash64(F.coalesce("text", F.lit("")))})


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, k, h, n_shingles, d1, d2, sig): the set's size, 128-bit digest and MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n, d1, d2, sig = [], [], [], []
                for s in shingle_sets(batch, width):
                    n.append(len(s))
                    d1.append(np.sum(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64).astype(np.int64))
                    d2.append(np.sum(mix64(s + np.uint64(0x0123456789ABCDEF)), dtype=np.uint64).astype(np.int64))
                    sig.append(minhash(s, coordinates).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "k", "h", "n_shingles", "d1", "d2", "sig"])

    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "k", "h", "text")
    return rows.mapInArrow(run, "doc_id long, k long, h long, n_shingles long, d1 long, d2 long, sig binary")


def _postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """(token, rep): a coordinate and its value in one long, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(coordinates, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            tokens = (sig.astype(np.int64) << 8 | at).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(b.column(0).to_numpy(), coordinates))], ["token", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "token long, rep long")


def prefix_lists(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, rep, weight) for the rarest ``coordinates - matches + 1`` tokens of each document.

    Tokens of one document only come first in that order and join with nothing, so they are
    counted but not kept. The weight is high for documents whose tokens are common: the originals
    of a group of near copies."""
    posted = _postings(reps, coordinates)
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    kept = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.sum((16 * F.log2("df")).cast("long")).alias("weight"))
    room = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("tokens"))
    return kept.where(room > 0).select("rep", "weight", F.explode(F.slice("tokens", F.lit(1), room)).alias("t")).select(F.col("t.token").alias("token"), "rep", "weight")


def _agreeing(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``matches`` places at least."""
    sig = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    both = pairs.join(sig, "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((sa == sb).sum(axis=1) >= matches))

    return both.mapInArrow(run, "a long, b long")


def shingle_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the full sets, as packed unsigned 64-bit hashes, of the rows in ``wanted`` (rep, k, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch, width)], pa.binary())], ["rep", "shingles"])

    chosen = keyed(docs).join(wanted, ["k", "h"]).dropDuplicates(["k", "h"]).select("rep", "text")
    return chosen.mapInArrow(run, "rep long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""
    left = pairs.join(sets.toDF("a", "sa"), "a")
    both = left.join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * n >= percent * (len(both) - n) and len(both) > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _possible(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``sets`` (rep, shingles) in different components that may reach ``percent``.

    A pair that reaches it shares one of the rarest ``n - ceil(percent * n / 100) + 1`` shingles of
    either, and at its first common shingle both have enough shingles left for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.int64)
                for at in range(0, len(s), 10_000):
                    part = s[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), rep)), pa.array(np.full(len(part), len(s)))], ["shingle", "rep", "n"])

    each = sets.select("rep", "shingles").mapInArrow(run, "shingle long, rep long, n long")
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    rows = each.join(shared, "shingle").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    alone = F.col("n") - F.size("s")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    rows = rows.where(room > 0).withColumn("alone", alone).select("rep", "n", "alone", F.posexplode(F.slice("s", F.lit(1), room.cast("int"))).alias("k", "t"))
    rows = rows.join(labels, rows.rep == labels.node, "left").select(F.col("t.shingle").alias("shingle"), "rep", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("left"), F.coalesce("component", "rep").alias("c"))
    rows = materialize(rows, "shingle-lists")
    mixed = rows.groupBy("shingle").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("shingle")
    rows = rows.join(mixed, "shingle")
    x, y = (rows.toDF("shingle", *(f"{k}{side}" for k in ("rep", "n", "left", "c"))) for side in "xy")
    enough = F.least("leftx", "lefty") * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))
    sized = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    pairs = x.join(y, "shingle").where((F.col("repx") < F.col("repy")) & (F.col("cx") != F.col("cy")) & enough & sized)
    return pairs.select(F.col("repx").alias("a"), F.col("repy").alias("b")).distinct()


def _classes(docs: DataFrame, width: int, percent: int, coordinates: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named): a (doc_id, k, h, n_shingles, d1, d2) per row of ``docs``, and of each class of equal
    sets its group ``g`` of linked classes and the smallest doc_id of that group.

    A class goes by the number of one of its rows, so rows may share an id or lack one."""
    rows = materialize(signatures(docs.select("doc_id", "text"), width, coordinates).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("rep"))
    reps = materialize(full.join(classes.select("rep"), full.row == F.col("rep")).select("rep", "k", "h", "sig"), "reps")
    lists = materialize(prefix_lists(reps, coordinates, matches), "lists")

    sizes = lists.groupBy("token").agg(F.count("*").alias("n"), F.max_by("rep", F.struct("weight", "rep")).alias("center")).where("n > 1")
    lists = materialize(lists.join(sizes, "token").select("token", "rep", "n", "center"), "shared-lists")
    short, long = lists.where(F.col("n") <= SHORT_LIST), lists.where(F.col("n") > SHORT_LIST)
    pairs = short.select("token", F.col("rep").alias("a")).join(short.select("token", F.col("rep").alias("b")), "token").where("a < b").select("a", "b")
    stars = long.where("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))
    near = materialize(_agreeing(pairs.union(stars).distinct(), reps, matches), "near")
    wanted = near.select(F.col("a").alias("rep")).union(near.select("b")).union(long.select("rep")).distinct()
    sets = materialize(shingle_table(docs, reps.select("rep", "k", "h").join(wanted, "rep"), width), "sets")
    links = materialize(_confirmed(near, sets, percent), "links")
    labels = connected_components(links)

    held = long.join(labels, long.rep == labels.node, "left").select("token", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = held.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("token")
    pool = materialize(held.join(mixed, "token", "left_semi").select("rep").distinct(), "pool")
    if not pool.isEmpty():
        more = materialize(_confirmed(_possible(sets.join(pool, "rep", "left_semi"), labels, percent), sets, percent), "links")
        if not more.isEmpty():
            labels = connected_components(links.union(more))
    named = classes.join(labels, classes.rep == labels.node, "left").select("n_shingles", "d1", "d2", "first_id", F.coalesce("component", "rep").alias("g"))
    named = materialize(named, "classes")
    least = named.groupBy("g").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "k", "h", "n_shingles", "d1", "d2"), named.join(least, "g").drop("first_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; more columns are ignored).

    Words are runs of non-space bytes with A-Z lower-cased; a document's set holds its distinct
    ``width``-word shingles, or its whole sequence if it has fewer words. Documents with equal sets
    are one class, compared once. A null, empty or blank text has an empty set, links with nothing and
    is kept. Rows may share a doc_id: each is a document of its own with its own text. Repeated rows
    get the same answer; a row without a doc_id gets the smallest id it is linked with, or none, and
    is not kept.
    """
    rows, named = _classes(docs, width, percent, coordinates, matches)
    out = rows.join(named, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row of each group of near duplicates in ``docs`` (doc_id, text, any more columns).

    The one with the smallest doc_id stays (of several with that id, the one of the smallest text
    hash); rows without an id come last. Different texts under one id are different documents, and a
    row with a null, empty or blank text stays."""
    rows, named = _classes(docs, width, percent, coordinates, matches)
    mine = rows.where("n_shingles > 0").join(named, ["n_shingles", "d1", "d2"])
    first = mine.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "k", "h")).alias("one")).select("one.k", "one.h")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    names = [f"`{c}`" for c in docs.columns]
    kept = keyed(docs.where(worded).withColumnsRenamed({c: f"__{c}" for c in ("k", "h") if c in docs.columns})).join(first, ["k", "h"]).dropDuplicates(["k", "h"])
    kept = kept.drop("k", "h").withColumnsRenamed({f"__{c}": c for c in ("k", "h") if c in docs.columns})
    return kept.select(*names).union(docs.where(~worded).select(*names))
