"""Dropping lines that repeat across documents, by probing a sharded minimal perfect hash.

The distinct line hashes of all documents are indexed in shards. A shard is a minimal perfect hash
(levels of bit arrays in which a key owns a bit that no other key hit) that gives each hash a slot
in compact arrays: a fingerprint of 32 bits, the number of documents (no further than the least
that matters, so one byte), and for the slots that reach it the document that keeps the line. That
is about six bytes a line.

Documents probe the arrays with their own lines, so lines are never joined with lines. While all
shards together fit a stated size they are broadcast and a document needs no shuffle. Beyond that
size line hashes are sent to the shard that holds them, each shard being dealt to several tasks so
that one very common line does not meet in one task, and only the hashes of lines to drop come back
to their documents. Both ways give the same rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .textops import LOWER, SPACE, Spans, mix64, slices, string_parts

#: Hashes in one shard, about.
SHARD_KEYS = 1 << 16
#: Largest index that is broadcast, in bytes.
BROADCAST_BYTES = 64 << 20
#: Lines that one task probes when lines are sent to shards.
PROBES = 500_000
_LEVELS = 40


class BitLevel:
    """A bit array with the number of set bits before each of its words."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size
        ones = np.bitwise_count(words)
        self.before = (np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32)
        self.ones = int(ones.sum())

    @classmethod
    def of(cls, bits: np.ndarray) -> BitLevel:
        packed = np.packbits(bits, bitorder="little")
        return cls(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"), len(bits))

    def probe(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the bit is set, set bits before it) at each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        held = self.words[word]
        return (held >> bit & np.uint64(1)).astype(bool), self.before[word] + np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys with arrays in slot order."""

    def __init__(self, levels: list[BitLevel], rest: np.ndarray, prints: np.ndarray, counts: np.ndarray, often: np.ndarray, keepers: np.ndarray):
        self.levels, self.rest, self.prints, self.counts, self.often, self.keepers = levels, rest, prints, counts, often, keepers

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 % 2**64)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray, least: int = 0) -> PerfectHash:
        """Keepers are held for counts of ``least`` or more."""
        left, levels = keys, []
        while len(left) and len(levels) < _LEVELS:
            size = 2 * len(left) + 1
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(BitLevel.of(alone))
            left = left[~alone[at]]
        none = np.zeros(0, np.int64)
        made = cls(levels, np.sort(left), none, none, none, none)
        slot = made.slots(keys)
        kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
        made.prints, made.counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), kind)
        made.prints[slot], made.counts[slot] = cls._print(keys), counts
        kept = np.flatnonzero(counts >= least)
        kept = kept[np.argsort(slot[kept])]
        made.often, made.keepers = slot[kept].astype(np.uint32), keepers[kept]
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; a key that is not in the set gets some slot or -1."""
        slot = np.full(len(keys), -1, np.int64)
        open_, taken = np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            hit, rank = bits.probe(self._place(keys[open_], level, bits.size))
            slot[open_[hit]] = taken + rank[hit]
            open_, taken = open_[~hit], taken + bits.ones
        if len(self.rest) and len(open_):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[k] == keys[open_]
            slot[open_[hit]] = taken + k[hit]
        return slot

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, keeper) of each key; a keeper that is not held is 0."""
        slot = self.slots(keys)
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        found = (slot >= 0) & (self.prints[slot] == self._print(keys))
        keeper = np.zeros(len(keys), np.int64)
        if len(self.often):
            k = np.minimum(np.searchsorted(self.often, slot), len(self.often) - 1)
            keeper = np.where(found & (self.often[k] == slot), self.keepers[k], 0)
        return found, np.where(found, self.counts[slot], 0).astype(np.int64), keeper

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<IIIII{len(self.levels)}I", len(self.levels), len(self.rest), len(self.prints), self.counts.dtype.itemsize, len(self.often), *(x.size for x in self.levels))
        return b"".join([head, *(x.words.tobytes() for x in self.levels), self.rest.astype("<u8").tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.often.tobytes(), self.keepers.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, rest, size, width, often = struct.unpack_from("<IIIII", raw)
        lengths = struct.unpack_from(f"<{n}I", raw, 20)
        at, arrays = 20 + 4 * n, []
        for kind, k in [*(("<u8", -(-x // 64)) for x in lengths), ("<u8", rest), ("<u4", size), (f"<u{width}", size), ("<u4", often), ("<i8", often)]:
            arrays.append(np.frombuffer(raw, kind, k, at))
            at += k * int(kind[-1])
        return cls([BitLevel(w, x) for w, x in zip(arrays, lengths, strict=False)], *arrays[n:])


class Lines:
    """Line spans and key hashes of a slice of documents."""

    def __init__(self, batch: pa.RecordBatch, least: int):
        self.data, offs = string_parts(batch.column(batch.schema.get_field_index("text")))
        breaks = np.flatnonzero(self.data == 10)
        self.starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
        self.first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offs)))])
        self.ends = np.empty_like(self.starts)
        self.ends[:-1] = self.starts[1:] - 1
        self.ends[self.first[1:] - 1] = offs[1:]
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        solid = np.flatnonzero(~SPACE[self.data])
        lo, hi = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        full = hi > lo
        self.lo, self.hi = self.starts.copy(), self.starts.copy()
        self.lo[full], self.hi[full] = solid[lo[full]], solid[hi[full] - 1] + 1
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.long = np.flatnonzero(points[self.hi] - points[self.lo] >= least)
        self.hash = Spans(LOWER[self.data]).hash(self.lo[self.long], self.hi[self.long])

    def text(self, doc: int, drop: np.ndarray) -> bytes:
        """The document without the lines in ``drop`` (line numbers of the slice)."""
        raw = self.data
        keep = np.setdiff1d(np.arange(self.first[doc], self.first[doc + 1]), drop, assume_unique=True)
        return b"\n".join(raw[self.starts[k] : self.ends[k]].tobytes() for k in keep)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(h, doc_id): the distinct long line keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = Lines(batch, least)
                doc = x.doc[x.long]
                order = np.lexsort((x.hash, doc))
                h, doc = x.hash[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].astype(np.int64)), batch.column(0).take(pa.array(doc[new]))], ["h", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h long, doc_id long")


def _shard(count: int):
    return F.pmod(F.col("h"), F.lit(count)).cast("int")


def build_index(stats: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, arrays) from (h, n_docs, keeper): one row per shard of about SHARD_KEYS hashes."""

    def build(t: pa.Table) -> pa.Table:
        counts = np.minimum(t["n_docs"].to_numpy(), least)  # what lies beyond decides nothing
        made = PerfectHash.build(t["h"].to_numpy().astype(np.uint64), counts, t["keeper"].fill_null(np.iinfo(np.int64).min).to_numpy(), least)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "arrays": pa.array([made.to_bytes()], pa.binary())})

    return stats.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, broadcast_bytes: int = BROADCAST_BYTES, probes: int = PROBES) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) with ``text`` replaced and n_lines, n_dropped added.

    Texts are split at newlines; a null or empty text is one empty line. A line's key is the line
    without ASCII white space at both ends and with A-Z lower-cased. Keys of ``min_chars`` code
    points or more that are found in ``min_docs`` rows or more lose their lines everywhere but in
    rows with the largest doc_id holding them; all other lines stay as they are, joined by newlines
    (nothing left: an empty text). A null doc_id is smaller than any other. Repeated rows count as
    documents of their own. Columns named n_lines or n_dropped in the input are replaced. ``probes`` is
    the number of lines that one task probes once lines are sent to their shards.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    found = _lines(docs, min_chars)
    stats = materialize(found.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")), "line-counts")
    shards = max(1, math.ceil(stats.count() / SHARD_KEYS))
    index = materialize(build_index(stats, shards, min_docs), "line-index")
    size = index.agg(F.coalesce(F.sum(F.octet_length("arrays")), F.lit(0)).alias("size")).first().size
    schema = docs.schema.fields
    names = [f.name for f in schema]
    added = ", n_lines long, n_dropped long"
    ddl = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in schema)
    least = np.iinfo(np.int64).min

    def rewritten(batch: pa.RecordBatch, x: Lines, dropped: np.ndarray) -> pa.RecordBatch:
        gone = np.bincount(x.doc[dropped], minlength=batch.num_rows)
        column = batch.column(names.index("text"))
        if len(dropped) or column.null_count:
            at = np.concatenate([[0], np.cumsum(gone)])
            texts = column.fill_null("")
            out = texts.to_pylist()
            for d in np.flatnonzero(gone):
                out[d] = x.text(d, dropped[at[d] : at[d + 1]]).decode("utf-8", "surrogatepass")
            column = pa.array(out, pa.string())
        columns = [column if k == "text" else batch.column(j) for j, k in enumerate(names)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(x.first)), pa.array(gone.astype(np.int64))], [*names, "n_lines", "n_dropped"])

    if size <= broadcast_bytes:
        arrays = spark.sparkContext.broadcast({r.shard: bytes(r.arrays) for r in index.toLocalIterator()})
        opened: dict[int, PerfectHash] = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not opened:
                opened.update({k: PerfectHash.from_bytes(v) for k, v in arrays.value.items()})
            for whole in batches:
                for batch in slices(whole):
                    x = Lines(batch, min_chars)
                    me = batch.column(names.index("doc_id")).cast(pa.int64()).fill_null(least).to_numpy()[x.doc[x.long]]
                    shard = x.hash.astype(np.int64) % shards
                    drop = np.zeros(len(x.hash), bool)
                    for k, one in opened.items():
                        mine = np.flatnonzero(shard == k)
                        hit, count, keeper = one.probe(x.hash[mine])
                        drop[mine] = hit & (count >= min_docs) & (keeper != me[mine])
                    yield rewritten(batch, x, x.long[drop])

        return docs.mapInArrow(run, ddl + added)

    # shards of common lines are dealt to several tasks, which each get the shard's arrays
    dealt = stats.groupBy(_shard(shards).alias("shard")).agg(F.ceil(F.sum("n_docs") / F.lit(probes)).cast("int").alias("salts")).where("salts > 1")
    dealt = materialize(dealt, "dealt-shards")
    salts = F.coalesce("salts", F.lit(1))
    keyed = found.withColumn("shard", _shard(shards)).join(dealt, "shard", "left").withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "doc_id"), salts).cast("int")).drop("salts")
    spread = index.join(dealt, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")

    def meet(probes: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows or not probes.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "h": pa.array([], pa.int64())})
        hit, count, keeper = PerfectHash.from_bytes(held["arrays"][0].as_py()).probe(probes["h"].to_numpy().astype(np.uint64))
        drop = hit & (count >= min_docs) & (keeper != probes["doc_id"].fill_null(least).to_numpy())
        return probes.filter(pa.array(drop)).select(["doc_id", "h"])

    drops = keyed.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(meet, "doc_id long, h long")
    drops = drops.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("h").alias("drop_lines"))
    joined = docs.join(drops, docs.doc_id.eqNullSafe(F.col("drop_id")), "left").select(*[docs[f"`{k}`"] for k in names], F.coalesce("drop_lines", F.array().cast("array<bigint>")).alias("drop_lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = Lines(batch, min_chars)
                lists = batch.column(len(names))
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                known, code = np.unique(np.concatenate([x.hash, lists.flatten().to_numpy().astype(np.uint64)]), return_inverse=True)
                place = np.concatenate([x.doc[x.long], owner]) * len(known) + code
                drop = np.isin(place[: len(x.hash)], place[len(x.hash) :])
                yield rewritten(batch, x, x.long[drop])

    return joined.mapInArrow(cut, ddl + added)
