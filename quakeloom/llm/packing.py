"""Packing token sequences by minimum bin slack.

Documents are tokenized and cut into pieces of a full window and one shorter remainder. How many
remainders there are of each length is all that planning needs, at most ``window`` numbers whatever
the size of the corpus. For each window the longest remaining length is taken, and a bitset of the
sums that the other remaining lengths can make finds the multiset that fills it closest to capacity;
its counts are backtracked through the bitsets. The same filling is repeated as often as the counts
allow, so the plan stays short. Pieces find their sequence and offset from their rank within their
length, which is counted in two levels so that a common length is spread over many tasks.
"""

from __future__ import annotations

import itertools
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .textops import release_memory, slices, string_parts

WINDOW = 2048
END_ID = 1
#: Distinct strings whose ids a task remembers; a worker that outlives the task keeps none.
REMEMBERED = 250_000
#: New parts that the tokenizer gets in one string.
JOINED = 512
#: Pieces in one bucket of a length, about.
BUCKET_ROWS = 20_000
#: Bytes of text that are encoded in one step.
ENCODED_BYTES = 1 << 21
#: What may follow a space for a new part to start there: no white space, and no first byte of a character of
#: which some are white space, unless its second byte tells.
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = False
_UNSURE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def starts_at_single_spaces(model: dict) -> bool:
    """Whether a tokenizer (its JSON) starts a new token at every single space before a non-space: the
    byte-level pattern does, if nothing changes the text before it."""
    pre = model.get("pre_tokenizer") or {}
    return model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)


class Encoder:
    """Token ids of whole texts, by the tokenizer's own encoding of each distinct part.

    Where the tokenizer's pattern starts a new token at every single space before a non-space, texts are
    cut there and each distinct part is encoded once: Arrow's dictionary finds the distinct parts of a
    step, new ones go to the tokenizer in strings of ``JOINED``, and the bytes of the tokens tell where
    each part ends. A text that holds one of the tokenizer's added tokens, or any text of a tokenizer
    with another pattern, is one part."""

    def __init__(self, path: str, end_id: int = END_ID):
        # Spark gives a task one core; the tokenizer's own threads would take all of them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end = end_id
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._parts = starts_at_single_spaces(json.loads(self._tokenizer.to_str())) and not any(" " in t for t in self._added)
        vocabulary = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():  # byte-level tokens spell every byte as one character
            self._bytes[k] = len(token)
        self.forget()

    def forget(self) -> None:
        self._numbers: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self._ids, self._used = np.full(1 << 16, self._end, np.int32), 1
        self._starts, self._sizes = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)

    def _apart(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many of each), each part encoded alone."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_apart``, for parts that start with their space."""
        chunks = [b"".join(parts[i : i + JOINED]).decode() for i in range(0, len(parts), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])
        reached = np.concatenate([[0], np.cumsum(self._bytes[ids])])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        k = np.minimum(np.searchsorted(reached, ends), len(ids))
        if not np.array_equal(reached[k], ends):  # a vocabulary that leaves bytes out
            return self._apart(parts)
        return ids, np.diff(k, prepend=0)

    def _learn(self, parts: list[bytes], numbers: np.ndarray, encode) -> None:
        if not len(numbers):
            return
        flat, sizes = encode(parts)
        while len(self._numbers) >= len(self._starts):
            self._starts, self._sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._sizes))
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._sizes[numbers] = sizes
        self._starts[numbers] = self._used + np.cumsum(sizes) - sizes
        self._ids[self._used : self._used + len(flat)] = flat
        self._used += len(flat)

    def _cuts(self, texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Places of the spaces that start a part."""
        if not self._parts:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(data[:-1] == 0x20)
        after = data[at + 1]
        cut = _SOLID[after]
        for first, seconds in _UNSURE.items():
            k = np.flatnonzero(after == first)
            cut[k] = ~np.isin(data[at[k] + 2], seconds)
        ends = np.zeros(len(data) + 1, bool)
        ends[offs] = True
        at = at[cut & ~ends[at + 1]]
        whole = np.zeros(len(texts), bool)
        for token in self._added:
            whole |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        return at[~whole[np.searchsorted(offs, at, "right") - 1]] if whole.any() else at

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; offsets of the texts)."""
        if len(self._numbers) > REMEMBERED:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, offs = string_parts(texts)
        starts_part, inner = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        inner[self._cuts(texts, data, offs)] = True
        starts_part[offs] = True
        edges = np.flatnonzero(starts_part | inner)
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        part, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        spaced = np.zeros(len(distinct), bool)
        spaced[part[inner[edges[:-1]]]] = True
        known = len(self._numbers)
        number = np.fromiter(map(self._numbers.__getitem__, distinct), np.int64, len(distinct))
        for kind, encode in ((spaced, self._joined), (~spaced, self._apart)):
            new = np.flatnonzero(kind & (number > known))
            self._learn([distinct[i] for i in new], number[new], encode)
        last = np.searchsorted(edges, offs[1:])
        k = np.insert(number[part], last, 0)
        sizes = self._sizes[k]
        ends = np.cumsum(sizes)
        where = np.repeat(self._starts[k] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._ids[where], np.concatenate([[0], np.concatenate([[0], ends])[last + np.arange(1, len(last) + 1)]])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids cut at multiples of ``window``.

    ``ids`` holds little-endian unsigned 32-bit numbers; the last one of a document is the end id.
    A null or empty text is the end id alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, limit=ENCODED_BYTES):
                ids, offs = encoder.encode(b.column(1))
                total = np.diff(offs)
                count = -(-total // window)
                doc = np.repeat(np.arange(b.num_rows), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, total[doc] - start)
                raw = ids.astype("<u4")
                lo = offs[doc] + start
                pieces = [raw[x : x + n].tobytes() for x, n in zip(lo, length, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(pieces, pa.binary()), pa.array(total[doc])], names)
        encoder.forget()
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


@dataclass
class Plan:
    """Intervals of ranks, ordered by (length, first rank): which sequences and offsets they get."""

    length: np.ndarray
    first: np.ndarray
    per_sequence: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) | self.first
        k = np.searchsorted(key, (length << 44) | rank, "right") - 1
        past = rank - self.first[k]
        return self.sequence[k] + past // self.per_sequence[k], self.offset[k] + past % self.per_sequence[k] * length


def fill_one(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is closest to ``room`` from below."""
    reach, layers, used = 1, [], []
    mask = (1 << (room + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        layers.append(reach)
        used.append(length)
        left, chunk = min(counts[length], room // length), 1
        while left:  # binary splitting: any number from 0 to the count
            chunk = min(chunk, left)
            reach |= (reach << (chunk * length)) & mask
            left -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, {}
    for before, length in zip(reversed(layers), reversed(used), strict=True):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            picked[length] = n
    return picked


def minimum_bin_slack(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Sequences for ``counts`` pieces of each length; sequence ids go from 0 without gaps."""
    left = {k: n for k, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        picked = fill_one(rest, window - seed)
        picked[seed] = picked.get(seed, 0) + 1
        times = min(left[k] // n for k, n in picked.items())
        offset = 0
        for k in sorted(picked, reverse=True):
            rows.append((k, given[k], picked[k], sequence, offset))
            offset += k * picked[k]
            given[k] += picked[k] * times
            left[k] -= picked[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    return Plan(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length, any more columns) with sequence_id and offset.

    Pieces of 1 to ``window`` tokens; a sequence's pieces lie at offsets from 0 without gaps."""
    pieces = pieces.drop("sequence_id", "offset")
    spark, held = pieces.sparkSession, materialize(pieces, "pieces")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(minimum_bin_slack(counts, window))
    # only common lengths are dealt to more than one bucket: at most window + pieces / BUCKET_ROWS in all
    dealt = spark.createDataFrame([(k, n // BUCKET_ROWS + 1) for k, n in counts.items()], "length long, buckets long")
    held = held.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets")).cast("int")).drop("buckets")
    sizes = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    ranked = held.withColumn("rank", F.row_number().over(order)).join(heads, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("head"))
    names = [f.name for f in pieces.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {k: b.schema.get_field_index(k) for k in ("length", "rank")}
            sequence, offset = plan.value.place(*(b.column(at[k]).to_numpy().astype(np.int64) for k in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(names))), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for every piece of ``docs``.

    Every id of a document, with its end id, lies in exactly one piece. Rows without a doc_id and
    repeated rows are packed like any other; an empty table packs to none."""
    return assign(cut_pieces(docs, tokenizer, window), window)
