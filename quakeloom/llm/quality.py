"""Quality scores from random-indexing word vectors and a small neural network.

Every word, number and run of punctuation has a sparse random index vector, made from its hash. A
word's vector is the sum of the index vectors of its neighbours over the whole corpus (random
indexing), so it is built by additions alone. Words are counted over all documents first: the most
frequent ones have a vector each, and what is rarer shares a vector with the words of equal hash.
A document's features are the mean of its words' vectors and a few ratios of its own (capitals,
numbers, punctuation, repeated words, lengths). A network of two layers, trained in numpy on a
bounded sample of labelled rows, gives a logit, and one temperature, fitted on rows kept apart from
training, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import discard, materialize
from .textops import LOWER, Spans, mix64, slices, string_parts

#: Words with a vector of their own, vectors that rarer words share by hash.
OWN, SHARED = 1 << 16, 1 << 15
#: Width of the word vectors and non-zero places of an index vector.
WIDTH, PLACES = 64, 2
#: Most labelled rows that a network is trained on, those of the smallest hash of doc_id.
TRAIN_ROWS = 20_000
HIDDEN = 32
#: Rows of word vectors that one record of a partial sum holds: 32 KB mostly. An Arrow batch is a number of
#: records, in the JVM and again in its Python worker, whatever they weigh.
BLOCK = 256
#: Rows of word vectors that one task adds up.
TASK_ROWS = 4096
#: Tasks that share the partial sums of a block in the first step.
SALTS = 4
#: Distinct words that a task holds before it adds up equal ones.
HELD_WORDS = 2_000_000
_SHAPES = 7
_KIND = np.full(256, 3, np.uint8)  # punctuation
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the sparse ternary index vector of each word, from its hash."""
    bits = mix64(h ^ np.uint64(0x2545F4914F6CDD1D))
    shifts = np.uint64(16) * np.arange(PLACES, dtype=np.uint64)
    part = bits[:, None] >> shifts
    return (part % np.uint64(WIDTH)).astype(np.int64), np.where(part >> np.uint64(15) & np.uint64(1), 1, -1)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, first token of each document and the total, shape ratios of each document).

    A word of two letters or more in capitals only is another word than its lower case."""
    data, offs = string_parts(batch.column(batch.schema.get_field_index("text")))
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offs] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    h = Spans(LOWER[data]).hash(starts, ends) ^ (shout * np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(starts, offs)
    kinds = kind[starts] if len(starts) else np.zeros(0, np.uint8)
    n = np.maximum(np.diff(first), 1)
    per = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[first]) / n
    again = np.zeros((2, len(h)), bool)
    for lag in (1, 2):
        again[lag - 1, lag:] = h[lag:] == h[:-lag]
        for k in range(lag):
            again[lag - 1, np.minimum(first[:-1] + k, first[1:] - 1)[np.diff(first) > 0]] = False
    shapes = np.stack([per(shout), per(kinds == 2), per(kinds == 3), per(again[0]), per(again[1]), per((ends - starts) * (kinds == 1)) / 10, np.log1p(np.diff(first)) / 10], axis=1)
    return h, first, shapes


@dataclass
class WordVectors:
    """Hashes of the words with a vector of their own, in order, and unit vectors: theirs, then the shared ones."""

    words: np.ndarray
    vectors: np.ndarray

    def rows(self, h: np.ndarray) -> np.ndarray:
        return word_rows(h, self.words)


def word_rows(h: np.ndarray, words: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """The row of each word: its own, or one that it shares."""
    out = len(words) + ((h >> np.uint64(8)) % np.uint64(shared)).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        out = np.where(words[at] == h, at, out)
    return out


def frequent_words(docs: DataFrame, most: int = OWN) -> np.ndarray:
    """Hashes, in order, of the ``most`` most frequent words of all rows; ties go to the smaller hash.

    Tasks add up their own counts before the shuffle. The least count that makes it comes from the number
    of words of each count (n different counts take n**2 / 2 words of text, so these are few), and the
    largest hash of that count from the numbers of its words in 65,536 ranges of hashes. Only words that
    make it leave their partitions: the driver gets ``most`` numbers, and one range's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        for whole in batches:
            for batch in slices(whole):
                parts.append(np.unique(tokens(batch)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > HELD_WORDS:
                    u, n = merged()
                    if len(u) > HELD_WORDS // 2:  # mostly distinct words: hand them on
                        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], ["h", "n"])
                        u, n = u[:0], n[:0]
                    parts, held = [(u, n)], len(u)
        if parts:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], ["h", "n"])

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).toPandas()
    held = sizes.words.to_numpy(np.int64).cumsum()
    at = int(np.searchsorted(held, most, "right"))  # the counts before this one make it with all their words
    if at == len(sizes):
        best = counts.select("h")
    else:
        least, left = int(sizes.n[at]), most - (int(held[at - 1]) if at else 0)
        tied = counts.where(F.col("n") == least).select("h", F.shiftright("h", 48).alias("range"))
        ranges = tied.groupBy("range").agg(F.count("*").alias("words")).orderBy("range").toPandas()
        below = ranges.words.to_numpy(np.int64).cumsum()
        k = int(np.searchsorted(below, left, "right"))
        cut, rest = int(ranges.range[k]), left - (int(below[k - 1]) if k else 0)
        best = counts.where(F.col("n") > least).select("h").union(tied.where(F.col("range") < cut).select("h")).union(tied.where(F.col("range") == cut).orderBy("h").limit(rest).select("h"))
    best = best.toPandas()
    discard(counts)
    return np.sort(best.h.to_numpy(np.int64).astype(np.uint64))


def word_vectors(docs: DataFrame, own: int = OWN) -> WordVectors:
    """Word vectors of unit length from all rows of ``docs``.

    A task adds up its partition in whole numbers; the sums of tasks are added by blocks of rows in two
    shuffled steps, so that no task reads more than its share. The driver gets one fixed-size matrix."""
    words = frequent_words(docs, own)
    held = docs.sparkSession.sparkContext.broadcast(words)
    blocks, tasks = (-(-(len(words) + SHARED) // n) for n in (BLOCK, TASK_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * BLOCK * WIDTH, np.int64)
        for whole in batches:
            for batch in slices(whole):
                h, first, _ = tokens(batch)
                row, (places, signs) = word_rows(h, held.value), index_vectors(h)
                pair = np.ones(max(len(h) - 1, 0), bool)
                inner = first[1:-1]
                pair[inner[(inner > 0) & (inner < len(h))] - 1] = False
                left = np.flatnonzero(pair)
                for a, b in ((left, left + 1), (left + 1, left)):
                    for k in range(PLACES):
                        np.add.at(total, row[a] * WIDTH + places[b, k], signs[b, k])
        yield from packed(total.reshape(blocks, -1), range(blocks))

    def packed(sums: np.ndarray, which) -> Iterator[pa.RecordBatch]:
        for k, x in zip(which, sums, strict=True):
            if x.any():
                kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(x).max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["block", "sums"])

    def opened(raw) -> np.ndarray:
        return np.frombuffer(raw, f"<i{len(raw) // (BLOCK * WIDTH)}").astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = opened(memoryview(raw.as_buffer()))
                added[k] = added[k] + x if k in added else x
        if added:
            yield from packed(np.stack(list(added.values())), list(added))

    schema = "block int, sums binary"
    sums = docs.select("text").mapInArrow(count, schema)
    salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(tasks * SALTS, "block", "salt")
    sums = salted.select("block", "sums").mapInArrow(add, schema).repartition(tasks, "block").mapInArrow(add, schema)
    out = np.zeros((blocks, BLOCK * WIDTH), np.int64)
    for r in sums.toLocalIterator():
        out[r.block] += opened(bytes(r.sums))
    out = out.reshape(-1, WIDTH)[: len(words) + SHARED].astype(np.float64)
    return WordVectors(words, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def pooled(batch: pa.RecordBatch, vectors: WordVectors) -> np.ndarray:
    """Features of each row: mean word vector and shape ratios; an empty text has zeros."""
    h, first, shapes = tokens(batch)
    n = np.diff(first)
    out = np.zeros((batch.num_rows, WIDTH + _SHAPES))
    full = np.flatnonzero(n)
    if len(full):
        out[full, :-_SHAPES] = np.add.reduceat(vectors.vectors[vectors.rows(h)], first[:-1][full], axis=0) / n[full, None]
    out[:, -_SHAPES:] = shapes
    return out


@dataclass
class Network:
    """tanh layer, linear layer, temperature; inputs are standardized with the training rows' moments."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, apart: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Full-batch Adam on the rows not in ``apart``; the temperature minimizes log loss on those in it.

    With no rows, or labels of one kind only, every score is that kind's smoothed share."""
    r = np.random.default_rng(80)
    dim = x.shape[1]
    net = Network(np.zeros(dim), np.ones(dim), r.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.1, HIDDEN), 0.0)
    fit = ~apart
    if len(np.unique(y[fit])) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.w2[:] = 0
        net.b2 = float(np.log(share / (1 - share)))
        return net
    net.mean, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z, t = (x[fit] - net.mean) / net.scale, y[fit]
    params = [net.w1, net.b1, net.w2, np.array([np.log(t.mean() / (1 - t.mean()))])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - t) / len(t)
        back = error[:, None] * params[2] * (1 - hidden**2)
        for j, g in enumerate((z.T @ back + decay * params[0], back.sum(axis=0), hidden.T @ error + decay * params[2], np.array([error.sum()]))):
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            params[j] -= rate * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.999**k)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if apart.any():
        logit, t = net.logits(x[apart]), y[apart]
        losses = {}
        for temperature in np.exp(np.linspace(np.log(0.25), np.log(8), 60)):
            losses[temperature] = np.mean(np.logaddexp(0, logit / temperature) - t * logit / temperature)
        net.temperature = float(min(losses, key=losses.get))
    return net


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, own: int = OWN) -> tuple[WordVectors, Network]:
    """Word vectors from all of ``docs`` (text), and a network from ``labels`` (doc_id, quality 0/1).

    Labelled rows beyond ``limit`` are left out by a hash of doc_id; a fifth of those taken, by
    another hash, fits the temperature only. Rows without a label, id or text teach nothing. The
    ids taken, ``limit`` at most, are broadcast, so texts stay where they lie."""
    vectors = word_vectors(docs, own)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    one = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taken = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(taken), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x.astype("<f4").tobytes() for x in pooled(b, held.value)], pa.binary()), b.column(2)], ["doc_id", "x", "quality"])

    got = rows.mapInArrow(features, "doc_id long, x binary, quality int").withColumn("apart", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(v, "<f4") for v in got.x]).astype(np.float64) if len(got) else np.zeros((0, WIDTH + _SHAPES))
    return vectors, train_network(x, got.quality.to_numpy(np.float64), got.apart.to_numpy(bool))


def score(docs: DataFrame, vectors: WordVectors, net: Network) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, from the text alone; a null text is as an
    empty one. A column of the input called score is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    names = [f.name for f in docs.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, model = held.value
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(pooled(b, vec)))], [*names, "score"])

    return docs.mapInArrow(run, f"{ddl}, score double")
