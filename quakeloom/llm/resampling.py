"""Importance resampling towards a target distribution, over hashed n-grams of words.

A document is normalised to its words, one space between two, and scanned once for the running CRC-32
of every prefix. The CRC-32 of any n-gram follows from the prefixes at its two ends: appending bytes
to a prefix shifts its CRC register, which is linear over GF(2), so shifting the earlier register by
the n-gram's length and adding (xor) the later one cancels all that stands before. No n-gram is cut
out or hashed by itself, whatever its width.

All documents and all target texts are counted in ``buckets`` cells of that hash; tasks add up their
own counts. A document's weight is the sum of the gains of its features' buckets, and adding Gumbel
noise that its id seeds makes the largest scores a weighted draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .textops import LOWER, slices, string_parts

BUCKETS = 10_000
#: Bytes of a lane: lanes are scanned side by side, and their registers are joined by shifts.
LANE = 1024
_POLYNOMIAL = 0xEDB88320
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _table() -> np.ndarray:
    """What a byte does to a register of CRC-32 (reflected)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), x >> np.uint32(1) ^ np.uint32(_POLYNOMIAL), x >> np.uint32(1))
    return x


_STEP = _table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of registers, as one table for each of their four bytes."""
    return tables[0][x & np.uint32(255)] ^ tables[1][x >> np.uint32(8) & np.uint32(255)] ^ tables[2][x >> np.uint32(16) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


def _shift_tables() -> list[np.ndarray]:
    """For each k the map that 2**k zero bytes do to a register."""
    every = np.arange(256, dtype=np.uint32)
    places = [every << np.uint32(8 * k) for k in range(4)]
    maps = [np.stack([_STEP[x & np.uint32(255)] ^ x >> np.uint32(8) for x in places])]
    for _ in range(40):
        maps.append(np.stack([_apply(maps[-1], x) for x in maps[-1]]))
    return maps


_SHIFTS = _shift_tables()


def shift(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers ``x`` after ``by`` zero bytes each."""
    x, k = x.copy(), 0
    while len(by) and int(by.max()) >> k:
        some = np.flatnonzero(by >> k & 1)
        x[some] = _apply(_SHIFTS[k], x[some])
        k += 1
    return x


def prefix_registers(data: np.ndarray) -> np.ndarray:
    """The register (from 0) before each byte of ``data`` and after the last one.

    Lanes are scanned from 0 side by side; what stands before a lane is added by shifts, in a doubling
    scan over the lanes' own registers."""
    n = max(1, -(-len(data) // LANE))
    padded = np.zeros(n * LANE, np.uint8)
    padded[: len(data)] = data
    lanes = np.ascontiguousarray(padded.reshape(n, LANE).T)  # a step reads a row
    out = np.zeros((LANE + 1, n), np.uint32)
    for k in range(LANE):
        out[k + 1] = _STEP[(out[k] ^ lanes[k]) & np.uint32(255)] ^ out[k] >> np.uint32(8)
    # the register at the start of each lane: an inclusive doubling scan, then one lane on
    whole, reach = out[LANE].copy(), 1
    while reach < n:
        whole[reach:] = shift(whole[:-reach], np.full(n - reach, reach * LANE)) ^ whole[reach:]
        reach *= 2
    start = np.concatenate([np.zeros(1, np.uint32), whole[:-1]])
    for k in range(LANE):
        out[k] ^= start
        start = _STEP[start & np.uint32(255)] ^ start >> np.uint32(8)
    return np.concatenate([out[:LANE].T.reshape(-1), whole[-1:]])[: len(data) + 1]


def substring_crcs(registers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes between any two prefixes."""
    length = ends - starts
    # a CRC starts from all ones and is inverted in the end
    kinds, at = np.unique(length, return_inverse=True)
    ones = ~shift(np.full(len(kinds), 0xFFFFFFFF, np.uint32), kinds)
    return registers[ends] ^ shift(registers[starts], length) ^ ones[at]


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word of each text and the total): words with one space after each.

    Words are runs of what is neither ASCII punctuation, space nor control, with A-Z lower-cased."""
    data = LOWER[data]
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begins = solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))
    ends = solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    before = np.cumsum(solid) - solid  # solid bytes before each byte
    rank = np.arange(len(starts))
    begin = before[starts] + rank if len(starts) else starts
    length = stops - starts
    out = np.full(int(solid.sum()) + len(starts), 0x20, np.uint8)
    word = np.repeat(rank, length)
    out[np.arange(int(length.sum())) + word] = data[solid]
    return out, begin, begin + length, np.searchsorted(starts, offs)


def feature_buckets(batch: pa.RecordBatch, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature of the texts in the batch, and the words of each text."""
    data, offs = string_parts(batch.column(batch.schema.get_field_index("text")))
    flat, starts, ends, first = normalised(data, offs)
    registers = prefix_registers(flat)
    text = np.repeat(np.arange(batch.num_rows), np.diff(first))
    rows, cells = [], []
    for n in range(low, high + 1):
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        rows.append(text[at])
        cells.append(substring_crcs(registers, starts[at], ends[at + n - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64), np.diff(first)


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (text); a task hands on at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in slices(whole):
                total += np.bincount(feature_buckets(b, low, high, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of every bucket, S and T being the
    totals of the two counts. ``buckets`` numbers come to the driver, whatever was counted."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    rows = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).toPandas()
    gains = np.zeros(buckets, np.int64)
    gains[rows.bucket.to_numpy()] = rows.gain.to_numpy(np.int64)
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, low: int = 1, high: int = 1) -> DataFrame:
    """Rows of ``docs`` without text, with n_words, n_features and weight (the sum of the features' gains)."""
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_features", "weight")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__none")).alias("row"), "text")
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for whole in batches:
            for b in slices(whole):
                text, cell, n = feature_buckets(b, low, high, len(gain))
                weight = np.zeros(b.num_rows, np.int64)
                np.add.at(weight, text, gain[cell])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(np.bincount(text, minlength=b.num_rows)), pa.array(weight)], ["row", "n_words", "n_features", "weight"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, n_words long, n_features long, weight long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "n_words", "n_features", "weight")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, from the first 8 hex digits of the SHA-256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the floor(percent * N / 100) highest scores among the N rows
    with ``least_words`` words at least, ties to the smaller doc_id (rows without one last); null for the rest.

    Ranges of the order are ranked apart and shifted by the rows before them, so no task sees all rows."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    table = materialize(scored, "scored")
    able = F.col("n_words") >= least_words
    ranged = materialize(table.where(able).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.floor(percent * F.sum("__n").over(Window.partitionBy()) / 100).alias("__drawn"))
    within = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    rank = (F.col("__k") + F.col("__before")).cast("long")
    done = within.join(F.broadcast(before), "__part").withColumn("rank", F.when(rank <= F.col("__drawn"), rank)).drop("__part", "__k", "__before", "__drawn")
    return done.unionByName(table.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("tie")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, more) without text, with n_words, n_features, weight, score and rank.

    Features are all runs of ``low`` to ``high`` words; counts take all rows of ``docs`` and ``target``
    (text). Null texts have no words: no features, weight 0. A row without a doc_id draws the noise of
    an empty id, rows of one id the same noise; each row is ranked by itself. Columns of ``docs`` named
    like a result are replaced."""
    made = ("n_words", "n_features", "weight", "score", "rank", "tie")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], F.xxhash64("text").alias("tie"))
    gains = bucket_gains(bucket_counts(docs, low, high, buckets), bucket_counts(target, low, high, buckets), buckets)
    scored = weigh(own, gains, low, high).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, percent, least_words)
