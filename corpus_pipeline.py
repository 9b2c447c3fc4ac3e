"""From raw documents to packed training sequences: five stages, each kept as a table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import langid, linededup, minhash, packing, quality
from quakeloom.llm.queries import table, tokenizer_path, train_languages, train_quality
from quakeloom.plans.checkpointing import discard, materialize

#: Least quality score that stays.
QUALITY = 0.3
#: Most rows of an Arrow batch. Spark's 10,000 whole documents are tens of megabytes for each task, in
#: the JVM and again in its Python worker.
BATCH_ROWS = 500
#: Most bytes of one, about: rows may be long texts or sums of vectors.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Columns that the operators add, and replace where a table has some of its own.
ADDED = ("lang_pred", "score", "n_lines", "n_dropped")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches have ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at most. Its
    result is computed when it is written, so the settings stay; ``run`` sets them back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(_BATCH))
        spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        spark.conf.set(_BYTES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def own_columns(stage: Stage) -> Stage:
    """The stage on a table whose columns named like an operator's results keep their values."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clash = {c: f"__own_{c}" for c in ADDED if c in docs.columns}
        out = stage(spark, docs.withColumnsRenamed(clash), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in clash.items()})

    return run


@small_batches
@own_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or without a letter go."""
    found = langid.identify(docs, train_languages(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


@small_batches
@own_columns
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 at least."""
    vectors, net = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, vectors, net).where(F.col("score") >= QUALITY).select(docs.columns)


@small_batches
@own_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(docs.columns)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with
    the smallest doc_id. Copies that differ in every few words share more two-word shingles than
    five-word ones, so those that ``op5_minhash_join`` links are not all near copies here. Different texts under one doc_id, or under none, are different documents; of
    rows with equal id and text one stays."""
    return minhash.drop_near_duplicates(docs)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their token ids, packed into windows of 2048."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("packing", pack),
]
#: The language, quality and packing stages learn, hash or search; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again, and
    what it was made from is removed once nothing reads it."""
    docs, before = table(spark, sf_dir, "documents"), {k: spark.conf.get(k) for k in (_BATCH, _BYTES)}
    try:
        for k, (_, stage) in enumerate(STAGES):
            made = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
            discard(docs)
            docs = made
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return docs
