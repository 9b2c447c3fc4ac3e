"""Language identification by rank-order n-gram profiles (out-of-place distance).

Letters are lower-cased; any other character ends a word, and a word is padded with one boundary on
each side. N-grams of one to three letters, with a boundary at one end at most, are counted per
document; a language's profile is the ranking of the most frequent n-grams of all its training
documents. A document's own most frequent n-grams are compared with each profile by the sum of
their distances in rank, an n-gram that a profile lacks counting the largest distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .textops import slices, string_parts

#: N-grams in a profile.
PROFILE = 400
UNKNOWN = "und"
_BITS = np.uint64(21)
_letters: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for what is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def ngrams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row (n-grams in ascending order, their counts); an n-gram is three packed code points."""
    table = _letter_codes()
    data, offs = string_parts(batch.column(batch.schema.get_field_index("text")))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        c = np.zeros(hi - lo + 2, np.uint64)
        c[1:-1] = table[points[lo:hi]]
        full = c > 0
        one, two = c[full], (c[:-1] << _BITS) | c[1:]
        three = (c[:-2] << (_BITS + _BITS)) | two[1:]
        two = two[full[:-1] | full[1:]]
        three = three[full[1:-1] & (full[:-2] | full[2:])]
        grams = np.sort(np.concatenate([one, two + (np.uint64(1) << np.uint64(63)), three]))
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        yield grams[new], np.diff(np.append(new, len(grams)))


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties in ascending order."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def train_profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from (text, lang) rows; null languages teach nothing.

    Counts cover all rows and are summed on the cluster; each language's are ranked by a window whose
    limit Spark applies before the shuffle, so what reaches a task or the driver is about ``size``
    n-grams for each language. A text without a letter teaches nothing, nor does its language's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def merged(parts: list[np.ndarray]) -> list[np.ndarray]:
            g, c = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
            u, at = np.unique(g, return_inverse=True)
            return [u, np.bincount(at, c, len(u)).astype(np.int64)]

        waiting = 0
        for whole in batches:
            for batch in slices(whole):
                for lang, (g, c) in zip(batch.column(1).to_pylist(), ngrams(batch), strict=True):
                    held.setdefault(lang, []).extend((g, c))
                    waiting += len(g)
                if waiting > 500_000:
                    held = {k: merged(v) for k, v in held.items()}
                    waiting = 0
        for lang, parts in held.items():
            g, c = merged(parts)
            for at in range(0, len(g), 10_000):
                n = len(g[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(g[at : at + n].astype(np.int64)), pa.array(c[at : at + n])], ["lang", "gram", "n"])

    counted = labelled.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    summed = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngram-counts")
    # packed n-grams are unsigned: those with the top bit come last, as in a document's own ranking
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    best: dict[str, np.ndarray] = {}
    for lang, g in ranked.select("lang", "gram", "rank").toPandas().groupby("lang"):
        best[lang] = g.sort_values("rank").gram.to_numpy().astype(np.uint64)
    return best


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the share of the largest distance that is saved).

    A null text, one without a letter, or an empty set of profiles gives ``und`` and 0. Among equal
    distances the first language in alphabetical order is taken. Columns of the input that are
    called lang_pred or score are replaced."""
    docs = docs.drop("lang_pred", "score")
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    for j, k in enumerate(langs):
        ranks[np.searchsorted(grams, profiles[k]), j] = np.arange(len(profiles[k]))
    names = [f.name for f in docs.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                label, score = [], []
                for g, c in ngrams(batch):
                    if not len(g) or not langs:
                        label.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    mine = top(g, c, size)
                    at = np.minimum(np.searchsorted(grams, mine), max(len(grams) - 1, 0))
                    at = np.where(grams[at] == mine, at, len(grams))
                    theirs = ranks[at]
                    apart = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
                    k = int(np.argmin(apart))
                    label.append(langs[k])
                    score.append(1.0 - float(apart[k]) / (size * len(mine)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{ddl}, lang_pred string, score double")
