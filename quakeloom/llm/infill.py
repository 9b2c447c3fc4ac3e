"""Fill-in-middle over seekable compressed texts.

``store`` cuts each whole text into independent zstandard frames and keeps, for every frame, the units
(``[A-Za-z]+|[^A-Za-z]``), code points and bytes before it. ``transform`` reads such frames: a cut at
unit k lies in the frame whose counts enclose k, so that only the frames with a cut are decompressed to
find its place; the pieces are then streamed frame by frame, in the order of the output, into new
frames and their digest. ``restore`` streams output frames back into the order of the text: the places
of the three marks come from one pass over the frames, and each part is read from its own frames.

A text is in memory whole only where Spark's row holds it. Cuts and forms are column expressions of
the id's SHA-256.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import slices, string_parts

#: Text bytes of a frame, about; a frame ends where a unit ends, so a run of letters is never cut.
FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = r"<[PSM]>"

#: Of each frame the counts before it; one more entry holds the totals.
FRAMES = "struct<data: array<binary>, units: array<bigint>, chars: array<bigint>, bytes: array<bigint>>"

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 texts start: at runs of ASCII letters, and at every other code point."""
    letter = _LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[:-1]
    inside[offs[:-1][offs[:-1] < len(data)]] = False
    return np.flatnonzero(_LEAD[data] & ~(letter & inside))


def _packed(raw: np.ndarray, starts: np.ndarray, size: int, press: zstandard.ZstdCompressor) -> dict:
    """One text as frames that start at units."""
    cuts, at = [0], 0
    while len(raw) - at > size:
        k = int(np.searchsorted(starts, at + size))
        if k == len(starts):
            break
        at = int(starts[k])
        cuts.append(at)
    cuts.append(len(raw))
    units = np.searchsorted(starts, cuts)
    chars = [0]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        chars.append(chars[-1] + int(_LEAD[raw[lo:hi]].sum()))
    return {"data": [press.compress(raw[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)], "units": units.tolist(), "chars": chars, "bytes": cuts}


_FRAMES_TYPE = pa.struct([("data", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64()))])


def store(docs: DataFrame, text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``frames`` in place of their text, and ``n`` units and ``marked``.

    A null text is stored as an empty one: one frame without bytes. ``marked`` tells whether a mark
    (``<P>``, ``<S>`` or ``<M>``) stands in the text. Other columns stay as they are, but for those
    named frames, n or marked, which are replaced."""
    rest = [c for c in docs.columns if c not in (text, "frames", "n", "marked")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__none")).alias("row"), whole.alias("text"), whole.rlike(_MARK).alias("marked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(whole):
                data, offs = string_parts(b.column(1))
                starts = unit_starts(data, offs)
                first = np.searchsorted(starts, offs)
                made = [_packed(data[lo:hi], starts[i:j] - lo, frame_bytes, press) for lo, hi, i, j in zip(offs, offs[1:], first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, _FRAMES_TYPE), pa.array(np.diff(first), pa.int64()), b.column(2)], ["row", "frames", "n", "marked"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, frames {FRAMES}, n bigint, marked boolean")
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "frames", "n", "marked")


def plan_cuts(stored: DataFrame, doc_id: str = "doc_id", plain: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """``stored`` with ``form`` (plain, psm, spm) and the units ``lo`` <= ``hi`` where it is cut.

    h1 to h4 are the first four groups of eight hex digits of the SHA-256 of ``seed:id`` (nothing after
    the colon for a null id). Cuts are h1 and h2 modulo n + 1; a text is plain if it is empty or holds
    a mark, or if h3 % 100 >= ``plain``; spm if h4 % 100 < ``spm``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("__digest", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    cut = [h[k] % (F.col("n") + 1) for k in range(2)]
    bare = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= plain)
    rows = stored.withColumn("__digest", digest)
    return rows.withColumns({"form": F.when(bare, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"), "lo": F.least(*cut), "hi": F.greatest(*cut)}).drop("__digest")


class Frames:
    """Random access to one text that is stored as frames; holds one decompressed frame at a time."""

    def __init__(self, frames: dict):
        self.data, self.units, self.chars, self.bytes = frames["data"], frames["units"], frames["chars"], frames["bytes"]
        self._open, self._held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, self._open.decompress(self.data[k], max_output_size=max(1, self.bytes[k + 1] - self.bytes[k])))
        return self._held[1]

    def place(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before a unit; only the frame that holds the unit is decompressed."""
        if unit >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        k = bisect_right(self.units, unit) - 1
        if unit == self.units[k]:
            return self.bytes[k], self.chars[k]
        raw = np.frombuffer(self.frame(k), np.uint8)
        at = int(unit_starts(raw, np.array([0, len(raw)]))[unit - self.units[k]])
        return self.bytes[k] + at, self.chars[k] + int(_LEAD[raw[:at]].sum())

    def stream(self, lo: int, hi: int) -> Iterator[bytes]:
        """The bytes from ``lo`` to ``hi``, frame by frame."""
        k = max(0, bisect_right(self.bytes, lo) - 1)
        while k < len(self.data) and self.bytes[k] < hi:
            raw = self.frame(k)
            yield raw[max(0, lo - self.bytes[k]) : hi - self.bytes[k]]
            k += 1

    def marks(self) -> list[tuple[int, bytes]]:
        """(place, mark) of every mark, in order, also where it runs across frames."""
        found, tail, at = [], b"", 0
        for k in range(len(self.data)):
            raw = tail + self.frame(k)
            base, seen = at - len(tail), 0
            while (seen := raw.find(b"<", seen)) >= 0:
                if raw[seen : seen + 3] in (PREFIX, SUFFIX, MIDDLE):
                    found.append((base + seen, raw[seen : seen + 3]))
                seen += 1
            at += len(self.frame(k))
            tail = raw[-2:]
        return found


def _reframe(chunks: Iterator[bytes], size: int, press: zstandard.ZstdCompressor) -> tuple[dict, str]:
    """New frames of streamed bytes, cut at code points, and the SHA-256 of all of them.

    Counts of units hold within frames only where frames start at units; outputs are read by bytes,
    so theirs are left out."""
    digest, frames, held = hashlib.sha256(), {"data": [], "units": [], "chars": [0], "bytes": [0]}, bytearray()

    def close(to: int) -> None:
        raw = bytes(held[:to])
        digest.update(raw)
        frames["data"].append(press.compress(raw))
        frames["bytes"].append(frames["bytes"][-1] + to)
        frames["chars"].append(frames["chars"][-1] + int(_LEAD[np.frombuffer(raw, np.uint8)].sum()))
        del held[:to]

    for chunk in chunks:
        held += chunk
        while len(held) > size + 3:
            to = size
            while 0x80 <= held[to] < 0xC0:
                to += 1
            close(to)
    close(len(held))
    return frames, digest.hexdigest()


def _parts(text: Frames, form: str, lo: int | None, hi: int | None) -> tuple[Iterator[bytes], int | None, int | None]:
    """The output as a stream, and the code points of prefix and middle."""
    end = text.bytes[-1]
    if form == "plain":
        return text.stream(0, end), None, None
    (a, before_a), (b, before_b) = text.place(lo), text.place(hi)

    def run() -> Iterator[bytes]:
        order = [(PREFIX, 0, a), (SUFFIX, b, end)] if form == "psm" else [(SUFFIX, b, end), (PREFIX, 0, a)]
        for mark, x, y in [*order, (MIDDLE, a, b)]:
            yield mark
            yield from text.stream(x, y)

    return run(), before_a, before_b - before_a


def transform(planned: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Rows of ``plan_cuts`` with ``output`` frames, ``output_sha256``, ``prefix_chars`` and ``middle_chars``.

    psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
    and plain the text as it is, with null counts. ``frames``, ``lo`` and ``hi`` are used up."""
    rest = [c for c in planned.columns if c not in ("frames", "form", "lo", "hi", "output", "output_sha256", "prefix_chars", "middle_chars")]
    rows = planned.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__none")).alias("row"), "form", "lo", "hi", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in _portions(whole, 4):
                made = []
                for form, lo, hi, frames in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                    chunks, prefix, middle = _parts(Frames(frames), form, lo, hi)
                    made.append((*_reframe(chunks, frame_bytes, press), prefix, middle))
                output, digest, prefix, middle = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, _FRAMES_TYPE), pa.array(digest)], ["row", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, form string, prefix_chars bigint, middle_chars bigint, output {FRAMES}, output_sha256 string")
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "form", "prefix_chars", "middle_chars", "output", "output_sha256")


def _restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text of an output: its parts between the marks, in the order of the text."""
    end = output.bytes[-1]
    if form == "plain":
        yield from output.stream(0, end)
        return
    at = {mark: place for place, mark in output.marks()}
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    part = {first: (at[first] + 3, at[second]), second: (at[second] + 3, at[MIDDLE]), MIDDLE: (at[MIDDLE] + 3, end)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*part[mark])


def restore(made: DataFrame, text: str | None = "text") -> DataFrame:
    """Rows of ``transform`` without ``output``, with ``restored_sha256`` and, unless ``text`` is None, the
    text itself, rebuilt from output and form alone."""
    rest = [c for c in made.columns if c not in ("output", "restored_sha256", text)]
    rows = made.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "form", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _portions(whole, 2):
                digests, texts = [], []
                for form, frames in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    digest, chunks = hashlib.sha256(), []
                    for chunk in _restored(Frames(frames), form):
                        digest.update(chunk)
                        if text is not None:
                            chunks.append(chunk)
                    digests.append(digest.hexdigest())
                    texts.append(b"".join(chunks).decode())
                more = [] if text is None else [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests), *more], ["row", "restored_sha256", *["restored"] * len(more)])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, restored_sha256 string" + ("" if text is None else ", restored string"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "restored_sha256", *([] if text is None else [F.col("restored").alias(text)]))


def output_text(output: Column) -> Column:
    """The whole output as a string, for those who train on it."""

    def run(column):
        import pandas as pd

        return pd.Series([b"".join(Frames(f).stream(0, f["bytes"][-1])).decode() for f in column.to_dict("records")])

    return F.pandas_udf(run, "string")(output)


def _portions(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text in frames, one row at least."""
    sizes = [x[-1] for x in batch.column(column).field("bytes").to_pylist()]
    at = 0
    while at < len(sizes):
        to, held = at + 1, sizes[at]
        while to < len(sizes) and held + sizes[to] <= limit:
            held, to = held + sizes[to], to + 1
        yield batch.slice(at, to - at)
        at = to
