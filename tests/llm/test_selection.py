"""Fill-in-middle, decontamination and importance resampling against brute force and edge cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quakeloom.llm import contamination, infill, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    (1, "def f(x):\n    return x + 1\n"),
    (2, ""),
    (3, None),
    (4, "has <S> inside"),
    (5, "é𝄞 abc, ГД ñ" * 40),
    (6, "a"),
    (7, "word " * 30_000),
    (8, "x" * 200_000),
    (9, "<" * 50 + "P>S>" * 10),
    (None, "no id here, some words"),
    (1, "def f(x):\n    return x + 1\n"),
    (11, "ends with <"),
    *[(100 + k, f"text {k} " * (k % 9 + 1)) for k in range(60)],
]


def brute_infill(doc_id, text, plain=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("frame", [7, 64, 1 << 16])
def test_infill(spark, frame):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("form", F.lit("mine")).withColumn("k", F.lit(3))
    made = infill.transform(infill.plan_cuts(infill.store(docs, frame_bytes=frame)), frame_bytes=frame)
    got = infill.restore(made.withColumn("out", infill.output_text(F.col("output")))).collect()
    assert len(got) == len(TEXTS) and {r.k for r in got} == {3}
    want = sorted(((i, *brute_infill(i, t), t or "") for i, t in TEXTS), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.out, r.text) for r in got), key=str) == want
    assert all(r.output_sha256 == hashlib.sha256(r.out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_frames_are_independent_and_selective():
    text = "".join(f"w{'abcdefghij'[k % 10]} é{k}\n" for k in range(5000)).encode()
    raw = np.frombuffer(text, np.uint8)
    starts = infill.unit_starts(raw, np.array([0, len(raw)]))
    frames = infill._packed(raw, starts, 1000, infill.zstandard.ZstdCompressor())
    f = infill.Frames(frames)
    opened, real = [], f.frame
    f.frame = lambda k: opened.append(k) or real(k)
    for unit in (0, 1, 777, 12_345, len(starts) - 1, len(starts)):
        opened.clear()
        at = int(starts[unit]) if unit < len(starts) else len(text)
        assert f.place(unit) == (at, len(text[:at].decode())) and len(opened) <= 1
    opened.clear()
    assert b"".join(f.stream(1500, 2500)) == text[1500:2500] and set(opened) <= {1, 2}
    for k, one in enumerate(frames["data"]):  # any frame alone
        assert infill.zstandard.ZstdDecompressor().decompress(one) == text[frames["bytes"][k] : frames["bytes"][k + 1]]


def test_infill_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.transform(infill.plan_cuts(infill.store(none)))).count() == 0


def brute_hits(docs, items, window=10):
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = low(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, named = low(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def random_corpus(seed=3):
    r = np.random.default_rng(seed)
    words = lambda n: " ".join(r.choice(["Alpha", "beta", "Γamma", "d3lta", "eps", "zeta", "ÉTA", "theta"], n))
    items = [(k, words(int(n))) for k, n in enumerate(r.integers(1, 40, 25))]
    items += [(25, items[0][1]), (None, words(12)), (26, ""), (27, None), (28, "one two"), (29, "lonely"), (3, words(15)), (30, "..., !")]
    docs = [(k, words(int(n))) for k, n in enumerate(r.integers(0, 120, 40))]
    docs += [(50 + k, f"{words(9)}; {t},{words(3)}") for k, (_, t) in enumerate(items) if t]
    docs += [(90, None), (91, ""), (None, items[5][1].upper()), (92, "ONE two lonely One-Two"), (93, (items[7][1] + " ") * 200), (50, docs[0][1]), (50, docs[0][1]), (94, items[2][1].replace("É", "é"))]
    return docs, items


@pytest.mark.parametrize("window,width", [(10, 5), (10, 1), (4, 4), (13, 5)])
def test_decontamination(spark, window, width):
    docs, items = random_corpus()
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("mine")).withColumn("w", F.lit(1))
    got = contamination.contaminated(left, spark.createDataFrame(items, "item_id long, text string"), window, width)
    assert got.columns == ["doc_id", "w", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.drop("w").collect()), key=str) == brute_hits(docs, items, window)


def test_decontamination_with_a_full_filter(spark, monkeypatch):
    """A bit array of 64 bits lets nearly all shingles pass; the results stay."""
    docs, items = random_corpus(5)
    real = contamination.places
    monkeypatch.setattr(contamination, "places", lambda *a: real(*a, size=1))
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(docs, items)


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id string, text string")
    assert contamination.contaminated(docs.limit(0), items).count() == 0
    r = contamination.contaminated(docs, items.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False) and r.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_decontamination_plan_has_no_python(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    found = contamination.places(docs, items.select(F.xxhash64("text").alias("h")), [2, 5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_substring_crcs():
    r = np.random.default_rng(1)
    for n in (0, 1, resampling.LANE - 1, resampling.LANE, resampling.LANE + 1, 70_000):
        data = r.integers(0, 256, n).astype(np.uint8)
        a, b = np.sort(r.integers(0, n + 1, (2, 100)), axis=0)
        got = resampling.substring_crcs(resampling.prefix_registers(data), a, b)
        assert got.tolist() == [zlib.crc32(data[x:y].tobytes()) for x, y in zip(a, b, strict=True)]


def brute_resample(docs, target, low, high, buckets, percent=10, least=20, seed=2024):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def cells(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(low, high + 1) for k in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for rows, total in ((docs, s), (target, t)):
        for _, text in rows:
            np.add.at(total, cells(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c] for c in cells(text))
        out.append([doc_id, len(words(text)), len(cells(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("low,high,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 97, 35), (2, 2, 1000, 100)])
def test_resampling(spark, low, high, buckets, percent):
    docs, items = random_corpus(9)
    docs = [d for k, d in enumerate(docs) if d not in docs[:k]]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("mine")).withColumn("row", F.lit(1))
    got = resampling.resample(left, spark.createDataFrame(items, "item_id long, text string"), percent, low, high, buckets)
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert rows == brute_resample(docs, items, low, high, buckets, percent) and "row" in got.columns


def test_resampling_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)] * 40 + [(None, "d e f " * 10)] * 10 + [(2, None), (3, "")], "doc_id long, text string")
    target = spark.createDataFrame([("a b",), (None,)], "text string")
    got = resampling.resample(docs, target, percent=50)
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 26))
    assert [tuple(r) for r in got.where("doc_id in (2, 3)").select("n_features", "weight", "rank").collect()] == [(0, 0, None)] * 2
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0), percent=50).where("rank is not null").count() == 25


def test_normalised_words():
    batch = pa.record_batch([pa.array(["Ab,cd  E", None, "", "éA9-ß!", "  x"])], ["text"])
    data, offs = resampling.string_parts(batch.column(0))
    flat, starts, ends, first = resampling.normalised(data, offs)
    assert [flat[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "e", "éa9", "ß", "x"]
    assert first.tolist() == [0, 3, 3, 3, 5, 6] and flat.tobytes().decode() == "ab cd e éa9 ß x "
