"""Benchmark passages in documents, by a prefix-filtered set join; DataFrame functions only.

A window is the set of word shingles of consecutive item words. Containing all of it means
containing its rarest shingle, so with shingles ordered by rarity over all documents the necessary
prefix of a window is one token: only the documents' places of that token meet the window. The token's
place in the window says where the window would have to start and end, which the document's length
bounds, and each start that is left is verified word by word on the item-sized window of the document.

Documents are read once. Their places of item shingles are written to the shared folder with the few
words around them, so that neither counting nor verifying reads a text again. What a document's
shingles are looked up in before that is a bit array of fixed size (a Bloom filter with one hash);
the exact equi-join follows, so its false positives cost space, not results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, and of a shingle (a shorter window is one shingle).
WINDOW, WIDTH = 10, 5
#: 64-bit words of the bit array: 256 KB with every row of documents, whatever the size of the items.
FILTER_WORDS = 1 << 15


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; no words of a null text."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and the same where all code points are of one byte
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _shingles(hashes: Column, n: Column, width: int) -> Column:
    """The shingles of ``width`` words as an array of (pos, h); ``hashes`` are those of the words."""
    h = lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)])
    every = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.struct(i.alias("pos"), h(i).alias("h")))


def item_windows(items: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(item, words, len, width, tokens) of ``items`` (item_id, text): a row per item and distinct window.

    ``tokens`` are the window's shingles as (pos, h). Items are named by their id as a string, an item
    without an id by an empty one; rows of one id are one item. An item without words has no window."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    last = F.greatest(F.lit(0), F.col("n") - window)
    rows = rows.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("words")).distinct()
    rows = rows.select("item", "words", F.size("words").alias("len"), F.least(F.size("words"), F.lit(width)).alias("width"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    tokens = _shingles(F.col("hashes"), F.col("len"), width)
    for k in range(1, width):
        tokens = F.when(F.col("width") == k, _shingles(F.col("hashes"), F.col("len"), k)).otherwise(tokens)
    return rows.select("item", "words", "len", "width", tokens.alias("tokens"))


def _bits(hashes: DataFrame, size: int) -> DataFrame:
    """One row: ``bits``, an array of ``size`` longs in which the bits of the column ``h`` are set."""
    at = hashes.select(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(size - 1)).cast("int").alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    some = at.groupBy("i").agg(F.bit_or("bit").alias("word"))
    every = hashes.sparkSession.range(size).select(F.col("id").cast("int").alias("i")).join(some, "i", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("word", F.lit(0)).alias("word")))).alias("a")).select(F.col("a.word").alias("bits"))


def places(docs: DataFrame, hashes: DataFrame, widths: list[int], window: int = WINDOW, size: int = FILTER_WORDS) -> DataFrame:
    """(row, n_words, pos, h, before, around) for each place in ``docs`` (text, more columns stay) whose
    shingle may be one of ``hashes`` (h), and one row with null ``pos`` for each document.

    ``around`` are the words that any window with that shingle can hold, ``before`` of them before it."""
    rows = docs.withColumns({"row": F.monotonically_increasing_id(), "__w": words(F.col("text"))}).drop("text")
    rows = rows.withColumns({"n_words": F.size("__w").cast("long"), "__h": F.transform("__w", lambda w: F.xxhash64(w))})
    rows = rows.crossJoin(F.broadcast(_bits(hashes, size)))
    hit = lambda x: F.getbit(F.get("bits", F.shiftrightunsigned(x.h, 6).bitwiseAND(F.lit(size - 1)).cast("int")), x.h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def near(k: int) -> Column:
        back = lambda x: F.least(x.pos, F.lit(window - k))
        some = F.filter(_shingles(F.col("__h"), F.size("__w"), k), hit)
        return F.transform(some, lambda x: F.struct(x.pos.alias("pos"), x.h.alias("h"), back(x).alias("before"), F.slice("__w", x.pos - back(x) + 1, back(x) + F.lit(window)).alias("around")))

    own = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("before"), F.lit(None).cast("array<string>").alias("around")))
    rows = rows.withColumn("__found", F.concat(own, *[near(k) for k in widths])).drop("__w", "__h", "bits")
    return rows.select("*", F.explode("__found").alias("__x")).select(*[f"`{c}`" for c in rows.columns if c != "__found"], "__x.*")


def occurrences(places: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, start, len, w) of every window that occurs; ``windows`` have (w, words, len, tokens).

    Shingles are counted over all documents; a window with one that no document has can't occur and
    joins nothing, any other joins the places of its rarest one."""
    token = windows.select("w", F.explode("tokens").alias("t")).select("w", "t.pos", "t.h")
    at = places.where("pos is not null")
    df = at.join(token.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    rarest = token.join(df, "h", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "pos", "h")).alias("t"))
    prefix = rarest.where("t.df > 0").select("w", F.col("t.pos").alias("k"), F.col("t.h").alias("h")).join(windows.select("w", "words", "len"), "w")
    pairs = at.select("row", "n_words", "pos", "h", "before", "around").join(prefix, "h")
    start = F.col("pos") - F.col("k")
    bounded = pairs.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    exact = bounded.where(F.slice("around", F.col("before") - F.col("k") + 1, F.col("len")) == F.col("words"))
    return exact.select("row", start.alias("start"), "len", "w")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without text, with n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A document's
    word is hit if it lies inside an occurrence of any window; ``n_items`` counts the items with
    occurring windows, and ``items_sha256`` is that of their ids as strings, sorted and joined by commas
    (of an empty text if there is none). Null and empty texts have no words. Rows are documents of their
    own, repeated or not; columns of ``docs`` that are named like a result are replaced."""
    if window > 64 or width > window:
        raise ValueError("windows have 64 words at most, and no fewer than a shingle")
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rest = [c for c in docs.columns if c not in ("text", *made)]
    each = materialize(item_windows(items, window, width), "item-windows")
    named = each.groupBy("words").agg(F.first("len").alias("len"), F.first("tokens").alias("tokens")).withColumn("w", F.monotonically_increasing_id())
    named = materialize(named, "windows")
    # one number to five: the shingle widths that occur
    widths = sorted(r.width for r in each.select("width").distinct().collect())
    hashes = named.select(F.explode("tokens.h").alias("h")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__none")).alias("own"), "text")
    found = materialize(places(own, hashes, widths, window), "places")
    hits = materialize(occurrences(found, named), "occurrences")

    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    more = lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, a.to))).cast("long").alias("n"), F.greatest(x.stop, a.to).alias("to"))
    n_hit = spans.select("row", F.aggregate("spans", zero, more, lambda a: a.n).alias("n_hit"))
    of = hits.select("row", "w").distinct().join(named.select("w", "words").join(each.select("item", "words"), "words").select("w", "item"), "w").select("row", "item").distinct()
    listed = of.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))

    out = found.where("pos is null").select("row", "own", "n_words").join(n_hit, "row", "left").join(listed, "row", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(*[F.col("own").getField(c).alias(c) for c in rest], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
