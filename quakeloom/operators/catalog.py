"""Bitemporal catalog: what was known at a time, page reads, quality flags, manifests, ledgers."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from ..plans.ranks import running_rank

#: Entries of a manifest's list that are joined in one string.
LEAF = 4096
#: Most events of a page from which a sample is taken.
SAMPLE_LIMIT = 200_000
# fixed values: source priorities, known magnitude types and accepted depths
PRIORITY = {"csn_daily": 0, "csn_compiled": 1, "usgs": 2}
OTHER_PRIORITY = 100
MAGNITUDE_TYPES = ("m", "mb", "md", "ml", "mlv", "ms", "mw", "mwb", "mwc", "mwr", "mww")
DEPTHS_KM = (-10.0, 800.0)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark stops sorting at it (rank limit below the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def as_of(revisions: DataFrame, moment: Column, key: str = "source_event_key", tie: str = "event_id") -> DataFrame:
    """Latest revision of each source event among those available at ``moment`` (inclusive)."""
    return first_of(revisions.where(F.col("available_at") <= moment), [key], [F.desc("available_at"), F.desc(tie)])


def source_priority(source: Column, priorities: dict[str, int] | None = None) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for name, rank in (priorities or PRIORITY).items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def preferred(members: DataFrame, canonical: str, priority: Column, tie: str = "event_id") -> DataFrame:
    """One member per canonical event: best source, then latest available."""
    return first_of(members, [canonical], [priority.asc(), F.desc("available_at"), F.desc(tie)])


def valid_at(memberships: DataFrame, moment: Column) -> DataFrame:
    """Memberships whose half-open interval holds ``moment``; a null end is open."""
    return memberships.where((F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (moment < F.col("valid_until"))))


def select_events(events: DataFrame, start: Column | None = None, end: Column | None = None, min_magnitude: float | None = None, magnitude_type: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Optional filters: [start, end) in time, magnitude at least (null drops), type, closed
    (south, north, west, east) box."""
    if start is not None:
        events = events.where(F.col("event_time") >= start)
    if end is not None:
        events = events.where(F.col("event_time") < end)
    if min_magnitude is not None:
        events = events.where(F.col("magnitude") >= min_magnitude)
    if magnitude_type is not None:
        events = events.where(F.col("magnitude_type") == magnitude_type)
    if bbox is not None:
        events = events.where(F.col("latitude").between(*bbox[:2]) & F.col("longitude").between(*bbox[2:]))
    return events


def newest(events: DataFrame, limit: int, tie: str = "event_id") -> DataFrame:
    """The newest ``limit`` rows, later ids first among equal times, in no order.

    Ranks come from ranges of the order that are sorted apart, so a limit of any size is not one task's top-k."""
    ranked = running_rank(events.withColumn("__order", F.struct("event_time", tie)), "__order").drop("__order")
    held = ranked.agg(F.max("rank")).first()[0] or 0
    return ranked.where(F.col("rank") > held - limit).drop("rank")


def known_sample(revisions: DataFrame, moment: datetime, start: datetime, end: datetime, magnitude_type: str, canonical: str, priority: Column, min_magnitude: float | None = None, bbox: tuple[float, float, float, float] | None = None, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Preferred revisions as they were known at ``moment``, in [start, end), of one magnitude type.

    Latest revisions come first, then the preferred member of each canonical event, then the filters and the
    newest ``limit`` of what they leave; only then are events without a magnitude or of another type left out,
    so that a sample is part of one page of the catalog. Times are UTC."""
    if start >= end:
        raise ValueError("start must be before end")
    literal = lambda t: F.lit((t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t).isoformat(" ")).cast("timestamp_ntz")
    best = preferred(as_of(revisions, literal(moment)), canonical, priority)
    chosen = newest(select_events(best, literal(start), literal(end), min_magnitude, None, bbox), limit)
    return chosen.where(F.col("magnitude").isNotNull() & (F.col("magnitude_type") == magnitude_type))


def magnitude_sample(*args, **options) -> DataFrame:
    """(event_time, magnitude, magnitude_type) for estimates of completeness; see ``known_sample``."""
    return known_sample(*args, **options).select("event_time", "magnitude", "magnitude_type")


def declustering_sample(*args, min_magnitude: float, **options) -> DataFrame:
    """(event_id, event_time, latitude, longitude, magnitude, magnitude_type) of located events from a least
    magnitude on; see ``known_sample``."""
    located = known_sample(*args, min_magnitude=min_magnitude, **options).where("latitude is not null and longitude is not null")
    return located.select("event_id", "event_time", "latitude", "longitude", "magnitude", "magnitude_type")


def page(events: DataFrame, limit: int = 100, offset: int = 0, tie: str = "event_id") -> DataFrame:
    """Newest first."""
    return events.orderBy(F.desc("event_time"), F.desc(tie)).offset(offset).limit(limit)


def quality_issues(events: DataFrame) -> DataFrame:
    """One row (event_id, flag, severity) per issue of an event, in one pass."""
    low, high = DEPTHS_KM
    rules = [
        ("missing_depth", "warning", F.col("depth_km").isNull()),
        ("implausible_depth", "error", ~F.col("depth_km").between(low, high)),
        ("missing_magnitude", "warning", F.col("magnitude").isNull()),
        ("unknown_magnitude_type", "warning", F.col("magnitude_type").isNull() | ~F.col("magnitude_type").isin(*MAGNITUDE_TYPES)),
        ("location_uncertainty_unknown", "info", F.col("location_uncertainty_km").isNull() if "location_uncertainty_km" in events.columns else F.lit(True)),
        ("magnitude_uncertainty_unknown", "info", F.col("magnitude_uncertainty").isNull() if "magnitude_uncertainty" in events.columns else F.lit(True)),
    ]
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(flag).alias("flag"), F.lit(severity).alias("severity"))) for flag, severity, bad in rules))
    return events.select("event_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("event_id", "i.flag", "i.severity")


def revision_hash(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON in the order of their names, so that it does not depend on the
    frame's column order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def append_if_absent(new: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not held yet, one per key; a null equals a null."""
    fresh, old = new.dropDuplicates(keys).alias("n"), held.select(*keys).distinct().alias("o")
    return fresh.join(old, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_anti")


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot after an upsert: values of ``new`` where it has the key, else those held."""
    old, fresh = held.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = old.join(fresh, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    return joined.select(*(F.when(F.col("n.__new"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in held.columns))


def manifest(events: DataFrame, as_of_text: str, leaf: int = LEAF) -> DataFrame:
    """(source_id, revisions, digest) per source, as frozen into a dataset.

    The digest is the SHA-256 of the as-of text, a bar and the sorted ids joined by commas. With more than
    ``leaf`` ids, each run of ``leaf`` of them is first replaced by the SHA-256 of its own list, as often as
    it takes to have ``leaf`` entries at most (a Merkle root), so that no task holds more than one run.
    Ids are placed by ranges of the order of (source_id, event_id). Rows without an id are counted in
    ``revisions`` only."""
    sizes = events.groupBy("source_id").agg(F.count("*").alias("revisions"))
    ids = events.where("event_id is not null").select("source_id", F.col("event_id").cast("string").alias("entry"), F.struct("source_id", "event_id").alias("o"))
    rows = running_rank(ids, "o").drop("o")
    while True:
        first = rows.groupBy("source_id").agg(F.min("rank").alias("first"), F.count("*").alias("entries"))
        placed = rows.alias("r").join(first.alias("f"), F.col("r.source_id").eqNullSafe(F.col("f.source_id"))).select("r.source_id", "entry", (F.col("rank") - F.col("first")).alias("place"), "entries")
        rows = placed.where(F.col("entries") <= leaf).select("source_id", "entry", F.col("place").alias("rank"))
        large = placed.where(F.col("entries") > leaf)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda e: e.entry), ",")
        small = large.groupBy("source_id", F.floor(F.col("place") / leaf).alias("rank")).agg(F.sha2(joined, 256).alias("entry"))
        rows = materialize(rows.unionByName(small), "manifest")
        if rows.groupBy("source_id").count().where(F.col("count") > leaf).isEmpty():
            break
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda e: e.entry), ",")
    digest = rows.groupBy("source_id").agg(entries.alias("entries"))
    out = sizes.alias("a").join(digest.alias("b"), F.col("a.source_id").eqNullSafe(F.col("b.source_id")), "left")
    return out.select("a.source_id", "revisions", F.sha2(F.concat(F.lit(as_of_text + "|"), F.coalesce("entries", F.lit(""))), 256).alias("digest"))


def summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count("magnitude").alias("with_magnitude"), F.min("magnitude").alias("least"), F.max("magnitude").alias("most"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))


def freshness(issued: Column, start: Column, end: Column, now: Column, interval_seconds: float) -> Column:
    """State of the latest forecast: missing, future_issuance, expired, stale or fresh."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(issued.cast("timestamp"))) / 1e6
    valid = (start <= now) & (now < end)
    return F.when(issued.isNull(), "missing").when(age < 0, "future_issuance").when(~valid, "expired").when(age > 2 * interval_seconds, "stale").otherwise("fresh")
