"""Reading an event service that answers bounded queries only.

The service takes a time range, a box and a least magnitude, says how many events that are, and
returns them as a feature collection; it refuses more than a fixed number at once. ``BoundedEvents`` is
a Spark data source over it. Filters on time, position and magnitude become parameters of the query, the
time range is halved until each slice is small enough, and each slice is one partition, fetched by one
task. ``backfill`` keeps a ledger of slices: one that fails is written down with its error while the
others go on, and a later run fetches open slices only.

Services are reached by URL. ``FolderService`` answers from a folder of features that Spark has written
(``write_feed``), on any file system that Arrow can open; others are named by ``module:Class``.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime, timedelta
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.catalog import append_if_absent
from ..plans.checkpointing import materialize

#: Most events of one answer; of a planned slice, which leaves room for events that arrive meanwhile.
MAX_RESULTS, SLICE_RESULTS = 20_000, 15_000
MIN_SLICE = timedelta(hours=6)
RETRIES, BACKOFF_S = 3, 2.0
#: South, north, west, east; closed.
BOUNDS = (-60.0, -15.0, -82.0, -62.0)

EVENT = "source_event_id string, event_time timestamp, source_updated_at timestamp, latitude double, longitude double, depth_km double, magnitude double, magnitude_type string, place string"
SCHEMA = f"{EVENT}, slice_start timestamp, slice_end timestamp, status string, events long, error string"
_ARROW = pa.schema([("source_event_id", pa.string()), *[(k, pa.timestamp("us", "UTC")) for k in ("event_time", "source_updated_at")], *[(k, pa.float64()) for k in ("latitude", "longitude", "depth_km", "magnitude")], ("magnitude_type", pa.string()), ("place", pa.string()), ("slice_start", pa.timestamp("us", "UTC")), ("slice_end", pa.timestamp("us", "UTC")), ("status", pa.string()), ("events", pa.int64()), ("error", pa.string())])


@dataclass(frozen=True)
class Query:
    """Events of ``[start, end)`` inside the box, at or above a magnitude (None: any, or none known)."""

    start: datetime
    end: datetime
    south: float = BOUNDS[0]
    north: float = BOUNDS[1]
    west: float = BOUNDS[2]
    east: float = BOUNDS[3]
    min_magnitude: float | None = None

    def parameters(self) -> dict[str, str | float]:
        named = {"format": "geojson", "starttime": self.start.isoformat(), "endtime": self.end.isoformat(), "minlatitude": self.south, "maxlatitude": self.north, "minlongitude": self.west, "maxlongitude": self.east, "orderby": "time-asc"}
        return named if self.min_magnitude is None else named | {"minmagnitude": self.min_magnitude}


def parse_count(answer: str) -> int:
    """The number in a count's answer: bare, or as ``{"count": n}``."""
    text = answer.strip()
    if not text.startswith("{"):
        return int(text)
    n = json.loads(text).get("count")
    if not isinstance(n, int) or isinstance(n, bool):
        raise ValueError("the count's answer holds no integer count")
    return n


class FolderService:
    """Answers queries from ``features/slot=<n>/*.txt`` (a feature a line) and ``index`` (a slot a line) under a URL.

    Counts of whole slots come from the index, which knows magnitudes by tenths and no positions, so a
    count is never below the number of events. The index is read once, and the slots that a count cuts are
    remembered for the next one, which often cuts them too."""

    def __init__(self, url: str):
        self.fs, self.root = fs.FileSystem.from_uri(url)
        self._slots: dict[int, dict[int, dict]] | None = None
        self._sums: dict[float | None, dict[int, tuple[list[int], list[int]]]] = {}
        self._cut: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _lines(self, folder: str) -> Iterator[bytes]:
        chosen = fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True)
        for f in self.fs.get_file_info(chosen):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                with self.fs.open_input_stream(f.path) as stream:
                    yield from stream.read().splitlines()

    def _index(self) -> dict[int, dict[int, dict]]:
        """Rows of the index by width and number of their slots."""
        if self._slots is None:
            self._slots = {}
            for row in map(json.loads, self._lines("index")):
                self._slots.setdefault(row["seconds"], {})[row["slot"]] = row
        return self._slots

    def _before(self, low: float | None) -> dict[int, tuple[list[int], list[int]]]:
        """For each width, its slots in order and the number of events at or above ``low`` before each."""
        if low not in self._sums:
            self._sums[low] = {}
            for width, slots in self._index().items():
                order = sorted(slots)
                held = (sum(n for m, n in zip(slots[k]["tenths"], slots[k]["n"], strict=True) if low is None or m is not None and m >= low) for k in order)
                self._sums[low][width] = order, [0, *accumulate(held)]
        return self._sums[low]

    def _times(self, width: int, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """Times in milliseconds and magnitudes in tenths (NaN: none) of a slot's features."""
        if (width, slot) not in self._cut:
            known = [f["properties"] for f in map(json.loads, self._lines(f"features/slot={slot}"))]
            tenths = [math.nan if p["mag"] is None else math.floor(p["mag"] * 10) for p in known]
            self._cut[width, slot] = np.array([p["time"] for p in known], float), np.array(tenths, float)
            if len(self._cut) > 8:
                self._cut.popitem(last=False)
        return self._cut[width, slot]

    def count(self, q: Query) -> str:
        low = None if q.min_magnitude is None else math.floor(q.min_magnitude * 10)
        lo, hi = q.start.timestamp(), q.end.timestamp()
        n = 0
        for width, (order, before) in self._before(low).items():
            first, last = math.ceil(lo / width), math.floor(hi / width)  # whole slots, from the first to before the last
            if first < last:
                n += before[bisect_left(order, last)] - before[bisect_left(order, first)]
            for slot in {math.floor(lo / width), math.floor(hi / width)}:
                if slot in self._index()[width] and not (first <= slot < last) and slot * width < hi:
                    t, tenths = self._times(width, slot)
                    inside = (t >= lo * 1000) & (t < hi * 1000)
                    n += int((inside if low is None else inside & (tenths >= low)).sum())
        return json.dumps({"count": n, "maxAllowed": MAX_RESULTS})

    def _inside(self, slot: int, q: Query) -> Iterator[dict]:
        lo, hi = q.start.timestamp() * 1000, q.end.timestamp() * 1000
        for feature in map(json.loads, self._lines(f"features/slot={slot}")):
            if lo <= feature["properties"]["time"] < hi:
                yield feature

    def fetch(self, q: Query) -> bytes:
        found = []
        for width, slots in self._index().items():
            for slot in range(math.floor(q.start.timestamp() / width), math.ceil(q.end.timestamp() / width)):
                for f in self._inside(slot, q) if slot in slots else ():
                    lon, lat = f["geometry"]["coordinates"][:2]
                    mag = f["properties"]["mag"]
                    if q.south <= lat <= q.north and q.west <= lon <= q.east and (q.min_magnitude is None or mag is not None and mag >= q.min_magnitude):
                        found.append(f)
        found.sort(key=lambda f: f["properties"]["time"])
        return json.dumps({"type": "FeatureCollection", "features": found}).encode()


def write_feed(events: DataFrame, url: str, seconds: int = 86_400) -> None:
    """Writes ``events`` (event_id, event_time, available_at, latitude, longitude, depth_km, magnitude,
    magnitude_type) as the folder that a ``FolderService`` answers from. Times are in milliseconds.

    A slot of ``seconds`` is one file; a service reads whole slots, so dense catalogs want short ones."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    place = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", "depth_km").alias("coordinates"))
    known = F.struct(F.col("magnitude").alias("mag"), ms("event_time").alias("time"), ms("available_at").alias("updated"), F.col("magnitude_type").alias("magType"), F.lit(None).cast("string").alias("place"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("event_id").cast("string").alias("id"), known.alias("properties"), place.alias("geometry")), {"ignoreNullFields": "false"})
    rows = events.select(F.floor(ms("event_time") / (seconds * 1000)).alias("slot"), F.floor(F.col("magnitude") * 10).alias("tenths"), feature.alias("value")).where("slot is not null")
    rows.select("slot", "value").repartition("slot").write.mode("append").partitionBy("slot").text(f"{url}/features")
    counts = rows.groupBy("slot", "tenths").agg(F.count("*").alias("n")).groupBy("slot").agg(F.collect_list(F.struct("tenths", "n")).alias("c"))
    line = F.struct("slot", F.lit(seconds).alias("seconds"), F.col("c.tenths").alias("tenths"), F.col("c.n").alias("n"))
    counts.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("append").text(f"{url}/index")


def plan_slices(count, whole: Query, most: int = SLICE_RESULTS, least: timedelta = MIN_SLICE) -> list[Query]:
    """``whole`` halved in time until ``count`` of each part is at most ``most``; parts cover it without gap
    or overlap. One that is too full at the least length is an error, never cut short."""
    if whole.start >= whole.end:
        raise ValueError("the start must lie before the end")
    n = count(whole)
    if n <= most:
        return [whole]
    if whole.end - whole.start <= least:
        raise RuntimeError(f"{whole.start.isoformat()} to {whole.end.isoformat()} holds {n} events at the least length of a slice; it can't be halved further")
    middle = whole.start + (whole.end - whole.start) / 2
    return plan_slices(count, replace(whole, end=middle), most, least) + plan_slices(count, replace(whole, start=middle), most, least)


@dataclass
class Slice(InputPartition):
    query: Query


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        number = lambda k: float(options[k]) if options.get(k) not in (None, "") else None
        box = [float(x) for x in options.get("bounds", ",".join(map(str, BOUNDS))).split(",")]
        self.query = Query(_utc(datetime.fromisoformat(options["start"])), _utc(datetime.fromisoformat(options["end"])), *box, number("min_magnitude"))
        self.isolate = options.get("isolate", "false") == "true"

    def _service(self):
        module, _, name = self.options.get("service", f"{__name__}:FolderService").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["url"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what the service can evaluate as it is: time in [start, end), closed box, least magnitude.

        A filter that only narrows the query (an open bound where the service's is closed) narrows it and
        is left to Spark too. In a backfill slices are part of the ledger's key, so nothing is taken over."""
        for f in filters:
            if self.isolate or not self._narrow(f):
                yield f

    def _narrow(self, f: Filter) -> bool:
        """Narrows the query by ``f``; whether the service then does all of it."""
        q, column = self.query, ".".join(getattr(f, "attribute", ()))
        lower, upper = isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
        if column == "event_time" and (lower or upper):
            tick = timedelta(microseconds=1)
            start = max(q.start, _utc(f.value)) if lower else q.start
            end = min(q.end, _utc(f.value) + (tick if isinstance(f, (LessThanOrEqual, EqualTo)) else timedelta())) if upper else q.end
            self.query = replace(q, start=start, end=max(end, start))
            return isinstance(f, (GreaterThanOrEqual, LessThan))
        if column == "magnitude" and lower and q.min_magnitude is None:
            self.query = replace(q, min_magnitude=float(f.value))
            return isinstance(f, GreaterThanOrEqual)
        if column == "magnitude" and lower:
            self.query = replace(q, min_magnitude=max(q.min_magnitude, float(f.value)))
            return isinstance(f, GreaterThanOrEqual)
        sides = {"latitude": ("south", "north"), "longitude": ("west", "east")}.get(column)
        if sides and (lower or upper):
            if lower:
                self.query = replace(self.query, **{sides[0]: max(getattr(self.query, sides[0]), float(f.value))})
            if upper:
                self.query = replace(self.query, **{sides[1]: min(getattr(self.query, sides[1]), float(f.value))})
            return not isinstance(f, (GreaterThan, LessThan))
        return False

    def _done(self) -> set[tuple]:
        """Keys of the slices that the ledger shows as fetched."""
        if not self.options.get("ledger"):
            return set()
        where, root = fs.FileSystem.from_uri(self.options["ledger"])
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return set()
        rows = pyarrow.dataset.dataset(root, filesystem=where, format="parquet").to_table(columns=["key", "status"]).to_pylist()
        return {r["key"] for r in rows if r["status"] == "succeeded"}

    def partitions(self) -> list[Slice]:
        if self.query.start >= self.query.end:
            return []
        service = self._service()
        most, least = int(self.options.get("slice_results", SLICE_RESULTS)), timedelta(hours=float(self.options.get("min_slice_hours", MIN_SLICE / timedelta(hours=1))))
        planned = plan_slices(lambda q: parse_count(service.count(q)), self.query, most, least)
        done = self._done()
        return [Slice(q) for q in planned if slice_key(q) not in done]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        q, retries, backoff = partition.query, int(self.options.get("retries", RETRIES)), float(self.options.get("backoff_s", BACKOFF_S))
        for attempt in range(1, retries + 1):
            try:
                rows = self._fetched(q)
                break
            except Exception as e:  # a query too large stays so: no retry
                if attempt < retries and not isinstance(e, TooMany):
                    time.sleep(backoff * attempt)
                elif self.isolate:
                    yield self._batch([{"slice_start": q.start, "slice_end": q.end, "status": "failed", "error": str(e)[:2000]}])
                    return
                else:
                    raise
        if self.isolate:
            rows.append({"slice_start": q.start, "slice_end": q.end, "status": "succeeded", "events": len(rows)})
        for lo in range(0, len(rows), 10_000):
            yield self._batch(rows[lo : lo + 10_000])

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: r.get(k) for k in _ARROW.names} for r in rows], schema=_ARROW)

    def _fetched(self, q: Query) -> list[dict]:
        service, most = self._service(), int(self.options.get("max_results", MAX_RESULTS))
        n = parse_count(service.count(q))
        if n > most:
            raise TooMany(f"the query would return {n} events; cut it below {most}")
        rows, ms = [], lambda x: None if x is None else datetime.fromtimestamp(x // 1000, UTC) + timedelta(milliseconds=x % 1000)
        for f in json.loads(service.fetch(q))["features"]:
            p, c = f["properties"], f["geometry"]["coordinates"]
            if f.get("id") is None or p.get("time") is None or len(c) < 2:
                raise ValueError("a feature lacks its id, time or position")
            kind = (p.get("magType") or "").strip().lower() or None
            rows.append({"source_event_id": f["id"], "event_time": ms(p["time"]), "source_updated_at": ms(p.get("updated")), "latitude": c[1], "longitude": c[0], "depth_km": c[2] if len(c) > 2 else None, "magnitude": p.get("mag"), "magnitude_type": kind, "place": p.get("place"), "slice_start": q.start, "slice_end": q.end})
        return rows


class TooMany(ValueError):
    """A query that the service refuses for its size."""


def slice_key(q: Query) -> str:
    """A slice's name in the ledger: all of its parameters, so that other bounds are other slices."""
    return json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(q).items()})


class BoundedEvents(DataSource):
    """Options: url, start, end (ISO times, UTC if they name no zone), bounds (south,north,west,east),
    min_magnitude, service, max_results, slice_results, min_slice_hours, retries, backoff_s, isolate, ledger."""

    @classmethod
    def name(cls) -> str:
        return "bounded_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(dict(self.options))


def bounded_events(spark: SparkSession, url: str, start: datetime, end: datetime, **options) -> DataFrame:
    """Events of a service between two times, planned in slices; filters on it reach the service."""
    spark.dataSource.register(BoundedEvents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {k: ",".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("bounded_events").options(url=url, start=_utc(start).isoformat(), end=_utc(end).isoformat(), **given).load()


def backfill(spark: SparkSession, url: str, start: datetime, end: datetime, table: str, ledger: str, **options) -> DataFrame:
    """One run over a time range: appends new events to ``table`` and a row per tried slice to ``ledger``.

    Returns this run's ledger rows (key, slice_start, slice_end, status, events, error). Slices that the
    ledger shows as succeeded aren't fetched again. Events are written before the ledger and only if their
    (source_event_id, source_updated_at) is not held, so that a run that dies between both repeats slices
    without doubling events."""
    rows = materialize(bounded_events(spark, url, start, end, ledger=ledger, isolate="true", **options), "slices")
    events = rows.where("status is null").drop("slice_start", "slice_end", "status", "events", "error")
    try:
        held = spark.read.schema(events.schema).parquet(table)
    except Exception as e:  # the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], events.schema)
    append_if_absent(events, held, ["source_event_id", "source_updated_at"]).write.mode("append").parquet(table)
    whole = BoundedReader({"start": _utc(start).isoformat(), "end": _utc(end).isoformat(), **{k: ",".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in options.items() if v is not None}}).query
    iso = lambda c: F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))).otherwise(""), F.lit("+00:00"))
    fixed = json.dumps({k: v for k, v in asdict(whole).items() if k not in ("start", "end")})[1:]
    key = F.concat(F.lit('{"start": "'), iso(F.col("slice_start")), F.lit('", "end": "'), iso(F.col("slice_end")), F.lit('", ' + fixed))
    tried = rows.where("status is not null").select(key.alias("key"), "slice_start", "slice_end", "status", "events", "error")
    tried.write.mode("append").parquet(ledger)
    return tried
