"""Event feeds, daily tables, rasters and fault traces as DataFrames."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import wrap_longitude
from ..plans.checkpointing import materialize

FEED = """type string, features array<struct<id: string, properties: struct<mag: double, place: string, time: bigint, updated: bigint, status: string, magType: string, horizontalError: double, depthError: double, magError: double>, geometry: struct<type: string, coordinates: array<double>>>>"""


def geojson_events(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of feature collections; a feature without id, time or position is rejected.

    ``bbox`` is (south, north, west, east), closed."""
    f = spark.read.schema(FEED).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p, c = F.col("f.properties"), F.col("f.geometry.coordinates")
    rows = f.select(
        F.col("f.id").alias("source_event_id"),
        F.timestamp_millis(p.time).alias("event_time"),
        F.timestamp_millis(p.updated).alias("source_updated_at"),
        F.try_element_at(c, F.lit(2)).alias("latitude"),
        F.try_element_at(c, F.lit(1)).alias("longitude"),
        F.try_element_at(c, F.lit(3)).alias("depth_km"),
        p.mag.alias("magnitude"),
        F.nullif(F.lower(F.trim(p.magType)), F.lit("")).alias("magnitude_type"),
        p.place.alias("place"),
        p.status.alias("status"),
        p.horizontalError.alias("location_uncertainty_km"),
        p.depthError.alias("depth_uncertainty_km"),
        p.magError.alias("magnitude_uncertainty"),
    )
    good = F.col("source_event_id").isNotNull() & F.col("event_time").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    good = F.coalesce(good, F.lit(False))
    events = rows.where(good)
    if bbox is not None:
        events = events.where(F.col("latitude").between(*bbox[:2]) & F.col("longitude").between(*bbox[2:]))
    return events, rows.where(~good)


def count_response(body: Column) -> Column:
    """Count of a probe that answers with a bare number or {"count": n}; null for anything else."""
    return F.coalesce(F.get_json_object(body, "$.count"), F.when(F.trim(body).rlike(r"^\d+$"), F.trim(body))).try_cast("int")


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[tuple[list[str], str | None]] = []
        self._cells: list[str] | None = None
        self._link: str | None = None
        self._open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._cells, self._link = [], None
        elif tag == "td" and self._cells is not None:
            self._cells.append("")
            self._open = True
        elif tag == "br" and self._open:
            self._cells[-1] += " "
        elif tag == "a" and self._open and self._link is None:
            self._link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "td":
            self._open = False
        elif tag == "tr" and self._cells is not None:
            self.rows.append(([" ".join(x.split()) for x in self._cells], self._link))
            self._cells = None

    def handle_data(self, data):
        if self._open and self._cells:
            self._cells[-1] += data


def daily_table_events(files: DataFrame) -> DataFrame:
    """Events of daily HTML tables in ``files`` (path, content), as ``binaryFile`` reads them.

    A row counts if it has five cells: local time and place, UTC time, latitude and longitude, depth,
    magnitude and type. Its id is in its report link, else it is made of its time and position."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                p = _Rows()
                p.feed(bytes(content).decode("utf-8", "replace"))
                out += [(path, *row, link) for row, link in p.rows if len(row) == 5]
            yield pd.DataFrame(out, columns=["path", "c1", "c2", "c3", "c4", "c5", "link"])

    raw = files.select("path", "content").mapInPandas(cells, "path string, c1 string, c2 string, c3 string, c4 string, c5 string, link string")
    part = lambda c, pattern, k=1: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    time = F.try_to_timestamp(part("c2", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)$"))
    lat, lon = part("c3", r"^(-?[\d.]+) +(-?[\d.]+)$").cast("double"), part("c3", r"^(-?[\d.]+) +(-?[\d.]+)$", 2).cast("double")
    digits = lambda c: F.translate(F.format_string("%.3f", c), ".-", "pm")
    made = F.concat_ws("_", F.regexp_replace("c2", r"\D", ""), digits(F.col("latitude")), digits(F.col("longitude")))
    rows = raw.select(time.alias("event_time"), lat.alias("latitude"), lon.alias("longitude"), part("c4", r"^([\d.]+) *km$").cast("double").alias("depth_km"), part("c5", r"^([\d.]+) *([A-Za-z]+)$").cast("double").alias("magnitude"), F.lower(part("c5", r"^([\d.]+) *([A-Za-z]+)$", 2)).alias("magnitude_type"), F.nullif(F.trim(F.substring("c1", 20, 1000)), F.lit("")).alias("place"), "c2", "link")
    rows = rows.where("event_time is not null and latitude is not null and longitude is not null and magnitude is not null")
    return rows.withColumn("source_event_id", F.coalesce(part("link", r"(\d+)\.html?$"), made)).drop("c2", "link")


def xyz_raster(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], step: float, absolute: bool = False) -> DataFrame:
    """(lat_index, lon_index, value) of a lon,lat,value file; NaN and points outside the bounds drop.

    Longitudes up to 360 are wrapped. A node that occurs twice is an error."""
    raw = spark.read.schema("lon double, lat double, value double").option("nanValue", "NaN").csv(path)
    rows = raw.withColumn("lon", wrap_longitude("lon")).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("lat").between(*bounds[:2]) & F.col("lon").between(*bounds[2:]))
    value = F.abs("value") if absolute else F.col("value")
    nodes = materialize(rows.select(F.rint(F.col("lat") / step).cast("int").alias("lat_index"), F.rint(F.col("lon") / step).cast("int").alias("lon_index"), value.alias("value")), "raster")
    if not nodes.groupBy("lat_index", "lon_index").count().where("count > 1").isEmpty():
        raise ValueError("a raster node occurs twice")
    return nodes


def interpreted_number(text: Column) -> Column:
    """(value, status) of a field that may hold a number, "~n", "a +/- b", a range or words."""
    t, number = F.trim(text), r"[+-]?\d+(?:\.\d+)?"
    first = F.regexp_extract(t, f"({number})", 1)
    plain = F.regexp_extract(t, f"^~?\\s*({number})$", 1).try_cast("double")
    case = lambda value, status: F.struct(value.alias("value"), F.lit(status).alias("status"))
    none = F.lit(None).cast("double")
    return (
        F.when(t.isNull() | (t == ""), case(none, "missing"))
        .when(F.lower(t).isin("nan", "inf", "-inf", "infinity"), case(none, "non_finite"))
        .when(t.rlike(f"^{number}$"), case(plain, "exact"))
        .when(t.rlike(f"^~\\s*{number}$"), case(plain, "approximate"))
        .when(t.rlike(f"^{number}\\s*(\\+/-|±)\\s*{number}$"), case(first.try_cast("double"), "uncertain"))
        .when(t.rlike(f"^{number}\\s*(-|–|to)\\s*{number}$"), case(none, "range"))
        .otherwise(case(none, "qualitative"))
    )


def shapefile_traces(files: DataFrame) -> DataFrame:
    """(path, record, parts, attributes) of zipped polyline shapefiles in ``files`` (path, content).

    ``parts`` holds the lines as arrays of (lon, lat); attributes are the table's fields as text."""

    def lines(raw: bytes) -> Iterator[list[list[tuple[float, float]]]]:
        at = 100
        while at + 8 <= len(raw):
            size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
            body = raw[at + 8 : at + 8 + size]
            at += 8 + size
            kind = struct.unpack_from("<i", body)[0]
            if kind not in (3, 13, 23):
                yield []
                continue
            n, m = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n}i", body, 44), m]
            xy = struct.unpack_from(f"<{2 * m}d", body, 44 + 4 * n)
            points = list(zip(xy[::2], xy[1::2], strict=True))
            yield [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    def fields(raw: bytes) -> Iterator[dict[str, str]]:
        count, head, width = struct.unpack_from("<IHH", raw, 4)
        names, at = [], 32
        while raw[at] != 0x0D:
            names.append((raw[at : at + 11].split(b"\0")[0].decode(), raw[at + 16]))
            at += 32
        for k in range(count):
            at, row = head + k * width + 1, {}
            for name, size in names:
                row[name] = raw[at : at + size].decode("utf-8", "replace").strip()
                at += size
            yield row

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    by = {re.sub(r".*\.", "", n).lower(): n for n in z.namelist()}
                    rows = zip(lines(z.read(by["shp"])), fields(z.read(by["dbf"])), strict=True)
                    out += [(path, k, [[{"lon": x, "lat": y} for x, y in part] for part in parts], attributes) for k, (parts, attributes) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "record", "parts", "attributes"])

    return files.select("path", "content").mapInPandas(read, "path string, record int, parts array<array<struct<lon: double, lat: double>>>, attributes map<string, string>")


def pinned(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``files`` whose length and SHA-256 are those of ``expected`` (name, bytes, sha256); others fail."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(expected, "name")
    ok = (F.length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.lower("sha256"))
    return named.withColumn("ok", F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("name"))).cast("boolean"))).where("ok").drop("ok")


def media_suffix(kind: Column) -> Column:
    out = F.lit("bin")
    for word in ("xml", "csv", "html", "json"):
        out = F.when(F.lower(kind).contains(word), word).otherwise(out)
    return out
