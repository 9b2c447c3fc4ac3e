"""Regular grids, cells, places, rasters, traces and tectonic classes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, PLACES_EARTH_KM, box, cell_area_km2, circular_mean, haversine_km, wrap_longitude
from ..functions.stats import at_least_one, interval_mass, normal_cdf
from ..sources.policies import ClassifierPolicy

# fixed values: magnitude bins and named places
BINS = ((3.0, 4.0), (4.0, 5.0), (5.0, 6.0), (6.0, 7.0), (7.0, None))
PLACES = (
    ("arica", "Arica", -18.478, -70.321),
    ("iquique", "Iquique", -20.230, -70.135),
    ("antofagasta", "Antofagasta", -23.650, -70.400),
    ("copiapo", "Copiapó", -27.366, -70.332),
    ("la_serena", "La Serena", -29.903, -71.250),
    ("valparaiso", "Valparaíso", -33.047, -71.613),
    ("santiago", "Santiago", -33.448, -70.669),
    ("rancagua", "Rancagua", -34.170, -70.744),
    ("talca", "Talca", -35.426, -71.655),
    ("concepcion", "Concepción", -36.827, -73.050),
    ("temuco", "Temuco", -38.736, -72.590),
    ("valdivia", "Valdivia", -39.814, -73.246),
    ("puerto_montt", "Puerto Montt", -41.469, -72.942),
    ("coyhaique", "Coyhaique", -45.571, -72.068),
    ("punta_arenas", "Punta Arenas", -53.163, -70.917),
)
RADIUS_KM = 40.0


def cell_id(row: Column, column: Column, name: str = "grid") -> Column:
    return F.format_string(f"{name}:r%04d:c%04d", row, column)


def cells(spark: SparkSession, south: float, north: float, west: float, east: float, step: float, name: str = "grid") -> DataFrame:
    """(cell_id, row, col, latitude, longitude, area_km2) of a grid, rows from the south.

    Edges are stepped in decimals, so that they do not drift; sides must be multiples of the step."""
    d = [Decimal(str(x)) for x in (south, north, west, east, step)]
    rows, columns = (d[1] - d[0]) / d[4], (d[3] - d[2]) / d[4]
    if rows != int(rows) or columns != int(columns) or rows <= 0 or columns <= 0:
        raise ValueError("the grid's sides are no multiples of its step")
    row, column = F.floor(F.col("id") / int(columns)).cast("int"), F.pmod("id", F.lit(int(columns))).cast("int")
    edge = lambda start, k: (F.lit(d[start]).cast("decimal(12,4)") + k.cast("decimal(12,4)") * F.lit(d[4]).cast("decimal(9,4)")).cast("double")
    out = spark.range(int(rows) * int(columns)).select(row.alias("row"), column.alias("col"))
    r, c = F.col("row"), F.col("col")
    south_, north_ = edge(0, r), edge(0, r + 1)
    return out.select(cell_id(r, c, name).alias("cell_id"), "row", "col", ((south_ + north_) / 2).alias("latitude"), ((edge(2, c) + edge(2, c + 1)) / 2).alias("longitude"), cell_area_km2(south_, north_, step).alias("area_km2"))


def point_to_cell(lat: Column, lon: Column, south: float, north: float, west: float, east: float, step: float, name: str = "grid") -> Column:
    """Cell of a point by arithmetic (edges within 1e-9 belong to the cell above); null outside."""
    row, column = F.floor((lat - south) / step + 1e-9).cast("int"), F.floor((lon - west) / step + 1e-9).cast("int")
    inside = (row >= 0) & (row < round((north - south) / step)) & (column >= 0) & (column < round((east - west) / step))
    return F.when(inside, cell_id(row, column, name))


def bins_frame(spark: SparkSession, bins: tuple[tuple[float, float | None], ...] = BINS) -> DataFrame:
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bins)], "bin int, lower double, upper double")


def assign_bins(events: DataFrame, bounds: tuple[tuple[float, float | None], ...] = BINS) -> DataFrame:
    """Range join with the few bins of a specification; magnitudes below the first one drop out."""
    bins = F.broadcast(bins_frame(events.sparkSession, bounds))
    return events.join(bins, (F.col("magnitude") >= F.col("lower")) & (F.col("upper").isNull() | (F.col("magnitude") < F.col("upper"))))


def place_readout(rates: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(place_id, cells, expected, probability) from (latitude, longitude, expected): cells whose centre
    lies within the radius. Places are a fixed list of fifteen; a box narrows the distance test."""
    places = rates.sparkSession.createDataFrame([(i, a, b) for i, _, a, b in PLACES], "place_id string, plat double, plon double")
    south, north, west, east = box("plat", "plon", radius_km, PLACES_EARTH_KM)
    near = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    km = haversine_km("plat", "plon", "latitude", "longitude", PLACES_EARTH_KM)
    hits = rates.where("expected is not null").join(F.broadcast(places), near & (km <= radius_km)).groupBy("place_id").agg(F.count("*").alias("cells"), F.sum("expected").alias("expected"))
    out = places.join(hits, "place_id", "left")
    return out.select("place_id", F.coalesce("cells", F.lit(0)).alias("cells"), "expected", at_least_one(F.col("expected")).alias("probability"))


def lattice_key(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    return F.rint(lat / step).cast("int"), F.rint(wrap_longitude(lon) / step).cast("int")


def merge_rasters(depth: DataFrame, **others: DataFrame) -> DataFrame:
    """Rasters (lat_index, lon_index, value) on one lattice: depth decides which nodes there are."""
    out = depth.select("lat_index", "lon_index", F.col("value").alias("depth_km"))
    for name, raster in others.items():
        out = out.join(raster.select("lat_index", "lon_index", F.col("value").alias(name)), ["lat_index", "lon_index"], "left")
    return out


def bilinear_sample(points: DataFrame, nodes: DataFrame, step: float) -> DataFrame:
    """(point_id, corners, depth_km, dip, strike) at (point_id, latitude, longitude).

    A point on a node or an edge needs one or two corners, any other four; if one is missing there
    is no sample. An attribute that a corner lacks is null; strike is averaged on the circle."""
    y, x = F.col("latitude") / step, F.col("longitude") / step
    on = lambda v: F.abs(v - F.rint(v)) < 1e-9
    low = lambda v: F.when(on(v), F.rint(v)).otherwise(F.floor(v))
    corner = lambda v: F.when(on(v), F.array(F.struct(low(v).cast("int").alias("k"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(low(v).cast("int").alias("k"), (1 - (v - low(v))).alias("w")), F.struct((low(v) + 1).cast("int").alias("k"), (v - low(v)).alias("w"))))
    spread = points.select("point_id", F.explode(corner(y)).alias("a"), corner(x).alias("bs")).select("point_id", "a", F.explode("bs").alias("b"), F.size("bs").alias("nb"))
    spread = spread.select("point_id", F.col("a.k").alias("lat_index"), F.col("b.k").alias("lon_index"), (F.col("a.w") * F.col("b.w")).alias("w"))
    need = spread.groupBy("point_id").agg(F.count("*").alias("need"))
    got = spread.join(nodes, ["lat_index", "lon_index"])
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col("w") * F.col(c)))
    out = got.groupBy("point_id").agg(F.count("*").alias("corners"), whole("depth_km").alias("depth_km"), whole("dip").alias("dip"), F.when(F.count("strike") == F.count("*"), circular_mean("w", "strike")).alias("strike"))
    return out.join(need, "point_id").where("corners = need").drop("need")


def classify(events: DataFrame, policy: ClassifierPolicy = ClassifierPolicy()) -> DataFrame:
    """``events`` (depth_km, slab_depth, any of depth_sigma, slab_sigma, thickness) with class masses.

    Masses of interface, intraslab, crustal and unknown come from a normal residual; a label needs
    the policy's least probability, ties go in that order. Without a depth or a slab all mass is unknown."""
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in events.columns else F.lit(default)
    s1, s2 = F.greatest(given("depth_sigma", policy.default_event_depth_uncertainty_km), F.lit(0.1)), F.greatest(given("slab_sigma", policy.default_slab_uncertainty_km), F.lit(0.1))
    sigma, residual = F.hypot(s1, s2), F.col("depth_km") - F.col("slab_depth")
    thick, half = F.greatest(given("thickness", policy.default_slab_thickness_km), F.lit(policy.interface_half_width_km)), F.lit(policy.interface_half_width_km)
    out = events.withColumns({"__i": interval_mass(-half, half, residual, sigma), "__s": interval_mass(half, thick, residual, sigma), "__a": normal_cdf(-half, residual, sigma), "__g": normal_cdf(F.lit(policy.maximum_crustal_depth_km), F.col("depth_km"), s1), "__b": 1 - normal_cdf(thick, residual, sigma)})
    out = out.withColumns({"__c": F.col("__a") * F.col("__g"), "__u": F.col("__a") * (1 - F.col("__g")) + F.col("__b")})
    total = F.col("__i") + F.col("__s") + F.col("__c") + F.col("__u")
    masses = {"interface": "__i", "intraslab": "__s", "crustal": "__c"}
    out = out.withColumns({**{k: F.coalesce(F.col(v) / total, F.lit(0.0)) for k, v in masses.items()}, "unknown": F.coalesce(F.col("__u") / total, F.lit(1.0))})
    order = ("interface", "intraslab", "crustal", "unknown")
    best = F.array_max(F.array(*(F.struct(F.col(k).alias("p"), F.lit(-j).alias("o"), F.lit(k).alias("label")) for j, k in enumerate(order))))
    return out.withColumn("label", F.when(best.p >= policy.minimum_label_probability, best.label).otherwise("unknown")).drop("__i", "__s", "__a", "__g", "__b", "__c", "__u")
