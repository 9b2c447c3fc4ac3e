"""Nearest traces on the sphere, by branch and bound over cells of space.

Points and segments are unit vectors, so longitudes need no wrapping and poles are no exception. Long
segments are listed piece by piece. Cells are cubes of the space around the sphere; pairs of a cell of
points and a cell of pieces are divided level by level, and a pair is dropped once another cell of pieces
is nearer for certain. Only points and pieces of the pairs that remain meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, arc_distance, unit_vector
from ..plans.checkpointing import materialize

#: Halvings of the cube around the sphere: cells of the last level have sides of about 100 km.
LEVELS = (3, 5, 7)
#: Rounding of unit vectors and bounds.
SLACK = 1e-12


def _cells() -> dict[str, Column]:
    many = 1 << LEVELS[-1]
    place = lambda c: F.least(F.lit(many - 1), F.greatest(F.lit(0), F.floor((F.col(c) + 1.0) * (many // 2)))).cast("int")
    return {"cx": place("x"), "cy": place("y"), "cz": place("z")}


def _pieces(segments: DataFrame, longest: float) -> DataFrame:
    """(trace_id, ax .. bz, x, y, z): the middle of each piece of a segment, none longer than ``longest``."""
    a, b = unit_vector("lat1", "lon1"), unit_vector("lat2", "lon2")
    ends = segments.select("trace_id", *(c.alias(k) for c, k in zip((*a, *b), ("ax", "ay", "az", "bx", "by", "bz"), strict=True)))
    chord = F.sqrt(sum((F.col(f"a{k}") - F.col(f"b{k}")) ** 2 for k in "xyz"))
    ends = ends.withColumn("arc", 2 * F.asin(F.least(F.lit(1.0), chord / 2)))
    ends = ends.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("arc") / longest).cast("int")))
    ends = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", (F.col("k") + 0.5) / F.col("n"))
    short = F.col("arc") < 1e-9
    left = F.when(short, 1.0).otherwise(F.sin((1 - F.col("t")) * F.col("arc")) / F.sin("arc"))
    right = F.when(short, 0.0).otherwise(F.sin(F.col("t") * F.col("arc")) / F.sin("arc"))
    return ends.select("trace_id", "ax", "ay", "az", "bx", "by", "bz", *((left * F.col(f"a{k}") + right * F.col(f"b{k}")).alias(k) for k in "xyz"))


def _candidates(places: DataFrame, pieces: DataFrame, half: float) -> DataFrame:
    """(cx, cy, cz, sx, sy, sz): cells of points, and the cells of pieces that may hold a nearest one.

    Distances are chords. No piece of a cell pair is nearer than the boxes' least distance less half a piece,
    and the middle of some piece is as near as their largest; the least of the latter over a cell's partners
    drops those whose former is beyond it. Cells are broadcast: about 4.7 x 4^level of them meet the sphere,
    77,000 rows of six integers at the last level."""
    fine_p = materialize(places.select("cx", "cy", "cz").distinct(), "point-cells")
    fine_s = materialize(pieces.select(F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz")).distinct(), "piece-cells")
    ps, ss = ("cx", "cy", "cz"), ("sx", "sy", "sz")

    def level(cells: DataFrame, names: tuple[str, ...], k: int, above: int) -> DataFrame:
        at = cells.select(*(F.shiftright(c, LEVELS[-1] - k).alias(c) for c in names)).distinct()
        return F.broadcast(at.select("*", *(F.shiftright(c, k - above).alias(f"up_{c}") for c in names)))

    pairs, above = None, 0
    for k in LEVELS:
        p, s = level(fine_p, ps, k, above), level(fine_s, ss, k, above)
        if pairs is None:  # level 0 is one cube, the parent of all
            both = p.join(s, [F.col(f"up_{a}") == F.col(f"up_{b}") for a, b in zip(ps, ss, strict=True)])
        else:
            both = pairs.select(*(F.col(c).alias(f"up_{c}") for c in (*ps, *ss))).join(p, [f"up_{c}" for c in ps]).join(s, [f"up_{c}" for c in ss])
        side, above = 2.0 / (1 << k), k
        gap = [F.abs(F.col(a) - F.col(b)) for a, b in zip(ps, ss, strict=True)]
        least = F.sqrt(sum(F.greatest(g - 1, F.lit(0)) ** 2 for g in gap)) * side - half
        most = F.sqrt(sum((g + 1) ** 2 for g in gap)) * side
        bound = F.min(most).over(Window.partitionBy(*ps))
        pairs = both.select(*ps, *ss, least.alias("least"), bound.alias("bound")).where(F.col("least") <= F.col("bound") + SLACK).select(*ps, *ss)
    return materialize(pairs, "cell-pairs")


def nearest_trace(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(point_id, trace_id, km): the trace whose great-circle segment (trace_id, lat1, lon1, lat2, lon2) is
    nearest to each point (point_id, latitude, longitude), at any distance; ties go to the least trace_id.

    A segment is the shorter arc between its ends; ends that are opposite points of the sphere have none and
    count as two points. Rows that lack a coordinate, or a trace its id, are left out; without segments there
    are no rows. Points at the same place are compared once, so a place may hold any share of them. Cells are
    bounded in number by their size, whatever the tables hold, and their pairs by branch and bound."""
    located = points.select("point_id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")).where("latitude is not null and longitude is not null")
    whole = segments.where("trace_id is not null and lat1 is not null and lon1 is not null and lat2 is not null and lon2 is not null")
    x, y, z = unit_vector("latitude", "longitude")
    places = located.select("latitude", "longitude").distinct().select("*", x.alias("x"), y.alias("y"), z.alias("z"))
    places = places.withColumns(_cells())
    longest = 2.0 / (1 << LEVELS[-1])
    pieces = _pieces(whole, longest).withColumns(_cells())
    pairs = _candidates(places, pieces, longest / 2)
    # a trace is listed once for a cell of points, however many of its pieces are near
    ends = ["trace_id", "ax", "ay", "az", "bx", "by", "bz"]
    near = pieces.select(*ends, F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz")).join(pairs, ["sx", "sy", "sz"]).select(*ends, "cx", "cy", "cz").distinct()
    arc = arc_distance([F.col(k) for k in "xyz"], [F.col(f"a{k}") for k in "xyz"], [F.col(f"b{k}") for k in "xyz"])
    met = places.join(near, ["cx", "cy", "cz"]).select("latitude", "longitude", F.struct((arc * EARTH_KM).alias("km"), "trace_id").alias("one"))
    best = met.groupBy("latitude", "longitude").agg(F.min("one").alias("best"))
    return located.join(best, ["latitude", "longitude"]).select("point_id", "best.trace_id", "best.km")
