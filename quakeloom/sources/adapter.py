"""The driver's ``events`` table seen as a located, revised and multi-source catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = """
    event_id, ts as event_time, ts + make_dt_interval(0, 0, cast(event_id % 7 as int), 0) as available_at,
    event_id div 3 as source_event_key, event_type as source_id,
    -60D + ((user_id * 7919) % 4500) / 100D + (event_id * 31 % 100) / 1000D as latitude,
    -82D + ((user_id * 10473) % 2000) / 100D + (event_id * 17 % 100) / 1000D as longitude,
    case when event_id % 11 = 0 then null else cast(event_id * 31 % 700 as double) end as depth_km,
    case when event_id % 97 = 0 then null else round(3D + value / 115.13D, 2) end as magnitude,
    case event_type when 'click' then 'mb' when 'view' then 'mwc' when 'purchase' then 'ml' when 'signup' then 'mww' else 'md' end as magnitude_type
"""
#: The same view in DuckDB, for the oracles.
ORACLE = """
    select event_id, ts as event_time, ts + to_minutes(event_id % 7) as available_at,
    event_id // 3 as source_event_key, event_type as source_id,
    -60::double + ((user_id * 7919) % 4500) / 100::double + (event_id * 31 % 100) / 1000::double as latitude,
    -82::double + ((user_id * 10473) % 2000) / 100::double + (event_id * 17 % 100) / 1000::double as longitude,
    case when event_id % 11 = 0 then null else (event_id * 31 % 700)::double end as depth_km,
    case when event_id % 97 = 0 then null else round(3::double + value / 115.13::double, 2) end as magnitude,
    case event_type when 'click' then 'mb' when 'view' then 'mwc' when 'purchase' then 'ml' when 'signup' then 'mww' else 'md' end as magnitude_type
    from events
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per revision."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_split(COLUMNS))


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shifted copy of every other event, as another agency would report it."""
    even = catalog(spark, sf_dir).where("event_id % 2 = 0")
    return even.select(
        F.col("event_id").alias("other_id"),
        F.expr("event_time + make_dt_interval(0, 0, 0, cast(event_id % 90 as decimal(18, 6)))").alias("event_time"),
        F.expr("latitude + 0.01D * (event_id % 30)").alias("latitude"),
        "longitude",
        "depth_km",
        F.expr("magnitude + 0.1D * (event_id % 5)").alias("magnitude"),
    )


def _split(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text.strip():
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
