"""Queries over the driver's tables, with DuckDB SQL for each that SQL can express.

The tables hold no earthquakes, so ``events`` is read as a catalog (see ``sources.adapter``).
Floats are rounded to six decimals on both sides.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import flat_area_km2
from .functions.stats import magnitude_bin, poisson_ppf
from .operators import catalog as cat
from .operators import fitting, forecasting, grid, issuance, linkage, magnitudes, scoring, seismicity
from .operators.quantiles import exact_quantiles
from .operators.traces import nearest_trace
from .plans.checkpointing import materialize, scratch
from .plans.graph import connected_components
from .plans.ranks import running_rank
from .sources import bounded, sinks
from .sources.adapter import ORACLE as EV
from .sources.adapter import catalog, second_source
from .streaming import clock
from .streaming import linkage as stream_linkage

AS_OF = "2024-01-15 00:00:00"
AS_OF_TIME = datetime.fromisoformat(AS_OF)
ORIGIN = "2024-01-01 00:00:00"
GRID = (-60.0, -15.0, -82.0, -62.0, 1.0)
ETAS = forecasting.Etas()

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB form; {ev} is the catalog view."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{ev}", EV).replace("{mc}", "(select mc from mcx)").replace("{as_of}", AS_OF).replace("{origin}", ORIGIN)
        return f

    return add


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(f"`{k}`").alias(k) if t == "double" else F.col(f"`{k}`") for k, t in df.dtypes))


def sample(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Located events at or above a magnitude, with days since the origin."""
    ev = catalog(spark, sf_dir).where(F.col("magnitude") >= least)
    return ev.withColumn("t_days", seismicity.days_since(F.col("event_time"), at(ORIGIN)))


def complete(f):
    """Calls a query of a magnitude sample with the catalog's own magnitude of completeness, which is then
    the models' reference magnitude too. In SQL it is {mc}."""

    def run(spark, sf_dir):
        return f(spark, sf_dir, completeness(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def completeness(spark: SparkSession, sf_dir: str) -> float:
    """Magnitude of completeness by maximum curvature; a catalog too small for one counts from its least magnitude."""
    ev = catalog(spark, sf_dir).where("magnitude is not null")
    found = magnitudes.mc_maximum_curvature(ev, []).first()
    mc = found.mc if found else None
    return float(mc if mc is not None else ev.agg(F.min("magnitude")).first()[0] or 0.0)


# --- bitemporal reads ---------------------------------------------------------------------------

LATEST = "latest as (select * from (select *, row_number() over (partition by source_event_key order by available_at desc, event_id desc) as rk from ev where available_at <= timestamp '{as_of}') where rk = 1)"
PRIORITY = "case source_id when 'purchase' then 0 when 'signup' then 1 when 'view' then 2 else 100 end"
PRIORITIES = {"purchase": 0, "signup": 1, "view": 2}
PREFERRED = "preferred as (select * from (select *, row_number() over (partition by source_event_key // 4 order by " + PRIORITY + ", available_at desc, event_id desc) as rk2 from latest) where rk2 = 1)"


def with_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).withColumn("canonical", F.expr("source_event_key div 4"))


def preferred_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = cat.as_of(catalog(spark, sf_dir), at(AS_OF)).withColumn("canonical", F.expr("source_event_key div 4"))
    return cat.preferred(latest, "canonical", cat.source_priority(F.col("source_id"), PRIORITIES))


@query(f"with ev as ({{ev}}), {LATEST}, {PREFERRED}, m as (select round(round_even(magnitude / 0.1, 0) * 0.1, 10) as m from preferred where magnitude is not null), s as (select * from m where m >= 3.5 - 1e-9), g as (select count(*) as n, avg(m) as mean, var_samp(m) as v from s), b as (select *, case when n >= 50 then log10(2.718281828459045) / (mean - 3.45) end as b from g) select n, round(b, 6) as b, round(2.30 * b * b * sqrt(v / n), 6) as b_error, round(log10(n) + b * 3.5, 6) as a from b")
def as_of_b_value(spark, sf_dir):
    """As of a time: latest revisions, preferred source, binned magnitudes, b and its error."""
    return rounded(magnitudes.b_value(preferred_events(spark, sf_dir), [], 3.5).select("n", "b", "b_error", "a"))


@query(f"with ev as ({{ev}}), {LATEST} select source_event_key, event_id, available_at, round(magnitude, 6) as magnitude from latest")
def as_of_latest(spark, sf_dir):
    return cat.as_of(catalog(spark, sf_dir), at(AS_OF)).select("source_event_key", "event_id", "available_at", r6("magnitude").alias("magnitude"))


@query(f"with ev as ({{ev}}), {LATEST}, {PREFERRED} select source_event_key // 4 as canonical, event_id, source_id from preferred")
def as_of_preferred(spark, sf_dir):
    return preferred_events(spark, sf_dir).select("canonical", "event_id", "source_id")


@query(f"with ev as ({{ev}}), {LATEST} select event_id, event_time, round(magnitude, 6) as magnitude from latest where event_time >= timestamp '2024-01-03 00:00:00' and event_time < timestamp '2024-01-12 00:00:00' and magnitude >= 3.5 and latitude between -50 and -20 and longitude between -80 and -65 order by event_time desc, event_id desc limit 100 offset 20")
def event_page(spark, sf_dir):
    """One page of the newest events: filters sit above the window, so an older revision never shows."""
    latest = cat.as_of(catalog(spark, sf_dir), at(AS_OF))
    chosen = cat.select_events(latest, at("2024-01-03 00:00:00"), at("2024-01-12 00:00:00"), 3.5, None, (-50, -20, -80, -65))
    return cat.page(chosen, 100, 20).select("event_id", "event_time", r6("magnitude").alias("magnitude"))


@query(f"with ev as ({{ev}}), {LATEST}, {PREFERRED}, page as (select * from preferred where event_time >= timestamp '2024-01-02 00:00:00' and event_time < timestamp '2024-01-14 00:00:00' order by event_time desc, event_id desc limit 200000) select event_time, magnitude_type, round(magnitude, 6) as magnitude from page where magnitude is not null and magnitude_type = 'ml'")
def magnitude_sample(spark, sf_dir):
    """One magnitude type as it was known at a time, for estimates of completeness."""
    out = cat.magnitude_sample(with_canonical(spark, sf_dir), AS_OF_TIME, datetime(2024, 1, 2), datetime(2024, 1, 14), "ml", "canonical", cat.source_priority(F.col("source_id"), PRIORITIES))
    return out.withColumn("magnitude", r6("magnitude"))


@query(f"with ev as ({{ev}}), {LATEST}, {PREFERRED}, page as (select * from preferred where event_time >= timestamp '2024-01-02 00:00:00' and event_time < timestamp '2024-01-14 00:00:00' and magnitude >= 3.3 and latitude between -50 and -20 and longitude between -80 and -65 order by event_time desc, event_id desc limit 200000) select event_id, event_time, magnitude_type, round(magnitude, 6) as magnitude, round(latitude, 6) as latitude, round(longitude, 6) as longitude from page where magnitude_type = 'mww'")
def declustering_sample(spark, sf_dir):
    """Located events of one magnitude type in a box, as they were known at a time."""
    out = cat.declustering_sample(with_canonical(spark, sf_dir), AS_OF_TIME, datetime(2024, 1, 2), datetime(2024, 1, 14), "mww", "canonical", cat.source_priority(F.col("source_id"), PRIORITIES), min_magnitude=3.3, bbox=(-50, -20, -80, -65))
    return rounded(out)


@query("with ev as ({ev}) select source_event_key, event_id from (select event_id as source_event_key, event_id, event_time as valid_from, case when event_id % 5 <> 0 then event_time + to_days((event_id % 9)::int) end as valid_until from ev) where valid_from <= timestamp '{as_of}' and (valid_until is null or timestamp '{as_of}' < valid_until)")
def membership_valid_at(spark, sf_dir):
    m = catalog(spark, sf_dir).select(F.col("event_id").alias("source_event_key"), "event_id", F.col("event_time").alias("valid_from"), F.expr("case when event_id % 5 <> 0 then event_time + make_dt_interval(cast(event_id % 9 as int)) end").alias("valid_until"))
    return cat.valid_at(m, at(AS_OF)).select("source_event_key", "event_id")


# --- summaries, quality, ledgers ----------------------------------------------------------------


@query("with ev as ({ev}) select count(*) as events, count(magnitude) as with_magnitude, round(min(magnitude), 6) as least, round(max(magnitude), 6) as most, min(event_time) as first, max(event_time) as last from ev")
def catalog_summary(spark, sf_dir):
    return rounded(cat.summary(catalog(spark, sf_dir)))


@query("with ev as ({ev}) select case when magnitude is null then null else magnitude_type end as magnitude_type, count(*) as n from ev group by 1")
def magnitude_type_counts(spark, sf_dir):
    kind = F.when(F.col("magnitude").isNotNull(), F.col("magnitude_type"))
    return catalog(spark, sf_dir).groupBy(kind.alias("magnitude_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("with ev as ({ev}) select event_id, round(magnitude, 6) as magnitude from ev where magnitude is not null order by ev.magnitude desc, event_id limit 10")
def top_magnitudes(spark, sf_dir):
    return catalog(spark, sf_dir).where("magnitude is not null").orderBy(F.desc("magnitude"), "event_id").limit(10).select("event_id", r6("magnitude").alias("magnitude"))


@query("with ev as ({ev}), q as (select case when depth_km is null then 'missing_depth' end as flag from ev union all select case when depth_km < -10 or depth_km > 800 then 'implausible_depth' end from ev union all select case when magnitude is null then 'missing_magnitude' end from ev union all select case when magnitude_type not in ('m','mb','md','ml','mlv','ms','mw','mwb','mwc','mwr','mww') then 'unknown_magnitude_type' end from ev union all select 'location_uncertainty_unknown' from ev union all select 'magnitude_uncertainty_unknown' from ev) select flag, count(*) as n from q where flag is not null group by flag")
def quality_flags(spark, sf_dir):
    return cat.quality_issues(catalog(spark, sf_dir)).groupBy("flag").agg(F.count("*").alias("n"))


@query("with ev as ({ev}), run as (select source_id, event_id, event_time from ev where source_id <> 'click'), last as (select source_id, max(event_time) as started, max_by(event_id, (event_time, event_id)) as run_id from run group by source_id) select s.source_id, coalesce(last.run_id, -1) as run_id, last.started from (select distinct source_id from ev) s left join last using (source_id)")
def source_status(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    last = ev.where("source_id <> 'click'").groupBy("source_id").agg(F.max_by("event_id", F.struct("event_time", "event_id")).alias("run_id"), F.max("event_time").alias("started"))
    return ev.select("source_id").distinct().join(last, "source_id", "left").withColumn("run_id", F.coalesce("run_id", F.lit(-1)))


@query("with ev as ({ev}) select source_id, count(*) as n from ev where event_id not in (select event_id from ev where event_id % 3 = 0) group by source_id")
def unclassified_events(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    return ev.join(ev.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


@query("with ev as ({ev}) select count(*) as n, sum(event_id)::bigint as id_sum from ev a where exists (select 1 from ev b where b.source_event_key = a.source_event_key and b.source_id = 'signup')")
def already_represented(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    signup = ev.where("source_id = 'signup'").select("source_event_key")
    return ev.join(signup, "source_event_key", "left_semi").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("with held as (select s_suppkey as k, s_nationkey as v from supplier), new as (select c_custkey as k, c_nationkey as v from customer where c_custkey % 4 = 0) select coalesce(n.k, h.k) as k, case when n.k is not null then n.v else h.v end as v from held h full join new n on h.k = n.k")
def registry_upsert(spark, sf_dir):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    held = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return cat.upsert(held, t("customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v")), ["k"])


@query("select min(event_id) as event_id, user_id, event_type from events where event_id % 2 = 1 and (user_id, event_type) not in (select (user_id, event_type) from events where event_id % 2 = 0) group by user_id, event_type")
def appended_if_absent(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    new = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return cat.append_if_absent(new, e.where("event_id % 2 = 0"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(f"with ev as ({{ev}}), {LATEST}, r as (select source_id, event_id::varchar as entry, row_number() over (partition by source_id order by event_id) - 1 as place, count(*) over (partition by source_id) as entries from latest), e as (select source_id, place, entry from r where entries <= 4096 union all select source_id, place // 4096 as place, sha256(string_agg(entry, ',' order by place)) as entry from r where entries > 4096 group by source_id, place // 4096), n as (select source_id, count(*) as revisions from latest group by 1) select source_id, revisions, sha256('{{as_of}}|' || string_agg(entry, ',' order by place)) as digest from e join n using (source_id) group by source_id, revisions")
def dataset_manifest(spark, sf_dir):
    return cat.manifest(cat.as_of(catalog(spark, sf_dir), at(AS_OF)), AS_OF)


@query("with f as (select event_id, ts as issued, ts + interval 1 hour as start, ts + (event_id % 5) * interval 1 day as stop from events), s as (select case when issued is null then 'missing' when issued > timestamp '{as_of}' then 'future_issuance' when not (start <= timestamp '{as_of}' and timestamp '{as_of}' < stop) then 'expired' when epoch(timestamp '{as_of}' - issued) > 2 * 86400 then 'stale' else 'fresh' end as state from f) select state, count(*) as n from s group by state")
def forecast_freshness(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "ts as issued", "ts + make_dt_interval(0, 1) as start", "ts + make_dt_interval(cast(event_id % 5 as int)) as stop")
    state = cat.freshness(F.col("issued"), F.col("start"), F.col("stop"), at(AS_OF), 86400.0)
    return f.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# --- linkage ------------------------------------------------------------------------------------


@query("with ev as ({ev}), o as (select event_id as other_id, event_time + to_seconds(event_id % 90) as event_time, latitude + 0.01::double * (event_id % 30) as latitude, longitude, depth_km, magnitude + 0.1::double * (event_id % 5) as magnitude from ev where event_id % 2 = 0), p as (select a.event_id, b.other_id, abs(epoch_us(a.event_time) - epoch_us(b.event_time)) / 1e6 as dt, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * power(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))) as km, abs(a.magnitude - b.magnitude) as dm, abs(a.depth_km - b.depth_km) as dz from ev a join o b on b.event_time between a.event_time - interval 5 minute and a.event_time + interval 5 minute), s as (select event_id, other_id, exp(-0.5 * (power(dt / 30, 2) + 2 * power(km / 30, 2) + coalesce(power(dm / 0.5, 2), 0) + coalesce(power(dz / 40, 2), 0))) as p from p) select event_id, other_id, round(p, 6) as probability, case when p >= 0.95 then 'auto_match' when p >= 0.5 then 'candidate' else 'distinct' end as decision from s")
def linkage_candidates(spark, sf_dir):
    return rounded(linkage.link_candidates(catalog(spark, sf_dir), second_source(spark, sf_dir)))


def observed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of both sources."""
    own = catalog(spark, sf_dir).select("event_id", F.lit("first").alias("source_id"), "event_time", "available_at", "latitude", "longitude", "magnitude", "depth_km")
    other = second_source(spark, sf_dir).select((-F.col("other_id") - 1).alias("event_id"), F.lit("second").alias("source_id"), "event_time", F.expr("event_time + make_dt_interval(0, 0, 10, 0)").alias("available_at"), "latitude", "longitude", "magnitude", "depth_km")
    return own.union(other)


@query()
def canonical_links(spark, sf_dir):
    """Greedy linkage of both sources' observations; see the tests for its sequential check."""
    return linkage.canonical_events(observed_twice(spark, sf_dir))


# --- frequency and magnitude --------------------------------------------------------------------

BINNED = "m as (select magnitude_type, round_even(magnitude / 0.1, 0)::int as k from ev where magnitude is not null), h as (select magnitude_type, k, count(*) as n from m group by 1, 2), axis as (select magnitude_type, unnest(range(min(k), max(k) + 1))::int as k from h group by 1), f as (select magnitude_type, k, coalesce(n, 0)::bigint as n, round(k * 0.1::double, 10) as bin, sum(coalesce(n, 0)) over (partition by magnitude_type order by k desc rows unbounded preceding)::bigint as n_above from axis left join h using (magnitude_type, k))"


@query(f"with ev as ({{ev}}), {BINNED} select magnitude_type, bin, n, n_above from f")
def magnitude_histogram(spark, sf_dir):
    return magnitudes.histogram(catalog(spark, sf_dir), ["magnitude_type"]).select("magnitude_type", "bin", "n", "n_above")


@query(f"with ev as ({{ev}}), {BINNED}, g as (select magnitude_type, sum(n)::bigint as events, max_by(bin, (n, -k)) as mode from f where n > 0 group by 1) select magnitude_type, events, case when events >= 200 then 'supported' when events >= 100 then 'high_uncertainty' when events >= 50 then 'research_only' else 'not_estimable' end as support, case when events >= 50 then round(mode + 0.2, 6) end as mc from g")
def mc_maximum_curvature(spark, sf_dir):
    return rounded(magnitudes.mc_maximum_curvature(catalog(spark, sf_dir), ["magnitude_type"]))


@query(f"with ev as ({{ev}}), {BINNED}, c as (select *, sum(n * bin) over (partition by magnitude_type order by k desc rows unbounded preceding) / n_above as mean, max(k) over (partition by magnitude_type) as top, sum(n) over (partition by magnitude_type)::bigint as events from f), d as (select *, log10(2.718281828459045) / (mean - (bin - 0.05)) as b from c where n_above >= 10 and top - k + 1 >= 10 and mean > bin - 0.05), x as (select d.magnitude_type, d.k as k0, d.bin as bin0, d.events, 100 * (1 - sum(abs(f.n_above - d.n_above * power(10.0::double, -d.b * (f.bin - d.bin)))) / sum(f.n_above)) as fit from d join f on d.magnitude_type = f.magnitude_type and f.k >= d.k group by all), y as (select magnitude_type, max(events) as events, min(case when fit >= 95 then bin0 end) as m95, min(case when fit >= 90 then bin0 end) as m90 from x group by 1) select magnitude_type, events, round(case when events >= 50 then coalesce(m95, m90) end, 6) as mc, case when m95 is not null then 95 when m90 is not null then 90 end as confidence from y")
def mc_goodness_of_fit(spark, sf_dir):
    return rounded(magnitudes.mc_goodness_of_fit(catalog(spark, sf_dir), ["magnitude_type"]))


B_SQL = "g as (select {keys}, mc, count(*) as n, avg(m) as mean, var_samp(m) as v, max(m) - max(mc) as span from s where m >= mc - 1e-9 group by all), b as (select *, case when n >= 50 and mean > mc - 0.05 then log10(2.718281828459045) / (mean - (mc - 0.05)) end as b from g) select {keys}, round(mc, 6) as mc, n, round(b, 6) as b, round(2.30 * b * b * sqrt(v / n), 6) as b_error, round(log10(n) + b * mc, 6) as a, span < 1.5 as limited_range, case when b is not null then not (b between 0.5 and 1.5) end as unusual from b"


@query("with ev as ({ev}), s as (select magnitude_type, round(round_even(magnitude / 0.1, 0) * 0.1, 10) as m, 3.5::double as mc from ev where magnitude is not null), " + B_SQL.replace("{keys}", "magnitude_type"))
def b_value_by_type(spark, sf_dir):
    return rounded(magnitudes.b_value(catalog(spark, sf_dir), ["magnitude_type"], 3.5))


@query("with ev as ({ev}), s as (select threshold, round(round_even(magnitude / 0.1, 0) * 0.1, 10) as m, round(round_even(threshold / 0.1, 0) * 0.1, 10) as mc from ev, (select unnest([3.0, 3.2, 3.4, 3.6, 3.8, 4.0, 4.2, 4.4, 4.6, 4.8])::double as threshold) where magnitude is not null), " + B_SQL.replace("{keys}", "threshold"))
def b_value_sweep(spark, sf_dir):
    return rounded(magnitudes.b_value_sweep(catalog(spark, sf_dir), [], [3.0, 3.2, 3.4, 3.6, 3.8, 4.0, 4.2, 4.4, 4.6, 4.8]))


@query()
def mc_entire_range(spark, sf_dir):
    """Roll-off and exponential law with a bootstrap interval (recovery is tested)."""
    return rounded(fitting.entire_range(magnitudes.histogram(catalog(spark, sf_dir), []).select("bin", "n"), resamples=40))


# --- grid, places, tectonics --------------------------------------------------------------------

HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians({b1}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * power(sin((radians({b2}) - radians({a2})) / 2), 2))))"
CELLS = "cell as (select 'grid:r' || lpad((i // 20)::varchar, 4, '0') || ':c' || lpad((i % 20)::varchar, 4, '0') as cell_id, -60::double + (i // 20) + 0.5 as latitude, -82::double + (i % 20) + 0.5 as longitude, power(6371.0088::double, 2) * radians(1::double) * abs(sin(radians(-59::double + i // 20)) - sin(radians(-60::double + i // 20))) as area_km2 from range(900) t(i))"


@query(f"with {CELLS}, ev as ({{ev}}), n as (select 'grid:r' || lpad((floor(latitude + 60 + 1e-9)::int)::varchar, 4, '0') || ':c' || lpad((floor(longitude + 82 + 1e-9)::int)::varchar, 4, '0') as cell_id, count(*) as n from ev where floor(latitude + 60 + 1e-9) between 0 and 44 and floor(longitude + 82 + 1e-9) between 0 and 19 group by 1) select cell_id, round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(area_km2, 4) as area_km2, coalesce(n, 0)::bigint as n from cell left join n using (cell_id)")
def cell_counts(spark, sf_dir):
    """All cells of the grid with their events, empty ones too."""
    where = grid.point_to_cell(F.col("latitude"), F.col("longitude"), *GRID)
    n = catalog(spark, sf_dir).groupBy(where.alias("cell_id")).agg(F.count("*").alias("n")).where("cell_id is not null")
    out = grid.cells(spark, *GRID).join(n, "cell_id", "left")
    return out.select("cell_id", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), F.round("area_km2", 4).alias("area_km2"), F.coalesce("n", F.lit(0)).alias("n"))


@query("with ev as ({ev}), bin(bin, lower, upper) as (values (0, 3.0, 4.0), (1, 4.0, 5.0), (2, 5.0, 6.0), (3, 6.0, 7.0), (4, 7.0, null)) select bin, count(*) as n from ev join bin on magnitude >= lower and (upper is null or magnitude < upper) group by bin")
def magnitude_bin_counts(spark, sf_dir):
    return grid.assign_bins(catalog(spark, sf_dir)).groupBy("bin").agg(F.count("*").alias("n"))


@query("with ev as ({ev}), place(place_id, plat, plon) as (values " + ", ".join(f"('{i}', {a}::double, {b}::double)" for i, _, a, b in grid.PLACES) + "), c as (select latitude, longitude, 0.001::double * (event_id % 100) as expected from ev), h as (select place_id, count(*) as cells, sum(expected) as expected from c join place on 2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(latitude) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * power(sin((radians(longitude) - radians(plon)) / 2), 2)))) <= 40 group by 1) select place_id, coalesce(cells, 0)::bigint as cells, round(expected, 6) as expected, round(case when expected <= 0 then 0 when expected > 50 then 1 else 1 - exp(-expected) end, 6) as probability from place left join h using (place_id)")
def place_readout(spark, sf_dir):
    rates = catalog(spark, sf_dir).select("latitude", "longitude", F.expr("0.001D * (event_id % 100)").alias("expected"))
    return rounded(grid.place_readout(rates))


NODES = "node as (select round_even(latitude, 0)::int as lat_index, round_even(longitude, 0)::int as lon_index, avg(depth_km) as depth_km, case when count(depth_km) % 7 <> 0 then avg(event_id % 90) end as dip, ((sum(event_id) * 13) % 360)::double as strike from ev where depth_km is not null group by 1, 2)"


def slab_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of mean depths on whole degrees, with dips missing here and there."""
    lat, lon = grid.lattice_key(F.col("latitude"), F.col("longitude"), 1.0)
    ev = catalog(spark, sf_dir).where("depth_km is not null")
    return ev.groupBy(lat.alias("lat_index"), lon.alias("lon_index")).agg(F.avg("depth_km").alias("depth_km"), F.expr("case when count(depth_km) % 7 <> 0 then avg(event_id % 90) end").alias("dip"), F.expr("cast((sum(event_id) * 13) % 360 as double)").alias("strike"))


SAMPLES = "pt as (select event_id as point_id, latitude, longitude from ev), corner as (select point_id, unnest(case when abs(latitude - round_even(latitude, 0)) < 1e-9 then [struct_pack(k := round_even(latitude, 0)::int, w := 1::double)] else [struct_pack(k := floor(latitude)::int, w := 1 - (latitude - floor(latitude))), struct_pack(k := floor(latitude)::int + 1, w := latitude - floor(latitude))] end) as a, case when abs(longitude - round_even(longitude, 0)) < 1e-9 then [struct_pack(k := round_even(longitude, 0)::int, w := 1::double)] else [struct_pack(k := floor(longitude)::int, w := 1 - (longitude - floor(longitude))), struct_pack(k := floor(longitude)::int + 1, w := longitude - floor(longitude))] end as bs from pt), flat as (select point_id, a, unnest(bs) as b from corner), spread as (select point_id, a.k as lat_index, b.k as lon_index, a.w * b.w as w from flat), need as (select point_id, count(*) as need from spread group by 1), got as (select point_id, count(*) as corners, sum(w * depth_km) as depth_km, case when count(dip) = count(*) then sum(w * dip) end as dip, sum(w * cos(radians(strike))) as x, sum(w * sin(radians(strike))) as y from spread join node using (lat_index, lon_index) group by 1), slab as (select got.*, case when sqrt(x * x + y * y) > 1e-12 then (degrees(atan2(y, x)) + 360) % 360 end as strike from got join need using (point_id) where corners = need)"


@query(f"with ev as ({{ev}}), {NODES}, {SAMPLES} select point_id, corners, round(depth_km, 5) as depth_km, round(dip, 5) as dip, round(strike, 4) as strike from slab")
def slab_samples(spark, sf_dir):
    points = catalog(spark, sf_dir).select(F.col("event_id").alias("point_id"), "latitude", "longitude")
    s = grid.bilinear_sample(points, slab_nodes(spark, sf_dir), 1.0)
    return s.select("point_id", "corners", F.round("depth_km", 5).alias("depth_km"), F.round("dip", 5).alias("dip"), F.round("strike", 4).alias("strike"))


def traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and stand-in fault segments."""
    ev = catalog(spark, sf_dir)
    segments = ev.where("event_id % 500 = 7").selectExpr("event_id as trace_id", "latitude as lat1", "longitude as lon1", "latitude + 1 + (event_id % 3) * 0.5D as lat2", "longitude + (event_id % 5) * 0.3D - 0.6D as lon2")
    return ev.select(F.col("event_id").alias("point_id"), "latitude", "longitude"), segments


def xyz(lat: str, lon: str, name: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) as {name}x, cos(radians({lat})) * sin(radians({lon})) as {name}y, sin(radians({lat})) as {name}z"


def dot(a: str, b: str) -> str:
    return " + ".join(f"{a}{k} * {b}{k}" for k in "xyz")


def cross(a: str, b: str, name: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y as {name}x, {a}z * {b}x - {a}x * {b}z as {name}y, {a}x * {b}y - {a}y * {b}x as {name}z"


ANGLE = lambda a, b: "2 * asin(least(1, sqrt(" + " + ".join(f"({a}{k} - {b}{k}) * ({a}{k} - {b}{k})" for k in "xyz") + ") / 2))"
ARCS = (
    f"seg as (select event_id as trace_id, {xyz('latitude', 'longitude', 'a')}, {xyz('latitude + 1 + (event_id % 3) * 0.5::double', 'longitude + (event_id % 5) * 0.3::double - 0.6::double', 'g')} from ev where event_id % 500 = 7), "
    f"nor as (select *, {cross('a', 'g', 'n')} from seg), foot as (select *, {cross('n', 'a', 'u')}, {cross('g', 'n', 'v')} from nor), "
    f"pt as (select event_id as point_id, {xyz('latitude', 'longitude', 'p')} from ev), "
    f"d as (select point_id, trace_id, 6371.0088 * case when {dot('u', 'p')} >= 0 and {dot('v', 'p')} >= 0 then asin(least(1, abs({dot('n', 'p')}) / sqrt({dot('n', 'n')}))) else least({ANGLE('p', 'a')}, {ANGLE('p', 'g')}) end as km from pt, foot)"
)


@query(f"with ev as ({{ev}}), {ARCS} select point_id, round(min(km), 4) as km from d group by point_id")
def nearest_traces(spark, sf_dir):
    """The nearest of all segments for every point, by great circles."""
    return nearest_trace(*traces(spark, sf_dir)).select("point_id", F.round("km", 4).alias("km"))


ERF = "sign({x}) * 1.1283791670955126 * exp(-power(least(abs({x}), 5), 2)) * list_reduce(list_prepend(struct_pack(t := least(abs({x}), 5), s := least(abs({x}), 5)), list_transform(range(1, 91), lambda n: struct_pack(t := n::double, s := 0::double))), lambda a, n: struct_pack(t := a.t * 2 * power(least(abs({x}), 5), 2) / (2 * n.t + 1), s := a.s + a.t * 2 * power(least(abs({x}), 5), 2) / (2 * n.t + 1))).s"


@query(f"with ev as ({{ev}}), {NODES}, {SAMPLES}, e as (select event_id, ev.depth_km, slab.depth_km as slab_depth, sqrt(325::double) as s from ev left join slab on point_id = event_id), z as (select event_id, unnest([(-10 - (depth_km - slab_depth)) / (s * sqrt(2)), (10 - (depth_km - slab_depth)) / (s * sqrt(2)), (60 - (depth_km - slab_depth)) / (s * sqrt(2)), (50 - depth_km) / (15 * sqrt(2))]) as x, unnest(['a', 'h', 't', 'g']) as part, depth_km, slab_depth from e), c as (select event_id, max(case when part = 'a' then v end) as a, max(case when part = 'h' then v end) as h, max(case when part = 't' then v end) as t, max(case when part = 'g' then v end) as g, max(depth_km) as depth_km, max(slab_depth) as slab_depth from (select *, 0.5 * (1 + {ERF.replace('{x}', 'x')}) as v from z) group by 1), p as (select event_id, depth_km is null or slab_depth is null as none, greatest(0, h - a) as i, greatest(0, t - h) as s, a * g as c, a * (1 - g) + 1 - t as u from c), m as (select event_id, case when none then 0 else i / (i + s + c + u) end as i, case when none then 0 else s / (i + s + c + u) end as s, case when none then 0 else c / (i + s + c + u) end as c, case when none then 1 else u / (i + s + c + u) end as u from p) select event_id, round(i, 6) as interface, round(s, 6) as intraslab, round(c, 6) as crustal, round(u, 6) as unknown, case when greatest(i, s, c, u) < 0.6 then 'unknown' when i >= 0.6 then 'interface' when s >= 0.6 then 'intraslab' when c >= 0.6 then 'crustal' else 'unknown' end as label from m")
def tectonic_classes(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    points = ev.select(F.col("event_id").alias("point_id"), "latitude", "longitude")
    slab = grid.bilinear_sample(points, slab_nodes(spark, sf_dir), 1.0).select(F.col("point_id").alias("event_id"), F.col("depth_km").alias("slab_depth"))
    out = grid.classify(ev.select("event_id", "depth_km").join(slab, "event_id", "left"))
    return rounded(out.select("event_id", "interface", "intraslab", "crustal", "unknown", "label"))


# --- declustering, rates, triggering ------------------------------------------------------------

SMALL = "mcx as (select round(max_by(k, (n, -k)) * 0.1::double + 0.2::double, 10) as mc from (select round_even(magnitude / 0.1, 0)::int as k, count(*) as n from ev where magnitude is not null group by 1)), s as (select *, (epoch_us(event_time) - epoch_us(timestamp '{origin}')) / 8.64e10 as t_days from ev where magnitude >= (select mc from mcx))"
PARENTS = "eta as (select c.event_id, p.event_id as parent_id, p.event_time as pt, greatest((epoch_us(c.event_time) - epoch_us(p.event_time)) / 1e6 / 86400, 1.0 / 86400) * power(greatest(" + HAVERSINE.format(a1="c.latitude", a2="c.longitude", b1="p.latitude", b2="p.longitude") + ", 1e-3), 1.6) * power(10.0::double, -p.magnitude) as eta from s c join s p on (p.event_time, p.event_id) < (c.event_time, c.event_id)), parent as (select event_id, min_by(parent_id, (eta, pt, parent_id)) as parent_id, log10(min(eta)) as log_eta from eta group by 1)"


@query(f"with ev as ({{ev}}), {SMALL}, {PARENTS} select event_id, parent_id, round(log_eta, 6) as log_eta from parent")
@complete
def nearest_parents(spark, sf_dir, least):
    return rounded(seismicity.nearest_parents(sample(spark, sf_dir, least)))


@query()
def declustered(spark, sf_dir):
    """Background and triggered events by a two-component mixture fitted on the cluster."""
    return rounded(seismicity.decluster(sample(spark, sf_dir, completeness(spark, sf_dir))))


@query(f"with recursive ev as ({{ev}}), {SMALL}, {PARENTS}, link as (select s.event_id, parent_id, coalesce(log_eta >= 0.5, true) as free from s left join parent using (event_id)), up as (select event_id, event_id as root, free, parent_id from link union all select up.event_id, l.event_id, l.free, l.parent_id from up join link l on l.event_id = up.parent_id where not up.free) select event_id, root as root_id from up where free")
@complete
def family_roots(spark, sf_dir, least):
    s = sample(spark, sf_dir, least)
    links = s.select("event_id").join(seismicity.nearest_parents(s), "event_id", "left").withColumn("is_background", F.coalesce(F.col("log_eta") >= 0.5, F.lit(True)))
    return seismicity.family_roots(links).select("event_id", "root_id")


WIDTHS = "near as (select a.event_id, " + HAVERSINE.format(a1="a.latitude", a2="a.longitude", b1="b.latitude", b2="b.longitude") + " as km from s a join s b on a.event_id <> b.event_id), width as (select event_id, greatest(1.0, list_sort(list(km))[least(5, count(*))]) as h from near group by 1)"


@query(f"with ev as ({{ev}}), {SMALL}, {WIDTHS} select event_id, round(h, 6) as bandwidth_km from width")
@complete
def kernel_bandwidths(spark, sf_dir, least):
    return rounded(seismicity.bandwidths(sample(spark, sf_dir, least)).select("event_id", "bandwidth_km"))


@query(f"with ev as ({{ev}}), {SMALL}, {WIDTHS}, {CELLS} select cell_id, round(sum(exp(-0.5 * power(km / h, 2)) / (2 * pi() * h * h)) * any_value(area_km2) / (30 / 365.25), 6) as rate_per_year from (select cell_id, area_km2, h, " + HAVERSINE.format(a1="cell.latitude", a2="cell.longitude", b1="s.latitude", b2="s.longitude") + " as km from cell, s join width using (event_id)) group by cell_id")
@complete
def background_rates(spark, sf_dir, least):
    kernels = seismicity.bandwidths(sample(spark, sf_dir, least))
    return rounded(seismicity.background_rates(grid.cells(spark, *GRID), kernels, 30.0).select("cell_id", "rate_per_year"))


@query(f"with ev as ({{ev}}), {SMALL} select a.event_id, round(0.5 + coalesce(sum(0.05 * exp(b.magnitude - {{mc}}) * power(a.t_days - b.t_days + 0.1, -1.2)), 0), 6) as intensity from s a left join s b on b.t_days < a.t_days group by a.event_id")
@complete
def etas_intensities(spark, sf_dir, least):
    out = seismicity.intensities(sample(spark, sf_dir, least), ETAS.mu, ETAS.k0, ETAS.alpha, ETAS.c, ETAS.p, least)
    return rounded(out.select("event_id", "intensity"))


OMORI = "((power({x} + 0.1, -0.2::double) - power(0.1::double, -0.2::double)) / -0.2)"


@query(f"with ev as ({{ev}}), {SMALL}, w as (select w, 28::double - w as start, 29::double - w as stop from range(0, 28) t(w)), e as (select w.w, coalesce(sum(0.05 * exp(magnitude - {{mc}}) * ({OMORI.format(x='(stop - t_days)')} - {OMORI.format(x='(start - t_days)')})), 0) as fed from w left join s on t_days < start group by 1) select w, round(0.5 + fed, 6) as expected from e")
@complete
def expected_counts(spark, sf_dir, least):
    windows = spark.range(28).select(F.col("id").alias("w"), (F.lit(28.0) - F.col("id")).alias("start"), (F.lit(29.0) - F.col("id")).alias("stop"))
    out = seismicity.expected_counts(windows, sample(spark, sf_dir, least), ETAS.mu, ETAS.k0, ETAS.alpha, ETAS.c, ETAS.p, least)
    return rounded(out.select("w", "expected"))


@query(f"with ev as ({{ev}}), {SMALL}, f as (select min(t_days) as first from s), w as (select w, 28::double - w * 0.5::double as start, 28.5::double - w * 0.5::double as stop from f, range(0, 200) t(w) where w = 0 or 28 - w * 0.5 >= first), x as (select w.w, 0.25 + coalesce(sum(case when t_days < start then 0.05 * exp(magnitude - {{mc}}) * ({OMORI.format(x='greatest(stop - t_days, 0)')} - {OMORI.format(x='greatest(start - t_days, 0)')}) end), 0) as expected, count(case when t_days >= start and t_days < stop then 1 end) as observed from w left join s on t_days < stop group by 1), d as (select *, case when observed <= expected then 0 else 2 * (observed * ln(observed / expected) - (observed - expected)) end as dev from x) select max(case when w = 0 then observed end) as observed, round(max(case when w = 0 then expected end), 6) as expected, round(max(case when w = 0 then dev end), 6) as deviance, count(case when w > 0 then 1 end) as windows, round(case when count(case when w > 0 then 1 end) >= 30 then 100.0 * sum(case when w > 0 and dev <= (select dev from d where w = 0) then 1 else 0 end) / count(case when w > 0 then 1 end) end, 6) as score from d")
@complete
def anomaly_index(spark, sf_dir, least):
    return rounded(seismicity.anomaly_index(sample(spark, sf_dir, least), 28.5, ETAS.mu, ETAS.k0, ETAS.alpha, ETAS.c, ETAS.p, least, window_days=0.5))


@query()
@complete
def omori_families(spark, sf_dir, least):
    """Aftershock decay of every family of the declustered catalog."""
    ev = sample(spark, sf_dir, least)
    links = materialize(seismicity.decluster(ev), "links")
    return rounded(fitting.omori(seismicity.aftershocks(ev, links), ["family"], "duration"))


@query()
@complete
def temporal_etas_fit(spark, sf_dir, least):
    """Six restarts in step on every event at or above the magnitude of completeness."""
    ev = sample(spark, sf_dir, least)
    return rounded(fitting.temporal_etas(ev, 31.0, least))


@query()
def spatiotemporal_etas_fit(spark, sf_dir):
    """Three restarts in step on the events from 4.7 on; pairs of events grow with the square of the sample."""
    return rounded(fitting.spatiotemporal_etas(sample(spark, sf_dir, 4.7), 31.0, 1.0e7, 4.7))


# --- forecasts and scores -----------------------------------------------------------------------


def forecast_rates(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    region = grid.cells(spark, *GRID).agg(F.sum("area_km2")).first()[0]
    return forecasting.forecast_cells(grid.cells(spark, *GRID), sample(spark, sf_dir, least), ETAS, 20.0, 27.0, least, region)


RATES = "fed as (select latitude, longitude, 0.05 * exp(magnitude - {mc}) * (" + OMORI.format(x="(27 - t_days)") + " - " + OMORI.format(x="(20 - t_days)") + ") as fed, 5 * exp(0.5 * (magnitude - {mc})) as d from s where t_days < 20), rate as (select cell_id, any_value(area_km2) as area_km2, 0.5 * 7 * any_value(area_km2) / (select sum(area_km2) from cell) + coalesce(sum(fed * 0.8 / (pi() * d * d) * power(1 + power(km / d, 2), -1.8)) * any_value(area_km2), 0) as expected from (select cell_id, area_km2, fed, d, " + HAVERSINE.format(a1="cell.latitude", a2="cell.longitude", b1="fed.latitude", b2="fed.longitude") + " as km from cell left join fed on true) group by 1)"
CUBE = "bin(bin, lower, upper) as (values (0, 3.0::double, 4.0::double), (1, 4.0, 5.0), (2, 5.0, 6.0), (3, 6.0, 7.0), (4, 7.0, null)), cube as (select cell_id, bin, lower, expected * case when lower >= {mc} then power(10::double, -(lower - {mc})) - coalesce(power(10::double, -(upper - {mc})), 0) end as expected from rate, bin)"


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, {RATES}, {CUBE} select cell_id, bin, round(expected, 6) as expected, round(1 - exp(-expected), 6) as probability, case when expected is null then 'not_estimable' else 'estimable' end as support from cube")
@complete
def forecast_cube(spark, sf_dir, least):
    cube = forecasting.forecast_cube(forecast_rates(spark, sf_dir, least), 1.0, least)
    return rounded(cube.select("cell_id", "bin", "expected", "probability", "support"))


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, {RATES}, {CUBE} select cell_id, round(cell.latitude, 6) as latitude, round(cell.longitude, 6) as longitude, lower, round(expected, 6) as expected, round(1 - exp(-expected), 6) as probability from cube join cell using (cell_id) where expected is not null and lower = (select coalesce(min(lower) filter (lower >= {{mc}}), min(lower)) from cube) order by round(expected, 6) desc, cell_id limit 100")
@complete
def forecast_detail(spark, sf_dir, least):
    """The 100 cells of the latest run with the most expected events in the lowest bin it can estimate."""
    cube = forecasting.forecast_cube(forecast_rates(spark, sf_dir, least), 1.0, least)
    cells = grid.cells(spark, *GRID)
    out = forecasting.run_detail(cube.withColumn("expected", r6("expected")), cells, least, limit=100)
    return rounded(out.select("cell_id", "latitude", "longitude", "lower", "expected", "probability"))


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, {RATES}, {CUBE} select grouping(cell_id) as by_bin, coalesce(cell_id, 'all') as cell_id, coalesce(bin, -1) as bin, round(sum(expected), 5) as expected from cube where expected is not null group by grouping sets ((cell_id), (bin))")
@complete
def forecast_marginals(spark, sf_dir, least):
    """Sums over bins and over cells in one pass."""
    cube = forecasting.forecast_cube(forecast_rates(spark, sf_dir, least), 1.0, least).where("expected is not null")
    return spark.sql("select cast(grouping(cell_id) as bigint) as by_bin, coalesce(cell_id, 'all') as cell_id, coalesce(bin, -1) as bin, round(sum(expected), 5) as expected from {cube} group by grouping sets ((cell_id), (bin))", cube=cube)


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, {RATES}, {CUBE} select distinct b.lower, b.upper from cube c join bin b using (bin) where c.expected is not null order by b.lower")
@complete
def forecast_bins(spark, sf_dir, least):
    """The magnitude bins that a forecast can estimate, in order."""
    cube = forecasting.forecast_cube(forecast_rates(spark, sf_dir, least), 1.0, least).where("expected is not null")
    return cube.select("lower", "upper").distinct().orderBy("lower")


@query("with ev as ({ev}), b as (select source_id, min(latitude) as s, max(latitude) as n, min(longitude) as w, max(longitude) as e from ev group by 1) select source_id, round(abs(radians(n - s) * 6371.0088 * radians(e - w) * 6371.0088 * cos(radians((s + n) / 2))), 3) as area_km2 from b")
def region_areas(spark, sf_dir):
    """Flat areas of the boxes around each source's events."""
    b = catalog(spark, sf_dir).groupBy("source_id").agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    return b.select("source_id", F.round(flat_area_km2("s", "n", "w", "e"), 3).alias("area_km2"))


@query("with t as (select event_type, count(*) * 0.001::double as rate from events group by 1), c as (select event_type, rate, n, sum(exp(n * ln(rate) - rate - lgamma(n + 1))) over (partition by event_type order by n) as p from t, range(0, 2000) z(n)) select event_type, round(rate, 6) as rate, min(n) filter (p >= 0.05) as low, min(n) filter (p >= 0.95) as high from c group by 1, 2")
def predictive_intervals(spark, sf_dir):
    """Poisson intervals that hold nine tenths of the counts to come."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg((F.count("*") * 0.001).alias("rate"))
    return t.select("event_type", r6("rate").alias("rate"), poisson_ppf(F.lit(0.05), F.col("rate")).alias("low"), poisson_ppf(F.lit(0.95), F.col("rate")).alias("high"))


@query("select user_id, state, round(lifetime, 6) as lifetime_offspring from (select user_id, case when alpha >= b * ln(10) then 'non_finite_magnitude_productivity' when p <= 1 then 'finite_horizon_only_p_not_above_one' when k0 * (b * ln(10) / (b * ln(10) - alpha)) * power(0.1::double, 1 - p) / (p - 1) >= 1 then 'supercritical_lifetime_branching' else 'subcritical_lifetime_branching' end as state, case when alpha < b * ln(10) and p > 1 then k0 * (b * ln(10) / (b * ln(10) - alpha)) * power(0.1::double, 1 - p) / (p - 1) end as lifetime from (select user_id, 0.01::double * (1 + user_id % 30) as k0, 0.1::double * (user_id % 30) as alpha, 0.9::double + 0.05::double * (user_id % 13) as p, 1::double as b from (select distinct user_id from events)))")
def branching_stability(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    params = users.selectExpr("user_id", "0.5D as mu", "0.01D * (1 + user_id % 30) as k0", "0.1D * (user_id % 30) as alpha", "0.1D as c", "0.9D + 0.05D * (user_id % 13) as p", "1D as b", "7D as horizon")
    return rounded(forecasting.stability(params).select("user_id", "state", "lifetime_offspring"))


SCORED = "row as (select event_id as id, case when event_id % 7 = 0 then event_id % 3 else 0 end as observed, least(1, (event_id * 31 % 1000) / 1000::double) as probability, 0.05::double + (event_id * 17 % 100) / 100::double as rate, 0.3::double as reference_rate, event_type from events)"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("event_id as id", "case when event_id % 7 = 0 then event_id % 3 else 0 end as observed", "least(1D, (event_id * 31 % 1000) / 1000D) as probability", "0.05D + (event_id * 17 % 100) / 100D as rate", "0.3D as reference_rate", "event_type")


@query(f"with {SCORED}, x as (select *, case when observed > 0 then 1 else 0 end as y, least(greatest(probability, 1e-12), 1 - 1e-12) as p, case observed when 0 then exp(-rate) when 1 then exp(-rate) * (1 + rate) else exp(-rate) * (1 + rate + rate * rate / 2) end as cdf, case observed when 0 then 0 when 1 then exp(-rate) else exp(-rate) * (1 + rate) end as below from row) select event_type, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss, round(avg(power(probability - y, 2)), 6) as brier, round(sum(observed * ln(rate) - rate - lgamma(observed + 1)), 5) as log_likelihood, round(avg(case when (observed = 0 or below < 0.975) and cdf >= 0.025 then 1 else 0 end), 6) as coverage, sum(observed)::bigint as events, round((sum(observed * ln(rate) - rate - lgamma(observed + 1)) - sum(observed * ln(0.3::double) - 0.3 - lgamma(observed + 1))) / sum(observed), 5) as gain_per_event from x group by event_type")
def forecast_scores(spark, sf_dir):
    s = scoring.basic_scores(scored_rows(spark, sf_dir), ["event_type"])
    return s.select("event_type", r6("log_loss").alias("log_loss"), r6("brier").alias("brier"), F.round("log_likelihood", 5).alias("log_likelihood"), r6("coverage").alias("coverage"), "events", F.round("gain_per_event", 5).alias("gain_per_event"))


@query(f"with {SCORED}, t as (select threshold, count(*) filter (observed > 0 and probability >= threshold) as tp, count(*) filter (observed = 0 and probability >= threshold) as fp, count(*) filter (observed > 0 and probability < threshold) as fn, count(*) filter (observed = 0 and probability < threshold) as tn from row, (select unnest([0.1, 0.5, 0.9, 2.0])::double as threshold) group by 1) select threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(fp / nullif(fp + tn, 0), 6) as false_alarm, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from t")
def threshold_scores(spark, sf_dir):
    return rounded(scoring.threshold_scores(scored_rows(spark, sf_dir), [0.1, 0.5, 0.9, 2.0]))


@query(f"with {SCORED}, r as (select observed, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2 as rk from row) select round((sum(case when observed > 0 then rk end) - count(*) filter (observed > 0) * (count(*) filter (observed > 0) + 1) / 2) / (count(*) filter (observed > 0) * count(*) filter (observed = 0)), 6) as auc from r")
def roc_auc(spark, sf_dir):
    return rounded(scoring.roc_auc(scored_rows(spark, sf_dir)))


@query(f"with {SCORED}, r as (select observed, row_number() over (order by probability desc, id) as place, sum(case when observed > 0 then 1 else 0 end) over (order by probability desc, id) as hits from row) select round(sum(case when observed > 0 then hits / place end) / count(*) filter (observed > 0), 6) as average_precision from r")
def average_precision(spark, sf_dir):
    return rounded(scoring.average_precision(scored_rows(spark, sf_dir), "id"))


@query(f"with {SCORED}, r as (select *, row_number() over (order by probability, id) as rk, count(*) over () as n from row), b as (select *, (select min(i) from range(0, 10) t(i) where rk <= (i + 1) * n // 10) as bucket from r) select bucket::int as bucket, count(*) as n, round(avg(probability), 6) as mean_probability, round(avg(case when observed > 0 then 1 else 0 end), 6) as observed_share from b group by 1")
def reliability_curve(spark, sf_dir):
    return rounded(scoring.reliability(scored_rows(spark, sf_dir), "id"))


@query(f"with {SCORED}, t as (select event_type, sum(observed) as observed, count(*) * 0.14::double as expected from row group by 1), p as (select event_type, observed::bigint as observed, expected, (select sum(exp(-expected + i * ln(expected) - lgamma(i + 1))) from range(0, (observed + 1)::bigint) z(i)) as low, 1 - (select sum(exp(-expected + i * ln(expected) - lgamma(i + 1))) from range(0, observed::bigint) z(i)) as high from t) select event_type, observed, round(expected, 6) as expected, round(high, 6) as p_at_least, round(low, 6) as p_at_most, low > 0.025 and high > 0.025 as consistent from p")
def number_test(spark, sf_dir):
    t = scored_rows(spark, sf_dir).groupBy("event_type").agg(F.sum("observed").alias("observed"), (F.count("*") * 0.14).alias("expected"))
    return rounded(scoring.number_test(t).select("event_type", "observed", "expected", "p_at_least", "p_at_most", "consistent"))


@query()
def likelihood_test(spark, sf_dir):
    return rounded(scoring.likelihood_test(scored_rows(spark, sf_dir), simulations=200))


@query()
def space_test(spark, sf_dir):
    """Cells alone, given the observed total: every simulated catalog has that many events."""
    cells = scored_rows(spark, sf_dir).groupBy(F.pmod("id", F.lit(400)).alias("id")).agg(F.sum("observed").alias("observed"), F.sum("rate").alias("rate"))
    return rounded(scoring.marginal_test(cells, simulations=200))


@query()
def magnitude_test(spark, sf_dir):
    """Magnitude bins alone: counts of the catalog per bin of 0.5 against the exponential law above 3.5."""
    bin_of = F.floor((F.col("magnitude") - 3.5) / 0.5).cast("long")
    seen = catalog(spark, sf_dir).where("magnitude >= 3.5").groupBy(bin_of.alias("id")).agg(F.count("*").alias("observed"))
    share = F.pow(F.lit(10.0), -0.5 * F.col("id")) - F.pow(F.lit(10.0), -0.5 * (F.col("id") + 1))
    return rounded(scoring.marginal_test(seen.withColumn("rate", share), simulations=200))


@query(f"with {SCORED}, r as (select *, row_number() over (order by probability, id) as rk, count(*) over () as n from row), b as (select *, (select min(i) from range(0, 10) t(i) where rk <= (i + 1) * n // 10) as bucket from r), c as (select count(*) as n, avg(probability) as p, avg(case when observed > 0 then 1 else 0 end) as y from b group by bucket) select round(sum(n * abs(p - y)) / sum(n), 6) as ece from c")
def calibration_error(spark, sf_dir):
    return rounded(scoring.calibration_error(scoring.reliability(scored_rows(spark, sf_dir), "id")))


@query()
@complete
def simulated_catalogs(spark, sf_dir, least):
    """Quantiles of simulated counts over a week, fed by every event before it, however many they are."""
    history = sample(spark, sf_dir, least).where("t_days < 20").select("event_id", "t_days", "magnitude")
    runs = forecasting.simulate(spark, ETAS, 1.0, least, history, 20.0, 27.0, 500, limit=None)
    return rounded(runs.agg(F.count("*").alias("runs"), F.avg("events").alias("mean"), *(F.percentile("events", q).alias(f"q{int(100 * q)}") for q in (0.05, 0.5, 0.95)), F.max("largest").alias("largest")))


@query("with f as (select i as fold, 5::double + i as start, 8::double + i as stop from range(0, 20) t(i)), e as (select (epoch_us(ts) - epoch_us(timestamp '{origin}')) / 8.64e10 as t from events) select fold, count(e.t) as observed, count(e.t) * 1.0::double / (select count(*) from e where t < f.start) as ratio from f left join e on t >= start and t < stop group by fold, f.start".replace("count(e.t) * 1.0::double / (select count(*) from e where t < f.start) as ratio", "round(max(start), 6) as start"))
def walk_forward_folds(spark, sf_dir):
    """Observed counts of every overlapping fold in one pass over the events."""
    f = forecasting.folds(spark, 5.0, 27.0, 1.0, 3.0)
    e = catalog(spark, sf_dir).select(seismicity.days_since(F.col("event_time"), at(ORIGIN)).alias("t"))
    seen = e.join(F.broadcast(f), (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop"))).groupBy("fold").agg(F.count("*").alias("observed"))
    return rounded(f.join(seen, "fold", "left").select("fold", F.coalesce("observed", F.lit(0)).alias("observed"), "start"))


def paired_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of two rate models per day of the catalog."""
    day = F.floor(F.col("id") / 500).cast("int")
    rows = scored_rows(spark, sf_dir).withColumn("fold", day)
    s = scoring.basic_scores(rows, ["fold"])
    return s.select("fold", F.col("log_likelihood").alias("candidate_ll"), F.col("reference_log_likelihood").alias("champion_ll"), "events")


@query()
def model_promotion(spark, sf_dir):
    return rounded(scoring.promotion(paired_folds(spark, sf_dir), resamples=200))


@query("with recursive ev as ({ev}), p as (select a.event_id as a, b.event_id as b from ev a join ev b on a.source_event_key = b.source_event_key and a.event_id < b.event_id and a.source_id = b.source_id), l as (select a, b from p union all select b, a from p), r(a, b) as (select a, a from l union select r.a, l.b from r join l on r.b = l.a) select a as node, min(b) as component from r group by a")
def revision_components(spark, sf_dir):
    """Groups of revisions of one event by one source, as connected components."""
    ev = catalog(spark, sf_dir).select("event_id", "source_event_key", "source_id")
    pairs = ev.alias("x").join(ev.alias("y"), ["source_event_key", "source_id"]).where("x.event_id < y.event_id").selectExpr("x.event_id as a", "y.event_id as b")
    return connected_components(pairs)


@query("with ev as ({ev}) select event_id, round(round(round_even(magnitude / 0.1, 0) * 0.1, 10), 6) as bin from ev where magnitude is not null")
def binned_magnitudes(spark, sf_dir):
    return catalog(spark, sf_dir).where("magnitude is not null").select("event_id", r6(magnitude_bin(F.col("magnitude"))).alias("bin"))


# --- archives, backfill and alignment -----------------------------------------------------------


@query("with a as (select event_type as source, props as body, case user_id % 4 when 0 then 'application/json' when 1 then 'text/html' when 2 then 'text/csv; charset=utf-8' else 'image/png' end as kind from events), k as (select source, sha256(body) as sha, kind from a where body is not null) select source, sha as sha256, count(*) as copies from k group by 1, 2")
def raw_archive(spark, sf_dir):
    """Distinct artifacts per source, by content address."""
    kind = F.expr("case user_id % 4 when 0 then 'application/json' when 1 then 'text/html' when 2 then 'text/csv; charset=utf-8' else 'image/png' end")
    a = spark.read.parquet(f"{sf_dir}/events.parquet").where("props is not null").select(F.col("event_type").alias("source"), F.col("props").cast("binary").alias("content"), kind.alias("media_type"))
    return issuance.archive_keys(a).groupBy("source", "sha256").agg(F.count("*").alias("copies"))


@query("with k as (select event_type as source, sha256(props) as sha256, octet_length(encode(props))::bigint as byte_length from events where props is not null and event_type is not null and props <> '') select distinct source, sha256, byte_length from k")
def archived_files(spark, sf_dir):
    """Raw artifacts written as files of their content address, each once, and read back."""
    a = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.col("props").cast("binary").alias("content"), F.lit("application/json").alias("media_type"))
    url = scratch(spark, "archive")
    sinks.write_archive(a, url).count()
    return sinks.read_archive(spark, url).select("source", "sha256", F.octet_length("content").cast("long").alias("byte_length"))


@query("with ev as ({ev}), x as (select available_at >= event_time and latitude between -90 and 90 and longitude between -180 and 180 as ok from ev) select count(*) filter (ok) as valid, count(*) filter (not ok) as rejected from x")
def validated_events(spark, sf_dir):
    good, bad = issuance.validated(catalog(spark, sf_dir))
    return good.agg(F.count("*").alias("valid")).join(bad.agg(F.count("*").alias("rejected")), F.lit(True))


SLOTS = "slot as (select floor((epoch_us(event_time) - epoch_us(timestamp '{origin}')) / 8.64e10 * 2)::bigint as slot, count(*) as n from ev group by 1)"


@query(f"with ev as ({{ev}}), {SLOTS}, total as (select count(*) as t from ev), s as (select level, slot >> level as slot, sum(n)::bigint as n from slot, range(0, 7) l(level) group by 1, 2), f as (select s.level, s.slot, s.n, p.n as around from s left join s p on p.level = s.level + 1 and p.slot = s.slot >> 1) select level, slot, n from f, total where n <= t // 8 and (around is null or around > t // 8)")
def backfill_slices(spark, sf_dir):
    """Time slices of at most an eighth of the events, by halving."""
    ev = catalog(spark, sf_dir)
    half_day = F.floor(seismicity.days_since(F.col("event_time"), at(ORIGIN)) * 2).cast("long")
    counts = ev.groupBy(half_day.alias("slot")).agg(F.count("*").alias("n"))
    plan = issuance.backfill_plan(counts, ev.count() // 8, 6)
    return plan.select(F.col("level").cast("long").alias("level"), "slot", "n")


#: Events that a slot of a feed holds on average, at most.
SLOT = 2_500


def feed(spark: SparkSession, sf_dir: str) -> tuple[str, datetime, datetime, float] | None:
    """The catalog as the folder of a bounded service, its time range, and the least hours of a slice, a
    slot's if that is short; None if it is empty. Slots are a day, or the fraction of it that a dense
    catalog needs."""
    ev = catalog(spark, sf_dir).select("event_id", "event_time", "available_at", "latitude", "longitude", "depth_km", "magnitude", "magnitude_type")
    ends = ev.agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count("event_time").alias("n")).first()
    url = scratch(spark, "feed")
    if ends.first is None:
        bounded.write_feed(ev, url)
        return None
    # the service's times are in milliseconds
    start, end = ends.first.replace(microsecond=ends.first.microsecond // 1000 * 1000), ends.last + timedelta(milliseconds=1)
    seconds = 86_400
    while seconds > 60 and ends.n * seconds > SLOT * (end - start).total_seconds():
        seconds = -(-seconds // 2)
    bounded.write_feed(ev, url, seconds)
    return url, start, end, min(bounded.MIN_SLICE.total_seconds(), seconds) / 3600


@query("with ev as ({ev}) select event_id::varchar as source_event_id, date_trunc('milliseconds', event_time) as event_time, latitude, longitude, depth_km, magnitude, magnitude_type from ev where latitude between -60 and -15 and longitude between -82 and -62")
def bounded_scan(spark, sf_dir):
    """Every event inside the service's box, read in slices that the service agrees to answer."""
    url, start, end, least = feed(spark, sf_dir) or (scratch(spark, "feed"), datetime(2024, 1, 1), datetime(2024, 1, 2), 6.0)
    out = bounded.bounded_events(spark, url, start, end, min_slice_hours=least)
    return out.select("source_event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "latitude", "longitude", "depth_km", "magnitude", "magnitude_type")


@query("with ev as ({ev}) select 'succeeded' as status, count(*) as events from ev where latitude between -60 and -15 and longitude between -82 and -62 having count(*) > 0")
def backfill_run(spark, sf_dir):
    """A backfill of the whole time range: what its ledger shows, by the state of the slices."""
    url, start, end, least = feed(spark, sf_dir) or (scratch(spark, "feed"), datetime(2024, 1, 1), datetime(2024, 1, 2), 6.0)
    tried = bounded.backfill(spark, url, start, end, scratch(spark, "backfilled"), scratch(spark, "ledger"), min_slice_hours=least)
    return tried.groupBy("status").agg(F.sum("events").alias("events")).where("events > 0")


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, {RATES}, {CUBE}, seen as (select 'grid:r' || lpad((floor(latitude + 60 + 1e-9)::int)::varchar, 4, '0') || ':c' || lpad((floor(longitude + 82 + 1e-9)::int)::varchar, 4, '0') as cell_id, case when magnitude < 4 then 0 when magnitude < 5 then 1 when magnitude < 6 then 2 when magnitude < 7 then 3 else 4 end as bin, count(*) as observed from s where t_days >= 20 and t_days < 27 group by 1, 2) select cell_id, bin, round(expected, 6) as expected, coalesce(observed, 0)::bigint as observed from cube left join seen using (cell_id, bin)")
@complete
def observed_cube(spark, sf_dir, least):
    """The forecast cube beside what was observed in its window."""
    cube = forecasting.forecast_cube(forecast_rates(spark, sf_dir, least), 1.0, least)
    seen = grid.assign_bins(sample(spark, sf_dir, least).where("t_days >= 20 and t_days < 27"))
    seen = seen.withColumn("cell_id", grid.point_to_cell(F.col("latitude"), F.col("longitude"), *GRID))
    return rounded(issuance.with_observed(cube, seen).select("cell_id", "bin", "expected", "observed"))


@query(f"with ev as ({{ev}}), {BINNED}, g as (select magnitude_type, max_by(bin, (n, -k)) + 0.2 as mc from f where n > 0 group by 1), b as (select magnitude_type, mc, unnest([3.0, 4.0, 5.0, 6.0, 7.0])::double as lower from g) select magnitude_type, coalesce(min(case when lower >= mc then lower end), min(lower)) as threshold from b group by 1")
def region_thresholds(spark, sf_dir):
    mc = magnitudes.mc_maximum_curvature(catalog(spark, sf_dir), ["magnitude_type"]).where("mc is not null")
    bins = mc.join(F.broadcast(grid.bins_frame(spark)), F.lit(True))
    return issuance.region_threshold(bins, ["magnitude_type"])


@query("with ev as ({ev}) select magnitude_type, round(quantile_cont(magnitude, 0.05), 6) as q5, round(quantile_cont(magnitude, 0.5), 6) as q50, round(quantile_cont(magnitude, 0.975), 6) as q97 from ev where magnitude is not null group by 1")
def magnitude_percentiles(spark, sf_dir):
    """Exact percentiles by rounds of counts."""
    return rounded(exact_quantiles(catalog(spark, sf_dir), ["magnitude_type"], "magnitude", [0.05, 0.5, 0.975]).toDF("magnitude_type", "q5", "q50", "q97"))


@query("with a as (select event_id // 500 as issued_at, sum(value) as ll from events group by 1), b as (select event_id // 500 as issued_at, avg(value) as ll from events group by 1) select issued_at, round(a.ll, 4) as candidate_ll, round(b.ll, 4) as champion_ll from a join b using (issued_at)")
def fold_alignment(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("issued_at", F.expr("event_id div 500"))
    both = issuance.aligned_folds(e.groupBy("issued_at").agg(F.sum("value").alias("log_likelihood")), e.groupBy("issued_at").agg(F.avg("value").alias("log_likelihood")))
    return both.select("issued_at", F.round("candidate_ll", 4).alias("candidate_ll"), F.round("champion_ll", 4).alias("champion_ll"))


@query()
def omori_weighted(spark, sf_dir):
    """Family-size weighted decay parameters."""
    return rounded(issuance.weighted_parameters(omori_families(spark, sf_dir)))


def replayed(ev: DataFrame) -> DataFrame:
    ranked = seismicity.running_rank(ev.select("source_id", "event_id", F.struct("available_at", "event_id").alias("o")), "o")
    return ranked.select("source_id", "event_id", F.col("rank").alias("step"))


@query("with ev as ({ev}) select source_id, event_id, row_number() over (order by available_at, event_id) as step from ev")
def replay_order(spark, sf_dir):
    """Events in the order in which they became known, numbered without one task holding all."""
    return replayed(catalog(spark, sf_dir))


#: Most rows of a batch that arrives, and files of one.
ARRIVING, FILES = 2_000_000, 8


def arriving(spark: SparkSession, rows: DataFrame, batches: int) -> DataFrame:
    """``rows`` as a stream of at least ``batches`` batches in the order in which they became known.

    Every batch but the last has the same number of files, none of them empty, and a trigger takes as many,
    so that no batch is mixed with a part of the next."""
    folder = scratch(spark, "arriving")
    ranked = materialize(running_rank(rows.withColumn("o", F.struct("available_at", "event_id")), "o").drop("o"), "ranked")
    n = ranked.count()
    size = max(1, -(-n // max(batches, -(-n // ARRIVING))))
    files = min(FILES, size)
    for k in range(-(-n // size)):
        part = ranked.where(F.floor((F.col("rank") - 1) / size) == k).withColumn("file", F.pmod("rank", F.lit(files)))
        part.select(*rows.columns, "file").repartition("file").write.mode("append").partitionBy("file").parquet(f"{folder}/batch={k}")
    if not n:
        rows.limit(0).write.parquet(f"{folder}/batch=0/file=0")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/batch=*/file=*")


@query("with ev as ({ev}) select source_id, event_id, row_number() over (partition by source_id order by available_at, event_id) as step from ev")
def replay_clocks(spark, sf_dir):
    """A replay on a stream: each source's events in the order in which they became known."""
    ev = catalog(spark, sf_dir).select("source_id", "event_id", "event_time", "available_at")
    out = scratch(spark, "steps")
    clock.start_replay(arriving(spark, ev, 2), out, scratch(spark, "clock")).awaitTermination()
    return spark.read.schema(clock.STEP).parquet(out).select("source_id", "event_id", "step")


@query()
def canonical_links_stream(spark, sf_dir):
    """``canonical_links`` as the observations arrive, in two batches."""
    rows = observed_twice(spark, sf_dir).select("event_id", "source_id", *(F.col(c).cast("timestamp").alias(c) for c in ("event_time", "available_at")), "latitude", "longitude", "magnitude", "depth_km")
    members = scratch(spark, "members")
    stream_linkage.link_stream(arriving(spark, rows, 2), members, scratch(spark, "linked")).awaitTermination()
    return stream_linkage.read_members(spark, members).select("event_id", "canonical_id")


def fold_scores(spark: SparkSession, sf_dir: str, windows: DataFrame, least: float) -> DataFrame:
    """Scores of every fold of (fold, start, stop), in one job."""
    cells = grid.cells(spark, *GRID)
    region = cells.agg(F.sum("area_km2")).first()[0]
    s = sample(spark, sf_dir, least)
    rates = forecasting.walk_forward(cells, s, ETAS, windows, least, region)
    where = grid.point_to_cell(F.col("latitude"), F.col("longitude"), *GRID)
    seen = s.join(F.broadcast(windows), (F.col("t_days") >= F.col("start")) & (F.col("t_days") < F.col("stop"))).groupBy("fold", where.alias("cell_id")).agg(F.count("*").alias("observed"))
    rows = rates.join(seen, ["fold", "cell_id"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    scores = scoring.basic_scores(rows, ["fold"])
    gain = F.col("log_likelihood") - F.col("reference_log_likelihood")
    return scores.select("fold", "events", F.round("expected", 5).alias("expected"), r6("brier").alias("brier"), F.round("log_likelihood", 4).alias("log_likelihood"), F.round(gain, 4).alias("gain"))


@query(f"with ev as ({{ev}}), {SMALL}, {CELLS}, ends as (select min(t) + 10 as s0, max(t) + 1 / 86400::double as e0 from (select (epoch_us(event_time) - epoch_us(timestamp '{{origin}}')) / 8.64e10 as t from ev)), nf as (select *, case when e0 - s0 < 3 then 0 else ceil((e0 - s0) / 3 - 1e-9)::int end as n from ends), g as (select unnest(range(n)) as fold, s0, case when n > 1 then (e0 - s0 - 3) / (n - 1) else 3 end as step from nf), f as (select fold, s0 + fold * step as start, s0 + fold * step + 3 as stop from g), fed as (select fold, latitude, longitude, 0.05 * exp(magnitude - {{mc}}) * ({OMORI.format(x='(stop - t_days)')} - {OMORI.format(x='(start - t_days)')}) as fed, 5 * exp(0.5 * (magnitude - {{mc}})) as d from f join s on t_days < start), part as (select fold, cell_id, sum(fed * 0.8 / (pi() * d * d) * power(1 + power(km / d, 2), -1.8)) as fed from (select fold, cell_id, fed, d, " + HAVERSINE.format(a1="cell.latitude", a2="cell.longitude", b1="fed.latitude", b2="fed.longitude") + " as km from cell, fed) group by 1, 2), rate as (select f.fold, cell.cell_id, 0.5 * 3 * area_km2 / (select sum(area_km2) from cell) as base, 0.5 * 3 * area_km2 / (select sum(area_km2) from cell) + coalesce(fed, 0) * area_km2 as rate from cell cross join f left join part on part.fold = f.fold and part.cell_id = cell.cell_id), seen as (select fold, 'grid:r' || lpad((floor(latitude + 60 + 1e-9)::int)::varchar, 4, '0') || ':c' || lpad((floor(longitude + 82 + 1e-9)::int)::varchar, 4, '0') as cell_id, count(*) as n from s join f on t_days >= start and t_days < stop group by 1, 2), x as (select rate.*, coalesce(n, 0) as n from rate left join seen using (fold, cell_id)) select fold::int as fold, sum(n)::bigint as events, round(sum(rate), 5) as expected, round(avg(power(1 - exp(-rate) - case when n > 0 then 1 else 0 end, 2)), 6) as brier, round(sum(n * ln(greatest(rate, 1e-12)) - rate - lgamma(n + 1)), 4) as log_likelihood, round(sum(n * ln(greatest(rate, 1e-12)) - rate - lgamma(n + 1)) - sum(n * ln(greatest(base, 1e-12)) - base - lgamma(n + 1)), 4) as gain from x group by 1")
def walk_forward_scores(spark, sf_dir):
    """Folds of three days without a gap, from the tenth day after the first event to the last one, on
    every event at or above the catalog's magnitude of completeness."""
    t = seismicity.days_since(F.col("event_time"), at(ORIGIN))
    ends = catalog(spark, sf_dir).agg(F.min(t).alias("first"), F.max(t).alias("last")).first()
    if ends[0] is None:
        return fold_scores(spark, sf_dir, forecasting.covering_folds(spark, 0.0, 0.0, 3.0), completeness(spark, sf_dir))
    windows = forecasting.covering_folds(spark, ends[0] + 10.0, ends[1] + 1 / 86400, 3.0)
    return fold_scores(spark, sf_dir, windows, completeness(spark, sf_dir))


@query(f"with ev as ({{ev}}), {LATEST}, art as (select event_id, sha256(coalesce(props, '')) as artifact from events), src as (select distinct source_id, " + PRIORITY + " as priority from ev) select l.source_event_key, l.event_id, src.priority::int as priority, art.artifact from latest l join src using (source_id) join art using (event_id)")
def revision_provenance(spark, sf_dir):
    """Latest revisions with their source's priority and their raw artifact."""
    latest = cat.as_of(catalog(spark, sf_dir), at(AS_OF))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.sha2(F.coalesce("props", F.lit("")).cast("binary"), 256).alias("artifact"))
    sources = catalog(spark, sf_dir).select("source_id").distinct().withColumn("priority", cat.source_priority(F.col("source_id"), PRIORITIES))
    return latest.join(sources, "source_id").join(raw, "event_id").select("source_event_key", "event_id", "priority", "artifact")


@query("with ev as ({ev}), k as (select *, round_even(latitude, 0)::int as lat_index, round_even(longitude, 0)::int as lon_index from ev), d as (select lat_index, lon_index, avg(depth_km) as depth_km from k where depth_km is not null group by 1, 2), t as (select lat_index, lon_index, avg(magnitude) as thickness from k where event_id % 3 = 0 group by 1, 2), u as (select lat_index, lon_index, max(event_id % 50)::double as uncertainty from k where event_id % 5 = 0 group by 1, 2) select lat_index, lon_index, round(depth_km, 6) as depth_km, round(thickness, 6) as thickness, round(uncertainty, 6) as uncertainty from d left join t using (lat_index, lon_index) left join u using (lat_index, lon_index)")
def merged_rasters(spark, sf_dir):
    """Rasters on one lattice; depth decides which nodes there are, the others may lack some."""
    lat, lon = grid.lattice_key(F.col("latitude"), F.col("longitude"), 1.0)
    k = catalog(spark, sf_dir).withColumns({"lat_index": lat, "lon_index": lon})
    node = lambda df, value: df.groupBy("lat_index", "lon_index").agg(value.alias("value"))
    depth = node(k.where("depth_km is not null"), F.avg("depth_km"))
    return rounded(grid.merge_rasters(depth, thickness=node(k.where("event_id % 3 = 0"), F.avg("magnitude")), uncertainty=node(k.where("event_id % 5 = 0"), F.max(F.col("event_id") % 50).cast("double"))))
