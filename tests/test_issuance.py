"""Archives, backfill plans, idempotent issue, notifications and range-wise ranks."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import catalog, forecasting, issuance, scoring, seismicity
from quakeloom.sources import files
from quakeloom.streaming import ingest


def test_archive_holds_each_content_once(spark):
    a = spark.createDataFrame([("s", b"x", "application/json"), ("s", b"x", "text/html"), ("t", b"x", None), ("s", b"y", "text/csv")], "source string, content binary, media_type string")
    held = issuance.archive_keys(a.where("source = 't'"))
    got = issuance.archive(a, held).collect()
    assert sorted((r.source, bytes(r.content)) for r in got) == [("s", b"x"), ("s", b"y")]
    assert all(r.path.startswith(f"{r.source}/{r.sha256[:2]}/{r.sha256[2:4]}/{r.sha256}.") for r in got)
    assert issuance.archive_keys(a.where("source = 't'")).first().path.endswith(".bin")


def test_pinned_assets(spark):
    f = spark.createDataFrame([("dir/a.xyz", b"abc")], "path string, content binary")
    good = f.select(F.lit("a.xyz").alias("name"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    assert files.pinned(f, good).count() == 1
    with pytest.raises(Exception, match="checksum mismatch"):
        files.pinned(f, good.withColumn("bytes", F.lit(9))).collect()


def test_backfill_covers_all_slots_once_and_resumes(spark):
    counts = spark.createDataFrame([(k, 1 + (k * 7) % 5) for k in range(60)] + [(61, 40)], "slot long, n long")
    plan = issuance.backfill_plan(counts, 40, 6)
    rows = plan.collect()
    covered = [s for r in rows for s in range(r.slot << r.level, (r.slot + 1) << r.level)]
    assert len(covered) == len(set(covered)) and set(range(60)) | {61} <= set(covered)
    assert all(r.n <= 40 for r in rows) and sum(r.n for r in rows) == counts.agg(F.sum("n")).first()[0]
    with pytest.raises(Exception, match="cap"):
        issuance.backfill_plan(counts, 39, 6).collect()
    done = plan.limit(2).withColumn("status", F.lit("done"))
    assert issuance.pending_slices(plan, done).count() == len(rows) - 2


def test_issue_is_idempotent(spark):
    req = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "model string, hour int")
    first = issuance.issue(req, spark.createDataFrame([], "run_id string"), ["model", "hour"])
    assert first.count() == 2 and issuance.issue(req, first, ["model", "hour"]).count() == 0


def test_folds_must_align(spark):
    a = spark.createDataFrame([(1, -3.0), (2, -4.0)], "issued_at int, log_likelihood double")
    assert issuance.aligned_folds(a, a).count() == 2
    with pytest.raises(Exception, match="differ"):
        issuance.aligned_folds(a, a.where("issued_at = 1")).collect()


def test_validation_splits(spark):
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    df = spark.createDataFrame([(91.0, 0.0, t, t), (0.0, 0.0, t, t), (None, 0.0, t, t), (0.0, 0.0, t, None)], "latitude double, longitude double, event_time timestamp, available_at timestamp")
    good, bad = issuance.validated(df)
    assert good.count() == 1 and bad.count() == 3


def test_quality_flags_of_one_event(spark):
    df = spark.createDataFrame([(1, 900.0, None, "xx"), (2, 10.0, 4.0, "mw")], "event_id long, depth_km double, magnitude double, magnitude_type string")
    got = catalog.quality_issues(df).groupBy("event_id").agg(F.sort_array(F.collect_list("flag")).alias("f")).orderBy("event_id").collect()
    assert got[0].f == ["implausible_depth", "location_uncertainty_unknown", "magnitude_uncertainty_unknown", "missing_magnitude", "unknown_magnitude_type"]
    assert got[1].f == ["location_uncertainty_unknown", "magnitude_uncertainty_unknown"]


def test_freshness_precedence(spark):
    t = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    rows = [(None, None, None), (t(5), t(5), t(9)), (t(0), t(0), t(3)), (t(0), t(0), t(9)), (t(3), t(3), t(9))]
    df = spark.createDataFrame(rows, "i timestamp, s timestamp, e timestamp")
    state = catalog.freshness(F.col("i"), F.col("s"), F.col("e"), F.lit(t(4)), 3600)
    assert [r[0] for r in df.select(state).collect()] == ["missing", "future_issuance", "expired", "stale", "fresh"]


def test_running_rank_is_global(spark):
    df = spark.createDataFrame([((k * 37) % 101,) for k in range(101)], "v int").repartition(7)
    got = {r.v: r.rank for r in seismicity.running_rank(df, "v").collect()}
    assert got == {v: v + 1 for v in range(101)}


def test_number_test_tails(spark):
    df = spark.createDataFrame([(10, 10.0), (40, 10.0), (0, 10.0)], "observed long, expected double")
    assert [r.consistent for r in scoring.number_test(df).collect()] == [True, False, False]


def test_likelihood_quantiles_are_uniform_under_the_model(spark):
    import numpy as np

    r = np.random.default_rng(8)
    quantiles = []
    for k in range(12):
        rates = r.uniform(0.1, 2, 60)
        df = spark.createDataFrame(pd.DataFrame({"id": range(1000 * k, 1000 * k + 60), "observed": r.poisson(rates), "rate": rates}))
        quantiles.append(scoring.likelihood_test(df, simulations=200, seed=k).first().quantile)
    assert 0.25 < np.mean(quantiles) < 0.75


def test_notifications(spark, tmp_path):
    """Oldest first, three a run; the rest waits for the next run, stale events are marked unsent."""
    schema = "event_id long, event_time timestamp"
    t = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    sent = []
    put = lambda ids: spark.createDataFrame([(k, t(k)) for k in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    moment = lambda h: F.lit(t(h)).cast("timestamp")
    land, seen = str(tmp_path / "land"), str(tmp_path / "seen")
    run = lambda h: ingest.notify(spark.read.schema(schema).parquet(land), seen, sent.extend, moment(h), max_age="6 hours")
    put([1, 2])
    assert run(2) == 0 and sent == []
    put([2, 3, 4, 5, 6, 7])
    assert run(7) == 3 and [r.event_id for r in sent] == [3, 4, 5]
    assert run(7) == 2 and [r.event_id for r in sent] == [3, 4, 5, 6, 7]
    put([8, 16])
    assert run(17) == 1 and sent[-1].event_id == 16
    assert run(17) == 0


def test_notifications_of_a_stream(spark, tmp_path):
    schema = "event_id long, event_time timestamp"
    sent = []
    when = pd.Timestamp("2024-01-01").to_pydatetime()
    put = lambda ids: spark.createDataFrame([(k, when) for k in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    run = lambda: ingest.notifications(ingest.landing_stream(spark, str(tmp_path / "land"), schema), str(tmp_path / "wait"), str(tmp_path / "seen"), str(tmp_path / "ck"), sent.extend, F.lit(when).cast("timestamp")).awaitTermination()
    put([1])
    run()
    put([2, 3, 4, 5])
    run()
    put([6])
    run()
    assert [r.event_id for r in sent] == [2, 3, 4, 5, 6]


def test_marginal_test_keeps_the_total(spark):
    import numpy as np

    r = np.random.default_rng(9)
    rates = r.uniform(0.1, 2, 300)
    frame = lambda n: spark.createDataFrame(pd.DataFrame({"id": range(300), "observed": n, "rate": rates}))
    n = r.multinomial(400, rates / rates.sum())
    got = scoring.marginal_test(frame(n), simulations=300).first()
    lam = 400 * rates / rates.sum()
    score = lambda c: float((c * np.log(lam) - lam - np.vectorize(math.lgamma)(c + 1.0)).sum())
    brute = np.array([score(np.random.default_rng(k).multinomial(400, rates / rates.sum())) for k in range(1000)])
    assert abs(got.observed_ll - score(n)) < 1e-6
    assert abs(got.mean_ll - brute.mean()) < 2 and abs(got.p05_ll - np.percentile(brute, 5)) < 4
    assert got == scoring.marginal_test(frame(n).repartition(7), simulations=300).first()
    # all events in one bin is no draw from these rates
    assert scoring.marginal_test(frame(np.where(np.arange(300) == 5, 400, 0)), simulations=300).first().consistent is False
    assert scoring.marginal_test(frame(np.zeros(300, int)), simulations=10).count() == 0


def test_append_takes_a_null_key_once(spark):
    held = spark.createDataFrame([(1, None), (1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, None), (1, "b"), (None, "a"), (None, "a")], "k int, v string")
    got = catalog.append_if_absent(new, held, ["k", "v"])
    assert got.columns == ["k", "v"] and {tuple(r) for r in got.collect()} == {(1, "b"), (None, "a")}


def test_run_detail(spark):
    bins = spark.createDataFrame([("a", 0, 3.0, None, "not_estimable"), ("a", 1, 5.0, 0.2, "estimable"), ("b", 1, 5.0, 0.7, "estimable"), ("c", 1, 5.0, 0.2, "estimable"), ("a", 2, 6.0, 0.01, "estimable")], "cell_id string, bin int, lower double, expected double, support string")
    cells = spark.createDataFrame([(k, 1.0, 2.0) for k in "abc"], "cell_id string, latitude double, longitude double")
    ids = lambda *a, **k: [(r.cell_id, r.lower) for r in forecasting.run_detail(bins, cells, *a, **k).collect()]
    assert ids(4.5) == [("b", 5.0), ("a", 5.0), ("c", 5.0)] and ids(4.5, limit=2) == [("b", 5.0), ("a", 5.0)]
    assert ids(4.5, 6.0) == [("a", 6.0)] and ids(9.0) == [] and ids(4.5, 3.0) == []
    runs = spark.createDataFrame([(1, 10), (2, 30), (3, 30), (4, 50)], "run_id int, issued_at int")
    assert forecasting.latest_run(runs, F.lit(40)).first().run_id == 3 and forecasting.latest_run(runs, F.lit(5)).count() == 0


def test_region_threshold_falls_back(spark):
    df = spark.createDataFrame([("a", 3.0, 3.5), ("a", 4.0, 3.5), ("b", 3.0, 9.0)], "k string, lower double, mc double")
    assert {r.k: r.threshold for r in issuance.region_threshold(df, ["k"]).collect()} == {"a": 4.0, "b": 3.0}


def test_lineage_refuses_other_windows(spark):
    est = spark.createDataFrame([(7, 9, 0, 10, "mb")], "mc_id int, b_id int, start int, stop int, magnitude_type string")
    rows = spark.createDataFrame([(7, 0, 10, "mb", True), (9, 0, 10, "mb", True), (8, 0, 10, "mb", False)], "id int, start int, stop int, magnitude_type string, usable boolean")
    assert issuance.checked_lineage(est, {"mc": rows, "b": rows}).count() == 1
    for bad in (rows.where("id <> 9"), rows.withColumn("stop", F.lit(11)), rows.withColumn("usable", F.lit(False)), rows.withColumn("magnitude_type", F.lit("ml"))):
        with pytest.raises(Exception, match="b: missing"):
            issuance.checked_lineage(est, {"mc": rows, "b": bad}).collect()
