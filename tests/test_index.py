import random
import warnings

import pytest
from pyspark.sql import functions as F

from pulsepanel import CALIB_FULL, CALIB_TRAIN, historic_percentile, pressure_index, resolve_calibration, zone, zone_short
from pulsepanel.functions import index as ix

M, T = "m", "t"


def scores(spark, rows, calib=None):
    df = spark.createDataFrame(rows, "m double, t double")
    return [r[0] for r in df.select(pressure_index(F.col(M), F.col(T), calib)).collect()]


def test_stays_in_unit_interval(spark):
    grid = [(float(m), float(t)) for m in (0, 100, 312, 800, 5000) for t in (-5, -0.9, 0, 1.5)]
    rng = random.Random(42)
    grid += [(rng.uniform(0, 3000), rng.uniform(-5, 2)) for _ in range(500)]
    assert all(0 < s < 1 for s in scores(spark, grid))


def test_mean_inputs_give_one_half(spark):
    assert scores(spark, [(312.4, -0.8834)])[0] == pytest.approx(0.5, abs=1e-12)


def test_formula_value(spark):
    assert scores(spark, [(850.0, -0.5)])[0] == pytest.approx(0.6460, abs=1e-4)


def test_missing_input_gives_missing_result(spark):
    assert scores(spark, [(None, -1.0), (100.0, None)]) == [None, None]
    df = spark.createDataFrame([(None,)], "s double")
    row = df.select(zone(F.col("s")), historic_percentile(F.col("s"))).first()
    assert row[0] is None and row[1] is None


def test_z_scores_are_clipped(spark):
    df = spark.createDataFrame([(999999.0, 100.0)], "m double, t double")
    r = df.select(ix.pressure_result(F.col(M), F.col(T)).alias("r")).first()["r"]
    assert (r.z_volume, r.z_tone) == (3.0, 3.0)
    assert r.percentile + r.top_pct == 100


def test_extremes(spark):
    df = spark.createDataFrame([(5000.0, 1.0), (0.0, -5.0)], "m double, t double")
    assert [r[0] for r in df.select(zone(pressure_index(F.col(M), F.col(T)))).collect()] == ["EXTREME", "MINIMAL"]


@pytest.mark.parametrize("score,label", [
    (0.30, "MINIMAL"), (0.50, "BASELINE"), (0.56, "ELEVATED"), (0.62, "HIGH"), (0.75, "EXTREME"),
    (0.470, "BASELINE"), (0.530, "ELEVATED"), (0.590, "HIGH"), (0.650, "EXTREME")])
def test_zone_lower_bounds_are_inclusive(spark, score, label):
    row = spark.range(1).select(zone(F.lit(score)), zone_short(F.lit(score))).first()
    assert row[0] == label and row[1] == label.capitalize()


def test_percentile(spark):
    vals = [0.30, 0.478, 0.80, 0.9]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    assert [r[0] for r in df.select(historic_percentile(F.col("s"))).collect()] == [5, 50, 99, 99]
    grid = spark.range(0, 1000).select((F.col("id") / 1000.0).alias("s")).select(historic_percentile(F.col("s")).alias("p")).collect()
    ps = [r.p for r in grid]
    assert ps == sorted(ps)


def test_full_sample_calibration_warns():
    with pytest.warns(UserWarning):
        assert resolve_calibration(CALIB_FULL)[1] == "FULL"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert resolve_calibration(None) == (CALIB_TRAIN, "TRAIN")


def test_benchmark_zone_covers_both_ends(spark):
    df = spark.createDataFrame([(0,), (24,), (25,), (100,), (101,)], "v int")
    assert [r[0] for r in df.select(ix.benchmark_zone(F.col("v"))).collect()] == [
        "Extreme Fear", "Extreme Fear", "Fear", "Extreme Greed", None]
