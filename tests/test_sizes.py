"""Queries against their SQL twins on tables whose keys or sizes the fixed ones do not have."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from fringeflow.operators import calibrate, flag, image, stats
from fringeflow.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def check(spark, folder, name, **tables):
    """Runs a query and its twin on tables given as SELECTs over the smallest ones."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.execute(f"CREATE VIEW small AS SELECT * FROM '{SF}/{t}.parquet'")
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"DROP VIEW small; CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(con.execute(registry.oracle_sql()[name]).df())
    return got


def test_azimuth_a_hair_west_of_north(spark, tmp_path):
    got = check(spark, tmp_path, "azimuth_elevation", lineitem="SELECT * REPLACE (180 + l_suppkey % 2 AS l_suppkey) FROM small LIMIT 500")
    assert (got.az > 6.28).any()


def test_system_temperatures_of_all_antennas(spark, tmp_path):
    got = check(spark, tmp_path, "initial_weights_tsys", lineitem="SELECT * REPLACE (l_suppkey * 397 AS l_suppkey) FROM small LIMIT 500")
    assert got.weight.notna().sum() > 250


DAYS = "SELECT * REPLACE (event_id + c * 1000000 AS event_id, ts + to_days(CAST(c AS INTEGER)) AS ts) FROM small, range(3) r(c) WHERE event_id % 7 <> 3"


@pytest.mark.parametrize("name", ["applycal_calflag", "applycal_calonly", "applycal_flagonly", "ephemeris_positions"])
def test_neighbours_in_time_in_one_pass(spark, tmp_path, name):
    check(spark, tmp_path, name, events=DAYS)
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()  # Spark computes such a frame anew for each row
    assert "_block" in plan  # few keys are many tasks


TIMELESS = "SELECT * REPLACE (CASE WHEN event_id % 9 = 1 THEN NULL ELSE ts + to_days(CAST(event_id % 3 AS INTEGER)) END AS ts) FROM small"


@pytest.mark.parametrize("name", ["applycal_calonly", "applycal_flagonly"])
def test_rows_meet_solutions_in_one_reading(spark, tmp_path, name):
    check(spark, tmp_path, name, events=TIMELESS)
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    assert "Sort" not in plan and "last(" not in plan  # no window carries samples to sorted rows


def test_two_antennas_share_solutions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["applycal_flagonly"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Window [") == 2  # the ends and the spans of one table


def test_samples_in_clusters(spark):
    rng = random.Random(3)
    times = {k: sorted({0.0} | {1.7e9 + c * 5e3 + rng.random() * 10**w for c in range(6) for w in (-3, 1, 3) for _ in range(15)}) for k in range(3)} | {3: [7.0]}
    samples = {(k, t): rng.choice([None, rng.random()]) for k, ts in times.items() for t in ts}
    cal = spark.createDataFrame([(k, t, g) for (k, t), g in samples.items()], "ant int, time double, g double")
    some = [t for ts in times.values() for t in ts]
    data = [(i, rng.choice([0, 1, 2, 3, 4, None]), rng.choice([None, rng.choice(some), rng.choice(some) + rng.random() * 10 ** rng.randint(-3, 9) - 1])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, ant int, time double")
    timed = df.where("ant IS NOT NULL AND time IS NOT NULL")
    for how in ("nearest", "linear"):
        got = {r.id: r.g for r in calibrate.asof_join(df, cal, ["ant"], "time", ["g"], how).collect()}
        assert len(got) == len(data)
        assert {r.id: r.g for r in calibrate.asof(timed, cal, ["ant"], "time", ["g"], how).collect()}.items() <= got.items()
        assert all(got[i] == (samples[k, times[k][-1]] if k in times else None) for i, k, t in data if t is None or k is None)
    spans = calibrate._spans(cal, ["ant"], "time", ["g"])[1]
    assert spans.groupBy("ant", "_level", "_block").count().agg(F.max("count")).first()[0] <= 3
    assert spans.count() <= 3 * len(samples)


def test_sources_of_an_image_whose_sums_vary(spark):
    hair = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()  # as sums in another order do
    pixels = spark.range(40 * 25).select(F.expr("id div 25").alias("chan"), F.expr("int(id % 5)").alias("x"), F.expr("int(id div 5 % 5)").alias("y"))
    got = image.sources(pixels.withColumn("value", hair(F.when((F.col("x") == 2) & (F.col("y") == 2), 9.0).otherwise(1.0))), ["chan"], 5.0, 100)
    assert sorted((r.chan, r.x, r.y) for r in got.collect()) == [(c, 2, 2) for c in range(40)]


def test_shadows_by_cells(spark, tmp_path):
    rng = random.Random(5)
    some = lambda f: None if rng.random() < 0.03 else f
    data = [(i % 3, some(i // 4), some(rng.uniform(-40, 40)), some(rng.choice([rng.uniform(-40, 40), 1e300, float("inf")])), some(float(rng.randrange(40))), some(rng.choice([1.0, 2.5, 6.0]))) for i in range(900)]
    df = spark.createDataFrame(data, "time int, ant int, u double, v double, w double, diameter double")
    for tolerance in (0.0, 1.5, 7.0):
        full = [r for r in data if None not in r]
        want = {a[:2] for a in full for b in full if a[0] == b[0] and a[1] != b[1] and a[4] < b[4] and math.hypot(a[2] - b[2], a[3] - b[3]) < (a[5] + b[5]) / 2 - tolerance}
        assert len(want) > 50 or tolerance
        got = [tuple(r) for r in flag.shadow(df, tolerance).collect()]
        assert sorted(got) == sorted(want)
    check(spark, tmp_path, "flag_shadow", lineitem="SELECT * REPLACE (l_orderkey % 3 AS l_orderkey) FROM small LIMIT 2000")
    assert "_x" in registry.queries()["flag_shadow"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def plan_of(spark, folder, name):
    return registry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


PRICES = "SELECT * REPLACE (l_extendedprice + c * 0.37 + l_partkey / 1e4 AS l_extendedprice) FROM small, range(5) r(c)"


@pytest.mark.parametrize("name", ["calstat_names", "visstat_phase", "visstat_amp"])
def test_quartiles_without_tables_of_values(spark, tmp_path, name):
    check(spark, tmp_path, name, lineitem=PRICES)
    assert " percentile(" not in plan_of(spark, tmp_path, name)  # it holds a group's distinct values in one task


def test_exact_quantiles(spark):
    rng = random.Random(7)
    of = {"uniform": rng.random, "tied": lambda: rng.choice([-1.0, 0.0, 2.5]), "far": lambda: rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300), "odd": lambda: rng.choice([None, math.nan, math.inf, 1.0, -0.0, 0.0])}
    data = [(k, f()) for k, f in of.items() for _ in range(3000)] + [(None, float(i)) for i in range(4)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    shares = {"least": 0.0, "a": 0.25, "m": 0.5, "b": 0.9, "most": 1.0}
    text = lambda rows: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    for keys in (["k"], []):
        want = df.where("v IS NOT NULL").groupBy(*keys).agg(*(F.percentile("v", q).alias(n) for n, q in shares.items())).collect()
        for sketch in (1, 2000):  # the first finds nothing, so that whole groups are sorted
            assert text(stats.exact_quantiles(df, "v", keys, shares, sketch).collect()) == text(want)
    both = [stats.statistics(df.where("k IS NULL OR k <> 'far'"), F.col("v"), ["k"], F.col("k") == "tied", few=few).select("k", "npts", "min", *stats.QUARTILES).collect() for few in (False, True)]
    assert text(both[0]) == text(both[1]) and len(both[0]) == 6
    assert stats.statistics(df.where("false"), F.col("v"), [], few=True).collect() == stats.statistics(df.where("false"), F.col("v"), []).collect()
    where = df.select(F.col("k"), F.col("v").alias("re"), (F.col("k") == "tied").alias("flag")).where("k NOT IN ('far', 'odd')")
    for keys in (["k"], []):
        both = [stats.visibility_statistics(where, "real", keys, few=few).select(*keys, "npts", *stats.QUARTILES, "medabsdevmed").collect() for few in (False, True)]
        assert text(both[0]) == text(both[1])
