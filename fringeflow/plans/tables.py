"""Queries on tables: sources, selections, listings, joins, sets, streams and extension points."""

from __future__ import annotations

import sqlite3
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import average, calibrate, extend, search, select
from ..session import scratch_root, table
from ..sources import asdm, filler, fitstables, headers, sqlite, tables
from ..streaming import windows
from . import sqlshim
from .base import CATALOG, FACT, LONG, SPECTRA, VIS, catalog, fact, long, spectra, vis
from .registry import add, rounded


def _place(s: SparkSession, what: str) -> str:
    return f"{scratch_root(s)}/{what}-{uuid.uuid4().hex[:12]}"


# --- sources and sinks --------------------------------------------------------------------------------------------
def _text_table(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "text")
    n = table(s, d, "nation").orderBy("n_nationkey").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.regexp_replace("n_name", " ", "_"), F.col("n_regionkey").cast("string")).alias("v"))
    n.coalesce(1).write.text(path)
    return tables.read_text_table(s, path, "id int, name string, region int", header=False, first=3, last=11)


def _line_list(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "lines")
    c = catalog(s, d)
    cells = [F.col("species"), F.when(F.col("el") > 20, "Yes").otherwise("No"), F.regexp_replace("chemname", ":", ""), F.col("frequency"), F.lit("q"), F.col("el"), F.lit(1), F.lit(2), F.col("el"), F.col("el") + 1, F.lit("L")]
    c.select(F.concat_ws(":", *(x.cast("string") for x in cells)).alias("v")).write.text(path)
    got = tables.read_line_list(s, [path], header=False)
    return got.groupBy("species", "recommended").agg(F.count("*").alias("n"), F.max("frequency").alias("top"), F.max("eu").cast("double").alias("eu"))


def _sqlite(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "lines")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE main (line_id INTEGER, species TEXT, frequency REAL)")
    db.executemany("INSERT INTO main VALUES (?, ?, ?)", [tuple(r) for r in table(s, d, "part").where("p_partkey <= 200").select("p_partkey", "p_brand", "p_retailprice").collect()])
    db.commit()
    fitstables.write_bytes(s, f"{path}/lines.db", db.serialize())
    return sqlite.read(s, path, "main", "species string, frequency double").where("frequency > 905").groupBy("species").agg(F.count("*").alias("n"))


def _archive(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "archive")
    scans = fact(s, d).where("scan < 200").select(F.col("spw").alias("scanNumber"), F.col("t").alias("time"))
    asdm.write(scans, path, "Main", ["time"])
    return asdm.summary(asdm.read(s, path, "Main", "scanNumber int, time double"), "time", ["scanNumber"])


def _uvfits(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "uv")
    p = fact(s, d).where("scan <= 40").orderBy("scan", "spw").toPandas()
    n = len(p)
    re = p["weight"].to_numpy()[:, None] + np.arange(3)
    raw = fitstables.encode_uvfits(p["scan"] / 8, p["spw"], np.zeros(n), 256 * (p["ant"] % 20) + p["part"] % 20, 2451545.0 + p["spw"] / 4, re, -re, np.full((n, 3), 0.5))
    fitstables.write_bytes(s, f"{path}/a.uvfits", raw)
    got = fitstables.read_uvfits(s, path)
    return got.groupBy("ant1", "chan").agg(F.count("*").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"), F.max("u").alias("u"), F.max("date").alias("date"), F.sum("weight").alias("weight"))


def _fits_idi(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "idi")
    p = vis(s, d).where("row_id < 400").orderBy("row_id").select("row_id", "ant", "t", "value").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(p)), 2)):
        q = p.iloc[part]
        flux = np.stack([q["value"], -q["value"]], 1)
        raw = fitstables.EMPTY_PRIMARY + fitstables.encode_table("UV_DATA", {"ROW": q["row_id"].to_numpy("i8"), "SOURCE": q["ant"].to_numpy("i4"), "TIME": q["t"].to_numpy("f8"), "FLUX": flux})
        fitstables.write_bytes(s, f"{path}/{i}.fits", raw)
    got = fitstables.read_table(s, path, "UV_DATA", "ROW long, SOURCE int, TIME double, FLUX array<double>")
    both = got.select(F.col("ROW").alias("row_id"), F.col("SOURCE").alias("field"), F.col("TIME").alias("time"), F.col("FLUX")[0].alias("re"), F.col("FLUX")[1].alias("im"), F.lit(0).alias("array"), F.lit(0).alias("series"))
    return average.gap_sessions(both, "time", ["series"], "field", 172_800.0, "array").select("row_id", "scan", "re", "im")


def _fits_images(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "images")
    from .base import cube

    fitstables.export_planes(cube(s, d), path, (64, 64), cards={"OBJECT": "test"})
    listed = fitstables.list_fits(s, path).where("key = 'NAXIS1'").groupBy("file").agg(F.max("value").alias("naxis1"))
    pixels = fitstables.read_planes(s, path).groupBy("file").agg(F.count("*").alias("npix"), F.sum("value").alias("flux"))
    return pixels.join(listed, "file").select(F.regexp_extract("file", r"(\d+)\.fits$", 1).cast("int").alias("chan"), "naxis1", "npix", "flux")


class _Squares:
    """A format that makes its rows: part p has p + 1 of them."""

    schema = "part int, n long"

    def parts(self, options):
        return list(range(int(options["parts"])))

    def rows(self, part, options):
        yield from ((part, part * 100 + k) for k in range(part + 1))


def _partitions(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "parts")
    tables.write_partitions(fact(s, d).withColumn("part_id", F.col("scan") % 4).select("part_id", "spw", "ant", "value"), path, ["part_id"])
    got = s.read.parquet(path)
    return tables.list_partitions(got, "part_id", "ant", "spw", F.lit(1)).groupBy("part_id").agg(F.count("*").alias("scans"), F.sum("nrows").alias("nrows"), F.max(F.size("spws")).alias("nspw")).withColumn("part_id", F.col("part_id").cast("long"))


def _concatenated(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier")
    sets = []
    for i in (0, 1):
        one = sup.where(F.col("s_suppkey") % 2 == i)
        dim = one.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("freq"))
        sets.append((one.select(F.col("s_suppkey").alias("id"), "s_acctbal"), dim))
    facts, dims = tables.concatenate(sets, "id", "id", "freq", 0.5)
    return facts.join(dims, "id").groupBy("freq").agg(F.count("*").alias("n"))


def _written_back(s: SparkSession, d: str) -> DataFrame:
    v = tables.Versioned(s, _place(s, "versions"))
    v.write(vis(s, d).select("row_id", "ant", "value", F.lit(False).alias("flag")))
    n = v.write_back(v.read().where("value > 50").select("row_id", F.lit(True).alias("flag")), "row_id", ["flag"])
    return v.read(n).groupBy("ant").agg(F.sum(F.col("flag").cast("long")).alias("flagged"), F.count("*").alias("n"))


def _dropped(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "tables")
    for name in ("a1", "a2", "b1"):
        table(s, d, "region").write.parquet(f"{path}/{name}")
    gone = tables.drop(s, f"{path}/a*")
    return s.createDataFrame([(g.rsplit("/", 1)[1],) for g in gone], "name string")


def _history(s: SparkSession, d: str) -> DataFrame:
    h = tables.with_history(None, s, "split", {"field": "a", "width": 4})
    h = tables.with_history(h, s, "clip", {"limit": 2.5})
    return headers.listed_history(h).select("task", "call")


add("text_table_lines", _text_table, "SELECT n_nationkey AS id, replace(n_name, ' ', '_') AS name, n_regionkey AS region FROM nation WHERE n_nationkey BETWEEN 3 AND 11")
add("line_list_table", _line_list, f"SELECT species, el > 20 AS recommended, count(*) AS n, max(frequency) AS top, CAST(max(el + 1) AS DOUBLE) AS eu FROM {CATALOG} GROUP BY 1, 2")
add("line_database", _sqlite, "SELECT p_brand AS species, count(*) AS n FROM part WHERE p_partkey <= 200 AND p_retailprice > 905 GROUP BY 1")
add("archive_summary", _archive, f"SELECT spw AS \"scanNumber\", count(*) AS rows, min(t) AS start, max(t) AS stop FROM {FACT} WHERE scan < 200 GROUP BY 1")
add("uvfits_round_trip", lambda s, d: rounded(_uvfits(s, d), digits=4),
    f"SELECT CAST(ant % 20 AS INTEGER) AS ant1, CAST(c AS INTEGER) AS chan, count(*) AS n, round(sum(weight + c), 4) AS re, round(-sum(weight + c), 4) AS im, round(max(scan / 8.0), 4)::DOUBLE AS u, round(max(2451545.0::DOUBLE + spw / 4.0::DOUBLE), 4) AS date, round(count(*) * 0.5, 4)::DOUBLE AS weight FROM {FACT}, range(3) r(c) WHERE scan <= 40 GROUP BY 1, 2")
add("fits_idi_scans", lambda s, d: rounded(_fits_idi(s, d)),
    f"WITH a AS (SELECT row_id, ant, t, value, lag(t) OVER (PARTITION BY ant ORDER BY t) AS p FROM {VIS} WHERE row_id < 400), b AS (SELECT *, (p IS NULL OR t - p > 172800)::INT AS n FROM a), c AS (SELECT *, sum(n) OVER (ORDER BY t, ant ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT row_id, CAST(last_value(CASE WHEN n = 1 THEN g END IGNORE NULLS) OVER (PARTITION BY ant ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan, round(value, 6) AS re, round(-value, 6) AS im FROM c")
add("fits_images", lambda s, d: rounded(_fits_images(s, d), digits=2), f"SELECT chan, '64' AS naxis1, count(*) AS npix, round(sum(value), 2) AS flux FROM (SELECT part % 64 AS x, ant % 64 AS y, spw AS chan, avg(value) AS value FROM {FACT} GROUP BY 1, 2, 3) GROUP BY chan")
add("generic_filler", lambda s, d: filler.filled(s, _Squares(), {"parts": 6}), "SELECT CAST(p AS INTEGER) AS part, p * 100 + k AS n FROM range(6) a(p), range(6) b(k) WHERE k <= p")
add("partition_listing", _partitions, f"WITH g AS (SELECT scan % 4 AS part_id, ant, count(*) AS n, count(DISTINCT spw) AS k FROM {FACT} GROUP BY 1, 2) SELECT part_id, count(*) AS scans, CAST(sum(n) AS BIGINT) AS nrows, CAST(max(k) AS INTEGER) AS nspw FROM g GROUP BY 1")
add("concatenated_sets", _concatenated, "SELECT s_nationkey::DOUBLE AS freq, count(*) AS n FROM supplier GROUP BY 1")
add("write_back", _written_back, f"SELECT ant, CAST(sum((value > 50)::INT) AS BIGINT) AS flagged, count(*) AS n FROM {VIS} GROUP BY 1")
add("drop_tables", _dropped, "SELECT unnest(['a1', 'a2']) AS name")
add("history_listing", _history, "SELECT unnest(['split', 'clip']) AS task, unnest(['field=''a'', width=4', 'limit=2.5']) AS call")
add("in_memory_subset", lambda s, d: tables.subset(fact(s, d), F.col("spw") == 2, ["ant", "scan"], "value").groupBy("ant").agg(F.count("*").alias("n"), F.round(F.sum("data"), 4).alias("data")), f"SELECT ant, count(*) AS n, round(sum(value), 4) AS data FROM {FACT} WHERE spw = 2 GROUP BY 1")
add("list_shapes", lambda s, d: tables.shapes(spectra(s, d), ["label"], "v"), f"SELECT label, CAST(len(v) AS INTEGER) AS nchan, count(*) AS rows FROM {SPECTRA} GROUP BY 1, 2")
add("ephemeris_positions", lambda s, d: rounded(tables.positions(s.range(400).select(F.lit(1).alias("body"), (1704067200.0 + F.col("id") * 7200).alias("t"), (F.col("id") * 0.5).alias("ra"), (10 - F.col("id") * 0.01).alias("dec")), "t", ["body"], ["ra", "dec"], vis(s, d).select("row_id", F.lit(1).alias("body"), "t"), 86400.0).select("row_id", "ra", "dec")),
    f"SELECT row_id, round(least(greatest((t - 1704067200.0) / 7200, 0), 399) * 0.5, 6) AS ra, round(10 - least(greatest((t - 1704067200.0) / 7200, 0), 399) * 0.01, 6) AS dec FROM {VIS}")

# --- rows, keys, groups -------------------------------------------------------------------------------------------
add("row_objects", lambda s, d: select.row_fields(table(s, d, "nation"), ["n_regionkey"], exclude=True).select("row.*"), "SELECT n_nationkey, n_name FROM nation")
add("group_iterator", lambda s, d: rounded(extend.for_each_group(vis(s, d).select("ant", "value"), ["ant"], _spread, "ant long, n long, spread double")), f"SELECT ant, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM {VIS} GROUP BY 1")
add("key_index_unique", lambda s, d: select.is_unique(vis(s, d), ["row_id"]).select(F.col("unique").alias("by_row")).crossJoin(select.is_unique(vis(s, d), ["ant", "spw"]).select(F.col("unique").alias("by_pair"))), f"SELECT count(*) = count(DISTINCT row_id) AS by_row, count(*) = count(DISTINCT (ant, spw)) AS by_pair FROM {VIS}")
add("key_index_rows", lambda s, d: select.rows_of_key(vis(s, d), {"ant": 7, "spw": "view"}).select("row_id"), f"SELECT row_id FROM {VIS} WHERE ant = 7 AND spw = 'view'")
add("key_index_range", lambda s, d: select.rows_between(fact(s, d), {"ant": 3, "spw": 2}, {"ant": 5, "spw": 1}, upper_included=False).select("scan", "ant", "spw"), f"SELECT scan, ant, spw FROM {FACT} WHERE (ant > 3 OR (ant = 3 AND spw >= 2)) AND (ant < 5 OR (ant = 5 AND spw < 1))")


def _spread(p):
    import pandas as pd

    return pd.DataFrame({"ant": [p["ant"].iloc[0]], "n": [len(p)], "spread": [p["value"].max() - p["value"].min()]})


# --- selections ---------------------------------------------------------------------------------------------------
add("select_crosscorr", lambda s, d: vis(s, d).where(select.cross_correlations("ant", "k")).groupBy("spw").agg(F.count("*").alias("n")), f"SELECT spw, count(*) AS n FROM {VIS} WHERE ant <> k GROUP BY spw")
add("autocorr_audit", lambda s, d: select.autocorrelation_status(vis(s, d), "ant", "ant", "k", F.col("value") < 50),
    f"SELECT ant, CASE WHEN bool_or(ant = k) THEN CASE WHEN bool_and(value < 50) FILTER (WHERE ant = k) THEN 'F' ELSE 'R' END ELSE 'N' END AS status FROM {VIS} GROUP BY ant")
add("list_observation", lambda s, d: select.observation(vis(s, d), ["ant", "spw"], "tick", F.col("value") < 10), f"SELECT ant, spw, min(tick) AS start, max(tick) AS stop, count(*) AS rows, CAST(sum((value >= 10)::INT) AS BIGINT) AS unflagged FROM {VIS} GROUP BY ant, spw")


def _ids(s: SparkSession, d: str) -> DataFrame:
    dims = {"field": (table(s, d, "nation"), "n_nationkey", "n_name"), "region": (table(s, d, "region"), "r_regionkey", "r_name")}
    found = select.indices(dims, field="NATION_1?,3~5,nation_24", region="")
    return s.createDataFrame([(a, i) for a, ids in found.items() for i in ids], "axis string, id long")


add("select_ids", _ids, "SELECT 'field' AS axis, n_nationkey::BIGINT AS id FROM nation WHERE n_name LIKE 'NATION_1_' OR n_nationkey BETWEEN 3 AND 5 OR n_name = 'NATION_24' UNION ALL SELECT 'region', r_regionkey FROM region")
add("select_antennas_by_name", lambda s, d: vis(s, d).where(select.antennas(select.antenna_names("DV01 & PM2; !DA41 & *", {"DV01": 3, "PM2": 7, "DA41": 5}), "ant", "k")).select("row_id"), f"SELECT row_id FROM {VIS} WHERE ((ant = 3 AND k = 7) OR (ant = 7 AND k = 3)) AND NOT ((ant = 5 OR k = 5) AND ant <> k)")
for _name, _spec, _sql in (
    ("pair", "3&7", "(ant = 3 AND k = 7) OR (ant = 7 AND k = 3)"), ("any", "3", "ant = 3 OR k = 3"), ("cross", "3~4&*", "(ant BETWEEN 3 AND 4 OR k BETWEEN 3 AND 4) AND ant <> k"), ("auto", "2,5&&&", "ant = k AND ant IN (2, 5)"),
):
    add(f"select_antennas_{_name}", lambda s, d, x=_spec: vis(s, d).where(select.antennas(x, "ant", "k")).select("row_id"), f"SELECT row_id FROM {VIS} WHERE {_sql}")
add("select_times_short", lambda s, d: vis(s, d).where(select.times_in_short("t", "2024/01/03/09:14:00~12:30:00,06:20,2024/01/05/10:00+2:30:00,>2024/01/27", "2024/01/02")).select("row_id"),
    f"SELECT row_id FROM {VIS} WHERE tick BETWEEN epoch_us(TIMESTAMP '2024-01-03 09:14:00') AND epoch_us(TIMESTAMP '2024-01-03 12:30:00') OR (tick >= epoch_us(TIMESTAMP '2024-01-02 06:20:00') AND tick < epoch_us(TIMESTAMP '2024-01-02 06:21:00')) OR tick BETWEEN epoch_us(TIMESTAMP '2024-01-05 10:00:00') AND epoch_us(TIMESTAMP '2024-01-05 12:30:00') OR tick > epoch_us(TIMESTAMP '2024-01-27')")
add("select_stokes", lambda s, d: fact(s, d).withColumn("stokes", F.element_at(F.array(*map(F.lit, ("XX", "XY", "YX", "YY", "I", "V", "Q"))), F.col("spw"))).where(F.col("stokes").isin(select.parse_stokes("XXYYI"))).groupBy("stokes").agg(F.count("*").alias("n")), f"SELECT ['XX', 'XY', 'YX', 'YY', 'I', 'V', 'Q'][spw] AS stokes, count(*) AS n FROM {FACT} WHERE spw IN (1, 4, 5) GROUP BY 1")
add("data_description_ids", lambda s, d: select.data_description_ids(table(s, d, "nation").select(F.col("n_nationkey").alias("ddid"), F.col("n_regionkey").alias("spw"), (F.col("n_nationkey") > 20).alias("flag_row")), [1, 3]), "SELECT n_nationkey AS ddid FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey <= 20")
add("row_locate", lambda s, d: select.locate(catalog(s, d), "line_id", [("el", ">", 40, False), ("species", "=", "Brand#11", True)]), f"SELECT line_id FROM {CATALOG} WHERE el > 40 AND species <> 'Brand#11'")
add("table_sorter", lambda s, d: select.sort_by(catalog(s, d), ("el", False), ("line_id", True)).limit(25).select("line_id", "el"), f"SELECT line_id, el FROM {CATALOG} ORDER BY el DESC, line_id LIMIT 25")
add("table_validator", lambda s, d: select.validate(table(s, d, "customer").select(F.substring("c_name", -3, 3).alias("c")).union(table(s, d, "region").select(F.col("r_name").alias("c"))), "c", "int"), "SELECT r_name AS c FROM region")
add("list_visibilities", lambda s, d: select.listing(vis(s, d).where("row_id < 50"), {"row_id": "%06d", "spw": "%-8s", "ant": "%3d"}).select("line"), f"SELECT printf('%06d %-8s %3d', row_id, spw, ant) AS line FROM {VIS} WHERE row_id < 50")
add("list_calibration", lambda s, d: select.listing(vis(s, d).groupBy("spw", "k").agg(F.count("*").alias("n")), {"spw": "%s", "k": "%02d", "n": "%5d"}).select("line"), f"SELECT printf('%s %02d %5d', spw, k, count(*)) AS line FROM {VIS} GROUP BY spw, k")


# --- query commands -----------------------------------------------------------------------------------------------
def _command(text: str):
    return lambda s, d: sqlshim.command(vis(s, d).select("row_id", "ant", "spw", "value", "k"), text)


_ROWS = f"SELECT row_id, ant, spw, value, k FROM {VIS}"
add("command_update", _command("UPDATE t SET value = value * 2, k = 0 WHERE spw == 'view' && ant IN [1, 3:5]"), f"SELECT row_id, ant, spw, CASE WHEN spw = 'view' AND (ant = 1 OR ant BETWEEN 3 AND 5) THEN value * 2 ELSE value END AS value, CAST(CASE WHEN spw = 'view' AND (ant = 1 OR ant BETWEEN 3 AND 5) THEN 0 ELSE k END AS INTEGER) AS k FROM {VIS}")
add("command_delete", _command("DELETE FROM t WHERE value < 50 || spw != 'click'"), f"{_ROWS} WHERE NOT (value < 50 OR spw <> 'click')")
add("command_insert", _command("INSERT INTO t (row_id, ant, spw, value) VALUES (-1, 2, 'a, (b)', 1.5), (-2, 3, 'c', 2.5)"), f"{_ROWS} UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 2::BIGINT, 'a, (b)', 1.5::DOUBLE, NULL::INTEGER), (-2, 3, 'c', 2.5, NULL)) v")
add("command_count", _command("COUNT ant, spw FROM t WHERE k > 4"), f"SELECT ant, spw, count(*) AS _count_ FROM {VIS} WHERE k > 4 GROUP BY ant, spw")
add("command_calc", _command("CALC value * 2 + k FROM t WHERE ant == 3"), f"SELECT value * 2 + k AS result FROM {VIS} WHERE ant = 3")
add("command_groupby", _command("SELECT spw, k, count(*) AS n, max(value) AS top FROM t WHERE ant < 9 GROUPBY spw, k HAVING n > 3 ORDERBY spw, k LIMIT 20"), f"SELECT spw, k, count(*) AS n, max(value) AS top FROM {VIS} WHERE ant < 9 GROUP BY spw, k HAVING n > 3 ORDER BY spw, k LIMIT 20")
add("command_create", lambda s, d: sqlshim.command(vis(s, d).select("row_id", "spw", "k"), "CREATE TABLE made_by_command AS SELECT row_id, k FROM t WHERE spw ~ p/v*w/"), f"SELECT row_id, k FROM {VIS} WHERE spw LIKE 'v%w'")
add("expression_functions", lambda s, d: rounded(sqlshim.query(spectra(s, d), "SELECT vec_id, sums(v) AS total, sumsqr(v) AS power, maxs(v) AS top, nelements(v) AS n, iif(means(v) > 0, 1, 0) AS up FROM t WHERE !(label IN [1, 2]) && vec_id % 2 == 0")),
    f"SELECT vec_id, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS power, round(list_max(v), 6) AS top, CAST(len(v) AS INTEGER) AS n, CAST(list_sum(v) > 0 AS INTEGER) AS up FROM {SPECTRA} WHERE label NOT IN (1, 2) AND vec_id % 2 = 0")


# --- headers and intents ------------------------------------------------------------------------------------------
def _header(s: SparkSession, d: str) -> DataFrame:
    h = headers.from_columns(table(s, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    h = headers.add(headers.put(h.where("NOT (name = '3' AND key = 'n_regionkey')"), "N_REGIONKEY", "9"), "n_regionkey", "new")
    return headers.as_columns(headers.remove(h, "n_comment"), ["n_name", "n_regionkey"])


add("image_header", _header, "SELECT n_nationkey::VARCHAR AS name, n_name, CASE WHEN n_nationkey = 3 THEN 'new' ELSE '9' END AS n_regionkey FROM nation")
add("table_header_get", lambda s, d: headers.get(headers.from_columns(table(s, d, "region"), "r_regionkey", ["r_name"]), "r_name"), "SELECT r_regionkey::VARCHAR AS name, r_name AS value FROM region")


def _intents(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_regionkey").cast("long").alias("state_id"))
    states = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("state_id"), F.col("r_name").alias("obs_mode"))
    out, st = tables.set_intents(rows, states, (F.col("row") % 2 == 0) & (F.col("state_id") > 1), "CALIBRATE", "append")
    return out.join(st, "state_id").select("row", "obs_mode")


add("set_intents", _intents, "SELECT n_nationkey::BIGINT AS row, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey > 1 THEN r_name || ',CALIBRATE' ELSE r_name END AS obs_mode FROM nation JOIN region ON n_regionkey = r_regionkey")

# --- joins and sets -----------------------------------------------------------------------------------------------
add("fk_lookup", lambda s, d: tables.lookup(tables.lookup(table(s, d, "supplier"), table(s, d, "nation"), "s_nationkey", "n_nationkey", ["n_name", "n_regionkey"]), table(s, d, "region"), "n_regionkey", "r_regionkey", ["r_name"]).groupBy("r_name", "n_name").agg(F.count("*").alias("antennas")),
    "SELECT r_name, n_name, count(*) AS antennas FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
add("semi_unflagged", lambda s, d: select.having(table(s, d, "orders"), fact(s, d).where("NOT flag"), F.col("o_orderkey") == F.col("scan")).groupBy("o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') GROUP BY 1")
add("anti_unflagged", lambda s, d: select.lacking(table(s, d, "orders"), fact(s, d).where("NOT flag"), F.col("o_orderkey") == F.col("scan")).groupBy("o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') GROUP BY 1")
add("beam_relabel", lambda s, d: rounded(average.beam_average(fact(s, d), "ant", [2, 5, 9], ~F.col("flag"), [], "value")), f"SELECT CASE WHEN ant IN (2, 5, 9) AND NOT flag THEN 2 ELSE ant END AS beam, round(avg(value), 6) AS value, count(*) AS n FROM {FACT} GROUP BY 1")
add("pointing_interpolation", lambda s, d: rounded(calibrate.pointing(vis(s, d).select("row_id", "ant", "t"), s.range(3000).select((F.col("id") % 100).alias("antenna"), (1704067200.0 + F.expr("id div 100") * 86400).alias("t"), (F.col("id") * 0.001).alias("az")), "ant", "t", ["az"]).where("ant < 100").select("row_id", "az")),
    f"SELECT row_id, round((ant + 100 * least(greatest((t - 1704067200.0) / 86400, 0), 29)) * 0.001, 6) AS az FROM {VIS} WHERE ant < 100")
add("line_species_join", lambda s, d: search.with_species(catalog(s, d), catalog(s, d).groupBy("species").agg(F.max("el").alias("top_el")).where("species <> 'Brand#11'"), "species", ["top_el"]).select("line_id", "top_el"), f"WITH t AS (SELECT species, max(el) AS top_el FROM {CATALOG} WHERE species <> 'Brand#11' GROUP BY species) SELECT line_id, top_el FROM {CATALOG} c LEFT JOIN t USING (species)")
add("line_objects", lambda s, d: search.astronomical(catalog(s, d).withColumn("comets", F.col("el") % 7 == 0).withColumn("top20", F.col("el") > 45), "comets", "top20").select("line_id"), f"SELECT line_id FROM {CATALOG} WHERE el % 7 = 0 OR el > 45")
add("line_records", lambda s, d: s.createDataFrame(search.records(catalog(s, d).where("el = 9").select("line_id", "frequency"), 10**6), "line_id long, frequency double"), f"SELECT line_id, frequency FROM {CATALOG} WHERE el = 9")
add("union_sets", lambda s, d: tables.reduce(DataFrame.unionByName, [vis(s, d).where("k < 3").select("row_id"), vis(s, d).where("k > 7").select("row_id")]), f"SELECT row_id FROM {VIS} WHERE k < 3 OR k > 7")
add("set_difference", lambda s, d: tables.differences(vis(s, d).where("k <> 4").select("row_id", "value"), vis(s, d).where("k <> 5").select("row_id", "value")), f"SELECT row_id, value, CASE k WHEN 5 THEN 'a' ELSE 'b' END AS only_in FROM {VIS} WHERE k IN (4, 5)")
add("nan_check", lambda s, d: tables.not_finite(long(s, d), ["label"], "value"), f"SELECT label, CAST(sum(isnan(value)::INT) AS BIGINT) AS nans, count(*) AS n FROM {LONG} GROUP BY label")

# --- windows of time ----------------------------------------------------------------------------------------------


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("tick"))



def _windowed(df: DataFrame) -> DataFrame:
    return rounded(df.select(*((F.unix_micros(c)).alias(c) if c in ("start", "end") else F.col(c) for c in df.columns)))


add("tumbling_window", lambda s, d: _windowed(windows.tumbling(_stamped(vis(s, d)), "ts", "6 hours", "1 hour", ["spw"], "value")), f"SELECT tick // 21600000000 * 21600000000 AS start, (tick // 21600000000 + 1) * 21600000000 AS \"end\", spw, round(avg(value), 6) AS mean, count(*) AS n FROM {VIS} GROUP BY 1, 2, 3")
add("sliding_window", lambda s, d: _windowed(windows.sliding(_stamped(vis(s, d)), "ts", "12 hours", "6 hours", "1 hour", ["spw"], "value", "k")).where("mean is not null"),
    f"SELECT (b - o) * 21600000000 AS start, (b - o + 2) * 21600000000 AS \"end\", spw, round(sum(value * k) / sum(k), 6) AS mean, count(*) AS n FROM (SELECT spw, value, k, tick // 21600000000 AS b FROM {VIS}), range(2) r(o) GROUP BY 1, 2, 3 HAVING sum(k) > 0")
add("session_window", lambda s, d: _windowed(windows.sessions(_stamped(vis(s, d).where("ant < 40")), "ts", "12 hours", "1 hour", ["ant"], "value")).drop("end"),
    f"WITH a AS (SELECT ant, tick, value, (tick - coalesce(lag(tick) OVER (PARTITION BY ant ORDER BY tick), -1e18) >= 43200000000)::INT AS n FROM {VIS} WHERE ant < 40), b AS (SELECT *, sum(n) OVER (PARTITION BY ant ORDER BY tick, n DESC ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT min(tick) AS start, ant, round(avg(value), 6) AS mean, count(*) AS n FROM b GROUP BY ant, g")


# --- extension points ---------------------------------------------------------------------------------------------
@extend.layer("scaled")
def _scaled(column: str, by: float) -> extend.Layer:
    return lambda df: df.withColumn(column, F.col(column) * by)


class _Power(extend.Statistic):
    """Mean of squares, as an example of a statistic whose parts merge."""

    def zero(self):
        return [0.0, 0.0]

    def add(self, state, values):
        return [state[0] + float((values * values).sum()), state[1] + len(values)]

    def merge(self, a, b):
        return [a[0] + b[0], a[1] + b[1]]

    def result(self, state):
        return state[0] / state[1]


class _Cubes(extend.Algorithm):
    schema = "cube long"

    def get(self):
        return list(range(12))

    def task(self, item):
        return (item**3,)


@extend.task
def _counted(df: DataFrame, least: int = 50) -> DataFrame:
    return df.where(F.col("value") > least).groupBy("spw").agg(F.count("*").alias("n"))


add("layers", lambda s, d: rounded(extend.stack(vis(s, d).select("row_id", "value"), ("pass_through", {}), ("scaled", {"column": "value", "by": 3.0}), lambda df: df.where("value > 90"))), f"SELECT row_id, round(value * 3, 6) AS value FROM {VIS} WHERE value * 3 > 90")
add("statistic_plug_in", lambda s, d: rounded(extend.plugged(vis(s, d), ["spw"], "value", _Power())), f"SELECT spw, round(avg(value * value), 6) AS value FROM {VIS} GROUP BY spw")
add("parallel_algorithm", lambda s, d: extend.dealt(s, _Cubes()), "SELECT i AS item, i * i * i AS cube FROM range(12) r(i)")
add("task_decorator", lambda s, d: _counted(vis(s, d)), f"SELECT spw, count(*) AS n FROM {VIS} WHERE value > 50 GROUP BY spw")
add("table_function", lambda s, d: extend.expanded(table(s, d, "part"), ["p_partkey"], "p_type", " ", "word"), "SELECT p_partkey, CAST(i AS INTEGER) AS place, string_split(p_type, ' ')[i + 1] AS word FROM part, range(5) r(i) WHERE i < len(string_split(p_type, ' '))")


# --- order, texts, versions -------------------------------------------------------------------------------------------
def _chunk_order(s: SparkSession, d: str) -> DataFrame:
    """Rows of each partition in chunk order: how often a row comes before its predecessor, and in how many partitions a chunk is."""
    from pyspark.sql import Window

    v = tables.in_chunks(vis(s, d).select("spw", "ant", "tick"), ["spw", "ant", "tick"], 5)
    v = v.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    key = F.struct("spw", "ant", "tick")
    w = Window.partitionBy("part").orderBy("n")
    back = v.withColumn("back", F.lag(key).over(w) > key)
    chunks = v.groupBy("spw", "ant").agg(F.count_distinct("part").alias("parts")).agg(F.max("parts").alias("parts"))
    return back.agg(F.sum(F.coalesce("back", F.lit(False)).cast("long")).alias("out_of_order"), F.count("*").alias("n")).crossJoin(chunks)


def _flag_versions(s: SparkSession, d: str) -> DataFrame:
    from ..operators.flag import Versions

    v = Versions(s, _place(s, "flags"))
    df = vis(s, d).select("row_id", (F.col("value") > 70).alias("flag"))
    v.save(df, "first")
    v.save(df.withColumn("flag", F.col("row_id") % 3 == 0), "second")
    v.rename("second", "third")
    v.save(df, "fourth")
    v.delete("fourth")
    out = v.restore(df, "third", "or")
    return out.withColumn("left_over", F.lit(",".join(v.names())))


def _library(s: SparkSession, d: str) -> DataFrame:
    rows = calibrate.parse_library("caltable='a.G' calwt=True tinterp='nearest' spwmap=[0, 0, 1] # gains\n\ncaltable=\"b.B\", field='3C'\n")
    return s.createDataFrame([(r["caltable"], r.get("tinterp", "linear"), ",".join(map(str, r.get("spwmap", [-1]))), bool(r.get("calwt", False))) for r in rows], "caltable string, tinterp string, spwmap string, calwt boolean")


def _scans(s: SparkSession, d: str) -> DataFrame:
    found = tables.parse_scans("b0:1,3~5;b1:*;b0:9")
    return s.createDataFrame([(b, x) for b, ids in found.items() for x in (ids or [None])], "block string, scan long")


def _units(s: SparkSession, d: str) -> DataFrame:
    from ..functions import units

    rows = [(*units.parse("5.5 km/s"), units.compare("3m", "2cm"), units.compare("3m", "2s"), units.factor("kg.m2/s2", "J"))]
    return s.createDataFrame(rows, "value double, unit string, alike boolean, unlike boolean, factor double")


add("time_sort", lambda s, d: tables.in_time_order(fact(s, d), "t", "scan", "spw", "part", "ant").limit(40).select("t", "scan", "spw"), f"SELECT t, scan, spw FROM {FACT} ORDER BY t, scan, spw, part, ant LIMIT 40")
add("chunk_sort", _chunk_order, f"SELECT 0::BIGINT AS out_of_order, count(*) AS n, 1::BIGINT AS parts FROM {VIS}")
add("flag_version_files", _flag_versions, f"SELECT row_id, value > 70 OR row_id % 3 = 0 AS flag, 'first,third' AS left_over FROM {VIS}")
add("calibration_library", _library, "SELECT * FROM (VALUES ('a.G', 'nearest', '0,0,1', true), ('b.B', 'linear', '-1', false)) t(caltable, tinterp, spwmap, calwt)")
add("archive_scan_list", _scans, "SELECT * FROM (VALUES ('b0', 1::BIGINT), ('b0', 3), ('b0', 4), ('b0', 5), ('b0', 9), ('b1', NULL)) t(block, scan)")
add("unit_texts", _units, "SELECT 5.5::DOUBLE AS value, 'km/s' AS unit, true AS alike, false AS unlike, 1.0::DOUBLE AS factor")
add("multi_set_iteration", lambda s, d: extend.for_each_group(tables.reduce(DataFrame.unionByName, [vis(s, d).where(F.col("k") % 3 == i).select(F.lit(i).alias("ant"), "value") for i in range(3)]).withColumn("ant", F.col("ant").cast("long")), ["ant"], _spread, "ant long, n long, spread double").transform(rounded),
    f"SELECT CAST(k % 3 AS BIGINT) AS ant, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM {VIS} GROUP BY 1")
add("value_providers", lambda s, d: rounded((lambda t: _complex(s, d).select("scan", "spw", *(t(a).alias(a) for a in ("amplitude", "phase", "real", "imaginary", "uvrange", "flag", "weight"))))(_provider)),
    f"SELECT scan, spw, round(sqrt(re * re + im * im), 6) AS amplitude, round(atan2(im, re), 6) AS phase, round(re, 6) AS real, round(im, 6) AS imaginary, round(sqrt(u * u + v * v), 6) AS uvrange, flag::INT::DOUBLE AS flag, weight FROM (SELECT *, value / 1000 AS re, (weight - 25) * 2 AS im, weight - 25 AS u, ant % 40 - 20.0::DOUBLE AS v FROM {FACT})")


def _complex(s: SparkSession, d: str) -> DataFrame:
    from .statistics import cvis

    return cvis(s, d)


def _provider(axis: str):
    from ..operators import stats

    return stats.transform(axis)
