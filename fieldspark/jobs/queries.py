"""One query for each operator, over fields derived from the provided tables, with a DuckDB twin where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.numeric import draw
from ..operators import ensemble, lim, linalg, resample, sampling, scale, spatial, spectral, state, temporal, verify
from ..sources import experiments, fields, hdf5, netcdf, nodes, store
from . import verification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def to_cents(df: DataFrame, c: str = "value") -> DataFrame:
    """Eight decimals: sums of cents in millions hold no more, so that a rebuilt value rounds to the one it was."""
    return df.withColumn(c, F.round(c, 8) + 0.0)


def r(x: str, name: str = "value") -> str:
    """The same in DuckDB, where undefined results are NaN."""
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE round({x}, 6) + 0.0 END AS {name}"


# ---- fields in SQL -------------------------------------------------------------------------------------------
F1 = """f1 AS (WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS cell FROM (SELECT DISTINCT event_type FROM events)),
 g AS (SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS t, cell, sum(value) AS value FROM events JOIN k USING (event_type) GROUP BY ALL)
 SELECT a.t::BIGINT AS t, k.cell::BIGINT AS cell, coalesce(g.value, 0) AS value FROM (SELECT unnest(range((SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM events))) AS t) a CROSS JOIN k LEFT JOIN g ON g.t = a.t AND g.cell = k.cell)"""
F2 = """f2 AS (WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS cell FROM (SELECT DISTINCT event_type FROM events)),
 g AS (SELECT (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) * 24 + hour(ts)) // 6 AS t, cell, avg(value) AS value FROM events JOIN k USING (event_type) GROUP BY ALL)
 SELECT a.t::BIGINT AS t, k.cell::BIGINT AS cell, g.value AS value FROM (SELECT unnest(range((SELECT (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1) * 4 FROM events))) AS t) a CROSS JOIN k LEFT JOIN g ON g.t = a.t AND g.cell = k.cell)"""


def _month(table: str) -> str:
    """Months of a table's dates since January of its first year."""
    date = fields.DATES[table]
    return f"(year({date}) - (SELECT min(year({date})) FROM {table})) * 12 + month({date}) - 1"


def _n(f: str, less: int = 0) -> str:
    """The number of times of a field that starts at 0, less some."""
    return f"(SELECT max(t) + 1 - {less} FROM {f})"


def _orders(name: str, cell: str) -> str:
    return f"""{name} AS (WITH g AS (SELECT {_month('orders')} AS t, {cell} AS cell, sum(o_totalprice) / 1e6 AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
 SELECT a.t::BIGINT AS t, k.cell::BIGINT AS cell, coalesce(g.value, 0) AS value FROM (SELECT unnest(range({_n('g')})) AS t) a CROSS JOIN (SELECT DISTINCT cell FROM g) k LEFT JOIN g ON g.t = a.t AND g.cell = k.cell)"""


F3, F4 = _orders("f3", "n_regionkey"), _orders("f4", "n_nationkey")
F5 = f"""f5 AS (WITH g AS (SELECT {_month('lineitem')} AS t, s_nationkey AS cell, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS value
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
 SELECT a.t::BIGINT AS t, k.cell::BIGINT AS cell, coalesce(g.value, 0) AS value FROM (SELECT unnest(range({_n('g')})) AS t) a CROSS JOIN (SELECT DISTINCT cell FROM g) k LEFT JOIN g ON g.t = a.t AND g.cell = k.cell)"""
F6 = "f6 AS (SELECT vec_id AS t, unnest(range(len(embedding)))::BIGINT AS cell, unnest(embedding)::DOUBLE AS value FROM embeddings)"
GRID = "grid AS (SELECT n_nationkey::BIGINT AS cell, (n_nationkey * 5 - 60)::DOUBLE AS lat, ((420 - 15 * n_nationkey) % 360)::DOUBLE AS lon, (1 + n_nationkey % 7)::DOUBLE AS cell_area FROM nation)"
MEMBERS = f"""em AS (SELECT substr(o_orderpriority, 1, 1)::INT AS member, ({_month('orders')})::BIGINT AS t, n_regionkey::BIGINT AS cell, sum(o_totalprice) / 1e6 AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _climo(f: str, year: int = 12) -> str:
    return f"SELECT t, cell, value - avg(value) OVER (PARTITION BY cell, t % {year}) AS value FROM {f}"


def _detrend(f: str) -> str:
    return f"SELECT t, cell, value - (regr_intercept(value, t) OVER (PARTITION BY cell) + regr_slope(value, t) OVER (PARTITION BY cell) * t) AS value FROM {f}"


ANOM = f"{F3}, a AS ({_climo('f3')}), d AS ({_detrend('a')})"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.detrend(temporal.anomaly(temporal.by_cell(fields.orders_region(spark, sf_dir)), 12))


def modes_sql(src: str, k: int, tag: str = "") -> str:
    """Leading modes of a CTE (t, cell, value): for mode q the matrix p (projector), its eigenvalue l and its vector v.

    A Gram matrix squared again and again, divided by its trace, becomes the projector on its first eigenvector, which
    is then taken out. A vector's largest entry is positive. Needs WITH RECURSIVE.
    """
    n = "range(1, len(m) + 1)"
    out = [f"g{tag}0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS row FROM (SELECT a.cell AS i, b.cell AS j, sum(a.value * b.value) AS s FROM {src} a JOIN {src} b USING (t) GROUP BY ALL) GROUP BY i))"]
    for q in range(k):
        g, p, sq, lam = f"g{tag}{q}", f"p{tag}{q}", f"s{tag}{q}", f"l{tag}{q}"
        out += [
            f"{sq}(n, m) AS (SELECT 0, m FROM {g} UNION ALL SELECT n + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / d)) FROM (SELECT n, m, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS d FROM {sq} WHERE n < 45))",
            f"{p} AS (SELECT m FROM {sq} WHERE n = 45)",
            f"{lam} AS (SELECT list_sum(list_transform({n}, lambda i: list_dot_product(m[i], gm[i]))) AS l FROM (SELECT {p}.m AS m, {g}.m AS gm FROM {p}, {g}))",
            f"g{tag}{q + 1} AS (SELECT list_transform({n}, lambda i: list_transform({n}, lambda j: gm[i][j] - l * m[i][j])) AS m FROM (SELECT {p}.m AS m, {g}.m AS gm, l FROM {p}, {g}, {lam}))",
            f"v{tag}{q} AS (SELECT list_transform(m[k], lambda x: x / sqrt(m[k][k])) AS v FROM (SELECT m, list_position(d, list_max(d)) AS k FROM (SELECT m, list_transform({n}, lambda i: m[i][i]) AS d FROM {p})))",
        ]
    return ", ".join(out)


def _rebuilt(src: str, k: int) -> str:
    """CTE rc (t, cell, value): a field rebuilt from k modes of modes_sql."""
    parts = " + ".join(f"list_dot_product(p{q}.m[i], x)" for q in range(k))
    return f"rc AS (SELECT t, cell, {parts} AS value FROM (SELECT t, list(value ORDER BY cell) AS x FROM {src} GROUP BY t), (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM {src})), {', '.join(f'p{q}' for q in range(k))})"


# ---- the flagship --------------------------------------------------------------------------------------------
@query(f"""WITH {ANOM}, p AS (SELECT t, cell, value AS f, lead(value) OVER w AS o FROM d WINDOW w AS (PARTITION BY cell ORDER BY t)),
s AS (SELECT cell, corr(f, o) AS lac, count(*) AS n FROM p WHERE o IS NOT NULL GROUP BY cell)
SELECT cell, {r('lac', 'lac')}, {r('(n + 1) * (1 - lac) / (1 + lac)', 'n_eff')} FROM s""")
def lag1_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly, detrending, lag-1 correlation and effective sample size by region: the diagonal model."""
    d = _anomalies(spark, sf_dir)
    lac = verify.skill(temporal.lag_pair(d, 1).withColumnsRenamed({"x0": "f", "x1": "o"})).select("cell", "lac")
    return rounded(lac.join(verify.n_eff(d.select("t", "cell", F.col("value").alias("f"), F.col("value").alias("o")), two=False), "cell"), "lac", "n_eff")


# ---- sources -------------------------------------------------------------------------------------------------
@query(f"WITH {F6} SELECT cell, count(*)::BIGINT AS n, {r('avg(value)')} FROM f6 GROUP BY cell")
def src_array(spark, sf_dir):
    return rounded(fields.embeddings(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.avg("value").alias("value")), "value")


@query(f"WITH {F1} SELECT t, cell, {r('value')} FROM f1")
def src_events_daily(spark, sf_dir):
    return rounded(fields.events_daily(spark, sf_dir), "value")


@query(f"WITH {F2} SELECT t, cell, {r('value')} FROM f2")
def src_events_6h(spark, sf_dir):
    return rounded(fields.events_6h(spark, sf_dir), "value")


@query(f"WITH {F5} SELECT t, cell, {r('value')} FROM f5")
def src_lineitem(spark, sf_dir):
    return rounded(fields.lineitem_snation(spark, sf_dir), "value")


@query(f"WITH {GRID}, a AS (SELECT s_nationkey::BIGINT AS cell, sum(s_acctbal) AS cell_area FROM supplier GROUP BY ALL) SELECT cell, lat, lon, {r('a.cell_area', 'cell_area')} FROM grid LEFT JOIN a USING (cell)")
def src_cell_area(spark, sf_dir):
    s = fields.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("cell")).agg(F.sum("s_acctbal").alias("cell_area"))
    return rounded(fields.with_cell_area(fields.nation_grid(spark, sf_dir), s), "cell_area")


@query(f"WITH {F3}, m AS (SELECT DISTINCT t, t - 30 AS k FROM f3) SELECT t, (floor(k / 12.0) + 1)::BIGINT AS year, (((k % 12) + 12) % 12 + 1)::BIGINT AS month, 1 AS day FROM m")
def time_yearzero(spark, sf_dir):
    """Months counted from January of year 1, also before it: years below 1 stay integers."""
    year, month = fields.months_since(F.col("t") - 30, 1)
    return fields.orders_region(spark, sf_dir).select("t").distinct().select("t", year.alias("year"), month.alias("month"), F.lit(1).alias("day"))


@query(f"WITH {MEMBERS} SELECT t, cell, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')} FROM em GROUP BY t, cell")
def ens_stats_file(spark, sf_dir):
    return rounded(ensemble.member_stats(fields.orders_members(spark, sf_dir)), "mean", "std")


_STAMPS = "SELECT DISTINCT o_orderdate::DATE AS d FROM orders"


def _cf(calendar_: str, n: str) -> str:
    """Year, month and day of a day number since 0001-01-01 in DuckDB, by other arithmetic than the library's."""
    if calendar_ == "standard":
        d = f"(DATE '0001-01-01' + ({n})::INT)"
        return f"year({d})::BIGINT AS year, month({d})::BIGINT AS month, day({d})::BIGINT AS day"
    if calendar_ == "360_day":
        return f"(({n}) // 360 + 1)::BIGINT AS year, (({n}) % 360 // 30 + 1)::BIGINT AS month, (({n}) % 30 + 1)::BIGINT AS day"
    at = f"(({n}) % 365)"
    ends = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"
    k = f"len(list_filter({ends}, lambda b: b <= {at}))"
    return f"(({n}) // 365 + 1)::BIGINT AS year, {k}::BIGINT AS month, ({at} - {ends}[{k}] + 1)::BIGINT AS day"


@query(f"WITH n AS (SELECT date_diff('day', DATE '0001-01-01', d) AS n FROM ({_STAMPS})) " + " UNION ALL ".join(f"SELECT '{c}' AS calendar, n * 24.0::DOUBLE + 6 AS number, {_cf(c, 'n')}, 21600::BIGINT AS second FROM n" for c in ("standard", "noleap", "360_day")))
def time_cf(spark, sf_dir):
    """Hours since year 1 in three calendars, from the dates of the orders."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("0001-01-01").cast("date"))
    n = fields.table(spark, sf_dir, "orders").select((days * 24 + 6).cast("double").alias("number")).distinct()
    parts = []
    for c in ("standard", "noleap", "360_day"):
        year, month, day, second = calendar.decode(F.col("number"), "hours since 0001-01-01 00:00:00", c)
        parts.append(n.select(F.lit(c).alias("calendar"), "number", year.cast("long").alias("year"), month.cast("long").alias("month"), day.cast("long").alias("day"), second.cast("long").alias("second")))
    return parts[0].union(parts[1]).union(parts[2])


def _variables(spark, sf_dir) -> dict[str, experiments.Variable]:
    """Two variables with coordinates; times are days since their first year in a calendar of 360 days, one row is a fill value."""
    out = {}
    for name, field, table in (("orders", fields.orders_nation(spark, sf_dir), "orders"), ("revenue", fields.lineitem_snation(spark, sf_dir), "lineitem")):
        year = fields.span(spark, sf_dir, table)[0]
        placed = field.join(fields.nation_grid(spark, sf_dir), "cell")
        value = F.when((F.col("t") == 3) & (F.col("cell") == 4), 1e20).otherwise(F.col("value"))
        out[name] = experiments.Variable(placed.select((F.col("t") * 30).alias("time"), "lat", "lon", value.alias("value")), f"days since {year}-01-01", "360_day", year, 1e20)
    return out


_LOADED = " UNION ALL ".join(f"SELECT '{n}' AS var, t, dense_rank() OVER (ORDER BY lat, lon) - 1 AS cell, lat, lon, CASE WHEN t = 3 AND cell = 4 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM {f} JOIN grid USING (cell)" for n, f in (("orders", "f4"), ("revenue", "f5")))


def _with_places(loaded: dict) -> DataFrame:
    parts = [f.join(g, "cell").select(F.lit(n).alias("var"), "t", "cell", "lat", "lon", "value") for n, (f, g) in loaded.items()]
    return rounded(parts[0].union(parts[1]), "value")


@query(f"WITH {F4}, {F5}, {GRID} {_LOADED}")
def exp_load(spark, sf_dir):
    """Variables of an experiment with their coordinates, decoded times and fill values."""
    return _with_places(experiments.load_all(_variables(spark, sf_dir)))


@query(f"WITH {F4}, {F5}, {GRID} {_LOADED}")
def conv_fields(spark, sf_dir):
    """The same, converted to a folder once and read back."""
    folder = f"{store.shared_dir(spark)}/experiment-{uuid.uuid4().hex}"
    experiments.convert(_variables(spark, sf_dir), folder)
    return _with_places(experiments.reload(spark, folder, ["orders", "revenue"]))


def _as_files(kind, variables: dict[str, experiments.Variable], spark) -> dict[str, experiments.Variable]:
    """The variables written as files of two years each, to be read from there. kind: ``netcdf`` or ``hdf5``."""
    folder, out = f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}", {}
    for name, v in variables.items():
        paths = kind.write(v.rows, folder, name, v.units, v.calendar, 24, v.fill)
        out[name] = kind.variable(spark, paths, name, v.base_year)
    return out


def _file_rows(variables: dict[str, experiments.Variable]) -> DataFrame:
    parts = [v.rows.select(F.lit(n).alias("var"), "time", "lat", "lon", "value") for n, v in variables.items()]
    return rounded(parts[0].union(parts[1]), "value")


def _by_two_years(kind, spark, sf_dir) -> DataFrame:
    """Means of a variable by two years, a few records of a file to each task; each mean reads only its own times' bytes."""
    folder = f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    placed = fields.lineitem_snation(spark, sf_dir).join(fields.nation_grid(spark, sf_dir), "cell").select((F.col("t") * 30).alias("time"), "lat", "lon", "value")
    paths = kind.write(placed, folder, "revenue", "days since 0001-01-01", "360_day", 40)
    n = -(-fields.months(spark, sf_dir, "lineitem") // 24)
    parts = [kind.read(spark, paths, "revenue", 720 * k, 720 * k + 719, 2000).groupBy("lat", "lon").agg(F.count("value").alias("n"), F.avg("value").alias("value")).withColumn("years", F.lit(k).cast("long")) for k in range(n)]
    return rounded(reduce(DataFrame.union, parts), "value")


_FILE_ROWS = f"WITH {F4}, {F5}, {GRID} " + " UNION ALL ".join(f"SELECT '{n}' AS var, t * 30.0::DOUBLE AS time, lat, lon, CASE WHEN t = 3 AND cell = 4 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM {f} JOIN grid USING (cell)" for n, f in (("orders", "f4"), ("revenue", "f5")))
_TWO_YEARS = f"WITH {F5}, {GRID} SELECT t // 24 AS years, lat, lon, count(*)::BIGINT AS n, {r('avg(value)')} FROM f5 JOIN grid USING (cell) GROUP BY ALL"


@query(_FILE_ROWS)
def src_netcdf(spark, sf_dir):
    """Rows of NetCDF files as they are: numbers of days, places and values without the fill value."""
    return _file_rows(_as_files(netcdf, _variables(spark, sf_dir), spark))


@query(_TWO_YEARS)
def src_netcdf_ooc(spark, sf_dir):
    return _by_two_years(netcdf, spark, sf_dir)


@query(_FILE_ROWS)
def src_hdf5(spark, sf_dir):
    """The same from chunked HDF5 files."""
    return _file_rows(_as_files(hdf5, _variables(spark, sf_dir), spark))


@query(_TWO_YEARS)
def src_hdf5_ooc(spark, sf_dir):
    return _by_two_years(hdf5, spark, sf_dir)


@query(f"WITH {F4}, {F5}, {GRID} {_LOADED}")
def conv_netcdf(spark, sf_dir):
    """Written as NetCDF, loaded from there, converted to a folder of Parquet once and read back."""
    folder = f"{store.shared_dir(spark)}/experiment-{uuid.uuid4().hex}"
    experiments.convert(_as_files(netcdf, _variables(spark, sf_dir), spark), folder)
    return _with_places(experiments.reload(spark, folder, ["orders", "revenue"]))


@query(f"WITH {F4}, {F5}, {GRID} {_LOADED}")
def conv_netcdf_hdf5(spark, sf_dir):
    """NetCDF files converted to HDF5 files, and loaded from those."""
    filled = {n: replace(v, rows=v.rows.select("time", "lat", "lon", "value"), fill=1e20) for n, v in _as_files(netcdf, _variables(spark, sf_dir), spark).items()}
    return _with_places(experiments.load_all(_as_files(hdf5, filled, spark)))


@query(f"WITH {F4} SELECT t, cell, {r('value')}, 'anomaly,detrended' AS ops FROM f4")
def field_saved(spark, sf_dir):
    """A field with its history, written in a folder for each cell and read back."""
    path = f"{store.shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    fields.save_field(fields.orders_nation(spark, sf_dir), path, fields.nation_grid(spark, sf_dir), ("anomaly", "detrended"), by="cell")
    f, ops = fields.load_field(spark, path)
    return rounded(f.select("t", F.col("cell").cast("long").alias("cell"), "value", F.lit(",".join(ops)).alias("ops")), "value")


@query(f"WITH {F4}, a AS ({_climo('f4')}) SELECT t, cell, {r('value')} FROM a")
def sink_carray(spark, sf_dir):
    """A node that is overwritten by anomalies of what it holds, read while it is replaced."""
    group = nodes.Group(spark, f"{store.shared_dir(spark)}/nodes-{uuid.uuid4().hex}")
    field = group.write("orders", fields.orders_nation(spark, sf_dir))
    out = group.write("orders", temporal.anomaly(field, 12))
    group.clean("orders")
    return rounded(out.select("t", "cell", "value"), "value")


@query(f"WITH {F3}, {F5} SELECT 'lim/run' AS grp, 'orders' AS node, count(*)::BIGINT AS n, {r('sum(value)', 'total')} FROM f3 UNION ALL SELECT 'lim/run', 'revenue', count(*), {r('sum(value)', 'total')} FROM f5 UNION ALL SELECT 'lim', 'empty', 0, NULL")
def sink_group(spark, sf_dir):
    """Nodes in groups of groups, one of which takes the place of a node, as they are found again."""
    top = nodes.Group(spark, f"{store.shared_dir(spark)}/nodes-{uuid.uuid4().hex}")
    lim_ = top.group("lim")
    lim_.write("run", fields.orders_region(spark, sf_dir))
    lim_.empty("empty", "t long, cell long, value double")
    run = lim_.group("run")
    run.write("orders", fields.orders_region(spark, sf_dir))
    run.write("revenue", fields.lineitem_snation(spark, sf_dir))
    parts = [g.read(n).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(name).alias("grp"), F.lit(n).alias("node"), "n", "total") for name, g in (("lim/run", run), ("lim", lim_)) for n in g.nodes()]
    return rounded(reduce(DataFrame.union, parts), "total")


@query(f"WITH {F6} SELECT cell, (cell * 2 - 60)::DOUBLE AS lat, (cell * 5)::DOUBLE AS lon, count(*)::BIGINT AS n, {r('avg(value)')} FROM f6 GROUP BY cell")
def src_posterior_ncf(spark, sf_dir):
    """Stations: one array of values a time, and arrays of each station's coordinates."""
    e = fields.table(spark, sf_dir, "embeddings").withColumn("lat", F.transform("embedding", lambda _, i: i * 2 - 60)).withColumn("lon", F.transform("embedding", lambda _, i: i * 5))
    f, grid = experiments.flat_arrays(e, "vec_id", "embedding", "lat", "lon")
    return rounded(f.groupBy("cell").agg(F.count("value").alias("n"), F.avg("value").alias("value")).join(grid, "cell").select("cell", "lat", "lon", "n", "value"), "value")


@query(f"WITH {F6} SELECT cell, (cell // 8 * 10 - 35)::DOUBLE AS lat, (cell % 8 * 45)::DOUBLE AS lon, count(*)::BIGINT AS n, {r('avg(value)')} FROM f6 GROUP BY cell")
def src_posterior_npz(spark, sf_dir):
    """A grid of 8 by 8: one array of values a time, latitudes and longitudes once."""
    f, grid = experiments.gridded_arrays(fields.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [10 * k - 35 for k in range(8)], [45 * k for k in range(8)])
    return rounded(f.groupBy("cell").agg(F.count("value").alias("n"), F.avg("value").alias("value")).join(grid, "cell").select("cell", "lat", "lon", "n", "value"), "value")


# ---- masks and grids -----------------------------------------------------------------------------------------
#: F5 with holes: cells 3, 10 and 17 miss one time each, as NaN, infinity and a fill value.
HOLES = f"{F5}, h AS (SELECT t, cell, CASE WHEN cell = 3 AND t = 5 THEN 'nan'::DOUBLE WHEN cell = 10 AND t = 0 THEN 'inf'::DOUBLE WHEN cell = 17 AND t = 71 THEN -999 ELSE value END AS value FROM f5), ok AS (SELECT cell, bool_and(isfinite(value) AND value <> -999) AS valid FROM h GROUP BY cell)"


def _holes(spark, sf_dir):
    v = F.when((F.col("cell") == 3) & (F.col("t") == 5), float("nan")).when((F.col("cell") == 10) & (F.col("t") == 0), float("inf")).when((F.col("cell") == 17) & (F.col("t") == 71), -999.0).otherwise(F.col("value"))
    return fields.lineitem_snation(spark, sf_dir).withColumn("value", v)


@query(f"WITH {HOLES} SELECT * FROM ok")
def mask_valid(spark, sf_dir):
    return spatial.valid_cells(_holes(spark, sf_dir), -999.0)


@query(f"WITH {F2} SELECT cell, bool_or(t % 50 = 7 * cell) AS masked FROM f2 GROUP BY cell")
def mask_composite(spark, sf_dir):
    return spatial.composite_mask(fields.events_6h(spark, sf_dir).select("t", "cell", (F.col("t") % 50 == 7 * F.col("cell")).alias("masked")))


@query(f"WITH {F4}, {GRID} SELECT t, cell, {r('value')} FROM f4 WHERE cell IN (SELECT cell FROM grid WHERE cell_area >= 4)")
def mask_apply(spark, sf_dir):
    return rounded(spatial.apply_mask(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir).where("cell_area >= 4")), "value")


@query(f"WITH {HOLES} SELECT t, cell, {r('value')} FROM h WHERE cell IN (SELECT cell FROM ok WHERE valid)")
def compress(spark, sf_dir):
    return rounded(spatial.compress(_holes(spark, sf_dir), -999.0), "value")


@query(f"WITH {F4} SELECT t, ((cell // 5) * 5 + cell % 5)::BIGINT AS flat, {r('value')} FROM f4")
def flatten(spark, sf_dir):
    return rounded(fields.orders_nation(spark, sf_dir).select("t", spatial.flat_cell(F.floor(F.col("cell") / 5), F.col("cell") % 5, 5).alias("flat"), "value"), "value")


@query(f"WITH {HOLES}, {GRID}, c AS (SELECT * FROM h WHERE cell IN (SELECT cell FROM ok WHERE valid)) SELECT a.t, grid.cell, {r('c.value')} FROM (SELECT DISTINCT t FROM c) a CROSS JOIN grid LEFT JOIN c ON c.t = a.t AND c.cell = grid.cell")
def inflate(spark, sf_dir):
    return rounded(spatial.inflate(spatial.compress(_holes(spark, sf_dir), -999.0), fields.nation_grid(spark, sf_dir)), "value")


@query(f"WITH {HOLES}, {GRID} SELECT cell, lat, lon FROM grid WHERE cell IN (SELECT cell FROM ok WHERE valid)")
def coord_grid(spark, sf_dir):
    return spatial.coordinate_grid(fields.nation_grid(spark, sf_dir), ["lat", "lon"], spatial.valid_cells(_holes(spark, sf_dir), -999.0).where("valid"))


@query(f"WITH {GRID} SELECT row_number() OVER (ORDER BY coord) - 1 AS index, coord FROM (SELECT DISTINCT lon AS coord FROM grid)")
def dim_coords(spark, sf_dir):
    return spatial.dim_coords(fields.nation_grid(spark, sf_dir), "lon")


@query(f"WITH {F3} SELECT t - 12 AS t, cell, {r('value')} FROM f3 WHERE t >= 12 AND t < 36")
def subset_time(spark, sf_dir):
    return rounded(spatial.subset_time(fields.orders_region(spark, sf_dir), 12, 36), "value")


@query(f"WITH {F3}, n AS (SELECT max(t) + 1 AS n FROM f3), w AS (SELECT unnest([n - 1, 0, 17, 17, 5]) AS t, unnest([0, 1, 2, 3, 4]) AS place FROM n) SELECT place::BIGINT AS t, cell, {r('value')} FROM f3 JOIN w USING (t)")
def subset_list(spark, sf_dir):
    """Samples of a list: the last one, the first, one twice."""
    return rounded(spatial.subset_times(fields.orders_region(spark, sf_dir), [fields.months(spark, sf_dir) - 1, 0, 17, 17, 5]), "value")


@query(f"WITH {GRID} SELECT cell, 'enso' AS box FROM grid WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 240 AND 290 UNION ALL SELECT cell, 'pdo' FROM grid WHERE lat BETWEEN 20 AND 70 AND lon BETWEEN 110 AND 250")
def box_filter(spark, sf_dir):
    g = fields.nation_grid(spark, sf_dir)
    return spatial.box(g, spatial.ENSO_BOX).select("cell", F.lit("enso").alias("box")).union(spatial.box(g, spatial.PDO_BOX).select("cell", F.lit("pdo")))


@query(f"WITH {F4}, {GRID} SELECT t, cell, {r('CASE WHEN cell_area > 5 THEN 0 ELSE value END')} FROM f4 JOIN grid USING (cell)")
def landsea_mask(spark, sf_dir):
    return rounded(spatial.landsea_fill(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir).where("cell_area > 5")), "value")


@query(f"""WITH {GRID}, x AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS i, lon AS x, count(*) OVER () AS n FROM grid),
r0 AS (SELECT *, lead(x) OVER w - x AS raw FROM x WINDOW w AS (ORDER BY i)),
d0 AS (SELECT *, CASE WHEN raw > 300 THEN lead(raw) OVER w WHEN raw < -300 THEN lag(raw) OVER w ELSE raw END AS d FROM r0 WINDOW w AS (ORDER BY i)),
b AS (SELECT *, lag(d) OVER (ORDER BY i) AS p FROM d0)
SELECT i, x - d / 2 AS edge FROM b WHERE i < n - 1 UNION ALL SELECT i + 1, x + p / 2 FROM b WHERE i >= n - 2""")
def latlon_bounds(spark, sf_dir):
    g = fields.nation_grid(spark, sf_dir)
    return spatial.bounds(g.select(F.col("cell").alias("i"), F.col("lon").alias("x")))


#: The nations as a lattice of five by five, whose longitudes cross the date line.
LATTICE = "lt AS (SELECT n_nationkey // 5 AS i, n_nationkey % 5 AS j, (n_nationkey // 5 * 31 - 60 + n_nationkey % 5 * 0.5)::DOUBLE AS lat, ((335 + n_nationkey % 5 * 11 + n_nationkey // 5 * 3) % 360)::DOUBLE AS lon FROM nation)"


def _lines(line: str, along: str, x: str, clamp: str) -> str:
    """Edges (line, i, edge) of every line of the lattice."""
    return f"""(SELECT line, CASE WHEN k = 0 THEN i ELSE i + 1 END AS i, CASE WHEN k = 0 THEN x - d / 2 ELSE x + p / 2 END AS edge FROM (SELECT *, lag(d) OVER w AS p FROM (SELECT *, {clamp.format(d='CASE WHEN raw > 300 THEN lead(raw) OVER w WHEN raw < -300 THEN lag(raw) OVER w ELSE raw END')} AS d
 FROM (SELECT {line} AS line, {along} AS i, {x} AS x, lead({x}) OVER w - {x} AS raw FROM lt WINDOW w AS (PARTITION BY {line} ORDER BY {along})) WINDOW w AS (PARTITION BY line ORDER BY i)) WINDOW w AS (PARTITION BY line ORDER BY i)), (SELECT unnest([0, 1]) AS k) WHERE (k = 0 AND i < 4) OR (k = 1 AND i >= 3))"""


@query(f"WITH {LATTICE}, la AS {_lines('j', 'i', 'lat', 'greatest(least({d}, 90), -90)')}, lo AS {_lines('i', 'j', 'lon', '{d}')} SELECT la.i::BIGINT AS i, lo.i::BIGINT AS j, la.edge AS lat_edge, lo.edge AS lon_edge FROM (SELECT line AS j, i, edge FROM la UNION ALL SELECT 5, i, edge FROM la WHERE line = 4) la JOIN (SELECT line, i, edge FROM lo UNION ALL SELECT 5, i, edge FROM lo WHERE line = 4) lo ON la.i = lo.line AND la.j = lo.i")
def latlon_bounds_2d(spark, sf_dir):
    """Edges of a lattice with coordinates of its own at every place."""
    k = F.col("n_nationkey")
    i, j = F.floor(k / 5), k % 5
    return spatial.bounds_2d(fields.table(spark, sf_dir, "nation").select(i.alias("i"), j.cast("long").alias("j"), (i * 31 - 60 + j * 0.5).alias("lat"), ((335 + j * 11 + i * 3) % 360).cast("double").alias("lon")))


@query(f"WITH {F4} SELECT t, cell // 5 AS cell, {r('avg(value)')} FROM f4 GROUP BY ALL")
def regrid(spark, sf_dir):
    w = fields.nation_grid(spark, sf_dir).select("cell", F.floor(F.col("cell") / 5).alias("new_cell"), F.lit(0.2).alias("w"))
    return rounded(spatial.regrid(fields.orders_nation(spark, sf_dir), w), "value")


#: The embeddings as a field on 8 latitudes by 8 longitudes of a globe, in real harmonics to degree 3, and places to put it on.
TOP, NEW_LATS, NEW_LONS = 3, tuple(75.0 - 30 * k for k in range(6)), tuple(10.0 + 30 * k for k in range(12))
_HARMONICS = {(0, 0): "sqrt(1 / (4 * pi()))", (1, 0): "sqrt(3 / (4 * pi())) * x", (1, 1): "sqrt(3 / (8 * pi())) * s", (2, 0): "sqrt(5 / (16 * pi())) * (3 * x * x - 1)", (2, 1): "sqrt(15 / (8 * pi())) * x * s", (2, 2): "sqrt(15 / (32 * pi())) * s * s",
 (3, 0): "sqrt(7 / (16 * pi())) * (5 * x * x * x - 3 * x)", (3, 1): "sqrt(21 / (64 * pi())) * s * (5 * x * x - 1)", (3, 2): "sqrt(105 / (32 * pi())) * x * s * s", (3, 3): "sqrt(35 / (64 * pi())) * s * s * s"}


def _basis(places: str) -> str:
    """Rows (cell, n, m, c, e): cosine and sine parts of the harmonics at places (cell, lat, lon)."""
    at = f"(SELECT cell, sin(radians(lat)) AS x, cos(radians(lat)) AS s, radians(lon) AS o FROM {places})"
    return " UNION ALL ".join(f"SELECT cell, {n} AS n, {m} AS m, {p} * cos({m} * o) AS c, -({p}) * sin({m} * o) AS e FROM {at}" for (n, m), p in _HARMONICS.items())


#: Weights of the mid-points of equal steps in colatitude: Fejer's rule.
GLOBE = f"""{F6}, old AS (SELECT range AS cell, 78.75 - 22.5 * (range // 8) AS lat, 45.0 * (range % 8) AS lon FROM range(64)), wl AS (SELECT i, (2.0 / 8) * (1 - 2 * sum(cos(2 * k * (i + 0.5) * pi() / 8) / (4 * k * k - 1))) AS w FROM (SELECT range AS i FROM range(8)), (SELECT range + 1 AS k FROM range(4)) GROUP BY i),
ob AS ({_basis('old')}), ce AS (SELECT t, n, m, sum(value * c * w * 2 * pi() / 8) AS re, sum(value * e * w * 2 * pi() / 8) AS im FROM f6 JOIN ob USING (cell) JOIN wl ON wl.i = cell // 8 GROUP BY t, n, m)"""


def _globe(spark, sf_dir):
    at = [(k, 78.75 - 22.5 * (k // 8), 45.0 * (k % 8)) for k in range(64)]
    return fields.embeddings(spark, sf_dir), spark.createDataFrame(at, "cell long, lat double, lon double")


@query(f"WITH {GLOBE}, nw AS (SELECT range AS cell, 75.0 - 30 * (range // 12) AS lat, 10.0 + 30 * (range % 12) AS lon FROM range(72)), nb AS ({_basis('nw')}) SELECT t, nb.cell, {r('sum(CASE WHEN nb.m > 0 THEN 2 ELSE 1 END * (re * c + im * e))')} FROM ce JOIN nb USING (n, m) GROUP BY t, nb.cell")
def regrid_spectral(spark, sf_dir):
    """Truncated at degree 3 and put on another grid."""
    return rounded(spectral.regrid(*_globe(spark, sf_dir), NEW_LATS, NEW_LONS, TOP), "value")


@query(f"WITH {GLOBE} SELECT t, n, m, {r('re', 're')}, {r('im', 'im')} FROM ce")
def spectral_analysis(spark, sf_dir):
    return rounded(spectral.analyse(*_globe(spark, sf_dir), TOP), "re", "im")


@query(f"WITH {GLOBE} SELECT t, ob.cell, {r('sum(CASE WHEN ob.m > 0 THEN 2 ELSE 1 END * (re * c + im * e))')} FROM ce JOIN ob USING (n, m) WHERE n > 0 GROUP BY t, ob.cell")
def spectral_synthesis(spark, sf_dir):
    """Back on the same grid without the global mean."""
    c = spectral.analyse(*_globe(spark, sf_dir), TOP).where("n > 0")
    return rounded(spectral.synthesise(c, [78.75 - 22.5 * k for k in range(8)], [45.0 * k for k in range(8)]), "value")


@query(f"WITH {GLOBE} SELECT n, {r('avg(p)', 'power')} FROM (SELECT t, n, sum(CASE WHEN m > 0 THEN 2 ELSE 1 END * (re * re + im * im)) AS p FROM ce GROUP BY t, n) GROUP BY n")
def spectral_power(spark, sf_dir):
    return rounded(spectral.power(spectral.analyse(*_globe(spark, sf_dir), TOP)), "power")


# ---- time ----------------------------------------------------------------------------------------------------
def _resample(f: str, shift: int, tag: str = "") -> str:
    return f"SELECT {tag}((t - {shift}) // 12)::BIGINT AS block, cell, min(t) AS first_t, {r('avg(value)')} FROM {f} WHERE t >= {shift} AND t < {shift} + 12 * (({_n(f)} - {shift}) // 12) GROUP BY ALL"


@query(f"WITH {F3} {_resample('f3', 4)}")
def resample_avg(spark, sf_dir):
    return rounded(temporal.resample_avg(fields.orders_region(spark, sf_dir), 12, fields.months(spark, sf_dir), 4), "value")


@query(f"WITH {F3} " + " UNION ALL ".join(_resample("f3", s, f"'{n}' AS name, ") for n, s in temporal.SHIFTS.items()) + f" UNION ALL SELECT 'none', t, cell, t, {r('value')} FROM f3")
def resample_named(spark, sf_dir):
    f, months = fields.orders_region(spark, sf_dir), fields.months(spark, sf_dir)
    parts = [temporal.resample_named(f, n, months).select(F.lit(n).alias("name"), "block", "cell", "first_t", "value") for n in (*temporal.SHIFTS, "none")]
    return rounded(reduce(DataFrame.union, parts), "value")


def _mirror(half: int) -> str:
    return f"m AS (SELECT t, cell, value FROM f3 UNION ALL SELECT -1 - t, cell, value FROM f3 WHERE t < {half} UNION ALL SELECT 2 * {_n('f3')} - 1 - t, cell, value FROM f3 WHERE t >= {_n('f3', half)})"


def _mean(f: str, before: int, after: int) -> str:
    return f"SELECT t, cell, avg(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS v FROM {f}"


@query(f"WITH {F3}, {_mirror(2)}, w AS ({_mean('m', 2, 2)}) SELECT t, cell, {r('v')} FROM w WHERE t BETWEEN 0 AND {_n('f3', 1)}")
def run_mean(spark, sf_dir):
    return rounded(temporal.run_mean(fields.orders_region(spark, sf_dir), 5, fields.months(spark, sf_dir)), "value")


@query(f"WITH {F3}, {_mirror(2)}, w AS ({_mean('m', 1, 2)}) SELECT t, cell, {r('v')} FROM w WHERE t BETWEEN 0 AND {_n('f3', 1)}")
def run_mean_even(spark, sf_dir):
    return rounded(temporal.run_mean(fields.orders_region(spark, sf_dir), 4, fields.months(spark, sf_dir)), "value")


@query(f"WITH {F3}, w AS ({_mean('f3', 5, 6)}) SELECT t, cell, {r('v')} FROM w WHERE t BETWEEN 12 AND {_n('f3', 13)}")
def run_mean_trim(spark, sf_dir):
    return rounded(temporal.run_mean_trim(fields.orders_region(spark, sf_dir), 12, fields.months(spark, sf_dir), 12), "value")


@query(f"WITH {F3}, a AS ({_climo('f3')}) SELECT t, cell, {r('value')} FROM a")
def anomaly(spark, sf_dir):
    return rounded(temporal.anomaly(fields.orders_region(spark, sf_dir), 12), "value")


@query(f"WITH {F3} SELECT cell, t % 12 AS phase, {r('avg(value)', 'climo')} FROM f3 GROUP BY ALL")
def climatology(spark, sf_dir):
    return rounded(temporal.climatology(fields.orders_region(spark, sf_dir), 12), "climo")


@query(f"WITH {F3}, c AS (SELECT cell, t % 12 AS phase, avg(value) AS climo FROM f3 WHERE t < 36 GROUP BY ALL) SELECT t, f3.cell, {r('value - climo')} FROM f3 JOIN c ON f3.cell = c.cell AND t % 12 = phase WHERE t >= 36")
def anomaly_given(spark, sf_dir):
    """Anomalies of the second half from the first half's climatology."""
    f = fields.orders_region(spark, sf_dir)
    return rounded(temporal.anomaly(f.where("t >= 36"), 12, temporal.climatology(f.where("t < 36"), 12)), "value")


@query(f"WITH {F3}, d AS ({_detrend('f3')}) SELECT t, cell, {r('value')} FROM d")
def detrend(spark, sf_dir):
    return rounded(temporal.detrend(fields.orders_region(spark, sf_dir)), "value")


@query(f"WITH {F3}, p AS (SELECT t, cell, value AS x0, lead(value, 3) OVER (PARTITION BY cell ORDER BY t) AS x1 FROM f3) SELECT t, cell, {r('x0', 'x0')}, {r('x1', 'x1')} FROM p WHERE t < {_n('f3', 3)}")
def lag_pair(spark, sf_dir):
    return rounded(temporal.lag_pair(fields.orders_region(spark, sf_dir), 3), "x0", "x1")


CE = "1 - sum((o - f) * (o - f)) / (var_pop(o) * count(o))"
PAIRS = f"{ANOM}, p AS (SELECT t, cell, value AS f, lead(value, 12) OVER (PARTITION BY cell ORDER BY t) AS o FROM d), q AS (SELECT * FROM p WHERE t < {_n('f3', 12)})"


@query(f"WITH {PAIRS} SELECT cell, {r('corr(f, o)', 'r')}, {r(CE, 'ce')} FROM q GROUP BY cell")
def persist_fcast(spark, sf_dir):
    return rounded(temporal.persistence(_anomalies(spark, sf_dir), 12), "r", "ce")


@query(f"WITH {F3} SELECT DISTINCT t, ((SELECT min(year(o_orderdate)) FROM orders) + t // 12)::BIGINT AS year FROM f3 WHERE t >= 12")
def years_of(spark, sf_dir):
    return temporal.years_of(fields.orders_region(spark, sf_dir), fields.span(spark, sf_dir, "orders")[0], 12)


# ---- weights and scales --------------------------------------------------------------------------------------
@query(f"WITH {F4}, {GRID} SELECT t, cell, {r('value * sqrt(abs(cos(radians(lat))))')} FROM f4 JOIN grid USING (cell)")
def area_weight_lat(spark, sf_dir):
    return rounded(spatial.area_weight_lat(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir)), "value")


@query(f"WITH {F4}, {GRID} SELECT t, cell, {r('value * sqrt(cell_area / (SELECT sum(cell_area) FROM grid))')} FROM f4 JOIN grid USING (cell)")
def area_weight_cell(spark, sf_dir):
    return rounded(spatial.area_weight_cell(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir)), "value")


@query(f"WITH {F4}, {GRID} SELECT t, cell, {r('value * sqrt(cos(radians(lat)))')} FROM f4 JOIN grid USING (cell)")
def area_wgt_old(spark, sf_dir):
    return rounded(spatial.area_weight_old(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir)), "value")


FACTOR = "k AS (SELECT 1 / sqrt(sum(v)) AS factor FROM (SELECT var_samp(value) AS v FROM f3 GROUP BY cell))"


@query(f"WITH {F3}, {FACTOR} SELECT t, cell, {r('value * factor')} FROM f3 CROSS JOIN k")
def standardize_field(spark, sf_dir):
    return rounded(scale.standardize_field(fields.orders_region(spark, sf_dir)), "value")


@query(f"WITH {F3}, {FACTOR} SELECT t, cell, {r('(value + 1) / factor')} FROM f3 CROSS JOIN k")
def unstandardize(spark, sf_dir):
    f = fields.orders_region(spark, sf_dir)
    return rounded(scale.unstandardize(f.withColumn("value", F.col("value") + 1), scale.field_factor(f)), "value")


@query(f"WITH {F1}, z AS (SELECT t, cell, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS v FROM f1 WINDOW w AS (PARTITION BY cell)) SELECT t, cell, {r('v')} FROM z")
def standardize_series(spark, sf_dir):
    return rounded(scale.standardize_series(fields.events_daily(spark, sf_dir)), "value")


PREP = f"{F4}, {GRID}, a AS ({_climo('f4')}), d AS ({_detrend('a')}), w AS (SELECT t, cell, value * sqrt(abs(cos(radians(lat)))) AS value FROM d JOIN grid USING (cell))"


def _prepared(spark, sf_dir):
    return scale.prepare(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir))[0]


@query(f"WITH {PREP} SELECT t, cell, {r('value')} FROM w")
def prep_chain(spark, sf_dir):
    return rounded(_prepared(spark, sf_dir), "value")


@query(f"WITH {PREP} SELECT 'anomaly' AS stage, t, cell, {r('value')} FROM a UNION ALL SELECT 'detrended', t, cell, {r('value')} FROM d")
def reset_key(spark, sf_dir):
    """Stages of a prepared field, gone back to by name."""
    stages = scale.prepare_stages(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir))
    parts = [stages.reset(n).select(F.lit(n).alias("stage"), "t", "cell", "value") for n in ("anomaly", "detrended")]
    return rounded(parts[0].union(parts[1]), "value")


# ---- linear algebra ------------------------------------------------------------------------------------------
@query(f"WITH {PREP} SELECT a.cell AS i, b.cell AS j, {r('sum(a.value * b.value)', 's')} FROM w a JOIN w b USING (t) GROUP BY ALL")
def gram(spark, sf_dir):
    return rounded(linalg.gram(_prepared(spark, sf_dir)), "s")


@query(f"WITH {PREP} SELECT b.cell AS i, a.cell AS j, {r('sum(a.value * b.value)', 's')} FROM w a JOIN w b ON b.t = a.t + 1 GROUP BY ALL")
def lag_cov(spark, sf_dir):
    return rounded(linalg.lag_covariance(_prepared(spark, sf_dir), 1), "s")


@query(f"WITH {PREP} SELECT t, cell, {r('value')} FROM w")
def eof(spark, sf_dir):
    """All modes rebuild the field, whatever their signs and order."""
    w = _prepared(spark, sf_dir)
    loadings, _ = linalg.eof(w, 25)
    return rounded(linalg.reconstruct(linalg.project(w, loadings), loadings), "value")


@query(f"WITH {PREP} SELECT count(DISTINCT cell)::BIGINT AS modes, {r('sum(value * value)', 'sum_sq')}, {r('sum(value * value) / ' + _n('f4'), 'eigvals')}, 25.0::DOUBLE AS basis_sq FROM w")
def eof_stats(spark, sf_dir):
    """Squared singular values add up to the squares of the field; loadings have norm 1."""
    loadings, stats = linalg.eof(_prepared(spark, sf_dir), 25)
    out = stats.agg(F.count("*").alias("modes"), F.sum(F.pow("sval", 2)).alias("sum_sq"), F.sum("eigval").alias("eigvals"))
    return rounded(out.join(F.broadcast(loadings.agg(F.sum(F.pow("loading", 2)).alias("basis_sq")))), "sum_sq", "eigvals", "basis_sq")


@query(f"WITH RECURSIVE {PREP}, {modes_sql('w', 3)}, x AS (SELECT t, list(value ORDER BY cell) AS x FROM d GROUP BY t) " + " UNION ALL ".join(f"SELECT t, {q} AS mode, {r('list_dot_product(x, v)')} FROM x, v{q}" for q in range(3)))
def eof_project(spark, sf_dir):
    """The weighted field's leading modes applied to the unweighted one."""
    f = temporal.detrend(temporal.anomaly(fields.orders_nation(spark, sf_dir), 12))
    return rounded(linalg.project_checked(f, linalg.eof(_prepared(spark, sf_dir), 3)[0]), "value")


def _prep_of(f: str, n: str) -> str:
    return f"a{n} AS ({_climo(f)}), d{n} AS ({_detrend(f'a{n}')}), w{n} AS (SELECT t, cell, value * sqrt(abs(cos(radians(lat)))) AS value FROM d{n} JOIN grid USING (cell)), x{n} AS (SELECT t, list(value ORDER BY cell) AS x FROM d{n} GROUP BY t)"


@query(f"WITH RECURSIVE {F4}, {F5}, {GRID}, {_prep_of('f4', '_o')}, {_prep_of('f5', '_r')}, {modes_sql('w_o', 2, 'o')}, {modes_sql('w_r', 2, 'r')} " + " UNION ALL ".join(f"SELECT '{name}' AS basis, t, {q} AS mode, {r('list_dot_product(x, v)')} FROM x_r, v{tag}{q}" for name, tag in (("own", "r"), ("foreign", "o")) for q in (0, 1)))
def eof_bulk(spark, sf_dir):
    """Revenue by nation in its own two modes, and in those of the orders (another experiment's basis)."""
    grid = fields.nation_grid(spark, sf_dir)
    orders, revenue = (scale.prepare_stages(f, grid) for f in (fields.orders_nation(spark, sf_dir), fields.lineitem_snation(spark, sf_dir)))
    weighted, plain = {"revenue": revenue.current}, {"revenue": revenue.reset("detrended")}
    own = linalg.eof_bulk(weighted, plain, 2)["revenue"][1]
    foreign = linalg.eof_bulk(weighted, plain, 2, {"revenue": linalg.eof(orders.current, 2)[0]})["revenue"][1]
    return rounded(own.select(F.lit("own").alias("basis"), "t", "mode", "value").union(foreign.select(F.lit("foreign"), "t", "mode", "value")), "value")


@query(f"WITH RECURSIVE {F6}, {modes_sql('f6', 3)} " + " UNION ALL ".join(f"SELECT {q} AS mode, {r('sqrt(l)', 'sval')} FROM l{q}" for q in range(3)))
def eof_ooc(spark, sf_dir):
    """Leading modes of a field with many cells (the vectors) and few times, by a subspace."""
    f = fields.embeddings(spark, sf_dir)
    return rounded(linalg.eof(f.select(F.col("cell").alias("t"), F.col("t").alias("cell"), "value"), 3, exact=0)[1].select("mode", "sval"), "sval")


TRUNCATED = f"{PREP}, {modes_sql('w', 3)}"


@query(f"WITH RECURSIVE {TRUNCATED}, c AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM w)), x AS (SELECT t, list(value ORDER BY cell) AS x FROM w GROUP BY t) SELECT t, cell, {r('list_dot_product(p0.m[i], x) + list_dot_product(p1.m[i], x) + list_dot_product(p2.m[i], x)')} FROM x, c, p0, p1, p2")
def eof_truncated(spark, sf_dir):
    """The field rebuilt from its three leading modes."""
    w = _prepared(spark, sf_dir)
    loadings, _ = linalg.eof(w, 3)
    return rounded(linalg.reconstruct(linalg.project(w, loadings), loadings), "value")


@query(f"WITH RECURSIVE {TRUNCATED}, k AS (SELECT sum(v) AS total FROM (SELECT var_samp(value) AS v FROM w GROUP BY cell)), n AS (SELECT count(DISTINCT t) AS nt FROM w) " + " UNION ALL ".join(f"SELECT {q} AS mode, {r('sqrt(l)', 'sval')}, {r('l / nt', 'eigval')}, {r('l / nt / total', 'var_expl')} FROM l{q}, k, n" for q in range(3)))
def eof_leading(spark, sf_dir):
    """Statistics of the three leading modes."""
    return rounded(linalg.eof(_prepared(spark, sf_dir), 3)[1], "sval", "eigval", "var_expl")


@query(f"WITH RECURSIVE {TRUNCATED} " + " UNION ALL ".join(f"SELECT cell, {q} AS mode, {r('v[i]', 'loading')} FROM v{q}, (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM w))" for q in range(3)))
def eof_loadings(spark, sf_dir):
    """The three leading modes themselves."""
    return rounded(linalg.eof(_prepared(spark, sf_dir), 3)[0], "loading")


STATE = f"{F3}, {F4}, s AS (SELECT t, cell AS feature, value FROM f3 UNION ALL SELECT t, cell + 5, value FROM f4)"


def _state(spark, sf_dir):
    return state.concat({"region": fields.orders_region(spark, sf_dir), "nation": fields.orders_nation(spark, sf_dir)})


@query(f"WITH {STATE} SELECT t, feature, {r('value')} FROM s")
def state_concat(spark, sf_dir):
    return rounded(_state(spark, sf_dir)[0], "value")


@query(f"WITH RECURSIVE {F3}, {F4}, s AS (SELECT t, cell, value FROM f3 UNION ALL SELECT t, cell + 5, value FROM f4), {modes_sql('s', 2)}, fi AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM s)) " + " UNION ALL ".join(f"SELECT CASE WHEN cell < 5 THEN 'region' ELSE 'nation' END AS var, CASE WHEN cell < 5 THEN cell ELSE cell - 5 END AS cell, {q} AS mode, {r('v[i]', 'loading')} FROM fi, v{q}" for q in (0, 1)))
def state_eofs(spark, sf_dir):
    """Leading modes of a state of two variables, each variable's rows of the basis."""
    s, spans = _state(spark, sf_dir)
    loadings = state.state_eofs(s, 2)[0].withColumnRenamed("cell", "feature")
    parts = [state.select_var(loadings, spans, v).select(F.lit(v).alias("var"), "cell", "mode", "loading") for v in ("region", "nation")]
    return rounded(parts[0].union(parts[1]), "loading")


@query(f"WITH {STATE} SELECT t, feature - 5 AS cell, {r('value')} FROM s WHERE feature >= 5")
def select_var(spark, sf_dir):
    return rounded(state.select_var(*_state(spark, sf_dir), "nation"), "value").select("t", "cell", "value")


@query(f"WITH {F3}, {F4}, k3 AS (SELECT 1 / sqrt(sum(v)) AS factor FROM (SELECT var_samp(value) AS v FROM f3 GROUP BY cell)), k4 AS (SELECT 1 / sqrt(sum(v)) AS factor FROM (SELECT var_samp(value) AS v FROM f4 GROUP BY cell)) SELECT t, cell AS feature, {r('value * factor')} FROM f3 CROSS JOIN k3 UNION ALL SELECT t, cell + 5, {r('value * factor')} FROM f4 CROSS JOIN k4")
def state_build(spark, sf_dir):
    return rounded(state.concat({"region": scale.standardize_field(fields.orders_region(spark, sf_dir)), "nation": scale.standardize_field(fields.orders_nation(spark, sf_dir))})[0], "value")


@query(f"WITH {STATE} SELECT t, feature, round(value, 8) + 0.0 AS value FROM s")
def state_back(spark, sf_dir):
    """A state through all of its modes and back."""
    s, _ = _state(spark, sf_dir)
    loadings, _ = state.state_eofs(s, 30)
    return to_cents(state.to_features(state.to_modes(s, loadings), loadings))


@query(f"WITH {F4} SELECT t, cell, round(value, 8) + 0.0 AS value FROM f4")
def basis_chain(spark, sf_dir):
    """A basis of the modes of a basis, as one basis: complete ones rebuild the field."""
    f = fields.orders_nation(spark, sf_dir)
    outer, _ = linalg.eof(f, 25)
    inner, _ = linalg.eof(linalg.project(f, outer).withColumnRenamed("mode", "cell"), 25)
    both = linalg.chain(outer, inner)
    return to_cents(linalg.reconstruct(linalg.project(f, both), both))


#: Leading modes of the state of all cells.
LEADING = 10
#: Members of integrations with noise, of 1440 steps a unit, and units of the long ones.
MEMBERS_RUN, UNITS = 100, 500

# ---- the model -----------------------------------------------------------------------------------------------
SMOOTH = "sm AS (SELECT t, cell, avg(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM {f}), y0 AS (SELECT t, cell, v - avg(v) OVER (PARTITION BY cell) AS value FROM sm WHERE t BETWEEN 2 AND {last})"
STATES = "xs AS (SELECT t, list(value ORDER BY cell) AS x FROM y GROUP BY t), z AS (SELECT t, list_dot_product(x, v0.v) AS a, list_dot_product(x, v1.v) AS b FROM xs, v0, v1)"
TWO = f"{F5}, {SMOOTH.format(f='f5', last=_n('f5', 3))}, y AS (SELECT * FROM y0), {modes_sql('y', 2)}, {STATES}"
FIT = """p AS (SELECT t, a, b, lead(a) OVER (ORDER BY t) AS a1, lead(b) OVER (ORDER BY t) AS b1 FROM z), c AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a1 * a) AS ka, sum(a1 * b) AS kb, sum(b1 * a) AS la, sum(b1 * b) AS lb, count(*) AS n FROM p WHERE a1 IS NOT NULL),
g AS (SELECT (ka * bb - kb * ab) / (aa * bb - ab * ab) AS g00, (kb * aa - ka * ab) / (aa * bb - ab * ab) AS g01, (la * bb - lb * ab) / (aa * bb - ab * ab) AS g10, (lb * aa - la * ab) / (aa * bb - ab * ab) AS g11 FROM c)"""
TWO_G = f"{TWO}, {FIT}"


def _smoothed(field: DataFrame, n: int) -> DataFrame:
    f = temporal.run_mean_trim(field, 5, n)
    return f.withColumn("value", F.col("value") - F.avg("value").over(temporal.Window.partitionBy("cell")))


def _revenue(spark, sf_dir) -> DataFrame:
    """Revenue by nation, smoothed and centred."""
    return _smoothed(fields.lineitem_snation(spark, sf_dir), fields.months(spark, sf_dir, "lineitem"))


def _states(f: DataFrame, k: int):
    """A field as a state of its leading modes, and their loadings."""
    loadings, _ = linalg.eof(f, k)
    return linalg.project(f, loadings).select("t", F.col("mode").cast("long").alias("mode"), "value"), loadings


def _two(spark, sf_dir):
    """All cells of the smoothed, centred field in its two leading modes."""
    return _states(_revenue(spark, sf_dir), 2)[0]


@query(f"WITH RECURSIVE {TWO_G} SELECT 0 AS i, 0 AS j, {r('g00', 're')} FROM g UNION ALL SELECT 0, 1, {r('g01', 're')} FROM g UNION ALL SELECT 1, 0, {r('g10', 're')} FROM g UNION ALL SELECT 1, 1, {r('g11', 're')} FROM g")
def lim_fit_G(spark, sf_dir):
    return rounded(lim.fit(_two(spark, sf_dir)).to_df(spark).select("i", "j", "re"), "re")


@query(f"WITH RECURSIVE {TWO_G} SELECT 2 AS lead, t, 0::BIGINT AS mode, {r('(g00 * g00 + g01 * g10) * a + (g00 * g01 + g01 * g11) * b')} FROM z, g UNION ALL SELECT 2, t, 1, {r('(g10 * g00 + g11 * g10) * a + (g10 * g01 + g11 * g11) * b')} FROM z, g")
def lim_forecast(spark, sf_dir):
    s = _two(spark, sf_dir)
    return rounded(lim.forecast(s, lim.fit(s).g, [2]), "value")


@query(f"""WITH RECURSIVE {TWO_G}, m AS (SELECT *, g00 + g11 AS tr, g00 * g11 - g01 * g10 AS det FROM g), e AS (SELECT unnest([(tr + sqrt(greatest(tr * tr / 4 - det, 0) * 4)) / 2, (tr - sqrt(greatest(tr * tr / 4 - det, 0) * 4)) / 2]) AS l, det, tr FROM m)
SELECT (row_number() OVER (ORDER BY l DESC) - 1)::INT AS mode, CASE WHEN tr * tr / 4 >= det THEN round(ln(l), 6) + 0.0 ELSE round(ln(det) / 2, 6) + 0.0 END AS re, CASE WHEN tr * tr / 4 >= det THEN round(-1 / ln(l), 6) + 0.0 ELSE round(-2 / ln(det), 6) + 0.0 END AS efold FROM e""")
def lim_modes(spark, sf_dir):
    return rounded(lim.eigen_modes(spark, lim.fit(_two(spark, sf_dir))).select("mode", "re", "efold"), "re", "efold")


@query(f"WITH RECURSIVE {TWO}, {FIT.replace('lead(a)', 'lead(a, 3)').replace('lead(b)', 'lead(b, 3)')} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'g{i}{j}', 're')} FROM g" for i in (0, 1) for j in (0, 1)))
def lim_fit_tau1(spark, sf_dir):
    """G from states and, given apart, those that follow them three months later."""
    s = store.stored(_two(spark, sf_dir), "states")
    later = s.withColumn("t", F.col("t") - 3).join(s.select("t").distinct(), "t", "left_semi")
    return rounded(lim.fit(s.join(later.select("t").distinct(), "t", "left_semi"), 3, tau1=later).to_df(spark).select("i", "j", "re"), "re")


@query(f"WITH RECURSIVE {TWO_G} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'g{i}{j}', 're')} FROM g" for i in (0, 1) for j in (0, 1)))
def lim_saved(spark, sf_dir):
    """A fitted model, written and read back."""
    path = f"{store.shared_dir(spark)}/model-{uuid.uuid4().hex}"
    lim.fit(_two(spark, sf_dir), noise=True).save(spark, path)
    return rounded(lim.Model.load(spark, path).to_df(spark).select("i", "j", "re"), "re")


@query(f"WITH RECURSIVE {TWO_G} " + " UNION ALL ".join(f"SELECT 1 AS lead, t, {i}::BIGINT AS mode, {r(f'g{i}0 * a + g{i}1 * b')} FROM z, g UNION ALL SELECT 2, t, {i}, {r(f'(g{i}0 * g00 + g{i}1 * g10) * a + (g{i}0 * g01 + g{i}1 * g11) * b')} FROM z, g" for i in (0, 1)))
def fcast_by_lead(spark, sf_dir):
    """Forecasts kept as a folder for each lead, two of three read back."""
    s = _two(spark, sf_dir)
    path = f"{store.shared_dir(spark)}/forecast-{uuid.uuid4().hex}"
    lim.save_by_lead(lim.forecast(s, lim.fit(s).g, [1, 2, 3]), path)
    return rounded(spark.read.parquet(path).where("lead < 3").select("lead", "t", "mode", "value"), "value")


def _whole(spark, sf_dir):
    """All cells of the smoothed, centred field as a state of its leading modes, and their loadings."""
    f = _revenue(spark, sf_dir)
    return *_states(f, LEADING), f


@query()
def lim_fit_G_state(spark, sf_dir):
    return rounded(lim.fit(_whole(spark, sf_dir)[0]).to_df(spark).select("i", "j", "re"), "re")


@query()
def lim_forecast_state(spark, sf_dir):
    """Lead-2 forecasts of every cell."""
    s, loadings, _ = _whole(spark, sf_dir)
    ahead = lim.forecast(s, lim.fit(s).g, [2]).select("t", F.col("mode").cast("int").alias("mode"), "value")
    return rounded(linalg.reconstruct(ahead, loadings), "value")


@query()
def lim_modes_state(spark, sf_dir):
    return rounded(lim.eigen_modes(spark, lim.fit(_whole(spark, sf_dir)[0])), "re", "im", "efold", "period")


@query()
def xfcast_state(spark, sf_dir):
    """Every cell a feature, forecast in the state's leading modes and taken back."""
    s, loadings, f = _whole(spark, sf_dir)
    return rounded(lim.cross_forecast(lim.fit(s), ["x"], ["x"], f.withColumnRenamed("cell", "feature"), loadings), "value")


def _model(spark, sf_dir):
    """A model with noise on two modes of the smoothed, centred, standardised nation field, and its state."""
    s, loadings = _states(scale.standardize_field(_smoothed(fields.orders_nation(spark, sf_dir), fields.months(spark, sf_dir))), 2)
    return lim.fit(s, noise=True), s, loadings


#: The same in SQL. The logarithm of a matrix of two by two is a multiple of it plus one of the identity.
MODEL = f"""{F4}, {SMOOTH.format(f='f4', last=_n('f4', 3))}, k AS (SELECT 1 / sqrt(sum(v)) AS factor FROM (SELECT var_samp(value) AS v FROM y0 GROUP BY cell)), y AS (SELECT t, cell, value * factor AS value FROM y0, k), {modes_sql('y', 2)}, {STATES}, {FIT},
e0 AS (SELECT *, g00 + g11 AS tr, g00 * g11 - g01 * g10 AS det, aa / (n - 1) AS c00, ab / (n - 1) AS c01, bb / (n - 1) AS c11 FROM g, c), e1 AS (SELECT *, sqrt(abs(tr * tr / 4 - det)) AS w, tr * tr / 4 > det AS two FROM e0),
e2 AS (SELECT *, CASE WHEN two THEN (ln(tr / 2 + w) - ln(tr / 2 - w)) / (2 * w) ELSE atan2(w, tr / 2) / w END AS kg FROM e1), e3 AS (SELECT *, CASE WHEN two THEN ln(tr / 2 + w) - kg * (tr / 2 + w) ELSE ln(det) / 2 - kg * tr / 2 END AS ki FROM e2),
l AS (SELECT *, ki + kg * g00 AS l00, kg * g01 AS l01, kg * g10 AS l10, ki + kg * g11 AS l11 FROM e3), q AS (SELECT *, -2 * (l00 * c00 + l01 * c01) AS qa, -(l00 * c01 + l01 * c11 + c00 * l10 + c01 * l11) AS qb, -2 * (l10 * c01 + l11 * c11) AS qd FROM l),
q2 AS (SELECT *, (qa + qd) / 2 + sqrt(pow((qa - qd) / 2, 2) + qb * qb) AS q0, (qa + qd) / 2 - sqrt(pow((qa - qd) / 2, 2) + qb * qb) AS q1 FROM q), q3 AS (SELECT *, sqrt(qb * qb + pow(q0 - qa, 2)) * CASE WHEN abs(qb) >= abs(q0 - qa) THEN sign(qb) ELSE sign(q0 - qa) END AS n0, sqrt(qb * qb + pow(q1 - qa, 2)) * CASE WHEN abs(qb) >= abs(q1 - qa) THEN sign(qb) ELSE sign(q1 - qa) END AS n1 FROM q2),
md AS (SELECT *, qb / n0 AS v00, (q0 - qa) / n0 AS v10, qb / n1 AS v01, (q1 - qa) / n1 AS v11 FROM q3)"""


@query(f"WITH RECURSIVE {MODEL} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'l{i}{j}', 're')}, 0.0::DOUBLE AS im, {r(f'q{i}', 'q')} FROM md" for i in (0, 1) for j in (0, 1)))
def lim_fit_Q(spark, sf_dir):
    """L, and the eigenvalues of the noise covariance beside its rows."""
    m = _model(spark, sf_dir)[0]
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(m.q_values)], "i int, q double")
    return rounded(linalg.to_coo(spark, m.lin).join(values, "i", "left"), "re", "im", "q")


def _joint(spark, sf_dir):
    """A model with noise on the leading modes of the joint state of orders and revenue by nation, its state and loadings.

    Both fields are smoothed, centred and standardised; the state has the months that both have. They are written once,
    as their tables would be joined anew for each of their uses. Where one of the ten modes grows by least squares (some
    larger tables), the covariance of starts and ends gives a model of as many modes that decay.
    """
    parts = {"orders": _smoothed(fields.orders_nation(spark, sf_dir), fields.months(spark, sf_dir)), "revenue": _revenue(spark, sf_dir)}
    parts = {k: store.stored(scale.standardize_field(store.stored(f, "smoothed")), "standard") for k, f in parts.items()}
    common = parts["orders"].select("t").distinct().join(parts["revenue"].select("t").distinct(), "t")
    joined = store.stored(state.concat({k: f.join(common, "t", "left_semi") for k, f in parts.items()})[0], "joint")
    loadings, _ = state.state_eofs(joined, LEADING)
    loadings = store.stored(loadings, "loadings")
    s = store.stored(state.to_modes(joined, loadings).select("t", F.col("mode").cast("long").alias("mode"), "value"), "states")
    return lim.fit(s, noise=True, settle=True), s, loadings


@query()
def lim_fit_Q_state(spark, sf_dir):
    """L of the joint state and the eigenvalues of its noise covariance, those below zero dropped and the rest rescaled."""
    m = _joint(spark, sf_dir)[0]
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(m.q_values)], "i int, q double")
    return rounded(linalg.to_coo(spark, m.lin).join(values, "i", "left"), "re", "im", "q")


@query()
def noise_modes_state(spark, sf_dir):
    m, _, loadings = _joint(spark, sf_dir)
    return rounded(lim.noise_modes(spark, m, loadings.withColumnRenamed("feature", "cell") if "feature" in loadings.columns else loadings), "loading")


@query()
def ens_1yr_state(spark, sf_dir):
    """Ensemble mean and spread of all modes of the joint state after one unit, from every sample of the last year."""
    m, s, _ = _joint(spark, sf_dir)
    last = s.agg(F.max("t").alias("t")).first().t
    x0 = np.array([x.value for x in s.where(F.col("t") > last - 12).orderBy("t", "mode").collect()]).reshape(-1, len(m.g))
    e = lim.ensemble(spark, m, x0, members=MEMBERS_RUN)
    return rounded(e.groupBy("sample", "mode").agg(F.avg("last").alias("mean"), F.stddev_samp("last").alias("std"), F.count("*").alias("members")), "mean", "std")


STEPS = 1440


def _scrambled(table: str, *columns: str) -> str:
    """Columns of a table through the 32-bit finaliser of the noise."""
    mask = "4294967295::UBIGINT"
    for shift, by in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        table = f"(SELECT * REPLACE ({', '.join(f'(xor({c}, {c} >> {shift}) * {by}::UBIGINT) & {mask} AS {c}' for c in columns)}) FROM {table})"
    return f"(SELECT * REPLACE ({', '.join(f'xor({c}, {c} >> 16) AS {c}' for c in columns)}) FROM {table})"


def ensemble_sql(units: int, starts: str) -> str:
    """CTE ``runs`` (member, sample, unit, a, b, ma, mb): last midpoints and means of each unit, from starts (sample, a, b).

    The scheme is linear: a unit's states are powers of I + L dt times its start, plus powers times the noise, so no
    step is taken one by one.
    """
    mask = "4294967295::UBIGINT"
    add = lambda column, by: f"({column} + {by}::UBIGINT) & {mask}"
    one = _scrambled(f"(SELECT member, ({add('h', 'member')}) AS h FROM {_scrambled('(SELECT (2654435769)::UBIGINT AS h)', 'h')}, (SELECT range::UBIGINT AS member FROM range({MEMBERS_RUN})))", "h")
    two = _scrambled(f"(SELECT unit, sample, ({add('h', 'sample')}) AS h FROM {_scrambled('(SELECT unit, (unit + 2246822507::UBIGINT) & 4294967295::UBIGINT AS h FROM (SELECT range::UBIGINT AS unit FROM range(' + str(units) + ')))', 'h')}, (SELECT sample::UBIGINT AS sample FROM starts))", "h")
    parts = [f"x{c}" for c in range(4)]
    first = _scrambled(f"(SELECT member, unit, sample, stream.h AS h1, place.h AS h2, i, {', '.join(f'(4 * i + {c} + stream.h) & {mask} AS x{c}' for c in range(4))} FROM stream, place, (SELECT range::UBIGINT AS i FROM range({STEPS})))", *parts)
    second = _scrambled(f"(SELECT * REPLACE ({', '.join(f'xor({c}, h2) AS {c}' for c in parts)}) FROM {first})", *parts)
    u = lambda c: f"(({c}::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"
    sums = {"e": "pw.i = left_ - 1", "f": "pw.i = left_ - 2"}
    return f"""st AS MATERIALIZED (SELECT 1 + l00 / {STEPS} AS a00, l01 / {STEPS} AS a01, l10 / {STEPS} AS a10, 1 + l11 / {STEPS} AS a11, v00 * sqrt(q0 / {STEPS}) AS b00, v01 * sqrt(q1 / {STEPS}) AS b01, v10 * sqrt(q0 / {STEPS}) AS b10, v11 * sqrt(q1 / {STEPS}) AS b11 FROM md),
starts AS ({starts}), stream AS {one}, place AS {two},
pw(i, p00, p01, p10, p11, c00, c01, c10, c11) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, n00, n01, n10, n11, c00 + n00, c01 + n01, c10 + n10, c11 + n11 FROM (SELECT *, a00 * p00 + a01 * p10 AS n00, a00 * p01 + a01 * p11 AS n01, a10 * p00 + a11 * p10 AS n10, a10 * p01 + a11 * p11 AS n11 FROM pw, st WHERE i < {STEPS})),
ns AS (SELECT member, unit, sample, i, sqrt(-2 * ln({u('x0')})) * cos(2 * pi() * {u('x1')}) AS n0, sqrt(-2 * ln({u('x2')})) * cos(2 * pi() * {u('x3')}) AS n1 FROM {second}),
ws AS (SELECT member, unit, sample, i, b00 * n0 + b01 * n1 AS w0, b10 * n0 + b11 * n1 AS w1 FROM ns, st),
kicks AS MATERIALIZED (SELECT member, unit, sample, sum(e.p00 * w0 + e.p01 * w1) AS e0, sum(e.p10 * w0 + e.p11 * w1) AS e1, sum(f.p00 * w0 + f.p01 * w1) AS f0, sum(f.p10 * w0 + f.p11 * w1) AS f1, sum(f.c00 * w0 + f.c01 * w1) AS d0, sum(f.c10 * w0 + f.c11 * w1) AS d1
 FROM ws JOIN pw e ON e.i = {STEPS - 1} - ws.i::BIGINT LEFT JOIN pw f ON f.i = {STEPS - 2} - ws.i::BIGINT GROUP BY ALL),
ends AS MATERIALIZED (SELECT s.p00 AS s00, s.p01 AS s01, s.p10 AS s10, s.p11 AS s11, t.p00 AS t00, t.p01 AS t01, t.p10 AS t10, t.p11 AS t11, t.c00 AS u00, t.c01 AS u01, t.c10 AS u10, t.c11 AS u11 FROM pw s, pw t WHERE s.i = {STEPS} AND t.i = {STEPS - 1}),
runs(member, sample, unit, xa, xb, a, b, ma, mb) AS (SELECT member, starts.sample::UBIGINT, 0::BIGINT, a, b, a, b, 0.0::DOUBLE, 0.0::DOUBLE FROM starts, stream UNION ALL
 SELECT member, sample, unit + 1, ya, yb, (za + ya) / 2, (zb + yb) / 2, (a + (2 * ka - xa + ya) / 2) / {STEPS + 1}, (b + (2 * kb - xb + yb) / 2) / {STEPS + 1} FROM (SELECT runs.*, s00 * xa + s01 * xb + e0 AS ya, s10 * xa + s11 * xb + e1 AS yb, t00 * xa + t01 * xb + f0 AS za, t10 * xa + t11 * xb + f1 AS zb, u00 * xa + u01 * xb + d0 AS ka, u10 * xa + u11 * xb + d1 AS kb
 FROM runs, ends, kicks WHERE runs.unit < {units} AND kicks.member = runs.member AND kicks.sample = runs.sample AND kicks.unit = runs.unit))"""


MODES = "(SELECT member, sample, unit, 0 AS mode, a AS last, ma AS mean FROM runs WHERE unit > 0 UNION ALL SELECT member, sample, unit, 1, b, mb FROM runs WHERE unit > 0)"
FROM_FIRST = "SELECT 0 AS sample, a, b FROM z WHERE t = 2"


@query(f"WITH RECURSIVE {MODEL}, {ensemble_sql(2, FROM_FIRST)} SELECT member::INT AS member, unit::INT AS unit, sample::INT AS sample, mode, {r('last', 'last')}, {r('mean', 'mean')} FROM {MODES}")
def lim_noise(spark, sf_dir):
    m, s, _ = _model(spark, sf_dir)
    x0 = np.array([x.value for x in s.where("t = 2").orderBy("mode").collect()])
    return rounded(lim.ensemble(spark, m, x0, members=MEMBERS_RUN, length=2), "last", "mean")


@query(f"WITH RECURSIVE {MODEL}, {ensemble_sql(1, f'SELECT row_number() OVER (ORDER BY t) - 1 AS sample, a, b FROM z WHERE t > (SELECT max(t) - 12 FROM z)')} SELECT sample::INT AS sample, mode, {r('avg(last)', 'mean')}, {r('stddev_samp(last)', 'std')}, count(*)::BIGINT AS members FROM {MODES} GROUP BY sample, mode")
def ens_1yr(spark, sf_dir):
    """Ensemble mean and spread after one unit, from every sample of the last year."""
    m, s, _ = _model(spark, sf_dir)
    rows = s.where(f"t >= {fields.months(spark, sf_dir) - 14}").orderBy("t", "mode").collect()
    x0 = np.array([x.value for x in rows]).reshape(-1, 2)
    e = lim.ensemble(spark, m, x0, members=MEMBERS_RUN)
    return rounded(e.groupBy("sample", "mode").agg(F.avg("last").alias("mean"), F.stddev_samp("last").alias("std"), F.count("*").alias("members")), "mean", "std")


@query(f"WITH RECURSIVE {MODEL}, {ensemble_sql(UNITS, FROM_FIRST)} SELECT unit::INT AS unit, mode, {r('avg(mean)', 'mean')}, {r('stddev_samp(last)', 'std')} FROM {MODES} GROUP BY unit, mode")
def ens_long(spark, sf_dir):
    m, s, _ = _model(spark, sf_dir)
    x0 = np.array([x.value for x in s.where("t = 2").orderBy("mode").collect()])
    return rounded(lim.ensemble(spark, m, x0, members=MEMBERS_RUN, length=UNITS).groupBy("unit", "mode").agg(F.avg("mean").alias("mean"), F.stddev_samp("last").alias("std")), "mean", "std")


CELLS = "cs AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM y))"


@query(f"WITH RECURSIVE {MODEL}, {CELLS} " + " UNION ALL ".join(f"SELECT cell, {j} AS mode, {r(f'(v0.v[i] * v0{j} + v1.v[i] * v1{j}) * q{j}', 'loading')} FROM cs, v0, v1, md" for j in (0, 1)))
def noise_modes(spark, sf_dir):
    m, _, loadings = _model(spark, sf_dir)
    return rounded(lim.noise_modes(spark, m, loadings), "loading")


@query(f"""WITH RECURSIVE {MODEL}, o AS (SELECT g01 AS ra, CASE WHEN two THEN tr / 2 + w - g00 ELSE tr / 2 - g00 END AS rb, g01 AS sa, CASE WHEN two THEN tr / 2 - w - g00 END AS sb, w, two FROM e1),
h AS (SELECT two, CASE WHEN two THEN (ra * sa + rb * sb) / sqrt((ra * ra + rb * rb) * (sa * sa + sb * sb)) ELSE ra * 0 END AS c, ra * ra + rb * rb AS x, w * w AS yy, rb * w AS xy FROM o),
f AS (SELECT CASE WHEN two THEN (1 + abs(c)) / (1 - abs(c)) ELSE ((x + yy) / 2 + sqrt(pow((x - yy) / 2, 2) + xy * xy)) / ((x + yy) / 2 - sqrt(pow((x - yy) / 2, 2) + xy * xy)) END AS bb FROM h)
SELECT k AS mode, 1.0::DOUBLE AS aa, 0.0::DOUBLE AS ab, {r('bb', 'bb')} FROM f, (SELECT unnest([0, 1]) AS k)""")
def mode_ortho(spark, sf_dir):
    """Rows (mode, aa, ab, bb): products of the parts of the turned complex eigenvectors, and of pairs of real ones."""
    return rounded(lim.orthogonal_modes(spark, _model(spark, sf_dir)[0]), "aa", "ab", "bb")


@query(f"WITH RECURSIVE {TWO_G}, cs AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM y)), ah AS (SELECT t, g00 * a + g01 * b AS a1, g10 * a + g11 * b AS b1 FROM z, g) SELECT t, cell AS feature, {r('v0.v[i] * a1 + v1.v[i] * b1')} FROM ah, cs, v0, v1")
def xfcast(spark, sf_dir):
    """Every cell a feature, forecast in two leading modes and taken back."""
    features = _revenue(spark, sf_dir).withColumnRenamed("cell", "feature")
    loadings, _ = state.state_eofs(features, 2)
    modes = state.to_modes(features, loadings).select("t", F.col("mode").cast("long").alias("mode"), "value")
    return rounded(lim.cross_forecast(lim.fit(modes), ["x"], ["x"], features, loadings), "value")


# ---- verification --------------------------------------------------------------------------------------------
def _pairs(spark, sf_dir):
    """Last year's anomaly as the forecast of this year's."""
    return temporal.lag_pair(_anomalies(spark, sf_dir), 12).withColumnsRenamed({"x0": "f", "x1": "o"})


@query(f"WITH {PAIRS} SELECT cell, {r('corr(f, o)', 'lac')} FROM q GROUP BY cell")
def lac(spark, sf_dir):
    return rounded(verify.skill(_pairs(spark, sf_dir)).select("cell", "lac"), "lac")


@query(f"WITH {PAIRS} SELECT cell, {r('avg((o - f) * (o - f))', 'mse')} FROM q GROUP BY cell")
def mse(spark, sf_dir):
    return rounded(verify.skill(_pairs(spark, sf_dir)).select("cell", "mse"), "mse")


@query(f"WITH {PAIRS} SELECT cell, {r(CE, 'ce')} FROM q GROUP BY cell")
def ce(spark, sf_dir):
    return rounded(verify.skill(_pairs(spark, sf_dir)).select("cell", "ce"), "ce")


NEFF = f"{PAIRS}, l AS (SELECT cell, f, o, lead(f) OVER w AS f1, lead(o) OVER w AS o1 FROM q WINDOW w AS (PARTITION BY cell ORDER BY t)), e AS (SELECT cell, corr(f, f1) * corr(o, o1) AS rr, count(*) AS n FROM l GROUP BY cell), ne AS (SELECT cell, n * (1 - rr) / (1 + rr) AS n_eff FROM e)"


@query(f"WITH {NEFF} SELECT cell, {r('n_eff', 'n_eff')} FROM ne")
def n_eff(spark, sf_dir):
    return rounded(verify.n_eff(_pairs(spark, sf_dir)), "n_eff")


@query(f"WITH {NEFF}, k AS (SELECT cell, corr(f, o) AS lac FROM q GROUP BY cell) SELECT cell, {r('lac', 'lac')}, {r('n_eff', 'n_eff')}, CASE WHEN abs(lac) < 0.5 THEN abs(lac) > 2 / sqrt(n_eff) WHEN n_eff > 3 THEN abs(0.5 * ln((1 + lac) / (1 - lac))) > 2 / sqrt(n_eff - 3) ELSE false END AS signif FROM k JOIN ne USING (cell)")
def corr_signif(spark, sf_dir):
    return rounded(verify.significance(_pairs(spark, sf_dir)), "lac", "n_eff")


TRIALS, TAU, LEN = 6, 2, 9
OBS = f"o AS (SELECT (k * {LEN} + s)::BIGINT AS t, d.cell, value FROM (SELECT range AS k FROM range({TRIALS})), (SELECT range AS s FROM range({LEN})), d WHERE d.t = k * 10 + {TAU} + s)"
FC = OBS.replace("o AS", "fc AS", 1).replace(f"+ {TAU} +", "+")


def _starts(spark):
    return spark.range(TRIALS).select(F.col("id").alias("trial"), (F.col("id") * 10).alias("start"))


@query(f"WITH {ANOM}, {OBS} SELECT t, cell, {r('value')} FROM o")
def trial_obs(spark, sf_dir):
    return rounded(verify.trial_obs(_anomalies(spark, sf_dir), _starts(spark), TAU, LEN), "value")


@query(f"WITH RECURSIVE {ANOM}, {modes_sql('d', 3)}, {_rebuilt('d', 3)}, {FC.replace(', d WHERE d.t', ', rc d WHERE d.t')} SELECT t, cell, {r('value')} FROM fc")
def trial_fcast(spark, sf_dir):
    """Trials of three of five modes taken back to cells."""
    d = _anomalies(spark, sf_dir)
    loadings, _ = linalg.eof(d, 3)
    pcs = linalg.project(d, loadings)
    want = _starts(spark).select("trial", F.explode(F.sequence(F.lit(0), F.lit(LEN - 1))).alias("s"), "start")
    trials = pcs.join(want, pcs.t == want.start + want.s).select("trial", "s", "mode", "value")
    return rounded(verify.trial_forecast(trials, loadings, LEN), "value")


TR = f"{ANOM}, {OBS}, {FC}, tr AS (SELECT t // {LEN} AS k, cell, fc.value AS f, o.value AS o FROM fc JOIN o USING (t, cell)), each AS (SELECT cell, k, corr(f, o) AS r, {CE} AS ce FROM tr GROUP BY ALL)"


def _trial_pairs(spark, sf_dir):
    d = _anomalies(spark, sf_dir)
    f = verify.trial_obs(d, _starts(spark), 0, LEN).withColumnRenamed("value", "f")
    return f.join(verify.trial_obs(d, _starts(spark), TAU, LEN).withColumnRenamed("value", "o"), ["t", "cell"])


@query(f"WITH {TR} SELECT cell, {r('avg(r)', 'lac')}, {r('avg(r) * sqrt(count(r)) / stddev_samp(r)', 't_stat')}, abs(avg(r) * sqrt(count(r)) / stddev_samp(r)) >= 2.570581835636314 AS signif FROM each GROUP BY cell")
def trial_corr(spark, sf_dir):
    return rounded(verify.trial_skill(_trial_pairs(spark, sf_dir), LEN, TRIALS).select("cell", "lac", "t_stat", "signif"), "lac", "t_stat")


@query(f"WITH {TR} SELECT cell, {r('avg(ce)', 'ce')} FROM each GROUP BY cell")
def trial_ce(spark, sf_dir):
    return rounded(verify.trial_skill(_trial_pairs(spark, sf_dir), LEN, TRIALS).select("cell", "ce"), "ce")


def _random(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT"


#: Models of the two modes fitted without a tenth of the blocks of six months, as many as the trials of the reference job.
HELD, SIZE, LEAD_HELD = 20, 6, 2
HOLD = f"""bl AS (SELECT count(*) AS n, ceil(count(*) * 0.1)::BIGINT AS m FROM (SELECT DISTINCT (t - 2) // {SIZE} AS block FROM z)), hs AS (SELECT trial, {_random(3, 'trial')} % (n - m + 1) AS first, m FROM (SELECT range AS trial FROM range({HELD})), bl), hb AS (SELECT trial, first, first + unnest(range(m)) AS block FROM hs),
pz AS (SELECT t, (t - 2) // {SIZE} AS ba, (t - 1) // {SIZE} AS bb, a, b, lead(a) OVER (ORDER BY t) AS a1, lead(b) OVER (ORDER BY t) AS b1 FROM z), tz AS (SELECT trial, pz.* FROM pz, hs WHERE a1 IS NOT NULL AND (ba < first OR ba >= first + m) AND (bb < first OR bb >= first + m)),
c AS (SELECT trial, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a1 * a) AS ka, sum(a1 * b) AS kb, sum(b1 * a) AS la, sum(b1 * b) AS lb FROM tz GROUP BY trial),
g AS (SELECT trial, n, (ka * bb - kb * ab) / (aa * bb - ab * ab) AS g00, (kb * aa - ka * ab) / (aa * bb - ab * ab) AS g01, (la * bb - lb * ab) / (aa * bb - ab * ab) AS g10, (lb * aa - la * ab) / (aa * bb - ab * ab) AS g11 FROM c)"""


def _held_out(spark, sf_dir):
    """The state, its loadings, the blocks that each trial holds out and the trials' models."""
    field = _revenue(spark, sf_dir)
    s, loadings = _states(field, 2)
    s = store.stored(s, "states")
    blocks = -(-(fields.months(spark, sf_dir, "lineitem") - 4) // SIZE)
    held = resample.held_blocks(spark, blocks, 0.1, HELD)
    return field, s, loadings, held, store.stored(resample.refits(resample.block_sums(s, 1, SIZE, 2), held), "models")


@query(f"WITH RECURSIVE {TWO}, {HOLD} " + " UNION ALL ".join(f"SELECT trial, n, {i} AS i, {j} AS j, {r(f'g{i}{j}', 'g')} FROM g" for i in (0, 1) for j in (0, 1)))
def resample_trials(spark, sf_dir):
    """A model for each trial, from sums without the blocks that it holds out."""
    models = _held_out(spark, sf_dir)[4]
    return rounded(resample.entries(models).join(models.select("trial", "n"), "trial"), "g")


@query(f"""WITH RECURSIVE {TWO}, {HOLD}, cs AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM y)), hz AS (SELECT trial, t, t - 2 - first * {SIZE} AS s, m * {SIZE} - {LEAD_HELD} AS samples, a, b FROM z JOIN hb ON (t - 2) // {SIZE} = block JOIN bl ON true),
f1 AS (SELECT trial, t, g00 * a + g01 * b AS a, g10 * a + g11 * b AS b FROM hz JOIN g USING (trial) WHERE s < samples), f2 AS (SELECT trial, t, g00 * a + g01 * b AS a, g10 * a + g11 * b AS b FROM f1 JOIN g USING (trial)),
tr AS (SELECT trial AS k, y.cell, v0.v[i] * a + v1.v[i] * b AS f, y.value AS o FROM f2 JOIN y ON y.t = f2.t + {LEAD_HELD} JOIN cs USING (cell), v0, v1), each AS (SELECT cell, k, corr(f, o) AS r, {CE} AS ce FROM tr GROUP BY ALL)
SELECT cell, {r('avg(r)', 'lac')}, {r('avg(ce)', 'ce')}, {r('avg(r) * sqrt(count(r)) / stddev_samp(r)', 't_stat')}, abs(avg(r) * sqrt(count(r)) / stddev_samp(r)) >= 2.093024054408263 AS signif FROM each GROUP BY cell""")
def resample_skill(spark, sf_dir):
    """Skill by cell of the trials' forecasts of what they held out, through the operators of trials."""
    field, s, loadings, held, models = _held_out(spark, sf_dir)
    m = held.where("trial = 0").count()
    samples = m * SIZE - LEAD_HELD
    ahead = resample.held_forecasts(s, models, held, SIZE, [LEAD_HELD], 2).where(F.col("s") < samples)
    f = verify.trial_forecast(ahead.select("trial", "s", F.col("mode").cast("int").alias("mode"), "value"), loadings, samples)
    starts = held.select("trial", (F.col("first") * SIZE + 2).alias("start")).distinct()
    o = verify.trial_obs(field, starts, LEAD_HELD, samples)
    pairs = f.withColumnRenamed("value", "f").join(o.withColumnRenamed("value", "o"), ["t", "cell"])
    return rounded(verify.trial_skill(pairs, samples, HELD), "lac", "ce", "t_stat")


#: Draws of bootstraps and of consistency bounds.
DRAWS, CONSISTENT, PAIRED = 10_000, 1000, _n('f3', 12)
#: Truth o a year ahead; forecasts f: the present value, and g: that of the month before the truth.
BOOTED = f"{ANOM}, q0 AS (SELECT * FROM (SELECT t, cell, value AS f, lead(value, 12) OVER w AS o, lead(value, 11) OVER w AS g FROM d WINDOW w AS (PARTITION BY cell ORDER BY t)) WHERE t < {PAIRED})"


def _skill_sql(f: str) -> dict[str, str]:
    return {"r": f"corr({f}, o)", "ce": CE.replace("(o - f)", f"(o - {f})")}


def _draws(iterations: int, n: str = PAIRED) -> str:
    return f"(SELECT i, {_random(7, 'i', 'k')} % {n} AS t FROM (SELECT range AS i FROM range({iterations})), (SELECT unnest(range({n})) AS k))"


def _booted(iterations: int, by: str = "cell", n: str = PAIRED) -> str:
    """CTE b: r and ce of both forecasts in each draw."""
    cols = ", ".join(f"{x} AS {p}{m}" for p, f in (("", "f"), ("auto1_", "g")) for m, x in _skill_sql(f).items())
    return f"b AS (SELECT {by}, i, {cols} FROM {_draws(iterations, n)} JOIN q0 USING (t) GROUP BY {by}, i)"


def _bounds(m: str) -> str:
    return f"{r(f'avg({m})', 'mean')}, {r(f'quantile_cont({m}, 0.025)', 'low')}, {r(f'quantile_cont({m}, 0.975)', 'high')}"


TABLE = ", ".join(f"{r(x, n)}" for p in ("", "auto1_") for m in ("r", "ce") for x, n in ((f"avg({p}{m})", f"{p}{m}"), (f"quantile_cont({p}{m}, 0.025)", f"{p}{m}_low"), (f"quantile_cont({p}{m}, 0.975)", f"{p}{m}_high")))


def _boot_sql(booted: str) -> str:
    return f"WITH {booted}, {_booted(DRAWS)} SELECT cell, 'r' AS metric, {_bounds('r')} FROM b GROUP BY cell UNION ALL SELECT cell, 'ce', {_bounds('ce')} FROM b GROUP BY cell"


def _table_sql(booted: str) -> str:
    return f"WITH {booted}, {_booted(DRAWS)} SELECT cell, 'orders' AS variable, 'none' AS average, 'cell' || cell AS scalar, {TABLE} FROM b GROUP BY cell"


#: The same of all nations.
BOOTED_NATIONS = BOOTED.replace(ANOM, f"{F3}, {F4}, a AS ({_climo('f4')}), d AS ({_detrend('a')})")


def _bootstraps(spark, sf_dir, d: DataFrame) -> DataFrame:
    b = verify.bootstraps(temporal.lag_pair(d, 12).withColumnsRenamed({"x0": "f", "x1": "o"}), fields.months(spark, sf_dir) - 12, DRAWS, by=("cell",))
    parts = [b.select("cell", F.lit(m).alias("metric"), *[F.col(f"{m}_{c}").alias(c) for c in ("mean", "low", "high")]) for m in verify.METRICS]
    return rounded(parts[0].union(parts[1]), "mean", "low", "high")


def _table(spark, sf_dir, d: DataFrame) -> DataFrame:
    """A year ahead by the present value, and persistence of the month before."""
    year = temporal.lag_pair(d, 12).withColumnsRenamed({"x0": "f", "x1": "o"})
    month = temporal.lag_pair(d, 1).where("t >= 11").select((F.col("t") - 11).alias("t"), "cell", F.col("x0").alias("f"), F.col("x1").alias("o"))
    t = verify.verification_table(year, month, fields.months(spark, sf_dir) - 12, DRAWS, ("orders", "none", "cell"), by=("cell",))
    return rounded(t.withColumn("scalar", F.concat("scalar", F.col("cell").cast("string"))), *[c for c in t.columns if c not in ("cell", "variable", "average", "scalar")])


def _nations(spark, sf_dir) -> DataFrame:
    return temporal.detrend(temporal.anomaly(temporal.by_cell(fields.orders_nation(spark, sf_dir)), 12))


@query(_boot_sql(BOOTED))
def boot_ci(spark, sf_dir):
    return _bootstraps(spark, sf_dir, _anomalies(spark, sf_dir))


@query(_table_sql(BOOTED))
def verif_table(spark, sf_dir):
    return _table(spark, sf_dir, _anomalies(spark, sf_dir))


@query(_boot_sql(BOOTED_NATIONS))
def boot_ci_cells(spark, sf_dir):
    """Of all nations, not regions."""
    return _bootstraps(spark, sf_dir, _nations(spark, sf_dir))


@query(_table_sql(BOOTED_NATIONS))
def verif_table_cells(spark, sf_dir):
    """Of all nations, not regions."""
    return _table(spark, sf_dir, _nations(spark, sf_dir))


@query(_table_sql(BOOTED))
def sink_table(spark, sf_dir):
    """The verification table, written and read back."""
    path = f"{store.shared_dir(spark)}/verification-{uuid.uuid4().hex}"
    _table(spark, sf_dir, _anomalies(spark, sf_dir)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


THREE = f"{F4}, {GRID}, {modes_sql('f4', 3)}, {_rebuilt('f4', 3)}"


@query(f"WITH RECURSIVE {THREE} SELECT t, {r('sum(value * cell_area) / sum(cell_area)')} FROM rc JOIN grid USING (cell) GROUP BY t")
def glob_mean(spark, sf_dir):
    """Through three modes: the index is a short sum over them."""
    f = fields.orders_nation(spark, sf_dir)
    loadings, _ = linalg.eof(f, 3)
    factor = linalg.scalar_factor(loadings, fields.nation_grid(spark, sf_dir).select("cell", F.col("cell_area").alias("w")))
    return rounded(linalg.scalar_index(linalg.project(f, loadings), factor), "value")


@query(f"WITH {F4}, {GRID} SELECT t, {r('avg(value)')} FROM f4 JOIN grid USING (cell) WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 240 AND 290 GROUP BY t")
def enso(spark, sf_dir):
    return rounded(spatial.box_mean(fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir)), "value")


@query(f"WITH RECURSIVE {PREP}, wb AS (SELECT t, cell, value FROM w JOIN grid USING (cell) WHERE lat BETWEEN 20 AND 70 AND lon BETWEEN 110 AND 250), {modes_sql('wb', 1)}, ix AS (SELECT t, list_dot_product(x, v) AS value FROM (SELECT t, list(value ORDER BY cell) AS x FROM wb GROUP BY t), v0) SELECT t, {r('(value - (SELECT avg(value) FROM ix)) / (SELECT stddev_samp(value) FROM ix)')} FROM ix")
def pdo(spark, sf_dir):
    """Leading mode of the weighted anomalies of a box, its index standardised."""
    grid = spatial.box(fields.nation_grid(spark, sf_dir), spatial.PDO_BOX)
    f = spatial.apply_mask(_prepared(spark, sf_dir), grid)
    loadings, _ = linalg.eof(f, 1)
    pcs = linalg.project(f, loadings).select("t", F.lit(0).cast("long").alias("cell"), "value")
    return rounded(scale.standardize_series(pcs).select("t", "value"), "value")


@query(f"WITH {F4}, {GRID}, a AS ({_climo('f4')}), q AS (SELECT t, cell, value AS f, lead(value) OVER (PARTITION BY cell ORDER BY t) AS o FROM a), s AS (SELECT cell, corr(f, o) AS lac, {CE} AS ce FROM q WHERE t < {_n('f4', 1)} GROUP BY cell) SELECT {r('sum(lac * cell_area) / sum(cell_area)', 'lac')}, {r('sum(ce * cell_area) / sum(cell_area)', 'ce')} FROM s JOIN grid USING (cell)")
def spatial_gm(spark, sf_dir):
    """Area-weighted means of the field skill: the summary row of a full verification."""
    a = temporal.anomaly(fields.orders_nation(spark, sf_dir), 12)
    s = verify.skill(temporal.lag_pair(a, 1).withColumnsRenamed({"x0": "f", "x1": "o"}))
    g = fields.nation_grid(spark, sf_dir)
    return rounded(verify.weighted_mean(s, g, "lac").join(F.broadcast(verify.weighted_mean(s, g, "ce"))), "lac", "ce")


# ---- ensembles -----------------------------------------------------------------------------------------------
#: Members: five priorities' totals of a region, standardised over all; reference: the next region's total, standardised.
#: The samples of the regions stand one after the other.
ENS = f"{MEMBERS}, {F3}, e AS (SELECT member, cell * {_n('f3')} + t AS t, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM em WINDOW w AS (PARTITION BY cell)), ref AS (SELECT (cell + 4) % 5 * {_n('f3')} + t AS t, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS o FROM f3 WINDOW w AS (PARTITION BY cell))"
SAMPLES = "(SELECT count(*) FROM ref)"


def _ens(spark, sf_dir):
    over = temporal.Window.partitionBy("cell")
    z = (F.col("value") - F.avg("value").over(over)) / F.stddev_samp("value").over(over)
    n = fields.months(spark, sf_dir)
    e = fields.orders_members(spark, sf_dir).withColumn("value", z).select("member", (F.col("cell") * n + F.col("t")).alias("t"), "value")
    ref = scale.standardize_series(fields.orders_region(spark, sf_dir)).select(((F.col("cell") + 4) % 5 * n + F.col("t")).alias("t"), "value")
    return e, ref


@query(f"WITH {ENS}, g AS (SELECT t, avg(value) AS m, var_samp(value) AS v FROM e GROUP BY t) SELECT {r('avg((m - o) * (m - o)) / avg(v)', 'ratio')} FROM g JOIN ref USING (t)")
def ens_calib(spark, sf_dir):
    return rounded(ensemble.calibration(*_ens(spark, sf_dir)), "ratio")


@query(f"WITH {MEMBERS}, {F3}, g AS (SELECT t, cell, avg(value) AS m, var_samp(value) AS v FROM em GROUP BY ALL) SELECT cell, {r('avg((m - value / 5) * (m - value / 5)) / avg(v)', 'ratio')} FROM g JOIN f3 USING (t, cell) GROUP BY cell")
def ens_calib_spatial(spark, sf_dir):
    ref = fields.orders_region(spark, sf_dir).withColumn("value", F.col("value") / 5)
    return rounded(ensemble.calibration_by_cell(fields.orders_members(spark, sf_dir), ref), "ratio")


@query(f"WITH {ENS}, k AS (SELECT t, sum(CASE WHEN value <= o THEN 1 ELSE 0 END)::BIGINT + 1 AS rank FROM e JOIN ref USING (t) GROUP BY t) SELECT rank, count(*)::BIGINT AS n FROM k GROUP BY rank")
def rank_hist(spark, sf_dir):
    return ensemble.rank_histogram(*_ens(spark, sf_dir))


def _prob(of: str = ">= 0.5", tag: str = "") -> str:
    return f"pr{tag} AS (SELECT t, avg(CASE WHEN value {of} THEN 1.0 ELSE 0.0 END)::DOUBLE AS p FROM e GROUP BY t), pb{tag} AS (SELECT t, p, o {of} AS occurred FROM pr{tag} JOIN ref USING (t))"


PROB = f"{ENS}, {_prob()}"
BIN = " + ".join(f"(p >= {x!r}::DOUBLE)::INT" for x in ensemble.EDGES) + " - 1"


@query(f"WITH {PROB} SELECT t, {r('p', 'p')}, occurred FROM pb")
def event_prob(spark, sf_dir):
    return rounded(ensemble.event_probability(*_ens(spark, sf_dir), "upper"), "p")


def _reliability(tag: str = "") -> str:
    return f"rg{tag} AS (SELECT {BIN} AS bin, avg(occurred::INT) AS h, avg(p) AS mp, count(*) AS n FROM pb{tag} GROUP BY 1), rl{tag} AS (SELECT b.bin, {r('h', 'hit_rate')}, {r('mp', 'mean_p')}, coalesce(n, 0)::BIGINT AS n FROM (SELECT range::INT AS bin FROM range(10)) b LEFT JOIN rg{tag} USING (bin))"


def _consistency(iterations: int, tag: str = "") -> str:
    return f"""dr{tag} AS (SELECT i, {_random(11, 'i', 'k')} % {SAMPLES} AS t, {_random(12, 'i', 'k')} / 4294967296.0::DOUBLE AS u FROM (SELECT range AS i FROM range({iterations})), (SELECT unnest(range({SAMPLES})) AS k)),
h{tag} AS (SELECT i, {BIN} AS bin, avg(CASE WHEN u < p THEN 1.0 ELSE 0.0 END)::DOUBLE AS h FROM dr{tag} JOIN (SELECT row_number() OVER (ORDER BY p, t) - 1 AS t, p FROM pb{tag}) USING (t) GROUP BY ALL), cg{tag} AS (SELECT bin, avg(h) AS m, quantile_cont(h, 0.025) AS q0, quantile_cont(h, 0.975) AS q1 FROM h{tag} GROUP BY bin HAVING count(*) = {iterations}),
mc{tag} AS (SELECT b.bin, {r('m - q0', 'lower')}, {r('q1 - m', 'upper')} FROM (SELECT range::INT AS bin FROM range(10)) b LEFT JOIN cg{tag} USING (bin))"""


@query(f"WITH {PROB}, {_reliability()} SELECT * FROM rl")
def reliability(spark, sf_dir):
    return rounded(ensemble.reliability(ensemble.event_probability(*_ens(spark, sf_dir), "upper")), "hit_rate", "mean_p")


@query(f"WITH {PROB}, {_consistency(CONSISTENT)} SELECT * FROM mc")
def reliability_mc(spark, sf_dir):
    return rounded(ensemble.reliability_bounds(ensemble.event_probability(*_ens(spark, sf_dir), "upper"), 5 * fields.months(spark, sf_dir), CONSISTENT), "lower", "upper")


# ---- sampling ------------------------------------------------------------------------------------------------
SPLIT = f"""{F3}, ts AS (SELECT t AS start FROM (SELECT DISTINCT t FROM f3 WHERE t < {_n('f3', 3)}) ORDER BY {_random(1, 't')}, t LIMIT (SELECT ceil({_n('f3', 3)} * 0.2)::BIGINT)),
te AS (SELECT start, lag, start + lag AS t FROM ts, (SELECT unnest([0, 1, 3]) AS lag)), us AS (SELECT DISTINCT t FROM te),
tr AS (SELECT DISTINCT t FROM f3 WHERE t NOT IN (SELECT t FROM us UNION SELECT t - 1 FROM us UNION SELECT t - 3 FROM us))"""


@query(f"WITH {SPLIT} SELECT 'test' AS part, lag, t, start AS other FROM te UNION ALL SELECT 'train', 0, t, t FROM tr UNION ALL SELECT 'pair', l.lag, a.t, b.t FROM tr a CROSS JOIN (SELECT unnest([1, 3]) AS lag) l JOIN tr b ON b.t = a.t + l.lag")
def train_test(spark, sf_dir):
    test, train, pairs = sampling.split(fields.orders_region(spark, sf_dir), fields.months(spark, sf_dir), 0.2, [1, 3])
    out = test.select(F.lit("test").alias("part"), "lag", "t", F.col("start").alias("other"))
    return out.union(train.select(F.lit("train"), F.lit(0), "t", F.col("t"))).union(pairs.select(F.lit("pair"), "lag", "t", "t1"))


@query(f"WITH {F3}, ms AS (SELECT DISTINCT cell * {_n('f3')} + t AS member FROM f3) SELECT member, {_random(5, 'member')} AS seed FROM ms")
def seeds(spark, sf_dir):
    """A seed for each sample of a field."""
    members = fields.orders_region(spark, sf_dir).select((F.col("cell") * fields.months(spark, sf_dir) + F.col("t")).alias("member")).distinct()
    return members.select("member", draw(5, F.col("member")).alias("seed"))


# ---- composed jobs -------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {THREE}, b AS (SELECT t, sum(value * cell_area) / sum(cell_area) AS glob_mean, avg(value) FILTER (lat BETWEEN -5 AND 5 AND lon BETWEEN 240 AND 290) AS enso FROM rc JOIN grid USING (cell) GROUP BY t)
SELECT t, 'glob_mean' AS name, {r('glob_mean')} FROM b UNION ALL SELECT t, 'enso', {r('enso')} FROM b""")
def scalar_outputs(spark, sf_dir):
    """Index series of a field through three modes."""
    f, grid = fields.orders_nation(spark, sf_dir), fields.nation_grid(spark, sf_dir)
    loadings, _ = linalg.eof(f, 3)
    pcs = linalg.project(f, loadings)
    parts = [verification.modes_index(pcs, loadings, verification.weights(grid, i), i).select("t", F.lit(i).alias("name"), "value") for i in ("glob_mean", "enso")]
    return rounded(parts[0].union(parts[1]), "value")


#: Index factors of the two modes, and series of forecast f, persistence g and truth o; the mode of the box comes from the rebuilt field.
PERFECT = f"""{MODEL}, {GRID}, {CELLS}, yb AS (SELECT t, cell, v0.v[i] * a + v1.v[i] * b AS value FROM z, cs, v0, v1), bx AS (SELECT yb.* FROM yb JOIN grid USING (cell) WHERE lat BETWEEN 20 AND 70 AND lon BETWEEN 110 AND 250), {modes_sql('bx', 1, 'x')},
ix AS (SELECT 'glob_mean' AS scalar, sum(v0.v[i] * cell_area) / sum(cell_area) AS fa, sum(v1.v[i] * cell_area) / sum(cell_area) AS fb FROM cs JOIN grid USING (cell), v0, v1
 UNION ALL SELECT 'enso', avg(v0.v[i]), avg(v1.v[i]) FROM cs JOIN grid USING (cell), v0, v1 WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 240 AND 290
 UNION ALL SELECT 'pdo', sum(v0.v[i] * vx0.v[j]), sum(v1.v[i] * vx0.v[j]) FROM (SELECT cs.cell, i, row_number() OVER (ORDER BY cs.cell) AS j FROM cs JOIN grid USING (cell) WHERE lat BETWEEN 20 AND 70 AND lon BETWEEN 110 AND 250), v0, v1, vx0),
sr AS (SELECT scalar, t - 2 AS t, fa * (g00 * a + g01 * b) + fb * (g10 * a + g11 * b) AS f, fa * a + fb * b AS g, lead(fa * a + fb * b) OVER (PARTITION BY scalar ORDER BY t) AS o FROM z, g, ix), q0 AS (SELECT * FROM sr WHERE o IS NOT NULL), {_booted(DRAWS, 'scalar', _n('f4', 5))},
fl AS (SELECT t, cell, v0.v[i] * (g00 * a + g01 * b) + v1.v[i] * (g10 * a + g11 * b) AS f, v0.v[i] * a + v1.v[i] * b AS g FROM z, g, cs, v0, v1), fo AS (SELECT *, lead(g) OVER (PARTITION BY cell ORDER BY t) AS o FROM fl),
sk AS (SELECT cell, {', '.join(f'{x} AS {p}{m}' for p, f in (('', 'f'), ('auto1_', 'g')) for m, x in _skill_sql(f).items())} FROM fo WHERE o IS NOT NULL GROUP BY cell)"""
_NONE = ", ".join(f"NULL::DOUBLE AS {p}{m}_{e}" for p in ("", "auto1_") for m in ("r", "ce") for e in ("low", "high"))
_COLUMNS = ", ".join(f"{p}{m}{e}" for p in ("", "auto1_") for m in ("r", "ce") for e in ("", "_low", "_high"))


@query(f"""WITH RECURSIVE {PERFECT}, every AS (SELECT scalar, {TABLE} FROM b GROUP BY scalar), mean AS (SELECT 'spatial_gm' AS scalar, {', '.join(r(f'sum({m} * cell_area) / sum(cell_area)', m) for m in ('r', 'ce', 'auto1_r', 'auto1_ce'))}, {_NONE} FROM sk JOIN grid USING (cell))
SELECT 'field' AS variable, 'none' AS average, scalar, {_COLUMNS} FROM every UNION ALL SELECT 'field', 'none', scalar, {_COLUMNS} FROM mean""")
def verif_perfect(spark, sf_dir):
    """The whole report of a lead-1 forecast of the smoothed nation field by its own model."""
    model, s, loadings = _model(spark, sf_dir)
    s = store.stored(s, "states")
    pcs = s.select("t", F.col("mode").cast("int").alias("mode"), "value")
    ahead = lim.forecast(s, model.g, [1]).select("t", F.col("mode").cast("int").alias("mode"), "value")
    grid = fields.nation_grid(spark, sf_dir)
    t = verification.perfect_forecast(pcs, ahead, loadings, grid, linalg.reconstruct(pcs, loadings), 1, fields.months(spark, sf_dir) - 5, 2, DRAWS)
    return rounded(t, *[c for c in t.columns if c not in ("variable", "average", "scalar")])


@query(f"WITH {ENS}, {_prob('>= 0.5', '_u')}, {_prob('<= -0.5', '_l')}, {_reliability('_u')}, {_reliability('_l')}, {_consistency(CONSISTENT, '_u')}, {_consistency(CONSISTENT, '_l')} " + " UNION ALL ".join(f"SELECT '{k}' AS event, rl_{k[0]}.*, lower, upper FROM rl_{k[0]} JOIN mc_{k[0]} USING (bin)" for k in ("upper", "lower")))
def verif_ens(spark, sf_dir):
    """Reliability with bounds of both events of an ensemble index."""
    report = verification.ensemble_report(*_ens(spark, sf_dir), 5 * fields.months(spark, sf_dir))
    parts = [report[f"reliability_{k}"].select(F.lit(k).alias("event"), "bin", "hit_rate", "mean_p", "n", "lower", "upper") for k in ("upper", "lower")]
    return rounded(parts[0].union(parts[1]), "hit_rate", "mean_p", "lower", "upper")


@query(f"""WITH RECURSIVE {MODEL}, {GRID}, {CELLS}, {ensemble_sql(UNITS, FROM_FIRST)}, fc AS (SELECT sum(v0.v[i] * cell_area) / sum(cell_area) AS fa, sum(v1.v[i] * cell_area) / sum(cell_area) AS fb FROM cs JOIN grid USING (cell), v0, v1), sd AS (SELECT stddev_samp(fa * a + fb * b) AS s FROM z, fc)
SELECT member::INT AS member, unit::INT AS t, {r('(fa * ma + fb * mb) / s')} FROM runs, fc, sd WHERE unit > 0""")
def long_scalar(spark, sf_dir):
    """The global mean of long integrations, in units of the source's deviation."""
    model, s, loadings = _model(spark, sf_dir)
    x0 = np.array([x.value for x in s.where("t = 2").orderBy("mode").collect()])
    w = verification.weights(fields.nation_grid(spark, sf_dir), "glob_mean")
    truth = verification.modes_index(s.select("t", F.col("mode").cast("int").alias("mode"), "value"), loadings, w, "glob_mean")
    series = verification.long_index(lim.ensemble(spark, model, x0, members=MEMBERS_RUN, length=UNITS), loadings, w, "glob_mean")
    return rounded(verification.standardized_by(series, truth), "value")
