"""Queries on windows, frequency axes, triads and grids: what needs no field."""

from __future__ import annotations

from pyspark.sql import functions as F

from triadic.functions import spectral
from triadic.operators import triads as T
from triadic.operators import weights as Q

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df, *columns: str, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


N = 64


def _window(name, periodic=False):
    return lambda spark, sf_dir: rounded(spectral.window_table(spark, name, N, periodic), "w")


HAMMING = "0.54 - 0.46 * cos(2 * pi() * n / {d})"
HANN = "0.5 * (1 - cos(2 * pi() * n / {d}))"
for _name, _taper, _periodic, _formula in (
    ("window_hamming", "hamming", False, HAMMING),
    ("window_hann", "hann", False, HANN),
    ("window_hann_periodic", "hann", True, HANN),
):
    query(_name, f"SELECT n, round({_formula.format(d=N if _periodic else N - 1)}, 9) + 0.0 AS w FROM range({N}) r(n)")(_window(_taper, _periodic))


@query("window_gain", f"SELECT round(1 / avg({HAMMING.format(d=N - 1)}), 9) AS gain FROM range({N}) r(n)")
def window_gain(spark, sf_dir):
    return rounded(spectral.window_gain(spectral.window_table(spark, "hamming", N)), "gain")


def _axis(n, dt):
    return lambda spark, sf_dir: rounded(spectral.frequency_axis(spark, n, dt), "freq")


def axis_sql(n, dt):
    return f'SELECT i AS "row", i - {n // 2} AS f_idx, round((i - {n // 2}) / {dt}::DOUBLE / {n}, 9) + 0.0 AS freq FROM range({n}) r(i)'


query("freq_axis_even", axis_sql(16, 0.5))(_axis(16, 0.5))
query("freq_axis_odd", axis_sql(15, 0.25))(_axis(15, 0.25))
query("freq_axis_by_index", axis_sql(16, 1 / 16))(_axis(16, None))


def triads_sql(n: int, dt: float, regions, bound: int | None, columns: str = "*") -> str:
    """An independent enumeration: a cross join, region tests as a list, numbering by one sort."""
    nyq, top = n // 2, (n - 1) // 2
    bound = nyq if bound is None else bound
    tests = {
        1: "k>=0 AND l>=0 AND l<=k", 2: "k>=0 AND l<=0 AND -l<=k", 3: "k>=0 AND l<=0 AND k<=-l", 4: "k<=0 AND l<=0 AND l<=k",
        5: "k<=0 AND l<=0 AND k<=l", 6: "k<=0 AND l>=0 AND l<=-k", 7: "k<=0 AND l>=0 AND -k<=l", 8: "k>=0 AND l>=0 AND k<=l",
    }
    best = "greatest(" + ", ".join(f"CASE WHEN {tests[r]} THEN {r} ELSE 0 END" for r in (*regions, regions[0])) + ")"
    return f"""SELECT {columns} FROM (
        SELECT row_number() OVER (ORDER BY k, l) - 1 AS triad_idx, k::INT AS k, l::INT AS l, (k + l)::INT AS kl,
            round(k / {dt}::DOUBLE / {n}, 9) + 0.0 AS f1, round(l / {dt}::DOUBLE / {n}, 9) + 0.0 AS f2, round((k + l) / {dt}::DOUBLE / {n}, 9) + 0.0 AS f3, region::INT AS region
        FROM (SELECT k, l, {best} AS region FROM range({-nyq}, {top + 1}) a(k), range({-nyq}, {top + 1}) b(l)
              WHERE abs(k + l) < {nyq} AND abs(k) <= {bound} AND abs(l) <= {bound}) WHERE region > 0)"""


CASES = {"triads_default": (32, 0.5, (1, 2), None), "triads_all_regions": (24, 1.0, tuple(range(1, 9)), None), "triads_bounded": (64, 0.12, (1, 2), 8), "triads_odd": (15, 0.5, (2, 7), None)}


def _table(spark, case):
    return T.triads(spark, *case)


for _name, _case in CASES.items():
    query(_name, triads_sql(*_case))(lambda spark, sf_dir, case=_case: rounded(_table(spark, case), "f1", "f2", "f3"))

ALL = CASES["triads_all_regions"]


@query("triad_region_counts", f"SELECT region, count(*) AS n FROM ({triads_sql(*ALL)}) GROUP BY region")
def triad_region_counts(spark, sf_dir):
    return _table(spark, ALL).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("triad_find", triads_sql(*CASES["triads_bounded"], columns="triad_idx, k, l, region") + " WHERE k = 5 AND l = -3")
def triad_find(spark, sf_dir):
    return _table(spark, CASES["triads_bounded"]).where("k = 5 AND l = -3").select("triad_idx", "k", "l", "region")


@query("triad_label", triads_sql(16, 1.0, (1,), 4, columns="triad_idx, '$(k,\\,l,\\,k+l) = (' || k || ',\\,' || l || ',\\,' || kl || ')$' AS label"))
def triad_label(spark, sf_dir):
    return T.triads(spark, 16, 1.0, (1,), 4).select("triad_idx", spectral.triad_label(F.col("k"), F.col("l")).alias("label"))


@query("freq_needed", f"WITH t AS ({triads_sql(*CASES['triads_bounded'])}) SELECT DISTINCT f_idx FROM (SELECT k AS f_idx FROM t UNION ALL SELECT l FROM t UNION ALL SELECT kl FROM t)")
def freq_needed(spark, sf_dir):
    return T.needed_frequencies(_table(spark, CASES["triads_bounded"]))


@query(
    "bispectrum_mask_grid",
    f"""WITH t AS ({triads_sql(*CASES["triads_odd"])}), g AS (SELECT k::INT AS k, l::INT AS l FROM range(-7, 8) a(k), range(-7, 8) b(l))
    SELECT g.k, g.l, t.triad_idx, t.triad_idx IS NOT NULL AS computed FROM g LEFT JOIN t ON g.k = t.k AND g.l = t.l""",
)
def bispectrum_mask_grid(spark, sf_dir):
    return T.dense_grid(spark, 15, _table(spark, CASES["triads_odd"]))


@query(
    "bispectrum_mask_complement",
    f"""WITH t AS ({triads_sql(*CASES["triads_odd"])}) SELECT k::INT AS k, l::INT AS l FROM range(-7, 8) a(k), range(-7, 8) b(l) EXCEPT SELECT k, l FROM t""",
)
def bispectrum_mask_complement(spark, sf_dir):
    t = _table(spark, CASES["triads_odd"])
    return T.dense_grid(spark, 15, t).select("k", "l").exceptAll(t.select("k", "l"))


X, Y, Z = (0.0, 0.1, 0.3, 0.6, 1.0, 1.5), (-1.0, -0.2, 0.0, 0.5, 2.0), (0.0, 1.0, 3.0)


def axis(spark, values):
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(values)], "i long, c double")


def _widths_sql(values, name):
    rows = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(values))
    return f"{name} AS (SELECT i, abs(coalesce(lead(c) OVER o, c) - coalesce(lag(c) OVER o, c)) / 2 AS w FROM (VALUES {rows}) v(i, c) WINDOW o AS (ORDER BY i))"


@query("weights_uniform", "SELECT p, v::INT AS v, 0.25::DOUBLE AS w FROM range(30) a(p), range(2) b(v)")
def weights_uniform(spark, sf_dir):
    return Q.uniform(spark.range(30).withColumnRenamed("id", "p"), 2, 0.25).select("p", "v", "w")


@query("weights_cell_widths", f"WITH {_widths_sql(X, 'x')} SELECT i, round(w, 9) AS width FROM x")
def weights_cell_widths(spark, sf_dir):
    return rounded(Q.cell_widths(axis(spark, X), "i", "c").select("i", "width"), "width")


@query("weights_trapz_2d", f"WITH {_widths_sql(X, 'x')}, {_widths_sql(Y, 'y')} SELECT y.i * {len(X)} + x.i AS p, v::INT AS v, round(x.w * y.w, 9) AS w FROM x, y, range(2) r(v)")
def weights_trapz_2d(spark, sf_dir):
    return rounded(Q.trapz_2d(axis(spark, X), axis(spark, Y), 2).select("p", "v", "w"), "w")


@query("weights_trapz_3d", f"WITH {_widths_sql(X, 'x')}, {_widths_sql(Y, 'y')}, {_widths_sql(Z, 'z')} SELECT (z.i * {len(Y)} + y.i) * {len(X)} + x.i AS p, round(x.w * y.w * z.w, 9) AS w FROM x, y, z")
def weights_trapz_3d(spark, sf_dir):
    return rounded(Q.trapz_3d(axis(spark, X), axis(spark, Y), axis(spark, Z), None).select("p", "w"), "w")


NR, NT = 9, 13


def annulus(spark):
    """A quarter of an annulus, radius along ix and angle along iy."""
    r, a = F.lit(1.0) + F.col("ix") / F.lit(float(NR - 1)), F.pi() / 2 * F.col("iy") / F.lit(float(NT - 1))
    grid = spark.range(NR * NT).select(F.col("id").alias("p"), F.floor(F.col("id") / NR).alias("iy"), (F.col("id") % NR).alias("ix"))
    return grid.select("p", "iy", "ix", (r * F.sin(a)).alias("y"), (r * F.cos(a)).alias("x"))


CURVILINEAR_SQL = f"""
WITH g AS (SELECT p, p // {NR} AS iy, p % {NR} AS ix FROM range({NR * NT}) r(p)),
c AS (SELECT *, (1 + ix / {NR - 1}.0) * sin(pi() / 2 * iy / {NT - 1}.0) AS y, (1 + ix / {NR - 1}.0) * cos(pi() / 2 * iy / {NT - 1}.0) AS x FROM g),
d AS (SELECT a.p, a.ix, a.iy,
        (e.x - w.x) / (e.ix - w.ix) AS xi, (e.y - w.y) / (e.ix - w.ix) AS yi, (n.x - s.x) / (n.iy - s.iy) AS xj, (n.y - s.y) / (n.iy - s.iy) AS yj
      FROM c a JOIN c e ON e.iy = a.iy AND e.ix = least(a.ix + 1, {NR - 1}) JOIN c w ON w.iy = a.iy AND w.ix = greatest(a.ix - 1, 0)
      JOIN c n ON n.ix = a.ix AND n.iy = least(a.iy + 1, {NT - 1}) JOIN c s ON s.ix = a.ix AND s.iy = greatest(a.iy - 1, 0))
SELECT p, round(abs(xi * yj - xj * yi) * CASE WHEN ix IN (0, {NR - 1}) THEN 0.5 ELSE 1 END * CASE WHEN iy IN (0, {NT - 1}) THEN 0.5 ELSE 1 END, 9) AS w FROM d
"""


@query("weights_curvilinear_2d", CURVILINEAR_SQL)
def weights_curvilinear_2d(spark, sf_dir):
    return rounded(Q.curvilinear_2d(annulus(spark), None).select("p", "w"), "w")
