"""Queries from tables to fields, block spectra, bispectral matrices and point estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from triadic.catalog.axes import HAMMING, HANN, rounded, triads_sql
from triadic.operators import estimators
from triadic.operators import spectra as S
from triadic.operators import triads as T
from triadic.sources import fields

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


#: Values are divided by these so that spectra are of order 1 and rounding is relative.
EVENT_SCALE, PRICE_SCALE = 1000.0, 100000.0

# ---- fields in SQL -------------------------------------------------------------------------------------------------

def _gridded_sql(rows: str, measures: list[str]) -> str:
    """rows: a query of (tick, name, ...); measures: aggregates of them. Times and points are those of the table."""
    values = " UNION ALL ".join(f"SELECT t, p, {v} AS v, coalesce(m{v}, 0)::DOUBLE AS value FROM s" for v in range(len(measures)))
    return f"""WITH e AS (SELECT * FROM ({rows}) WHERE tick IS NOT NULL), o AS (SELECT min(tick) AS lo, max(tick) AS hi FROM e),
        y AS (SELECT name, row_number() OVER (ORDER BY name NULLS LAST) - 1 AS p FROM (SELECT DISTINCT name FROM e)),
        c AS (SELECT unnest(range(hi - lo + 1)) AS t, lo FROM o),
        s AS (SELECT c.t, y.p, {", ".join(f"{m} AS m{i}" for i, m in enumerate(measures))} FROM c CROSS JOIN y LEFT JOIN e ON e.tick = c.t + c.lo AND e.name IS NOT DISTINCT FROM y.name GROUP BY c.t, y.p)
        SELECT t, p, v, value FROM ({values})"""


def _events_sql(every: str, measures: tuple[str, ...], scale: float = 1.0) -> str:
    known = {"count": "count(e.value)", "sum": "sum(e.value)", "max": "max(e.value)"}
    step = {"hour": 3600, "day": 86400}[every]
    return _gridded_sql(f"SELECT floor(epoch(ts) / {step})::BIGINT AS tick, event_type AS name, value FROM events", [f"{known[m]}::DOUBLE / {scale}" for m in measures])


HOURLY, DAILY = _events_sql("hour", ("sum",), EVENT_SCALE), _events_sql("day", ("sum",), EVENT_SCALE)
HOURLY3 = _events_sql("hour", ("count", "sum", "max"), EVENT_SCALE)
EMBEDDINGS = "SELECT t, (i - 1)::BIGINT AS p, 0 AS v, e[i]::DOUBLE AS value FROM (SELECT vec_id AS t, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
LINEITEM = _gridded_sql("SELECT floor(epoch(l_shipdate) / 86400)::BIGINT AS tick, l_returnflag || l_linestatus AS name, l_quantity, l_extendedprice FROM lineitem", ["sum(l_quantity) / 100", f"sum(l_extendedprice) / {PRICE_SCALE}"])
ORDERS = _gridded_sql("SELECT floor(epoch(o_orderdate) / 86400)::BIGINT AS tick, o_orderpriority AS name, o_totalprice FROM orders", [f"sum(o_totalprice) / {PRICE_SCALE}"])
WAVE_F, WAVE_K = (0.046875, 0.203125, 0.25), (3.2, 1.35, 0.2)
WAVES = "SELECT t, p::BIGINT AS p, 0 AS v, " + " + ".join(f"cos({k} * (p * 2 * pi() / 100) - 2 * pi() * {f} * t)" for f, k in zip(WAVE_F, WAVE_K)) + " AS value FROM range(1280) a(t), range(100) b(p)"

hourly = lambda spark, d: fields.events(spark, d, "hour", ("sum",), EVENT_SCALE)
hourly3 = lambda spark, d: fields.events(spark, d, "hour", ("count", "sum", "max"), EVENT_SCALE)
daily = lambda spark, d: fields.events(spark, d, "day", ("sum",), EVENT_SCALE)
embedding_signal = fields.embeddings
lineitem_daily = lambda spark, d: fields.lineitem_daily(spark, d, scale=(100.0, PRICE_SCALE))
orders_daily = lambda spark, d: fields.orders_daily(spark, d, scale=PRICE_SCALE)
wave_triad = lambda spark, d: fields.waves(spark, WAVE_F, WAVE_K)


def _round_sql(sql: str) -> str:
    return f"SELECT t, p, v, round(value, 8) + 0.0 AS value FROM ({sql})"


for _name, _build, _sql in (
    ("field_events_hourly", hourly, HOURLY),
    ("field_events_hourly_3var", hourly3, HOURLY3),
    ("field_events_daily", daily, DAILY),
    ("field_embeddings", embedding_signal, EMBEDDINGS),
    ("field_lineitem_daily", lineitem_daily, LINEITEM),
    ("field_orders_daily", orders_daily, ORDERS),
):
    query(_name, _round_sql(_sql))(lambda spark, d, build=_build: rounded(build(spark, d), "value", digits=8))


@query("field_concat_time", f"WITH f AS ({DAILY}) SELECT t, p, v, round(value, 6) + 0.0 AS value FROM f UNION ALL SELECT t + 30, p, v, round(2 * value, 6) + 0.0 FROM f")
def field_concat_time(spark, d):
    f = daily(spark, d)
    return rounded(S.concat_in_time([f, f.withColumn("value", F.col("value") * 2)]), "value", digits=6)


@query("field_shape", f"SELECT max(t) + 1 AS nt, max(p) + 1 AS nx, (max(v) + 1)::BIGINT AS nv, count(*) AS n FROM ({HOURLY3})")
def field_shape(spark, d):
    f = hourly3(spark, d)
    return f.agg((F.max("t") + 1).alias("nt"), (F.max("p") + 1).alias("nx"), (F.max("v") + 1).cast("long").alias("nv"), F.count(F.lit(1)).alias("n"))


@query("long_time_mean", f"SELECT p, v, round(avg(value), 6) + 0.0 AS mean FROM ({LINEITEM}) GROUP BY p, v")
def long_time_mean(spark, d):
    return rounded(S.long_time_mean(lineitem_daily(spark, d)), "mean", digits=6)


# ---- blocks and spectra --------------------------------------------------------------------------------------------

HOUR = {"n_dft": 48, "step": 36}  # a quarter of overlap
BOUND = 4
DAY = {"n_dft": 16, "step": 14}


@query(
    "blocks_membership",
    f"""WITH f AS ({HOURLY}), nb AS (SELECT (max(t) + 1 - 12) // 36 AS nb FROM f), s AS (SELECT unnest(range(nb)) AS b FROM nb)
    SELECT p, b::INT AS b, count(*) AS n, min(t) AS first_t, max(t) AS last_t, min(t - b * 36)::INT AS first_n, max(t - b * 36)::INT AS last_n
    FROM f, s WHERE t >= b * 36 AND t < b * 36 + 48 GROUP BY p, b""",
)
def blocks_membership(spark, d):
    field = hourly(spark, d)
    cut = S.blocks_of(field, **HOUR, n_blocks=S.number_of_blocks(field, **HOUR))
    return cut.groupBy("p", "b").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


def blocks_sql(field: str, n_dft: int, step: int, taper: str = HAMMING, periodic: bool = False) -> str:
    w = taper.format(d=n_dft if periodic else n_dft - 1)
    return f"""f AS ({field}), nb AS (SELECT (max(t) + 1 - {n_dft - step}) // {step} AS nb FROM f), bs AS (SELECT unnest(range(nb)) AS b FROM nb), mean AS (SELECT p, v, avg(value) AS mean FROM f GROUP BY p, v),
        win AS (SELECT n, {w} AS w FROM range({n_dft}) r(n)),
        y AS (SELECT b, n, p, v, (value - mean) * w AS y FROM bs JOIN win ON true JOIN f ON f.t = b * {step} + n JOIN mean USING (p, v))"""


def dft_sql(field: str, freqs, n_dft: int, step: int, taper: str = HAMMING, periodic: bool = False) -> str:
    """CTEs up to q(f, p, v, b, re, im)."""
    angle = f"2 * pi() * ((f * n) % {n_dft}) / {n_dft}"
    return f"""{blocks_sql(field, n_dft, step, taper, periodic)},
        q AS (SELECT f, p, v, b, sum(y * cos({angle})) * g / {n_dft} AS re, -sum(y * sin({angle})) * g / {n_dft} AS im
              FROM y, unnest([{", ".join(map(str, freqs))}]) u(f), (SELECT 1 / avg(w) AS g FROM win) GROUP BY f, p, v, b, g)"""


@query("blocks_windowed", f"WITH {blocks_sql(DAILY, **DAY)} SELECT b::INT AS b, n::INT AS n, p, v, round(y, 6) + 0.0 AS y FROM y")
def blocks_windowed(spark, d):
    field = daily(spark, d)
    out = S.windowed_blocks(field, **DAY, n_blocks=S.number_of_blocks(field, **DAY))
    return rounded(out.select("b", F.col("n").cast("int").alias("n"), "p", "v", "y"), "y", digits=6)


FREQS = list(range(-BOUND, 2 * BOUND + 1))


def hourly_qhat(spark, d, build=hourly):
    """Spectra of the field's blocks, and how many blocks there are."""
    field = build(spark, d)
    n = S.number_of_blocks(field, **HOUR)
    return S.realizations(field, HOUR["n_dft"], HOUR["step"], n, FREQS), n


@query("dft_realizations", f"WITH {dft_sql(HOURLY, FREQS, **HOUR)} SELECT f::INT AS f, p, v, b::INT AS b, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM q")
def dft_realizations(spark, d):
    return rounded(hourly_qhat(spark, d)[0], "re", "im", digits=6)


# ---- bispectral matrices -------------------------------------------------------------------------------------------


def b_triads(spark):
    return T.triads(spark, HOUR["n_dft"], 1.0, (1, 2), BOUND)


TRIADS = triads_sql(HOUR["n_dft"], 1.0, (1, 2), BOUND)
WEIGHT = "1 + p / 4.0"  # by point
_PAIR = "x.re * y.re - x.im * y.im AS re, x.re * y.im + x.im * y.re AS im"


def _matrix_sql(legs: str, weight: str = "1") -> str:
    return f"""{legs} SELECT triad_idx, i::INT AS i, j::INT AS j, round(sum((a.re * b.re + a.im * b.im) * ({weight})) / any_value(nb), 6) + 0.0 AS re, round(sum((a.re * b.im - a.im * b.re) * ({weight})) / any_value(nb), 6) + 0.0 AS im
        FROM (SELECT triad_idx, p, s, b AS i, re, im FROM total) a JOIN (SELECT triad_idx, p, s, b AS j, re, im FROM product) b USING (triad_idx, p, s), nb GROUP BY triad_idx, i, j"""


def standard_legs_sql(field: str, triads: str = TRIADS, freqs=None, shape=None) -> str:
    return f"""WITH {dft_sql(field, freqs or FREQS, **(shape or HOUR))}, tr AS ({triads}),
        total AS (SELECT triad_idx, p, v AS s, b, re, im FROM tr JOIN q ON q.f = tr.kl),
        product AS (SELECT triad_idx, x.p, x.v AS s, x.b, {_PAIR} FROM tr JOIN q x ON x.f = tr.k JOIN q y ON y.f = tr.l AND y.p = x.p AND y.v = x.v AND y.b = x.b)"""


def cross_legs_sql(field: str, terms: list[tuple], triads: str = TRIADS, freqs=None, shape=None) -> str:
    rows = ", ".join(map(str, terms))
    return f"""WITH {dft_sql(field, freqs or FREQS, **(shape or HOUR))}, tr AS ({triads}), te AS (SELECT * FROM (VALUES {rows}) v(state, s_v, term, q_v, r_v)),
        total AS (SELECT triad_idx, p, state AS s, b, re, im FROM tr JOIN q ON q.f = tr.kl JOIN (SELECT DISTINCT state, s_v FROM te) ON v = s_v),
        product AS (SELECT triad_idx, x.p, state AS s, x.b, sum(x.re * y.re - x.im * y.im) AS re, sum(x.re * y.im + x.im * y.re) AS im
            FROM tr JOIN te ON true JOIN q x ON x.f = tr.k AND x.v = q_v JOIN q y ON y.f = tr.l AND y.v = r_v AND y.p = x.p AND y.b = x.b GROUP BY triad_idx, x.p, state, x.b)"""


def _matrix(spark, d, field=hourly, terms=None, weights=None):
    q, n = hourly_qhat(spark, d, field)
    table = None if terms is None else spark.createDataFrame(terms, "state int, s_v int, term int, q_v int, r_v int")
    total, product = S.triad_legs(q, b_triads(spark), table)
    return rounded(S.bispectral_matrix(total, product, n, weights), "re", "im", digits=6)


def point_weights(spark, d):
    points = fields.table(spark, d, "events").select("event_type").distinct().count()
    return spark.range(points).select(F.col("id").alias("p"), (F.lit(1.0) + F.col("id") / F.lit(4.0)).alias("w"))


@query("bispectral_matrix", _matrix_sql(standard_legs_sql(HOURLY)))
def bispectral_matrix(spark, d):
    return _matrix(spark, d)


@query("bispectral_matrix_weighted", _matrix_sql(standard_legs_sql(HOURLY), WEIGHT))
def bispectral_matrix_weighted(spark, d):
    return _matrix(spark, d, weights=point_weights(spark, d))


ONE_TERM, TWO_TERMS, SAME = [(0, 0, 0, 1, 2)], [(0, 0, 0, 1, 2), (0, 0, 1, 0, 1), (1, 1, 0, 0, 2)], [(0, 0, 0, 0, 0)]


@query("cross_bispectral_matrix", _matrix_sql(cross_legs_sql(HOURLY3, ONE_TERM), WEIGHT))
def cross_bispectral_matrix(spark, d):
    return _matrix(spark, d, hourly3, ONE_TERM, point_weights(spark, d))


@query("cross_two_terms", _matrix_sql(cross_legs_sql(HOURLY3, TWO_TERMS)))
def cross_two_terms(spark, d):
    return _matrix(spark, d, hourly3, TWO_TERMS)


@query("cross_reduces_to_standard", _matrix_sql(standard_legs_sql(HOURLY)))
def cross_reduces_to_standard(spark, d):
    """The cross form with a variable as state and as both factors: the same matrices as of the variable with itself."""
    return _matrix(spark, d, hourly, SAME)


# ---- point estimates -----------------------------------------------------------------------------------------------

POINT_N = 32


def point_spectra(spark, d):
    field = hourly(spark, d)
    return estimators.block_dft(field, POINT_N, S.number_of_blocks(field, POINT_N, POINT_N), list(range(POINT_N // 2)))


_POINT = dft_sql(HOURLY, range(POINT_N // 2), POINT_N, POINT_N, HANN, True)


@query("amplitude_spectrum", f"WITH {_POINT} SELECT f::INT AS f, p, v, round(2 * avg(sqrt(re * re + im * im)), 6) AS amplitude FROM q GROUP BY f, p, v")
def amplitude_spectrum(spark, d):
    return rounded(estimators.amplitude_spectrum(point_spectra(spark, d)), "amplitude", digits=6)


@query(
    "classical_bispectrum",
    f"""WITH {_POINT}, m AS (SELECT a.p, a.v, a.f AS i, c.f AS j, avg((a.re * c.re - a.im * c.im) * s.re + (a.re * c.im + a.im * c.re) * s.im) AS re, avg((a.re * c.im + a.im * c.re) * s.re - (a.re * c.re - a.im * c.im) * s.im) AS im
        FROM q a JOIN q c ON c.b = a.b AND c.p = a.p AND c.f <= a.f JOIN q s ON s.b = a.b AND s.p = a.p AND s.f = a.f + c.f WHERE a.f + c.f < {POINT_N // 2} GROUP BY ALL)
    SELECT p, v, i::INT AS i, j::INT AS j, round(sqrt(re * re + im * im), 6) AS value FROM m""",
)
def classical_bispectrum(spark, d):
    return rounded(estimators.classical_bispectrum(point_spectra(spark, d), POINT_N // 2, POINT_N), "value", digits=6)


def _embedding_grid(spark, d):
    f = embedding_signal(spark, d)
    return f.select("t", F.floor(F.col("p") / 8).cast("int").alias("iy"), (F.col("p") % 8).cast("int").alias("ix"), F.col("value").alias("re"), F.lit(0.0).alias("im"))


_GRID = f"g AS (SELECT t, p // 8 AS iy, p % 8 AS ix, value FROM ({EMBEDDINGS}))"


@query("symmetric_fraction", f"WITH {_GRID} SELECT a.t, round(sum(((a.value + m.value) / 2) ** 2) / sum(a.value ** 2), 6) AS fraction FROM g a JOIN g m ON m.t = a.t AND m.ix = a.ix AND m.iy = 7 - a.iy GROUP BY a.t")
def symmetric_fraction(spark, d):
    return rounded(estimators.symmetric_fraction(_embedding_grid(spark, d), 8, ["t"]), "fraction", digits=6)


#: The grid has eight columns, so a transform padded to 4096 is a sum of eight terms for each wavenumber.
_PAD = 4096


@query(
    "streamwise_wavelength",
    f"""WITH {_GRID}, r AS (SELECT t, iy, list(value ORDER BY ix) AS row FROM g GROUP BY t, iy),
    a AS (SELECT m, list(cos(2 * pi() * m * ix / {_PAD}) ORDER BY ix) AS c, list(sin(2 * pi() * m * ix / {_PAD}) ORDER BY ix) AS d FROM range(1, {_PAD // 2 + 1}) r(m), range(8) x(ix) GROUP BY m),
    w AS (SELECT t, m, sum(list_inner_product(row, c) ** 2 + list_inner_product(row, d) ** 2) AS power FROM r, a GROUP BY t, m)
    SELECT t, round({_PAD} * 0.5 / arg_max(m, power), 6) AS wavelength FROM w GROUP BY t""",
)
def streamwise_wavelength(spark, d):
    return rounded(estimators.streamwise_wavelength(_embedding_grid(spark, d), 0.5, _PAD, ["t"]), "wavelength", digits=6)
