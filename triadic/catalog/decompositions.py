"""Queries on whole fits: radii, transfers, rankings, modes and maps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from triadic.catalog import spectra as C
from triadic.catalog.axes import rounded, triads_sql
from triadic.operators import estimators
from triadic.plans.config import FitConfig
from triadic.plans.decompose import fit, selected_for_saving, top_triads

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Two blocks: the numerical radius of a 2 x 2 matrix is a scan over angles of a closed form, which SQL can do.

DAY = FitConfig(n_dft=16, time_step=1.0, n_overlap=2, tol=1e-12)
DAY_CLEAN = FitConfig(n_dft=16, time_step=1.0, n_overlap=2, tol=1e-12, constituent_modes=True)
_FREQS = range(-8, 8)
_TRIADS = triads_sql(16, 1.0, (1, 2), None)

#: CTEs up to r(triad_idx, k, l, kl, f1, f2, f3, region, l_abs, l_re): a coarse scan of angles, then a fine one around the best.
RADIUS_SQL = f"""{C.standard_legs_sql(C.DAILY, _TRIADS, _FREQS, C.DAY)},
    b AS (SELECT triad_idx, i, j, sum(a.re * b.re + a.im * b.im) / 2 AS re, sum(a.re * b.im - a.im * b.re) / 2 AS im
          FROM (SELECT triad_idx, p, s, b AS i, re, im FROM total) a JOIN (SELECT triad_idx, p, s, b AS j, re, im FROM product) b USING (triad_idx, p, s) GROUP BY triad_idx, i, j),
    m AS (SELECT triad_idx, max(re) FILTER (i = 0 AND j = 0) AS ar, max(im) FILTER (i = 0 AND j = 0) AS ai, max(re) FILTER (i = 0 AND j = 1) AS br, max(im) FILTER (i = 0 AND j = 1) AS bi,
          max(re) FILTER (i = 1 AND j = 0) AS cr, max(im) FILTER (i = 1 AND j = 0) AS ci, max(re) FILTER (i = 1 AND j = 1) AS dr, max(im) FILTER (i = 1 AND j = 1) AS di FROM b GROUP BY triad_idx),
    c1 AS (SELECT m.*, n * 2 * pi() / 4000 AS t FROM m, range(4000) r(n)),
    v1 AS (SELECT *, (h1 + h2) / 2 + sqrt(((h1 - h2) / 2) ** 2 + gr ** 2 + gi ** 2) AS w FROM (SELECT *, ar * cos(t) - ai * sin(t) AS h1, dr * cos(t) - di * sin(t) AS h2,
          ((br + cr) * cos(t) - (bi + ci) * sin(t)) / 2 AS gr, ((br - cr) * sin(t) + (bi - ci) * cos(t)) / 2 AS gi FROM c1)),
    t1 AS (SELECT triad_idx, arg_max(t, w) AS t0 FROM v1 GROUP BY triad_idx),
    c2 AS (SELECT m.*, t0 + (n - 2000) * 2 * pi() / 4000 / 2000 AS t FROM m JOIN t1 USING (triad_idx), range(4001) r(n)),
    v2 AS (SELECT *, (h1 + h2) / 2 + sqrt(((h1 - h2) / 2) ** 2 + gr ** 2 + gi ** 2) AS w FROM (SELECT *, ar * cos(t) - ai * sin(t) AS h1, dr * cos(t) - di * sin(t) AS h2,
          ((br + cr) * cos(t) - (bi + ci) * sin(t)) / 2 AS gr, ((br - cr) * sin(t) + (bi - ci) * cos(t)) / 2 AS gi FROM c2)),
    r AS (SELECT tr.*, w AS l_abs, w * cos(t) AS l_re FROM (SELECT triad_idx, max(w) AS w, arg_max(t, w) AS t FROM v2 GROUP BY triad_idx) JOIN tr USING (triad_idx))"""

def radius_sql(legs: str, weight: str = "1", levels=((60, 10), *((13, n) for n in range(20, 34, 2)))) -> str:
    """CTEs up to r(triad_idx, k, l, ..., l_abs, l_re, t) for any number of blocks.

    exp(it) B has a Hermitian part whose largest eigenvalue is sought over t, on ever finer grids around the best. As a
    real symmetric matrix of twice the size, shifted to have no negative eigenvalue, it is squared again and again, which
    leaves the projector S on its top eigenspace: the eigenvalue is tr(S M) / tr(S), the transfer tr(S U) / tr(S).
    """
    steps, before, step = [], None, None
    for k, (angles, squarings) in enumerate(levels):
        if before is None:
            source, step = f"SELECT mt.*, n * 2 * pi() / {angles} AS th FROM mt, range({angles}) r(n)", 6.283185307179586 / angles
        else:
            step /= angles // 2
            source = f"SELECT mt.*, t0 + (n - {angles // 2}) * {step!r} AS th FROM mt JOIN {before} USING (triad_idx), range({angles}) r(n)"
        before = f"t{k}"
        steps.append(
            f"""m{k} AS (SELECT triad_idx, u, th, list_transform(a, lambda r, i: list_transform(r, lambda x, j: cos(th) * x + sin(th) * c[i][j] + (i = j)::INT)) AS m FROM ({source})),
    p{k} AS (SELECT triad_idx, u, th, m AS m0, m, 0 AS k FROM m{k}
        UNION ALL SELECT triad_idx, u, th, m0, list_transform(sq, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(sq, lambda q, i: q[i])))), k + 1
        FROM (SELECT *, list_transform(m, lambda r: list_transform(m, lambda q: list_inner_product(r, q))) AS sq FROM p{k} WHERE k < {squarings})),
    w{k} AS (SELECT triad_idx, th, list_inner_product(flatten(m), flatten(m0)) / list_sum(list_transform(m, lambda r, i: r[i])) - 1 AS w,
        list_inner_product(flatten(m), flatten(u)) / list_sum(list_transform(m, lambda r, i: r[i])) AS t FROM p{k} WHERE k = {squarings}),
    t{k} AS (SELECT triad_idx, max(w) AS w, arg_max(th, w) AS t0, arg_max(t, w) AS t FROM w{k} GROUP BY triad_idx)"""
        )
    return f"""{legs.replace("WITH ", "WITH RECURSIVE ", 1)},
    b AS (SELECT triad_idx, i, j, sum((a.re * b.re + a.im * b.im) * ({weight})) / any_value(nb) AS re, sum((a.re * b.im - a.im * b.re) * ({weight})) / any_value(nb) AS im,
              sum(a.re * b.re + a.im * b.im) / any_value(nb) AS ur, sum(a.re * b.im - a.im * b.re) / any_value(nb) AS ui
          FROM (SELECT triad_idx, p, s, b AS i, re, im FROM total) a JOIN (SELECT triad_idx, p, s, b AS j, re, im FROM product) b USING (triad_idx, p, s), nb GROUP BY triad_idx, i, j),
    pr AS (SELECT x.triad_idx, x.i, x.j, (x.re + y.re) / 2 AS p, (x.im + y.im) / 2 AS q, (x.im - y.im) / 2 AS r, (x.re - y.re) / 2 AS s, (x.ur + y.ur) / 2 AS v, (x.ui - y.ui) / 2 AS o
           FROM b x JOIN b y ON y.triad_idx = x.triad_idx AND y.i = x.j AND y.j = x.i),
    sc AS (SELECT triad_idx, sqrt(sum(re * re + im * im)) + 1e-300 AS f FROM b GROUP BY triad_idx),
    em AS (SELECT triad_idx, h, i, list((CASE WHEN g = h THEN p WHEN h = 0 THEN -r ELSE r END) / f ORDER BY g, j) AS a, list((CASE WHEN g = h THEN -q WHEN h = 0 THEN -s ELSE s END) / f ORDER BY g, j) AS c,
               list(CASE WHEN g = h THEN v WHEN h = 0 THEN -o ELSE o END ORDER BY g, j) AS u
           FROM pr JOIN sc USING (triad_idx), range(2) gg(g), range(2) hh(h) GROUP BY triad_idx, h, i),
    mt AS (SELECT triad_idx, list(a ORDER BY h, i) AS a, list(c ORDER BY h, i) AS c, list(u ORDER BY h, i) AS u FROM em GROUP BY triad_idx),
    {", ".join(steps)},
    r AS (SELECT tr.*, w * f AS l_abs, w * f * cos(t0) AS l_re, t FROM {before} JOIN sc USING (triad_idx) JOIN tr USING (triad_idx))"""


_LISTED = "triad_idx, k::BIGINT AS k, l::BIGINT AS l, kl::BIGINT AS kl, f1, f2, f3, region::BIGINT AS region"


def day_fit(spark, d, config=DAY):
    return fit(C.daily(spark, d), config)


@query("numerical_radius_2block", f"{RADIUS_SQL} SELECT triad_idx, k, l, round(l_abs, 5) + 0.0 AS l_abs FROM r")
def numerical_radius_2block(spark, d):
    return rounded(day_fit(spark, d).bispectrum.select("triad_idx", "k", "l", "l_abs"), "l_abs", digits=5)


@query("energy_transfer", f"{RADIUS_SQL} SELECT triad_idx, k, l, round(l_re, 4) + 0.0 AS t FROM r WHERE k <> 0 AND l <> 0")
def energy_transfer(spark, d):
    """With weights of 1 the transfer is the real part of L. Triads on the axes have real matrices, whose L has no definite sign."""
    return rounded(day_fit(spark, d).bispectrum.where("k <> 0 AND l <> 0").select("triad_idx", "k", "l", "t"), "t", digits=4)


def _ranked(order: str, where: str, n: int) -> str:
    return f"{RADIUS_SQL} SELECT {_LISTED}, round(exact, 4) + 0.0 AS value FROM (SELECT *, {order} AS exact FROM r WHERE {where}) ORDER BY exact DESC, triad_idx LIMIT {n}"


def _ranking(n, quantity, exclude_zero=True):
    return lambda spark, d: rounded(rounded(day_fit(spark, d).top_triads(n, quantity, exclude_zero), "f1", "f2", "f3"), "value", digits=4)


query("top_triads_L", _ranked("l_abs", "k <> 0 AND l <> 0", 10))(_ranking(10, "L"))
query("top_triads_T", _ranked("abs(l_re)", "k <> 0 AND l <> 0", 5))(_ranking(5, "t"))
query("top_triads_incl_zero", _ranked("l_abs", "true", 10))(_ranking(10, "L", False))


@query("save_modes_top_selection", f"{RADIUS_SQL} SELECT triad_idx FROM (SELECT triad_idx FROM r WHERE k <> 0 AND l <> 0 ORDER BY l_abs DESC, triad_idx LIMIT (SELECT ceil(0.1 * count(*))::BIGINT FROM r WHERE k <> 0 AND l <> 0))")
def save_modes_top_selection(spark, d):
    return selected_for_saving(day_fit(spark, d).bispectrum, 0.1)


@query("bispectrum_map", f"{RADIUS_SQL} SELECT f1, f2, round(ln(l_abs), 4) + 0.0 AS value FROM r")
def bispectrum_map(spark, d):
    return rounded(rounded(estimators.bispectrum_map(day_fit(spark, d).bispectrum), "f1", "f2"), "value", digits=4)


@query(
    "bispectrum_dense",
    f"{RADIUS_SQL}, g AS (SELECT k::INT AS k, l::INT AS l FROM range(-8, 8) a(k), range(-8, 8) b(l)) SELECT g.k, g.l, round(coalesce(l_abs, -1), 5) + 0.0 AS value FROM g LEFT JOIN r ON r.k = g.k AND r.l = g.l",
)
def bispectrum_dense(spark, d):
    """The full plane; entries off the triads, which are NaN, are shown as -1."""
    return rounded(day_fit(spark, d).dense().withColumn("value", F.nanvl("value", F.lit(-1.0))), "value", digits=5)


@query("bispectrum_levels", f"{RADIUS_SQL} SELECT i::INT AS i, round(top * i / 256, 4) + 0.0 AS level FROM (SELECT max(l_abs) AS top FROM r), range(257) s(i)")
def bispectrum_levels(spark, d):
    return rounded(estimators.contour_levels(day_fit(spark, d).bispectrum.select(F.col("l_abs").alias("value")), symmetric=False), "level", digits=4)


# ---- modes ---------------------------------------------------------------------------------------------------------

_CHOSEN = [0, 5, 20, 30]


def _modes(spark, d, config=DAY, ids=_CHOSEN):
    return day_fit(spark, d, config).modes_of(ids)


#: CTE z: the maximiser of a triad's 2 x 2 form at its best angle, of norm 1, with its larger entry positive; CTE psi: the normalised legs at each point.
MODES_SQL = f"""{RADIUS_SQL},
    e AS (SELECT triad_idx, v.x AS x, v.gr AS gr, v.gi AS gi, sqrt(v.x ** 2 + v.gr ** 2 + v.gi ** 2) AS n, sqrt(v.gr ** 2 + v.gi ** 2) AS g
          FROM (SELECT triad_idx, arg_max({{'x': w - h2, 'gr': gr, 'gi': gi}}, w) AS v FROM v2 GROUP BY triad_idx)),
    z AS (SELECT triad_idx, b, CASE WHEN abs(x) >= g THEN (CASE WHEN b = 0 THEN abs(x) ELSE sign(x) * gr END) ELSE (CASE WHEN b = 0 THEN x * gr / g ELSE g END) END / n AS zr,
              CASE WHEN abs(x) >= g THEN (CASE WHEN b = 0 THEN 0 ELSE -sign(x) * gi END) ELSE (CASE WHEN b = 0 THEN x * gi / g ELSE 0 END) END / n AS zi FROM e, range(2) s(b)),
    legs AS (SELECT 0 AS comp, * FROM total UNION ALL SELECT 1, * FROM product
        UNION ALL SELECT 2, triad_idx, p, v, b, re, im FROM tr JOIN q ON q.f = tr.k UNION ALL SELECT 3, triad_idx, p, v, b, re, im FROM tr JOIN q ON q.f = tr.l),
    raw AS (SELECT triad_idx, comp::INT AS comp, p, s::INT AS s, sum(re * zr - im * zi) AS re, sum(re * zi + im * zr) AS im FROM legs JOIN z USING (triad_idx, b) GROUP BY triad_idx, comp, p, s),
    size AS (SELECT triad_idx, comp, sqrt(sum(re * re + im * im)) AS norm FROM raw GROUP BY triad_idx, comp),
    psi AS (SELECT triad_idx, comp, p, s, re / norm AS re, im / norm AS im, sqrt(re * re + im * im) / norm AS modulus FROM raw JOIN size USING (triad_idx, comp))"""
_ONES = f"triad_idx IN {tuple(_CHOSEN)}"
_MODULI = "triad_idx, comp, p, s, round(modulus, 4) + 0.0 AS modulus"


def _with_moduli(modes):
    return rounded(modes.select("triad_idx", "comp", "p", "s", F.hypot("re", "im").alias("modulus")), "modulus", digits=4)


@query("mode_norms", f"{MODES_SQL} SELECT triad_idx, comp, round(norm, 4) + 0.0 AS before, 1.0::DOUBLE AS after FROM size WHERE {_ONES} AND comp < 2")
def mode_norms(spark, d):
    """Norms of the legs that the coefficients combine, and of the modes made of them."""
    result = day_fit(spark, d)
    before = result.bispectrum.select("triad_idx", F.posexplode("norms").alias("comp", "before"))
    after = result.modes_of(_CHOSEN).groupBy("triad_idx", "comp").agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("after"))
    return rounded(rounded(after.join(before, ["triad_idx", "comp"]).select("triad_idx", "comp", "before", "after"), "before", digits=4), "after")


@query("constituent_modes", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE {_ONES}")
def constituent_modes(spark, d):
    return _with_moduli(_modes(spark, d, DAY_CLEAN))


@query("reconstruct_modes", f"{MODES_SQL} SELECT triad_idx, comp, p, s, round(modulus, 4) + 0.0 AS modulus, 1.0::DOUBLE AS overlap FROM psi WHERE triad_idx IN (5, 20) AND comp < 2")
def reconstruct_modes(spark, d):
    """Modes rebuilt in the declarative path, and their overlap with those of the chunked engine: 1 whatever their phase."""
    from triadic.operators import spectra as S
    from triadic.operators import triads as T

    field, result = C.daily(spark, d), day_fit(spark, d)
    ids = [5, 20]
    chosen = T.triads(spark, 16, 1.0).where(F.col("triad_idx").isin(ids))
    legs = S.triad_legs(S.realizations(field, 16, 14, S.number_of_blocks(field, **C.DAY), list(_FREQS)), chosen)
    a = result.coeffs.where(F.col("triad_idx").isin(ids)).select("triad_idx", F.col("block").alias("b"), F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    plain = None
    for comp, leg in enumerate(legs):
        own = S.normalised(S.combined(leg, a)).withColumn("comp", F.lit(comp))
        plain = own if plain is None else plain.unionByName(own)
    other = result.reconstruct_modes(field, ids).select("triad_idx", "comp", "p", "s", F.col("re").alias("xr"), F.col("im").alias("xi"))
    both = plain.join(other, ["triad_idx", "comp", "p", "s"])
    inner = both.groupBy("triad_idx", "comp").agg(F.sum(F.col("re") * F.col("xr") + F.col("im") * F.col("xi")).alias("r"), F.sum(F.col("re") * F.col("xi") - F.col("im") * F.col("xr")).alias("i"))
    overlap = rounded(inner.select("triad_idx", "comp", F.hypot("r", "i").alias("overlap")), "overlap")
    return _with_moduli(plain).join(overlap, ["triad_idx", "comp"]).select("triad_idx", "comp", "p", F.col("s").cast("int").alias("s"), "modulus", "overlap")


_SAVED = "(SELECT triad_idx FROM r WHERE k <> 0 AND l <> 0 ORDER BY l_abs DESC, triad_idx LIMIT (SELECT ceil(0.1 * count(*))::BIGINT FROM r WHERE k <> 0 AND l <> 0))"


@query("modes_top", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE comp < 2 AND triad_idx IN {_SAVED}")
def modes_top(spark, d):
    """Modes of the strongest tenth of triads."""
    result = day_fit(spark, d)
    return _with_moduli(result.modes_of(selected_for_saving(result.bispectrum, 0.1)))


@query(
    "interaction_map",
    f"{MODES_SQL} SELECT triad_idx, p, s, round(a.modulus * b.modulus, 4) + 0.0 AS value FROM psi a JOIN psi b USING (triad_idx, p, s) WHERE a.comp = 0 AND b.comp = 1 AND triad_idx IN {tuple(_CHOSEN)}",
)
def interaction_map(spark, d):
    return rounded(estimators.interaction_map(_modes(spark, d)), "value", digits=4)


@query("mode_moduli", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE {_ONES} AND comp < 2")
def mode_moduli(spark, d):
    """Moduli of modes, which the free phase of the coefficients leaves alone."""
    return _with_moduli(_modes(spark, d))


@query(
    "mode_panels",
    f"""{MODES_SQL}, g AS (SELECT triad_idx, comp AS row, s, p, re AS value FROM psi WHERE s = 0 UNION ALL
        SELECT a.triad_idx, -1, a.s, a.p, a.modulus * b.modulus FROM psi a JOIN psi b USING (triad_idx, p, s) WHERE a.comp = 0 AND b.comp = 1 AND a.s = 0)
    SELECT triad_idx, row, s AS var, (p // nx)::INT AS iy, (p % nx)::INT AS ix, round(value, 3) + 0.0 AS value, round(max(abs(value)) OVER (PARTITION BY triad_idx, row, s), 3) + 0.0 AS level_max
    FROM g, (SELECT max(p) + 1 AS nx FROM f) WHERE triad_idx IN (5, 20)""",
)
def mode_panels(spark, d):
    """Real parts on the grid of points: coefficients have their largest entry positive, which fixes the phase."""
    result = day_fit(spark, d, DAY_CLEAN)
    return rounded(estimators.mode_panels(result.modes_of([5, 20]), result.nx, [0]), "value", "level_max", digits=3)


# ---- larger fits ---------------------------------------------------------------------------------------------------

HOUR = FitConfig(n_dft=48, time_step=1.0, overlap=25, max_freq_idx=8)
CROSS = FitConfig(n_dft=48, time_step=1.0, overlap=25, max_freq_idx=8, n_variables=3, state_idx=(0, 1), qr_idx=((1, 2), (0, 2)))
_SPECTRUM = ("triad_idx", "k", "l", "region", "l_abs", "t")


@query("mode_bispectrum")
def mode_bispectrum(spark, d):
    return fit(C.hourly(spark, d), HOUR, C.point_weights(spark, d)).bispectrum.select(*_SPECTRUM)


@query("cross_mode_bispectrum")
def cross_mode_bispectrum(spark, d):
    return fit(C.hourly3(spark, d), CROSS, C.point_weights(spark, d)).bispectrum.select(*_SPECTRUM)


DAY_SAME = FitConfig(n_dft=16, time_step=1.0, n_overlap=2, tol=1e-12, state_idx=(0,), qr_idx=((0, 0),))


@query("cross_fit_reduces_to_standard", f"{RADIUS_SQL} SELECT triad_idx, round(l_abs, 5) + 0.0 AS l_abs FROM r")
def cross_fit_reduces_to_standard(spark, d):
    """A fit of products of variables whose only product is that of a variable with itself."""
    return rounded(day_fit(spark, d, DAY_SAME).bispectrum.select("triad_idx", "l_abs"), "l_abs", digits=5)


@query(
    "radius_bounds",
    f"""WITH m AS ({C.ORACLES["bispectral_matrix"]}) SELECT triad_idx, round(max(sqrt(re * re + im * im)) FILTER (i = j), 4) + 0.0 AS low, round(sqrt(sum(re * re + im * im)), 4) + 0.0 AS high, true AS within FROM m GROUP BY triad_idx""",
)
def radius_bounds(spark, d):
    """|L| lies between the largest diagonal entry of B and its Frobenius norm, B being that of the declarative path."""
    config = FitConfig(n_dft=48, time_step=1.0, overlap=25, max_freq_idx=4)
    solved = fit(C.hourly(spark, d), config).bispectrum.select("triad_idx", "l_abs")
    b = C.bispectral_matrix(spark, d)
    sides = b.groupBy("triad_idx").agg(F.max(F.when(F.col("i") == F.col("j"), F.hypot("re", "im"))).alias("low"), F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("high"))
    return rounded(solved.join(sides, "triad_idx").select("triad_idx", "low", "high", (F.col("l_abs").between(F.col("low") - 1e-4, F.col("high") + 1e-4)).alias("within")), "low", "high", digits=4)


# Fits of a few blocks, whose radii SQL can find for matrices of any size.

_FEW = {
    "hourly": (C.hourly, C.HOURLY, {"n_dft": 192, "step": 144}, 6, (1, 2)),
    "lineitem": (C.lineitem_daily, C.LINEITEM, {"n_dft": 1249, "step": 625}, 5, (1, 2)),
    "orders": (C.orders_daily, C.ORDERS, {"n_dft": 1202, "step": 601}, 6, (1, 2)),
    "embedding": (C.embedding_signal, C.EMBEDDINGS, {"n_dft": 200, "step": 100}, 3, tuple(range(1, 9))),
}


def _few(name: str, variables: int = 1) -> FitConfig:
    _, _, shape, bound, regions = _FEW[name]
    return FitConfig(n_dft=shape["n_dft"], time_step=1.0, n_overlap=shape["n_dft"] - shape["step"], max_freq_idx=bound, regions=regions, n_variables=variables, tol=1e-12)


def _few_sql(name: str, weight: str = "1", terms=None, field: str | None = None) -> str:
    _, sql, shape, bound, regions = _FEW[name]
    triads, freqs = triads_sql(shape["n_dft"], 1.0, regions, bound), range(-2 * bound, 2 * bound + 1)
    legs = C.standard_legs_sql(sql, triads, freqs, shape) if terms is None else C.cross_legs_sql(field, terms, triads, freqs, shape)
    return radius_sql(legs, weight)


_RADII = "SELECT triad_idx, k, l, region, round(l_abs, {n}) + 0.0 AS l_abs FROM r"
_TRANSFERS = "SELECT triad_idx, k, l, round(t, {n}) + 0.0 AS t FROM r WHERE k <> 0 AND l <> 0 AND kl <> 0"


def _radii(result, digits: int):
    return rounded(result.bispectrum.select("triad_idx", "k", "l", "region", "l_abs"), "l_abs", digits=digits)


@query("radius_weighted_few_blocks", f"{_few_sql('hourly', C.WEIGHT)} {_RADII.format(n=5)}")
def radius_weighted_few_blocks(spark, d):
    return _radii(fit(C.hourly(spark, d), _few("hourly"), C.point_weights(spark, d)), 5)


@query("energy_transfer_weighted", f"{_few_sql('hourly', C.WEIGHT)} {_TRANSFERS.format(n=3)}")
def energy_transfer_weighted(spark, d):
    """With weights the transfer is the form of another matrix than the one whose radius is sought."""
    rows = fit(C.hourly(spark, d), _few("hourly"), C.point_weights(spark, d)).bispectrum.where("k <> 0 AND l <> 0 AND kl <> 0")
    return rounded(rows.select("triad_idx", "k", "l", "t"), "t", digits=3)


_CROSS_TERMS = [(0, 0, 0, 1, 2), (1, 1, 0, 0, 2)]


@query("cross_radius_few_blocks", f"{_few_sql('hourly', C.WEIGHT, _CROSS_TERMS, C.HOURLY3)} {_RADII.format(n=5)}")
def cross_radius_few_blocks(spark, d):
    config = replace(_few("hourly", 3), state_idx=(0, 1), qr_idx=((1, 2), (0, 2)))
    return _radii(fit(C.hourly3(spark, d), config, C.point_weights(spark, d)), 5)


@query("lineitem_radius_few_blocks", f"{_few_sql('lineitem')} {_RADII.format(n=5)}")
def lineitem_radius_few_blocks(spark, d):
    return _radii(fit(C.lineitem_daily(spark, d), _few("lineitem", 2)), 5)


@query("orders_radius_few_blocks", f"{_few_sql('orders')} {_RADII.format(n=5)}")
def orders_radius_few_blocks(spark, d):
    return _radii(fit(C.orders_daily(spark, d), _few("orders")), 5)


@query("embedding_radius_few_blocks", f"{_few_sql('embedding')} {_RADII.format(n=6)}")
def embedding_radius_few_blocks(spark, d):
    return _radii(fit(C.embedding_signal(spark, d), _few("embedding")), 6)


@query("radius_in_chunks", f"{RADIUS_SQL} SELECT triad_idx, round(l_abs, 5) + 0.0 AS l_abs FROM r")
def radius_in_chunks(spark, d):
    """Matrices added up over chunks of one point."""
    return rounded(day_fit(spark, d, replace(DAY, chunk_values=1)).bispectrum.select("triad_idx", "l_abs"), "l_abs", digits=5)


@query("radius_of_a_scaled_field", f"{RADIUS_SQL} SELECT triad_idx, round(l_abs, 5) + 0.0 AS l_abs FROM r")
def radius_of_a_scaled_field(spark, d):
    """A field a thousand times smaller has radii 10 ** 9 times smaller."""
    small = C.daily(spark, d).withColumn("value", F.col("value") / 1000)
    return rounded(fit(small, DAY).bispectrum.select("triad_idx", (F.col("l_abs") * 1e9).alias("l_abs")), "l_abs", digits=5)


@query("radius_in_single_precision", f"{RADIUS_SQL} SELECT triad_idx, round(l_abs, 2) + 0.0 AS l_abs FROM r")
def radius_in_single_precision(spark, d):
    return rounded(day_fit(spark, d, replace(DAY, dtype="single")).bispectrum.select("triad_idx", "l_abs"), "l_abs", digits=2)


@query("lineitem_bispectrum")
def lineitem_bispectrum(spark, d):
    """Two variables at once: quantity and price of line items by day, weeks of four."""
    config = FitConfig(n_dft=28, time_step=1.0, n_variables=2, regions=(1, 2), max_freq_idx=10)
    return fit(C.lineitem_daily(spark, d), config).bispectrum.select(*_SPECTRUM)


@query("orders_top_triads")
def orders_top_triads(spark, d):
    return fit(C.orders_daily(spark, d), FitConfig(n_dft=56, time_step=1.0, max_freq_idx=14)).top_triads(10)


@query("embedding_bispectrum")
def embedding_bispectrum(spark, d):
    return fit(C.embedding_signal(spark, d), FitConfig(n_dft=50, time_step=1.0, regions=tuple(range(1, 9)), max_freq_idx=8)).bispectrum.select(*_SPECTRUM)


WAVES = FitConfig(n_dft=128, time_step=1.0, overlap=0, window="hann", regions=(1,), max_freq_idx=40)


@query("surrogate_triad", "SELECT 357::BIGINT AS triad_idx, 26::BIGINT AS k, 6::BIGINT AS l, 32::BIGINT AS kl")
def surrogate_triad(spark, d):
    """Three waves of which the third's frequency is the sum of the others': their triad is the strongest."""
    return top_triads(fit(C.wave_triad(spark, d), WAVES).bispectrum, 1).select("triad_idx", "k", "l", "kl")


@query("surrogate_spectrum", f"WITH {C.dft_sql(C.WAVES, (0, 6, 26, 32), 128, 128)} SELECT f::INT AS f, b::INT AS b, round(sum(re * re + im * im), 6) + 0.0 AS power FROM q GROUP BY f, b")
def surrogate_spectrum(spark, d):
    from triadic.operators import spectra as S

    q = S.realizations(C.wave_triad(spark, d), 128, 128, 10, [0, 6, 26, 32])
    return rounded(q.groupBy("f", "b").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("power")), "power", digits=6)
