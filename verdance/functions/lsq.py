"""Least squares of ``y = a + b*x + c*e + d*x*e``, one fit per group.

The fit is one aggregation: every map task reduces its rows to one row of sums
per group, so a group of any size costs the same shuffle, and the 3x3 system is
solved with column arithmetic.

Raw sums over pixel numbers and flux units would lose digits (the condition
number of that design is near 5e4). Two things prevent it: ``x`` is scaled to
[-1, 1] by the caller, and ``e`` and ``y`` are taken relative to a value of
their own group that is known before: a sample, or else the means from a first
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions.arrays import record

PIVOT_LIMIT = 1e-12

_VARS = ("x", "e", "w", "y")
_PRODUCTS = [(a, b) for i, a in enumerate(_VARS) for b in _VARS[i:]]


def _pivot(value: str, scale: str) -> str:
    """A pivot, NULL where the design is singular."""
    return f"if({value} > {PIVOT_LIMIT} * {scale}, {value}, NULL)"


def fit_groups(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    x: str,
    e: str,
    e_shift: str | None = None,
    y_shift: str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Coefficients ``c0..c3`` of intercept, x, e, x*e and ``rsq`` per group.

    ``e_shift`` and ``y_shift`` name columns that are constant within a group; where
    one is left out, both are the means of a first aggregation over the keys.
    Rows with a missing value take no part. ``extra`` adds aggregates to the
    same pass. ``rsq`` is the squared correlation of observed and fitted
    values; it is NULL where either is constant. A singular design gives NULLs.
    """
    return solve_sums(fit_sums(df, keys, y, x, e, e_shift, y_shift, extra))


def fit_sums(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    x: str,
    e: str,
    e_shift: str | None = None,
    y_shift: str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """What a fit needs of its rows: one row per group with the number, the shifts and all sums of products.

    Such rows can be written, merged to coarser groups (:func:`merge_sums`) and solved (:func:`solve_sums`) later, so
    that new rows never ask for the old ones again. Arguments as in :func:`fit_groups`.
    """
    whole = f"{x} IS NOT NULL AND {e} IS NOT NULL AND {y} IS NOT NULL"
    if e_shift is None or y_shift is None:
        df, e_shift, y_shift = _with_means(df, keys, whole, e, y), "_mean_e", "_mean_y"
    e0, y0 = e_shift, y_shift
    rows = df.selectExpr(
        "*",
        f"if({whole}, double({x}), NULL) AS _x",
        f"if({whole}, double({e}) - ({e0}), NULL) AS _e",
        f"if({whole}, double({x}) * (double({e}) - ({e0})), NULL) AS _w",
        f"if({whole}, double({y}) - ({y0}), NULL) AS _y",
        f"{e0} AS _e0",
        f"{y0} AS _y0",
    )
    sums = ["count(_x) AS _n", "max(_e0) AS _e0", "max(_y0) AS _y0"]
    sums += [f"sum(_{a}) AS s_{a}" for a in _VARS]
    sums += [f"sum(_{a} * _{b}) AS s_{a}{b}" for a, b in _PRODUCTS]
    return rows.groupBy(*keys).agg(*[F.expr(s) for s in (*sums, *extra)])


def merge_sums(sums: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows of :func:`fit_sums` merged to the coarser groups ``keys``; ``extra`` adds aggregates.

    Groups were taken relative to shifts of their own. They are moved to the mean of the merged group first, a
    polynomial in the difference, so the merged sums keep their digits as if they had been taken there.
    """
    centre = sums.groupBy(*keys).agg(
        F.expr("try_divide(sum(_n * _e0 + s_e), sum(if(_n > 0, _n, NULL))) AS _e1"),
        F.expr("try_divide(sum(_n * _y0 + s_y), sum(if(_n > 0, _n, NULL))) AS _y1"),
    )
    centre = centre.select("_e1", "_y1", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & sums[k].eqNullSafe(centre[f"_key{i}"])
    moved = sums.join(centre, same).selectExpr("*", "_e0 - _e1 AS _d", "_y0 - _y1 AS _t")
    # with d and t the moves: e' = e + d, w' = w + d x, y' = y + t
    new = {
        "s_x": "s_x",
        "s_e": "s_e + _n * _d",
        "s_w": "s_w + _d * s_x",
        "s_y": "s_y + _n * _t",
        "s_xx": "s_xx",
        "s_xe": "s_xe + _d * s_x",
        "s_xw": "s_xw + _d * s_xx",
        "s_xy": "s_xy + _t * s_x",
        "s_ee": "s_ee + 2 * _d * s_e + _n * _d * _d",
        "s_ew": "s_ew + _d * (s_xe + s_w + _d * s_x)",
        "s_ey": "s_ey + _t * s_e + _d * s_y + _n * _d * _t",
        "s_ww": "s_ww + _d * (2 * s_xw + _d * s_xx)",
        "s_wy": "s_wy + _t * s_w + _d * (s_xy + _t * s_x)",
        "s_yy": "s_yy + _t * (2 * s_y + _n * _t)",
    }
    aggs = ["sum(_n) AS _n", "max(_e1) AS _e0", "max(_y1) AS _y0", *(f"sum({e}) AS {n}" for n, e in new.items())]
    return moved.groupBy(*keys).agg(*[F.expr(a) for a in (*aggs, *extra)])


def _with_means(df: DataFrame, keys: Sequence[str], whole: str, e: str, y: str) -> DataFrame:
    """``df`` with the means of e and y of its group: one row per group is joined back."""
    means = df.groupBy(*keys).agg(
        F.expr(f"coalesce(avg(if({whole}, double({e}), NULL)), 0D) AS _mean_e"),
        F.expr(f"coalesce(avg(if({whole}, double({y}), NULL)), 0D) AS _mean_y"),
    )
    means = means.select("_mean_e", "_mean_y", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = [df[k].eqNullSafe(means[f"_key{i}"]) for i, k in enumerate(keys)]
    return df.join(means, same).drop(*[f"_key{i}" for i in range(len(keys))])


def solve_sums(g: DataFrame) -> DataFrame:
    """Sums to coefficients, all in generated code.

    The result leaves through a one-element generator. Without it a filter on
    the result would be pushed below these projections, which replaces every
    intermediate name by its definition again and again until the code no
    longer compiles.
    """
    kept = [c for c in g.columns if not c.startswith(("_", "s_"))]
    steps = [
        # means, and centred sums of squares and products
        {f"m_{a}": f"try_divide(s_{a}, double(_n))" for a in _VARS},
        {f"v_{a}{b}": f"s_{a}{b} - m_{a} * s_{b}" for a, b in _PRODUCTS},
        # spreads; a variable without spread makes the fit singular. From here
        # on a singular pivot is NULL, never zero, so plain division is safe.
        {f"d_{a}": f"sqrt({_pivot(f'v_{a}{a}', f's_{a}{a}')})" for a in _VARS},
        # correlation matrix of (x, e, w) and its right-hand side
        {
            "l21": "v_xe / (d_x * d_e)",
            "l31": "v_xw / (d_x * d_w)",
            "r32": "v_ew / (d_e * d_w)",
            "z1": "v_xy / d_x",
            "r2": "v_ey / d_e",
            "r3": "v_wy / d_w",
        },
        # elimination
        {"p2": _pivot("(1D - l21 * l21)", "1D"), "t": "r32 - l31 * l21", "u2": "r2 - l21 * z1"},
        {"p3": _pivot("(1D - l31 * l31 - t * t / p2)", "1D"), "u3": "r3 - l31 * z1 - t * u2 / p2"},
        # back substitution; "fitted" is the centred sum of squares of the fit
        {"g3": "u3 / p3"},
        {"g2": "(u2 - t * g3) / p2", "fitted": "z1 * z1 + u2 * u2 / p2 + u3 * u3 / p3"},
        {"b_x": "(z1 - l21 * g2 - l31 * g3) / d_x", "b_e": "g2 / d_e", "b_w": "g3 / d_w"},
    ]
    for step in steps:
        g = g.selectExpr("*", *[f"{e} AS {name}" for name, e in step.items()])
    # undo the shift of e and y: w = x*e - x*e0
    result = {
        "c0": "_y0 + m_y - b_x * m_x - b_e * (m_e + _e0) - b_w * m_w",
        "c1": "b_x - b_w * _e0",
        "c2": "b_e",
        "c3": "b_w",
        "rsq": "if(fitted > 0, fitted / (d_y * d_y), NULL)",
    }
    return g.selectExpr(*kept, "_n AS n", f"inline_outer(array({record(result)}))")


def line(c_const: str, c_slope: str, n: int) -> str:
    """``c_const + c_slope * x`` for the samples ``1..n``."""
    return f"transform(sequence(1, {n}), x -> {c_const} + {c_slope} * double(x))"
