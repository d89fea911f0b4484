"""Causal statistics of time series: lagged regressions, transfer entropy and their composite."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lagged(y: np.ndarray, p: int) -> np.ndarray:
    """Columns y(t-1) … y(t-p) for t from p on."""
    return np.column_stack([y[p - i - 1 : len(y) - i - 1] for i in range(p)])


def rss(design: np.ndarray, y: np.ndarray, ridge: float = 1e-8) -> float:
    """Sum of squared residuals of the regression of y on the design, with a slight ridge."""
    beta = np.linalg.solve(design.T @ design + ridge * np.eye(design.shape[1]), design.T @ y)
    return float(((y - design @ beta) ** 2).sum())


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * f


def f_test(x: np.ndarray, y: np.ndarray, p: int, level: float = 0.05) -> dict:
    """Whether lags of x help to predict y: f, p_value, significant and the gain in R²; neutral where there are too few points."""
    neutral = {"f": 0.0, "p_value": 1.0, "significant": False, "gain": 0.0}
    n = min(len(x), len(y))
    t = n - p
    if t <= 2 * p + 1:
        return neutral
    x, y = x[:n], y[:n]
    own, other, ones, goal = lagged(y, p), lagged(x, p), np.ones((t, 1)), y[p:]
    small, full = rss(np.hstack([own, ones]), goal), rss(np.hstack([own, other, ones]), goal)
    total = float(((goal - goal.mean()) ** 2).sum())
    gain = max(0.0, (small - full) / total) if total >= 1e-12 else 0.0
    free = t - 2 * p - 1
    if free <= 0 or full < 1e-12:
        return neutral | {"gain": round(gain, 6)}
    f = max(0.0, (small - full) / p / (full / free))
    tail = beta_tail(free / (free + p * f), free / 2, p / 2) if f > 0 else 1.0
    return {"f": round(f, 4), "p_value": round(tail, 6), "significant": tail < level, "gain": round(gain, 6)}


def best_lag(x: np.ndarray, y: np.ndarray, most: int = 3, criterion: str = "bic") -> int:
    """The lag of least BIC or AIC; 1 if none can be fitted."""
    n, best = min(len(x), len(y)), (math.inf, 1)
    for p in range(1, most + 1):
        t = n - p
        if t <= 2 * p + 2:
            break
        r = rss(np.hstack([lagged(y[:n], p), lagged(x[:n], p), np.ones((t, 1))]), y[p:n])
        if r > 0:
            k = 2 * p + 1
            best = min(best, (t * math.log(r / t) + (k * math.log(t) if criterion == "bic" else 2 * k), p))
    return best[1]


def transfer(x: np.ndarray, y: np.ndarray, p: int = 1, bins: int = 3) -> float:
    """Transfer entropy from x to y in nats over equal-frequency bins; 0 where there are too few points."""
    n = min(len(x), len(y))
    if n <= p + 1:
        return 0.0
    cut = lambda a: np.digitize(a, np.percentile(a, np.linspace(0, 100, bins + 1)[1:-1]))
    dx, dy = cut(x[:n]), cut(y[:n])
    rows = [(int(dy[t]), tuple(dy[t - p : t].tolist()), tuple(dx[t - p : t].tolist())) for t in range(p, n)]
    joint, pair, past, own = Counter(rows), Counter((b, c) for _, b, c in rows), Counter(b for _, b, _ in rows), Counter((a, b) for a, b, _ in rows)
    return max(0.0, sum(k / len(rows) * math.log((k / pair[b, c]) / (own[a, b] / past[b])) for (a, b, c), k in joint.items()))


def strength(significant: bool, gain: float, entropy: float, asymmetry: float) -> float:
    return min(1.0, 0.3 * significant + 0.3 * min(1.0, 5 * gain) + 0.2 * min(1.0, 10 * entropy) + 0.2 * min(1.0, max(0.0, 5 * asymmetry)))


RESULT = "lag int, f double, p_value double, significant boolean, gain double, reverse_f double, reverse_p double, asymmetry double, entropy double, dominant string, strength double, n int"


def analysis(x: np.ndarray, y: np.ndarray, most: int = 3) -> dict:
    """Both directions at the best lag, transfer entropy and composite strength; strength 0 under five points."""
    n = min(len(x), len(y))
    if n < 5:
        return {"lag": 0, "f": 0.0, "p_value": 1.0, "significant": False, "gain": 0.0, "reverse_f": 0.0, "reverse_p": 1.0, "asymmetry": 0.0, "entropy": 0.0, "dominant": "insufficient_data", "strength": 0.0, "n": n}
    p = best_lag(x, y, most)
    there, back = f_test(x, y, p), f_test(y, x, p)
    te = round(transfer(x, y, min(p, 2)), 6)
    way = {(True, False): "x_causes_y", (False, True): "y_causes_x", (True, True): "bidirectional", (False, False): "no_causality"}[bool(there["significant"]), bool(back["significant"])]
    asymmetry = round(there["gain"] - back["gain"], 6)
    return {
        "lag": p, "f": there["f"], "p_value": there["p_value"], "significant": bool(there["significant"]), "gain": there["gain"], "reverse_f": back["f"], "reverse_p": back["p_value"],
        "asymmetry": asymmetry, "entropy": te, "dominant": way, "strength": round(strength(bool(there["significant"]), there["gain"], te, asymmetry), 4), "n": n,
    }


def granger(points: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The full analysis of (keys, t, x, y): one row per series pair, keyed by ``keys``.

    A pair is one group of numbers in the order of t; rows with a null x or y are left out. A series is as long as its
    time axis, not as the data are many, so a group fits a task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        got = analysis(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), most)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | got])

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.select(*keys, "t", "x", "y").filter("x is not null and y is not null").groupBy(*keys).applyInPandas(one, f"{kinds}, {RESULT}")


def granger_lag1(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, f, gain) of the lag-1 test by aggregates alone: the normal equations of two and three unknowns in closed form.

    The regressions are on values less their means, which leaves residuals as they are; constant series give null.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    d = points.select(*keys, F.col("y"), F.lag("y").over(w).alias("b"), F.lag("x").over(w).alias("a")).filter("b is not null and a is not null")
    n = "count(*)"

    def s(u: str, v: str) -> str:
        return f"(sum({u} * {v}) - sum({u}) * sum({v}) / {n})"

    g = d.groupBy(*keys).agg(*[F.expr(e).alias(k) for k, e in {"n": n, "syy": s("y", "y"), "sbb": s("b", "b"), "saa": s("a", "a"), "syb": s("y", "b"), "sya": s("y", "a"), "sab": s("a", "b")}.items()])
    small, det = "(syy - syb * syb / sbb)", "(sbb * saa - sab * sab)"
    g = g.filter(f"n > 3 and sbb > 0 and {det} > 0 and syy > 0")
    full = f"(syy - (syb * syb * saa - 2 * syb * sya * sab + sya * sya * sbb) / {det})"
    return g.selectExpr(*keys, "n", f"round(({small} - {full}) / ({full} / (n - 3)), 4) AS f", f"round(({small} - {full}) / syy, 6) AS gain")


def transfer_entropy(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, te) of (keys, t, x, y) at lag 1 over three bins by exact percentiles, windows and counts."""
    cuts = points.groupBy(*keys).agg(F.expr("percentile(x, array(1D / 3, 2D / 3))").alias("cx"), F.expr("percentile(y, array(1D / 3, 2D / 3))").alias("cy"))
    binned = points.join(cuts, keys).select(*keys, "t", F.expr("size(filter(cx, c -> x >= c))").alias("bx"), F.expr("size(filter(cy, c -> y >= c))").alias("by"))
    w = Window.partitionBy(*keys).orderBy("t")
    rows = binned.select(*keys, F.col("by").alias("a"), F.lag("by").over(w).alias("b"), F.lag("bx").over(w).alias("c")).filter("b is not null")
    k = rows.groupBy(*keys, "a", "b", "c").agg(F.count("*").alias("_k"))
    by = lambda *cols: Window.partitionBy(*keys, *cols)
    p = k.select(*keys, "_k", F.sum("_k").over(by("b", "c")).alias("_bc"), F.sum("_k").over(by("a", "b")).alias("_ab"), F.sum("_k").over(by("b")).alias("_b"), F.sum("_k").over(by()).alias("_n"))
    return p.groupBy(*keys).agg(F.round(F.greatest(F.lit(0.0), F.sum(F.expr("_k / _n * ln((_k / _bc) / (_ab / _b))"))), 6).alias("te"))
