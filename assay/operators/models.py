"""OLS, logistic, Poisson and NB2 regression: each pass over the data is one aggregate, the algebra is on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D
from ..functions.columns import RID
from . import formula as formulas

KINDS = ("ols", "logistic", "poisson", "negbin")
MOST_ROUNDS = 50
LAG_ROWS = 1_000_000


class FitError(ValueError):
    def __init__(self, kind: str, message: str, hint: str = ""):
        super().__init__(message)
        self.kind, self.hint = kind, hint


@dataclass
class Fitted:
    kind: str
    formula: str
    design: formulas.Design
    params: list[float]
    cov: list[list[float]]
    n_obs: int
    df_resid: float
    llf: float
    aic: float
    bic: float
    robust: bool = False
    scale: float = 1.0
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return self.design.names

    @property
    def se(self) -> list[float]:
        return [math.sqrt(max(0.0, self.cov[i][i])) for i in range(len(self.params))]

    def coefficients(self) -> list[dict[str, Any]]:
        """estimate, std_err, statistic, p_value, ci: t for plain OLS, else normal."""
        by_t = self.kind == "ols" and not self.robust
        q = D.t_ppf(0.975, self.df_resid) if by_t else D.norm_ppf(0.975)
        out = []
        for name, b, s in zip(self.names, self.params, self.se, strict=True):
            t = b / s if s else math.nan
            p = (D.t_two_sided(t, self.df_resid) if by_t else 2 * D.norm_sf(abs(t))) if s else math.nan
            out.append({"name": name, "estimate": b, "std_err": s, "statistic": t, "p_value": p, "ci": [b - q * s, b + q * s]})
        return out

    def eta(self, df: DataFrame) -> Column:
        """The linear predictor as an expression over ``df``."""
        return reduce(lambda a, b: a + b, [F.lit(b) * e for b, (_, e) in zip(self.params, formulas.columns(self.design, df), strict=True)])

    def mean(self, df: DataFrame) -> Column:
        return inverse_link(self.kind, self.eta(df))


def inverse_link(kind: str, eta: Column) -> Column:
    return eta if kind == "ols" else 1 / (1 + F.exp(-eta)) if kind == "logistic" else F.exp(eta)


def _x(k: int) -> list[Column]:
    return [F.col(f"x{i}") for i in range(k)]


def _dot(beta: np.ndarray, x: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)])


def sums(data: DataFrame, k: int, weight: Column | None, right: Column, more: dict[str, Column] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(sum w x x', sum x r, further sums) in one aggregate."""
    x = _x(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    own = [F.sum((weight * x[i] * x[j]) if weight is not None else x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs]
    row = data.agg(*own, *[F.sum(x[i] * right).alias(f"b{i}") for i in range(k)], *[F.sum(c).alias(n) for n, c in (more or {}).items()]).first()
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), {n: row[n] or 0.0 for n in more or {}}


def prepared(df: DataFrame, formula: str, kind: str, keep: list[str] | None = None) -> tuple[formulas.Design, DataFrame]:
    try:
        design = formulas.design_of(formula, df)
        data = formulas.complete(formulas.frame(design, df, keep), design)
    except formulas.FormulaError as e:
        raise FitError("formula_error", str(e)) from e
    return design, data


def check_outcome(data: DataFrame, kind: str) -> int:
    """Rows; raises where the outcome does not fit the kind."""
    y = F.col("y")
    r = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(y < 0).alias("neg"), F.count_if(y != F.floor(y)).alias("frac"), F.count_if(~y.isin(0.0, 1.0)).alias("other"), F.count_if(y == 1).alias("ones")).first()
    if r["n"] == 0:
        raise FitError("formula_error", "no complete rows")
    if kind == "negbin" and (r["neg"] or r["frac"]):
        raise FitError("negbin_requires_nonneg_int", f"{r['neg']} negative and {r['frac']} fractional outcomes")
    if kind == "poisson" and r["neg"]:
        raise FitError("formula_error", "the outcome has negative values")
    if kind == "logistic" and (r["other"] or not 0 < r["ones"] < r["n"]):
        raise FitError("formula_error", "the outcome must be 0 or 1, with both present")
    return r["n"]


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


def _inverse(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def ols_from_sums(a: np.ndarray, b: np.ndarray, yy: float, y: float, n: int, intercept: bool) -> dict[str, Any]:
    beta = _solve(a, b)
    rss = max(0.0, yy - float(beta @ b))
    tss = yy - y * y / n if intercept else yy
    k = len(beta)
    df = n - k
    scale = rss / df if df > 0 else math.nan
    llf = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.inf
    r2 = 1 - rss / tss if tss else math.nan
    return {"beta": beta, "rss": rss, "tss": tss, "scale": scale, "llf": llf, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - intercept) / df if df > 0 else math.nan, "df": df}


def fit(df: DataFrame, formula: str, kind: str = "ols", robust: bool = False) -> Fitted:
    if kind not in KINDS:
        raise FitError("invalid_kind", kind)
    if robust and kind != "ols":
        raise FitError("robust_not_supported", "robust errors are for OLS")
    design, data = prepared(df, formula, kind)
    data = data.persist()
    try:
        n = check_outcome(data, kind)
        return {"ols": _fit_ols, "logistic": _fit_logistic, "poisson": _fit_poisson, "negbin": _fit_negbin}[kind](data, design, formula, n, robust)
    finally:
        data.unpersist()


def _fit_ols(data: DataFrame, design: formulas.Design, formula: str, n: int, robust: bool) -> Fitted:
    k = len(design.names)
    y = F.col("y")
    # centring the outcome keeps the residual sum of squares exact enough to subtract
    shift = data.agg(F.avg("y")).first()[0] if design.intercept else 0.0
    a, b, more = sums(data, k, None, y - F.lit(shift), {"yy": (y - F.lit(shift)) ** 2, "y": y - F.lit(shift)})
    if np.linalg.matrix_rank(a, tol=1e-10 * max(1.0, np.abs(a).max())) < k and np.linalg.cond(a) > 1e18:
        a = a.copy()
    s = ols_from_sums(a, b, more["yy"], more["y"], n, design.intercept)
    beta = s["beta"].copy()
    if design.intercept:
        beta[0] += shift
    inverse = _inverse(a)
    resid = y - _dot(beta, _x(k))
    exact = data.agg(F.sum(resid * resid)).first()[0]
    s["rss"], s["scale"] = exact, exact / s["df"] if s["df"] > 0 else math.nan
    s["llf"] = -n / 2 * (math.log(2 * math.pi * exact / n) + 1) if exact > 0 else math.inf
    cov = inverse * s["scale"]
    if robust:
        x = _x(k)
        h = reduce(lambda p, q: p + q, [F.lit(float(inverse[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(k) for j in range(i, k)])
        meat, _, _ = sums(data, k, (resid / (1 - h)) ** 2, F.lit(0.0))
        cov = inverse @ meat @ inverse
    r2 = 1 - exact / s["tss"] if s["tss"] else math.nan
    adj = 1 - (1 - r2) * (n - design.intercept) / s["df"] if s["df"] > 0 else math.nan
    llf = s["llf"]
    return Fitted("ols", formula, design, beta.tolist(), cov.tolist(), n, s["df"], llf, -2 * llf + 2 * k, -2 * llf + k * math.log(n), robust, s["scale"], {"r_squared": r2, "adj_r_squared": adj, "xtx": a.tolist(), "rss": exact})


def _log1pexp(e: Column) -> Column:
    return F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))


def _newton(data: DataFrame, k: int, start: np.ndarray, parts, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Maximise a log-likelihood; ``parts(eta)`` gives (weight, score, log-likelihood) expressions. Steps are halved while they lose."""
    beta, last = start, -math.inf
    step = np.zeros(k)
    for _ in range(MOST_ROUNDS):
        weight, score, ll = parts(_dot(beta, _x(k)))
        a, b, more = sums(data, k, weight, score, {"ll": ll})
        if more["ll"] < last - 1e-9 * abs(last) and np.abs(step).max() > 1e-8:
            step = step / 2
            beta = beta - step
            continue
        step = _solve(a, b)
        if not np.isfinite(step).all():
            return beta, a, more["ll"], False
        last = more["ll"]
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()) or float(step @ b) < 1e-14 * max(1.0, abs(last)):
            return beta + step, a, last, True
        beta = beta + step
    return beta, a, last, False


def _fit_logistic(data: DataFrame, design: formulas.Design, formula: str, n: int, robust: bool) -> Fitted:
    k, y = len(design.names), F.col("y")

    def parts(eta: Column):
        p = 1 / (1 + F.exp(-eta))
        return p * (1 - p), y - p, y * eta - _log1pexp(eta)

    beta, a, ll, settled = _newton(data, k, np.zeros(k), parts)
    cov = _inverse(a)
    se = np.sqrt(np.abs(np.diag(cov)))
    if not settled or not np.isfinite(se).all() or np.abs(beta).max() > 30 and (np.abs(beta).max() > 1e3 or se.max() > 1e3 or abs(ll) < 1e-6 * n):
        gram, _, _ = sums(data, k, None, F.lit(0.0))
        if np.linalg.matrix_rank(gram) < k:
            raise FitError("formula_error", "the design matrix is rank deficient")
        if not np.isfinite(se).all() or np.abs(beta).max() > 30 or se.max() > 1e3 or abs(ll) < 1e-6 * n:
            raise FitError("perfect_separation", "some predictors separate the outcomes perfectly")
        raise FitError("convergence_failed", "Newton's method did not settle")
    ones = data.agg(F.sum("y")).first()[0]
    share = ones / n
    null = ones * math.log(share) + (n - ones) * math.log(1 - share)
    return Fitted("logistic", formula, design, beta.tolist(), cov.tolist(), n, n - k, ll, -2 * ll + 2 * k, -2 * ll + k * math.log(n), extra={"pseudo_r_squared": 1 - ll / null, "ll_null": null})


def _log_factorials(data: DataFrame) -> float:
    """Sum of log y!, over counts of distinct outcomes."""
    counts = data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    return float(sum(r["n"] * math.lgamma(r["y"] + 1) for r in counts))


def _fit_poisson(data: DataFrame, design: formulas.Design, formula: str, n: int, robust: bool) -> Fitted:
    k, y = len(design.names), F.col("y")
    mean = data.agg(F.avg("y")).first()[0]
    start = np.zeros(k)
    if design.intercept:
        start[0] = math.log(max(mean, 1e-6))

    def parts(eta: Column):
        mu = F.exp(F.least(eta, F.lit(300.0)))
        return mu, y - mu, y * eta - mu

    beta, a, ll, settled = _newton(data, k, start, parts)
    if not settled:
        raise FitError("convergence_failed", "Newton's method did not settle")
    fixed = _log_factorials(data)
    mu = F.exp(_dot(beta, _x(k)))
    chi = data.agg(F.sum((y - mu) ** 2 / mu)).first()[0]
    ll -= fixed
    null = n * mean * math.log(mean) - n * mean - fixed if mean > 0 else 0.0
    return Fitted("poisson", formula, design, beta.tolist(), _inverse(a).tolist(), n, n - k, ll, -2 * ll + 2 * k, -2 * ll + k * math.log(n), extra={"pseudo_r_squared": 1 - ll / null if null else math.nan, "pearson_chi2": chi, "dispersion": chi / (n - k)})


def _fit_negbin(data: DataFrame, design: formulas.Design, formula: str, n: int, robust: bool) -> Fitted:
    """Joint Newton over coefficients and dispersion. Gamma functions are summed over distinct outcomes only."""
    k, y = len(design.names), F.col("y")
    first = _fit_poisson(data, design, formula, n, False)
    beta = np.array(first.params)
    counts = data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    ys, ns = np.array([r["y"] for r in counts], float), np.array([r["n"] for r in counts], float)
    fixed = float((ns * D.log_gamma(ys + 1)).sum())
    alpha = max(0.05, (first.extra["dispersion"] - 1) / max(1e-9, float((ys * ns).sum() / n)))
    theta, last, step = np.append(beta, math.log(alpha)), -math.inf, np.zeros(k + 1)
    settled = False
    for _ in range(3 * MOST_ROUNDS):
        b, al = theta[:k], math.exp(min(50.0, max(-50.0, theta[k])))
        r = 1 / al
        eta = _dot(b, _x(k))
        mu = F.exp(F.least(eta, F.lit(300.0)))
        d = 1 + F.lit(al) * mu
        weight = mu * (1 + F.lit(al) * y) / (d * d)
        score = (y - mu) / d
        cross = {f"c{i}": x * mu * (y - mu) / (d * d) for i, x in enumerate(_x(k))}
        a, g, m = sums(data, k, weight, score, {"ld": F.log1p(F.lit(al) * mu), "ye": y * eta, "yld": y * F.log1p(F.lit(al) * mu), "s1": mu / d, "s2": mu * mu / (d * d), "y1": y * mu / d, "y2": y * mu * mu / (d * d), **cross})
        ll = float((ns * (D.log_gamma(ys + r) - D.log_gamma(r))).sum()) - fixed - r * m["ld"] + math.log(al) * float((ys * ns).sum()) + m["ye"] - m["yld"]
        if ll < last - 1e-10 * abs(last) and np.abs(step).max() > 1e-9:
            step = step / 2
            theta = theta - step
            continue
        last = ll
        psi, psi1 = ns @ (D.digamma(ys + r) - D.digamma(r)), ns @ (D.trigamma(ys + r) - D.trigamma(r))
        sy = float((ys * ns).sum())
        # derivatives by alpha, then by its logarithm
        ga = -psi * r * r + m["ld"] * r * r - r * m["s1"] + sy / al - m["y1"]
        haa = psi1 * r**4 + 2 * psi * r**3 - 2 * r**3 * m["ld"] + 2 * r * r * m["s1"] + r * m["s2"] - sy / al**2 + m["y2"]
        hba = np.array([-m[f"c{i}"] for i in range(k)])
        h = np.zeros((k + 1, k + 1))
        h[:k, :k], h[:k, k], h[k, :k], h[k, k] = -a, hba * al, hba * al, haa * al * al + ga * al
        grad = np.append(g, ga * al)
        step = -_solve(h, grad)
        if float(step @ grad) < 0:
            step = np.append(_solve(a, g), np.sign(ga) * 0.5)
        step = np.clip(step, -5, 5)
        at_poisson = theta[k] < -12 and np.abs(step[:k]).max() <= 1e-9 * max(1.0, np.abs(theta[:k]).max())
        if at_poisson or np.abs(step).max() <= 1e-9 * max(1.0, np.abs(theta).max()):
            settled = True  # a dispersion that runs to zero leaves the Poisson model
            break
        theta = theta + step
    if not settled and not np.isfinite(theta).all():
        raise FitError("convergence_failed", "the negative binomial fit did not settle")
    # covariance over (beta, alpha) from the observed information
    info = np.zeros((k + 1, k + 1))
    info[:k, :k], info[:k, k], info[k, :k], info[k, k] = a, -hba, -hba, -haa
    cov = _inverse(info)
    alpha_se = math.sqrt(cov[k, k]) if cov[k, k] > 0 else None
    p = k + 1
    pseudo = 0.0
    if k > 1 or not design.intercept:
        empty = formulas.Design(design.outcome, design.outcome_source, True, [], names=["Intercept"])
        null = _fit_negbin(data.select(F.lit(1.0).alias("x0"), "y"), empty, formula, n, False)
        pseudo = 1 - last / null.llf
    return Fitted("negbin", formula, design, theta[:k].tolist(), cov[:k, :k].tolist(), n, n - k, last, -2 * last + 2 * p, -2 * last + p * math.log(n), extra={"alpha": al, "alpha_se": alpha_se, "converged": settled, "pseudo_r_squared": pseudo})


# --- diagnostics ---------------------------------------------------------------------------------


def lag_sum(data: DataFrame, order: str, value: str) -> float:
    """Sum of squared differences of neighbours in ``order``: windows inside blocks, then the blocks' ends."""
    cut = data.withColumn("__b", F.floor(F.col(order) / LAG_ROWS))
    step = F.col(value) - F.lag(value).over(Window.partitionBy("__b").orderBy(order))
    blocks = cut.withColumn("__d", step).groupBy("__b").agg(F.sum(F.col("__d") ** 2).alias("s"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last")).orderBy("__b").collect()
    total = sum(r["s"] or 0.0 for r in blocks)
    return total + sum((b["first"] - a["last"]) ** 2 for a, b in zip(blocks, blocks[1:], strict=False))


def residuals(model: Fitted, df: DataFrame) -> DataFrame:
    """row_index (where there is one), fitted, resid, leverage, standardised residual of an OLS model."""
    keep = [RID] if RID in df.columns else []
    data = formulas.complete(formulas.frame(model.design, df, keep), model.design)
    k = len(model.params)
    x, inverse = _x(k), _inverse(np.array(model.extra["xtx"]))
    h = reduce(lambda p, q: p + q, [F.lit(float(inverse[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(k) for j in range(i, k)])
    fitted = _dot(np.array(model.params), x)
    out = data.select(*[F.col(c).alias("row_index") for c in keep], fitted.alias("fitted"), (F.col("y") - fitted).alias("resid"), h.alias("leverage"), *[F.col(f"x{i}") for i in range(k)])
    return out.withColumn("std_resid", F.col("resid") / F.sqrt(F.lit(model.scale) * (1 - F.col("leverage"))))


def diagnostics(model: Fitted, df: DataFrame) -> dict[str, Any]:
    """Breusch-Pagan, Durbin-Watson, Jarque-Bera, condition number, VIF."""
    k, n = len(model.params), model.n_obs
    data = residuals(model, df).persist()
    try:
        e = F.col("resid")
        a, b, m = sums(data, k, None, e * e, {"e1": e, "e2": e**2, "e3": e**3, "e4": e**4})
        aux = ols_from_sums(a, b, m["e4"], m["e2"], n, True)
        tss = m["e4"] - m["e2"] ** 2 / n
        lm = n * (1 - aux["rss"] / tss) if tss else 0.0
        mean = m["e1"] / n
        m2 = m["e2"] / n - mean**2
        m3 = m["e3"] / n - 3 * mean * m["e2"] / n + 2 * mean**3
        m4 = m["e4"] / n - 4 * mean * m["e3"] / n + 6 * mean**2 * m["e2"] / n - 3 * mean**4
        skew, kurt = m3 / m2**1.5, m4 / m2**2
        jb = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
        dw = lag_sum(data.select("row_index", "resid"), "row_index", "resid") / m["e2"] if "row_index" in data.columns else None
    finally:
        data.unpersist()
    return {"breusch_pagan": {"statistic": lm, "p_value": D.chi2_sf(lm, max(1, k - 1))}, "durbin_watson": dw, "jarque_bera": {"statistic": jb, "p_value": D.chi2_sf(jb, 2), "skew": skew, "kurtosis": kurt}, "condition_number": math.sqrt(np.linalg.cond(a)), "vif": vif(a, model.design)}


def vif(gram: np.ndarray, design: formulas.Design) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others, from the cross-product matrix alone."""
    out = {}
    for i, name in enumerate(design.names):
        if name == "Intercept" or len(design.names) < 2:
            continue
        rest = [j for j in range(len(design.names)) if j != i]
        b = gram[rest, i]
        rss = gram[i, i] - float(_solve(gram[np.ix_(rest, rest)], b) @ b)
        tss = gram[i, i] - gram[0, i] ** 2 / gram[0, 0] if design.intercept else gram[i, i]
        out[name] = tss / rss if rss > 0 else math.inf
    return out


def warnings_of(model: Fitted, found: dict[str, Any] | None) -> list[dict[str, str]]:
    out = []
    if found:
        high = [n for n, v in found["vif"].items() if v > 10]
        if high:
            out.append({"type": "multicollinearity", "message": f"VIF above 10: {', '.join(high)}"})
        if found["breusch_pagan"]["p_value"] < 0.05:
            out.append({"type": "heteroscedasticity", "message": "Breusch-Pagan p below .05; consider robust errors"})
        if found["jarque_bera"]["p_value"] < 0.05:
            out.append({"type": "non_normal_residuals", "message": "Jarque-Bera p below .05"})
    if model.kind == "poisson" and model.extra["dispersion"] > 1.5:
        out.append({"type": "overdispersion", "message": f"Pearson chi-square / df = {model.extra['dispersion']:.2f}; consider negbin"})
    if model.kind == "negbin":
        alpha, se = model.extra["alpha"], model.extra["alpha_se"]
        if alpha < 0.05 and (se is None or alpha / se < 2):
            out.append({"type": "underdispersion_vs_negbin", "message": "dispersion is near zero; poisson may do"})
        if se is not None and se / alpha > 0.5:
            out.append({"type": "unstable_dispersion", "message": "the dispersion is estimated poorly"})
    return out


def outcome_notes(model: Fitted, df: DataFrame) -> list[dict[str, str]]:
    """What a reader should know of the outcome's type."""
    dtype = df.schema[model.design.outcome_source].dataType if model.design.outcome_source in df.columns else None
    if model.kind == "ols" and isinstance(dtype, T.BooleanType):
        return [{"type": "boolean_outcome_lpm", "message": "a boolean outcome makes this a linear probability model"}]
    if model.kind == "negbin" and isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return [{"type": "coerced_float_to_int", "message": "whole floating-point outcomes were taken as counts"}]
    return []


def interpretation(model: Fitted) -> str:
    rows = [c for c in model.coefficients() if c["name"] != "Intercept" and c["p_value"] == c["p_value"]]
    if not rows:
        return "The model has an intercept only."
    best = min(rows, key=lambda c: c["p_value"])
    b = best["estimate"]
    if model.kind == "ols":
        effect = f"one unit more goes with {b:+.4g} in {model.design.outcome}"
    elif model.kind == "logistic":
        effect = f"one unit more changes the odds by {100 * math.expm1(b):+.1f} %"
    else:
        effect = f"one unit more multiplies the expected count by {math.exp(b):.4g}"
    return f"{best['name']} is the clearest predictor (p = {best['p_value']:.3g}): {effect}."


def fit_block(model: Fitted) -> dict[str, Any]:
    out: dict[str, Any] = {"aic": model.aic, "bic": model.bic, "n_obs": model.n_obs, "df_resid": model.df_resid, "log_likelihood": model.llf}
    keys = {"ols": ("r_squared", "adj_r_squared"), "logistic": ("pseudo_r_squared",), "poisson": ("pseudo_r_squared", "dispersion"), "negbin": ("alpha", "alpha_se", "converged", "pseudo_r_squared")}[model.kind]
    return out | {k: model.extra[k] for k in keys}


def outcome_type(df: DataFrame, model: Fitted) -> str | None:
    """None where the outcome column suits the kind, else what is wrong."""
    name = model.design.outcome_source
    if name not in df.columns:
        return "outcome_column_missing"
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "outcome_dtype_mismatch"
    if model.kind in ("logistic", "poisson", "negbin"):
        y = F.col("`" + name.replace("`", "``") + "`").cast("double")
        bad = ~y.isin(0.0, 1.0) if model.kind == "logistic" else (y < 0) | (y != F.floor(y))
        if df.where(bad).limit(1).count():
            return "outcome_dtype_mismatch"
    return None
