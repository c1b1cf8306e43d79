"""Predictions, evaluation, splits and cross-validation."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import RID, as_double, col, cumulative, exact_quantiles
from . import formula as formulas
from . import models as M


# --- predict -------------------------------------------------------------------------------------


def predictions(model: M.Fitted, df: DataFrame, output: str = "response", threshold: float = 0.5, include_se: bool = False) -> DataFrame:
    """row_index and prediction for rows whose predictors are all there, in one projection."""
    eta = model.eta(df)
    value = {"link": eta, "response": M.inverse_link(model.kind, eta)}.get(output)
    if value is None:
        value = F.when(M.inverse_link(model.kind, eta) >= threshold, 1).when(eta.isNotNull(), 0)
    out = [F.col(RID).alias("row_index"), value.alias("prediction")]
    if include_se:
        x = [e for _, e in formulas.columns(model.design, df)]
        cov = np.array(model.cov)
        terms = [F.lit(float(cov[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
        var = terms[0]
        for t in terms[1:]:
            var = var + t
        se = F.sqrt(F.greatest(var, F.lit(0.0)))
        q = F.lit(D.norm_ppf(0.975) if model.robust else D.t_ppf(0.975, model.df_resid))
        out += [se.alias("se"), (eta - q * se).alias("ci_low"), (eta + q * se).alias("ci_high")]
    return df.select(*out).where("prediction IS NOT NULL AND NOT isnan(prediction)")


def page(scored: DataFrame, limit: int, cursor: int | None = None) -> tuple[list[dict[str, Any]], int | None]:
    """Rows from ``cursor`` on in row order, and where the next page starts."""
    rows = (scored if cursor is None else scored.where(F.col("row_index") >= cursor)).orderBy("row_index").limit(limit + 1).collect()
    return [r.asDict() for r in rows[:limit]], rows[limit]["row_index"] if len(rows) > limit else None


def scored_outcomes(model: M.Fitted, df: DataFrame) -> DataFrame:
    """(y, p) of complete rows."""
    data = df.select(formulas.expression(model.design.outcome, df, None, []).alias("y"), model.mean(df).alias("p"))
    return data.where("y IS NOT NULL AND p IS NOT NULL AND NOT isnan(y) AND NOT isnan(p)")


# --- metrics -------------------------------------------------------------------------------------


def curve(pairs: DataFrame) -> DataFrame:
    """Per distinct score: p, pos, n and their running sums from the highest score down."""
    counts = pairs.groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("__o", -F.col("p"))
    return cumulative(cumulative(counts, "__o", "pos", "tp"), "__o", "n", "top").drop("__o")


def rank_metrics(pairs: DataFrame) -> DataFrame:
    """roc_auc and average_precision from the curve over distinct scores."""
    c = curve(pairs)
    neg, fp = F.col("n") - F.col("pos"), F.col("top") - F.col("tp")
    wins = F.col("pos") * 0.0 + neg * (F.col("tp") - F.col("pos") / 2)  # positives above, and half of those level
    sums = c.agg(F.sum("pos").alias("P"), F.sum(neg).alias("N"), F.sum(wins).alias("w"), F.sum(F.col("pos") * F.col("tp") / F.col("top")).alias("ap"), F.max(fp).alias("__f"))
    return sums.select((F.col("w") / F.nullif(F.col("P") * F.col("N"), F.lit(0.0))).alias("roc_auc"), (F.col("ap") / F.nullif(F.col("P"), F.lit(0.0))).alias("average_precision"))


def confusion(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    up, one = F.col("p") >= threshold, F.col("y") == 1
    return pairs.agg(F.count_if(up & one).alias("tp"), F.count_if(up & ~one).alias("fp"), F.count_if(~up & one).alias("fn"), F.count_if(~up & ~one).alias("tn"))


def losses(pairs: DataFrame) -> DataFrame:
    """Brier score and log loss, probabilities clipped at 1e-15."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return pairs.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"))


def calibration(pairs: DataFrame, bins: int) -> DataFrame:
    """Quantile bins of the scores (equal edges merged, right-closed): bin, mean_predicted, observed, n."""
    edges = sorted(set(exact_quantiles(pairs, "p", [i / bins for i in range(bins + 1)])))
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + (F.col("p") > F.lit(e)).cast("int")
    return pairs.groupBy(at.alias("bin")).agg(F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"), F.count(F.lit(1)).alias("n"))


def _rates(c: dict[str, int]) -> dict[str, float]:
    n = sum(c.values())
    precision = c["tp"] / (c["tp"] + c["fp"]) if c["tp"] + c["fp"] else 0.0
    recall = c["tp"] / (c["tp"] + c["fn"]) if c["tp"] + c["fn"] else 0.0
    return {"accuracy": (c["tp"] + c["tn"]) / n if n else math.nan, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


def error_sums(pairs: DataFrame) -> dict[str, float]:
    e, p, y = F.col("y") - F.col("p"), F.col("p"), F.col("y")
    deviance = 2 * (F.when(y > 0, y * F.log(y / p)).otherwise(0.0) - (y - p))
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), (F.var_pop("y") * F.count("y")).alias("tss"), F.sum(F.when(p > 0, e * e / p)).alias("chi"), F.sum(F.when(p > 0, deviance)).alias("dev")).first()
    return r.asDict()


def metrics(pairs: DataFrame, kind: str, n_params: int, threshold: float = 0.5) -> dict[str, Any]:
    if kind == "logistic":
        c = confusion(pairs, threshold).first().asDict()
        return rank_metrics(pairs).first().asDict() | losses(pairs).first().asDict() | _rates(c) | {"n": sum(c.values()), "confusion_matrix": c}
    s = error_sums(pairs)
    n = s["n"]
    if not n:
        return {"n": 0}
    out = {"n": n, "rmse": math.sqrt(s["sse"] / n), "mae": s["sae"] / n}
    if kind == "ols":
        p = n_params - 1
        r2 = 1 - s["sse"] / s["tss"] if s["tss"] else math.nan
        return out | {"r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / (n - p - 1) if n > p + 1 else math.nan}
    return out | {"pearson_chi2": s["chi"], "deviance": s["dev"]}


def evaluate(model: M.Fitted, df: DataFrame, threshold: float, n_bins: int) -> dict[str, Any]:
    pairs = scored_outcomes(model, df).persist()
    try:
        out = metrics(pairs, model.kind, len(model.params), threshold)
        out["n_dropped"] = df.count() - out["n"]
        if model.kind == "logistic":
            few = out["n"] // 20 < 2
            bins = min(n_bins, max(2, out["n"] // 20))
            out["calibration"] = None if few else [r.asDict() for r in calibration(pairs, bins).orderBy("bin").collect()]
            if few:
                out["calibration_note"] = "too few rows for calibration bins"
    finally:
        pairs.unpersist()
    return out


# --- splits --------------------------------------------------------------------------------------


def test_size(n: int, fraction: float) -> int:
    return max(1, min(n - 1, round(n * fraction)))


def seeded_membership(sizes: list[tuple[str | None, int]], fraction: float, seed: int) -> tuple[list[np.ndarray], list[str | None]]:
    """Per stratum, in order, a test mask over its rows; strata of one row are training rows and named."""
    dice = np.random.RandomState(seed)
    masks, small = [], []
    for value, n in sizes:
        mask = np.zeros(n, bool)
        if n < 2:
            small.append(value)
        else:
            mask[dice.permutation(n)[: test_size(n, fraction)]] = True
        masks.append(mask)
    return masks, small


#: The column that marks test rows.
TEST = "__assay_test"
#: Row ordinals of one task where rows are numbered within their key.
CHUNK = 100_000


def with_position(df: DataFrame, key: Column, starts: list[tuple[str | None, int]], name: str) -> DataFrame:
    """df with ``name``: the start of the row's key plus its place, from 0, among the rows of that key in row order.

    Rows are numbered within chunks of CHUNK ordinals and chunks by prefix sums of their counts, so that neither
    the whole table nor a large stratum meets in one task.
    """
    k, chunk, base, start = (f"{name}_{x}" for x in ("key", "chunk", "base", "start"))
    tagged = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    marked = df.withColumn(k, tagged(key)).withColumn(chunk, F.floor(F.col(RID) / CHUNK))
    first = df.sparkSession.createDataFrame([("n" if v is None else f"v{v}", s) for v, s in starts], f"{k} string, {start} long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(k).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = marked.groupBy(k, chunk).agg(F.count(F.lit(1)).alias("n")).withColumn(base, before).join(first, k).select(k, chunk, (F.col(base) + F.col(start)).alias(base))
    place = F.row_number().over(Window.partitionBy(k, chunk).orderBy(RID)) - 1
    return marked.join(bases, [k, chunk]).withColumn(name, F.col(base) + place).drop(k, chunk, base)


def split_rows(df: DataFrame, fraction: float = 0.25, seed: int = 42, stratify_by: str | None = None) -> tuple[DataFrame, list[str | None]]:
    """df with TEST: a seeded permutation inside each stratum, over rows in row order.

    The permutation is drawn on the driver and sent as one bit per row; ``hash_split`` has no such bound.
    """
    key = col(stratify_by).cast("string") if stratify_by else F.lit("")
    counts = {r["k"]: r["n"] for r in df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted((k for k in counts if k is not None)) + ([None] if None in counts else [])
    masks, small = seeded_membership([(k, counts[k]) for k in order], fraction, seed)
    bits = df.sparkSession.sparkContext.broadcast(np.packbits(np.concatenate([*masks, np.zeros(0, bool)])))

    @F.pandas_udf("boolean")
    def is_test(at: pd.Series) -> pd.Series:
        place = at.to_numpy("int64")
        return pd.Series((bits.value[place >> 3] >> (7 - (place & 7))) & 1 == 1)

    at = np.cumsum([0] + [counts[k] for k in order]).tolist()
    placed = with_position(df, key, list(zip(order, at)), TEST)
    return placed.withColumn(TEST, is_test(TEST)), small


def hash_split(df: DataFrame, key: Column, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """df with TEST by a hash of ``key``: no shuffle, no driver state, stable when rows are added."""
    share = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn(TEST, share < F.lit(int(fraction * 2**32)))


# --- cross-validation ----------------------------------------------------------------------------


def fold_ids(n: int, k: int, seed: int, strata: np.ndarray | None = None) -> np.ndarray:
    dice = np.random.RandomState(seed)
    out = np.zeros(n, np.int64)
    groups = [np.arange(n)] if strata is None else [np.flatnonzero(strata == v) for v in np.unique(strata)]
    for own in groups:
        out[own[dice.permutation(len(own))]] = np.arange(len(own)) % k
    return out


def with_folds(df: DataFrame, design: formulas.Design, k: int, seed: int, stratified: bool) -> DataFrame:
    """Complete design rows with a fold: seeded permutations over rows in row order, by class for a logistic model."""
    data = formulas.complete(formulas.frame(design, df, [RID]), design)
    key = F.col("y") if stratified else F.lit(0.0)
    counts = {r["c"]: r["n"] for r in data.groupBy(key.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if stratified and any(n < k for n in counts.values()):
        raise M.FitError("outcome_class_too_small", f"each class needs {k} rows")
    dice = np.random.RandomState(seed)
    order = sorted(counts)
    at = np.cumsum([0] + [counts[c] for c in order])
    dealt = np.empty(at[-1], np.uint8)
    for c, start in zip(order, at):
        dealt[start + dice.permutation(counts[c])] = np.arange(counts[c]) % k
    shared = df.sparkSession.sparkContext.broadcast(dealt)  # a byte per row

    @F.pandas_udf("int")
    def fold_of(place: pd.Series) -> pd.Series:
        return pd.Series(shared.value[place.to_numpy("int64")].astype(np.int32))

    return with_position(data, key.cast("long"), [(str(int(c)), int(s)) for c, s in zip(order, at)], "fold").withColumn("fold", fold_of("fold"))


def cross_validate(df: DataFrame, formula: str, kind: str, robust: bool = False, k: int = 5, seed: int = 42, threshold: float = 0.5) -> dict[str, Any]:
    """k-fold: one design for all folds; OLS takes every fold's fit from one grouped pass of cross-products."""
    M.fit(df, formula, kind, robust)  # errors of the whole come first
    design, _ = M.prepared(df, formula, kind)
    data = with_folds(df, design, k, seed, kind == "logistic").persist()
    try:
        n = data.count()
        if n < k or n // k < 1 or n - -(-n // k) <= len(design.names):
            raise M.FitError("fold_too_small", f"{n} rows in {k} folds")
        per_fold, failures = [], []
        folds = _ols_folds(data, design, k) if kind == "ols" else {}
        for f in range(k):
            try:
                beta = folds[f] if kind == "ols" else np.array(_refit(data.where(F.col("fold") != f), design, formula, kind).params)
            except M.FitError as e:
                failures.append({"fold": f, "type": e.kind, "message": str(e)})
                continue
            p = M.inverse_link(kind, M._dot(beta, M._x(len(beta))))
            per_fold.append({"fold": f} | metrics(data.where(F.col("fold") == f).select("y", p.alias("p")), kind, len(beta), threshold))
    finally:
        data.unpersist()
    if not per_fold:
        raise M.FitError("cv_fit_failed", "no fold could be fitted")
    names = [m for m, v in per_fold[0].items() if m not in ("fold", "n", "confusion_matrix") and isinstance(v, float)]
    summary = {m: {"mean": float(np.mean(v)), "std": float(np.std(v, ddof=1)) if len(v) > 1 else None} for m in names for v in [[x[m] for x in per_fold if x[m] is not None]] if v}
    return {"k": k, "seed": seed, "n_obs": n, "metrics": summary, "per_fold": per_fold, "failures": failures}


def _ols_folds(data: DataFrame, design: formulas.Design, k: int) -> dict[int, np.ndarray]:
    p = len(design.names)
    x, pairs = M._x(p), [(i, j) for i in range(p) for j in range(i, p)]
    rows = data.groupBy("fold").agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(p)]).collect()
    a, b = {}, {}
    for r in rows:
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"a{i}_{j}"]
        a[r["fold"]], b[r["fold"]] = m, np.array([r[f"b{i}"] for i in range(p)])
    whole_a, whole_b = sum(a.values()), sum(b.values())
    return {f: M._solve(whole_a - a.get(f, 0), whole_b - b.get(f, 0)) for f in range(k)}


def _refit(data: DataFrame, design: formulas.Design, formula: str, kind: str) -> M.Fitted:
    n = M.check_outcome(data, kind)
    return {"logistic": M._fit_logistic, "poisson": M._fit_poisson, "negbin": M._fit_negbin}[kind](data, design, formula, n, False)


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept, r2, n of one predictor, in one aggregate."""
    a, b = as_double(col(y)), as_double(col(x))
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))
