"""Plots as bounded data: each kind is a reduction whose size does not follow the rows; a small PNG renderer draws it."""

from __future__ import annotations

import base64
import struct
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import RID, as_double, col, is_numeric, numeric_columns
from . import formula as formulas
from . import groups as G
from . import models as M
from . import profile

KINDS = {"hist": ("x",), "bar": ("x",), "line": ("x", "y"), "scatter": ("x", "y"), "box": ("y",), "violin": ("y",), "heatmap": ()}
MOST_POINTS = 2_000
MOST_BARS = 200


def sample_points(df: DataFrame, n: int = MOST_POINTS) -> DataFrame:
    """At most ``n`` rows, evenly by a hash of the row ordinal."""
    total = df.count()
    if total <= n:
        return df
    key = F.pmod(F.xxhash64(RID), F.lit(1_000_003))
    return df.where(key < F.lit(int(1_000_003 * min(1.0, 1.3 * n / total)))).orderBy(key, RID).limit(n)


def box_stats(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """grp, n, q1, median, q3, whisker_low, whisker_high, n_fliers: whiskers end at data within 1.5 IQR."""
    pairs = df.select((col(x).cast("string") if x else F.lit("all")).alias("grp"), as_double(col(y)).alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND grp IS NOT NULL")
    q = pairs.groupBy("grp").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    found = pairs.join(F.broadcast(q), "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("n_fliers"))
    return found.select("grp", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_low", "whisker_high", "n_fliers")


def bars(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """label, value: rows per label, or the mean of y; the most frequent labels first, one more than are drawn."""
    value = F.avg(as_double(col(y))) if y else F.count(F.lit(1)).cast("double")
    return df.where(col(x).isNotNull()).groupBy(col(x).cast("string").alias("label")).agg(value.alias("value"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_BARS + 1)


def violin(df: DataFrame, y: str, x: str | None = None, points: int = 64) -> list[dict[str, Any]]:
    """Gaussian kernel densities over 512-bin histograms, Scott's bandwidth."""
    pairs = df.select((col(x).cast("string") if x else F.lit("all")).alias("g"), as_double(col(y)).alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND g IS NOT NULL")
    stats = {r["g"]: r for r in pairs.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")).collect()}
    if not stats:
        return []
    lo, hi = min(s["lo"] for s in stats.values()), max(s["hi"] for s in stats.values())
    width = (hi - lo) / 512 or 1.0
    cells = pairs.groupBy("g", F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(511)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for g in sorted(stats):
        s = stats[g]
        at = np.array([lo + (r["b"] + 0.5) * width for r in cells if r["g"] == g])
        w = np.array([r["n"] for r in cells if r["g"] == g], float)
        h = max((s["sd"] or 0.0) * s["n"] ** -0.2, width)
        grid = np.linspace(s["lo"] - 2 * h, s["hi"] + 2 * h, points)
        density = (np.exp(-0.5 * ((grid[:, None] - at[None, :]) / h) ** 2) * w).sum(1) / (w.sum() * h * np.sqrt(2 * np.pi))
        out.append({"group": g, "x": grid.tolist(), "density": density.tolist()})
    return out


def _drawn(found: list[dict[str, Any]]) -> dict[str, Any]:
    """The bars that are drawn, and whether there are more."""
    return {"kind": "bar", "bars": found[:MOST_BARS], "truncated": len(found) > MOST_BARS}


def plot_data(df: DataFrame, kind: str, x: str | None = None, y: str | None = None, hue: str | None = None, bins: int = 20) -> dict[str, Any]:
    """The data of one plot; raises ValueError with an error type."""
    if kind not in KINDS:
        raise ValueError("invalid_kind")
    given = {"x": x, "y": y}
    if any(given[p] is None for p in KINDS[kind]):
        raise ValueError("missing_required_param")
    unknown = [c for c in (x, y, hue) if c is not None and c not in df.columns]
    if unknown:
        raise ValueError(f"column_not_found: {unknown[0]}")
    rows = lambda d: [r.asDict() for r in d.collect()]
    if kind == "hist":
        if not is_numeric(df, x):
            return _drawn(rows(bars(df, x)))
        return {"kind": kind, "bins": rows(profile.histogram(df, x, bins).orderBy("bin"))}
    if kind == "bar":
        return _drawn(rows(bars(df, x, y)))
    if kind == "box":
        return {"kind": kind, "boxes": rows(box_stats(df, y, x).orderBy("grp"))}
    if kind == "violin":
        return {"kind": kind, "violins": violin(df, y, x)}
    if kind == "heatmap":
        names = numeric_columns(df)
        if len(names) < 2:
            raise ValueError("no_numeric_columns")
        return {"kind": kind, "columns": names, "cells": rows(G.correlation_pairs(df, names))}
    cols = [col(x).alias("x"), as_double(col(y)).alias("y")] + ([col(hue).cast("string").alias("hue")] if hue else [])
    known = df.where(col(x).isNotNull() & col(y).isNotNull())
    points = sample_points(known).select(*cols)
    found = rows(points.orderBy("x") if kind == "line" else points)
    return {"kind": kind, "points": found, "truncated": len(found) == MOST_POINTS and known.count() > MOST_POINTS}


def regression_line(model: M.Fitted, df: DataFrame, predictor: str, points: int = 100) -> list[dict[str, float]]:
    """Fitted mean and 95 % band over the predictor's range; other numeric columns at their mean, others at their first value."""
    if model.kind != "ols":
        raise ValueError("regression_diagnostics_ols_only")
    if predictor not in df.columns or predictor not in model.design.sources:
        raise ValueError("column_not_found")
    if not is_numeric(df, predictor):
        raise ValueError("non_numeric_predictor")
    ends = df.agg(F.min(as_double(col(predictor))).alias("lo"), F.max(as_double(col(predictor))).alias("hi"), *[(F.avg(as_double(col(c))) if is_numeric(df, c) else F.first(col(c), ignorenulls=True)).alias(f"v{i}") for i, c in enumerate(model.design.sources)]).first()
    grid = df.sparkSession.range(points).select((F.lit(ends["lo"]) + (F.lit(ends["hi"]) - F.lit(ends["lo"])) * F.col("id") / F.lit(points - 1.0)).alias("__at"), F.col("id").alias(RID))
    for i, c in enumerate(model.design.sources):
        grid = grid.withColumn(c, F.col("__at") if c == predictor else F.lit(ends[f"v{i}"]))
    from .scoring import predictions

    found = predictions(model, grid, "response", include_se=True).join(grid.select(F.col(RID).alias("row_index"), F.col("__at").alias("x")), "row_index").orderBy("row_index")
    return [{"x": r["x"], "fit": r["prediction"], "low": r["ci_low"], "high": r["ci_high"]} for r in found.collect()]


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.6) -> np.ndarray:
    """Local linear smoother with tricube weights over the nearest share of a bounded sample."""
    order = np.argsort(x)
    xs, ys = x[order], y[order]
    n, k = len(xs), max(2, int(np.ceil(share * len(xs))))
    out, left = np.empty(n), 0
    for i in range(n):
        while left + k < n and xs[left + k] - xs[i] < xs[i] - xs[left]:
            left += 1
        wx, wy = xs[left : left + k], ys[left : left + k]
        h = max(abs(wx[0] - xs[i]), abs(wx[-1] - xs[i])) or 1.0
        w = (1 - np.minimum(1, np.abs(wx - xs[i]) / h) ** 3) ** 3
        mx, my = np.average(wx, weights=w + 1e-12), np.average(wy, weights=w + 1e-12)
        sxx = (w * (wx - mx) ** 2).sum()
        out[i] = my + ((w * (wx - mx) * (wy - my)).sum() / sxx if sxx > 1e-12 else 0.0) * (xs[i] - mx)
    result = np.empty(n)
    result[order] = out
    return result


def cooks_distance(model: M.Fitted, df: DataFrame) -> DataFrame:
    """residuals with cooks: r^2 h / (p (1 - h))."""
    p = len(model.params)
    return M.residuals(model, df).withColumn("cooks", F.col("std_resid") ** 2 * F.col("leverage") / (p * (1 - F.col("leverage"))))


def residual_data(model: M.Fitted, df: DataFrame, kind: str = "all") -> dict[str, Any]:
    """Bounded samples for residual plots: fitted and smooth, Q-Q, scale-location, leverage with Cook's contours."""
    if model.kind != "ols":
        raise ValueError("regression_diagnostics_ols_only")
    if kind not in ("resid_vs_fitted", "qq", "scale_location", "all"):
        raise ValueError("invalid_kind")
    from ..functions.distributions import norm_ppf

    rows = sample_points(cooks_distance(model, df).withColumnRenamed("row_index", RID)).select("fitted", "resid", "std_resid", "leverage", "cooks").toPandas()
    out: dict[str, Any] = {"kind": kind, "n": len(rows)}
    fitted, resid, std = (rows[c].to_numpy(float) for c in ("fitted", "resid", "std_resid"))
    if kind in ("resid_vs_fitted", "all"):
        out["resid_vs_fitted"] = {"fitted": fitted.tolist(), "resid": resid.tolist(), "smooth": lowess(fitted, resid).tolist()}
    if kind in ("qq", "all"):
        out["qq"] = {"theoretical": [norm_ppf((i + 0.5) / len(std)) for i in range(len(std))], "sample": np.sort(std).tolist()}
    if kind in ("scale_location", "all"):
        root = np.sqrt(np.abs(std))
        out["scale_location"] = {"fitted": fitted.tolist(), "root": root.tolist(), "smooth": lowess(fitted, root).tolist()}
    if kind == "all":
        p, h = len(model.params), np.linspace(0.001, max(0.01, float(rows["leverage"].max())), 50)
        out["leverage"] = {"leverage": rows["leverage"].tolist(), "std_resid": std.tolist(), "cooks": rows["cooks"].tolist(), "contours": {str(d): {"h": h.tolist(), "r": np.sqrt(d * p * (1 - h) / h).tolist()} for d in (0.5, 1.0)}}
    return out


# --- a small renderer ----------------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + pixels[i].tobytes() for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def render(data: dict[str, Any], width: int = 480, height: int = 320) -> dict[str, Any]:
    """A plain drawing of plot data: bars, points, lines or cells, without text."""
    image = np.full((height, width, 3), 255, np.uint8)
    image[height - 20, 20 : width - 10] = 90
    image[10 : height - 20, 20] = 90
    blue = np.array([70, 110, 170], np.uint8)

    def bar(values: list[float]) -> None:
        top = max([abs(v) for v in values if v is not None], default=1) or 1
        step = (width - 40) / max(1, len(values))
        for i, v in enumerate(values):
            h = int((height - 40) * abs(v or 0) / top)
            image[height - 20 - h : height - 20, int(22 + i * step) : max(int(22 + i * step) + 1, int(20 + (i + 1) * step))] = blue

    def points(xs: list[float], ys: list[float]) -> None:
        x, y = np.array(xs, float), np.array(ys, float)
        good = np.isfinite(x) & np.isfinite(y)
        x, y = x[good], y[good]
        if len(x):
            px = 22 + ((x - x.min()) / ((x.max() - x.min()) or 1) * (width - 40)).astype(int)
            py = height - 22 - ((y - y.min()) / ((y.max() - y.min()) or 1) * (height - 40)).astype(int)
            for dx in (0, 1):
                for dy in (0, 1):
                    image[np.clip(py + dy, 0, height - 1), np.clip(px + dx, 0, width - 1)] = blue

    if "bins" in data:
        bar([b["n"] for b in data["bins"]])
    elif "bars" in data:
        bar([b["value"] for b in data["bars"]])
    elif "boxes" in data:
        bar([b["median"] for b in data["boxes"]])
    elif "points" in data:
        try:
            points([float(p["x"]) for p in data["points"]], [p["y"] for p in data["points"]])
        except (TypeError, ValueError):
            points(list(range(len(data["points"]))), [p["y"] for p in data["points"]])
    elif "violins" in data:
        for v in data["violins"]:
            points(v["x"], v["density"])
    elif "cells" in data:
        names = data["columns"]
        step_x, step_y = (width - 30) // len(names), (height - 30) // len(names)
        for c in data["cells"]:
            for a, b in ((c["a"], c["b"]), (c["b"], c["a"])):
                i, j, r = names.index(a), names.index(b), c["r"] if c["r"] is not None else 0.0
                shade = int(255 * (1 - abs(r)))
                image[10 + i * step_y : 10 + (i + 1) * step_y, 22 + j * step_x : 22 + (j + 1) * step_x] = (255, shade, shade) if r > 0 else (shade, shade, 255)
    elif "line" in data:
        points([p["x"] for p in data["line"]], [p["fit"] for p in data["line"]])
    elif "resid_vs_fitted" in data:
        points(data["resid_vs_fitted"]["fitted"], data["resid_vs_fitted"]["resid"])
    elif "qq" in data:
        points(data["qq"]["theoretical"], data["qq"]["sample"])
    elif "scale_location" in data:
        points(data["scale_location"]["fitted"], data["scale_location"]["root"])
    return {"png_base64": base64.b64encode(png(image)).decode(), "width": width, "height": height}


def design_sources(model: M.Fitted, df: DataFrame) -> list[str]:
    formulas.columns(model.design, df)
    return model.design.sources
