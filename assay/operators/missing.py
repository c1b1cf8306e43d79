"""Missingness: per column, patterns, pairwise phi, structural grouping, Little's MCAR test."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import as_double, col, is_string, numeric_columns, user_columns


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_null, fraction - one scan."""
    columns = columns or user_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null"), (F.col(f"c{i}") / F.nullif(F.col("n"), F.lit(0))).alias("fraction")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.*")


def patterns(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent null masks: pattern (1 where null, in column order), n."""
    mask = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


def phi(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, phi of null masks for pairs where both vary, from one scan of products."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    mask = {c: col(c).isNull() for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(mask[c]).alias(f"c{i}") for i, c in enumerate(columns)], *[F.count_if(mask[a] & mask[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    n, at = F.col("n").cast("double"), {c: F.col(f"c{i}").cast("double") for i, c in enumerate(columns)}
    rows = []
    for k, (a, b) in enumerate(pairs):
        bottom = F.sqrt(at[a] * (n - at[a]) * at[b] * (n - at[b]))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((n * F.col(f"p{k}") - at[a] * at[b]) / F.nullif(bottom, F.lit(0.0))).alias("phi")))
    if not rows:
        return df.sparkSession.createDataFrame([], "a string, b string, phi double")
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("phi IS NOT NULL")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.lit(True)
    for c in columns:
        whole = whole & col(c).isNotNull()
    return df.agg(F.count_if(whole).alias("n_complete"), F.count(F.lit(1)).alias("n_rows"))


def grouped_nulls(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Null fraction of each column by the group's values (null is one of them)."""
    return df.groupBy(col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(col(c).isNull().cast("double")).alias(f"f{i}") for i, c in enumerate(columns)])


def structural(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Columns that are null in all or none of the rows of each group of some categorical column: column -> grouping."""
    texts = [c for c in user_columns(df) if is_string(df, c)]
    if not texts:
        return {}
    n = df.count()
    sizes = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    out: dict[str, tuple[int, str]] = {}
    for i, c in enumerate(texts):
        if not 1 < sizes[f"d{i}"] <= 60:
            continue
        others = [x for x in columns if x != c]
        rows = grouped_nulls(df, c, others).collect() if others else []
        if not 1 < len(rows) <= 51 or len(rows) > math.sqrt(n):
            continue
        for k, name in enumerate(others):
            shares = {r[f"f{k}"] for r in rows}
            if shares == {0.0, 1.0}:
                best = (len(rows), c)
                out[name] = min(out.get(name, best), best)
    return {k: v[1] for k, v in out.items()}


def mcar_moments(df: DataFrame, columns: list[str]) -> tuple[list[dict[str, Any]], np.ndarray, np.ndarray]:
    """Per null pattern its size and its sums and products of centred values; the centres; the pairs of columns."""
    mask = F.concat(*[F.when(col(c).isNull(), "0").otherwise("1") for c in columns])
    x = [as_double(col(c)) for c in columns]
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    shift = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    centred = [c - F.lit(float(shift[f"m{i}"] or 0.0)) for i, c in enumerate(x)]
    found = df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(centred)], *[F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    rows = [r.asDict() for r in found if "1" in r["pattern"]]
    return rows, np.array([float(shift[f"m{i}"] or 0.0) for i in range(k)]), np.array(pairs)


def little_mcar(df: DataFrame, columns: list[str] | None = None) -> dict[str, Any]:
    """Little's test from per-pattern sums: one scan for centring, one for the sums."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return {"skipped": "fewer than two numeric columns"}
    rows, _, pairs = mcar_moments(df, columns)
    k = len(columns)
    if sum(r["n"] >= 2 for r in rows) < 2:
        return {"skipped": "fewer than two missingness patterns"}
    seen = np.array([[ch == "1" for ch in r["pattern"]] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    sums = np.array([[r[f"s{i}"] or 0.0 for i in range(k)] for r in rows])
    total = (seen * n[:, None]).sum(0)
    if (total == 0).any():
        return {"skipped": "a column has no values"}
    mean = (sums * seen).sum(0) / total
    cov = np.zeros((k, k))
    for i, j in pairs:
        both = seen[:, i] & seen[:, j]
        m = n[both].sum()
        product = sum(r[f"p{i}_{j}"] for r, b in zip(rows, both, strict=True) if b)
        centred = product - mean[i] * sums[both, j].sum() - mean[j] * sums[both, i].sum() + m * mean[i] * mean[j]
        cov[i, j] = cov[j, i] = centred / (m - 1) if m > 1 else 0.0
    d2, used, pinv, tested = 0.0, 0, False, 0
    for r in range(len(rows)):
        if n[r] < 2:  # counts for the means, not as a pattern
            continue
        tested += 1
        own = np.flatnonzero(seen[r])
        delta = sums[r, own] / n[r] - mean[own]
        block = cov[np.ix_(own, own)]
        try:
            solved = np.linalg.solve(block, delta)
        except np.linalg.LinAlgError:
            solved, pinv = np.linalg.pinv(block) @ delta, True
        d2 += n[r] * float(delta @ solved)
        used += len(own)
    df_ = used - k
    if df_ <= 0:
        return {"skipped": "no degrees of freedom"}
    return {"statistic": float(d2), "df": df_, "p_value": D.chi2_sf(d2, df_), "n_patterns": tested, "columns": columns, "used_pseudo_inverse": pinv}


def analyse(df: DataFrame, columns: list[str], pattern_top_k: int, threshold: float, run_mcar: bool) -> dict[str, Any]:
    per = [r.asDict() for r in null_counts(df, columns).collect()]
    groups = structural(df, [r["column"] for r in per if r["n_null"]])
    for r in per:
        r["grouped_by"] = groups.get(r["column"])
    pairs = sorted(({"a": r["a"], "b": r["b"], "phi": round(r["phi"], 4)} for r in phi(df, columns).collect() if abs(r["phi"]) >= threshold), key=lambda r: (-abs(r["phi"]), r["a"], r["b"]))
    rows = complete_rows(df, columns).first()
    out: dict[str, Any] = {"n_rows": rows["n_rows"], "n_complete": rows["n_complete"], "per_column": per, "pairwise": pairs, "patterns": [{"null_columns": [c for c, ch in zip(columns, r["pattern"], strict=True) if ch == "1"], "n": r["n"]} for r in patterns(df, columns, pattern_top_k).collect()]}
    out["mcar"] = little_mcar(df, [c for c in numeric_columns(df) if c in columns]) if run_mcar else None
    hints: list[tuple[int, str]] = []
    for r in per:
        if r["grouped_by"]:
            hints.append((0, f"{r['column']} is null exactly within groups of {r['grouped_by']}: structural"))
        elif (r["fraction"] or 0) > 0.5:
            hints.append((1, f"{r['column']} is mostly null"))
    hints += [(2, f"{p['a']} and {p['b']} go missing together (phi {p['phi']})") for p in pairs if abs(p["phi"]) > 0.5]
    mcar = out["mcar"]
    if mcar and "p_value" in mcar and any(0.01 < (r["fraction"] or 0) <= 0.5 for r in per):
        hints.append((3, "values do not go missing at random" if mcar["p_value"] < 0.05 else "no evidence against missing completely at random"))
    out["suggestions"] = [h for _, h in sorted(hints)[:6]]
    return out
