"""Hypothesis tests: distributed sufficient statistics, finished on the driver."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import as_double, col, cumulative, value_ranks

SHAPIRO_ROWS = 5000
#: Copies of one value that are numbered at once.
COPIES = 10_000


def labelled(df: DataFrame, group: str, metric: str, groups: list[str] | None = None) -> DataFrame:
    """(g, x): labels as text and values as doubles, complete cases only."""
    out = df.select(col(group).cast("string").alias("g"), as_double(col(metric)).alias("x")).where("g IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    return out if groups is None else out.where(F.col("g").isin([str(g) for g in groups]))


def moments(pairs: DataFrame) -> DataFrame:
    """g, n, mean, var (ddof 1) of (g, x)."""
    return pairs.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def rank_sums(pairs: DataFrame) -> DataFrame:
    """g, n, rank_sum, and (alike in every row) total and ties = sum of t^3 - t, by value-compressed average ranks."""
    ranked = value_ranks(pairs, "x", ["g"])
    tied = ranked.groupBy("v").agg(F.max("ties").alias("t")).agg(F.sum("t").alias("total"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    return ranked.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum")).crossJoin(F.broadcast(tied))


def ks_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """d, n_a, n_b: the largest distance of two empirical distribution functions."""
    counts = pairs.where(F.col("g").isin(a, b)).groupBy("x").agg(F.count_if(F.col("g") == a).alias("na"), F.count_if(F.col("g") == b).alias("nb"))
    up = cumulative(cumulative(counts, "x", "na", "ca"), "x", "nb", "cb")
    totals = counts.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))
    return up.crossJoin(F.broadcast(totals)).groupBy("n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("d"))


def median_deviations(pairs: DataFrame) -> DataFrame:
    """(g, x) with x replaced by its distance from the group's median."""
    medians = pairs.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return pairs.join(F.broadcast(medians), "g").select("g", F.abs(F.col("x") - F.col("m")).alias("x"))


def contingency(df: DataFrame, group: str, metric: str, groups: list[str] | None = None) -> DataFrame:
    """g, m, n of complete pairs, labels as text; absent cells are absent."""
    pairs = df.select(col(group).cast("string").alias("g"), col(metric).cast("string").alias("m")).where("g IS NOT NULL AND m IS NOT NULL")
    if groups is not None:
        pairs = pairs.where(F.col("g").isin([str(x) for x in groups]))
    return pairs.groupBy("g", "m").agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, group: str) -> DataFrame:
    return df.where(col(group).isNotNull()).groupBy(col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g")


# --- finishers ---------------------------------------------------------------------------------


def cohens_d(a: dict[str, Any], b: dict[str, Any]) -> float:
    sp = math.sqrt(((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2))
    return (a["mean"] - b["mean"]) / sp if sp else 0.0


def student(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    df = a["n"] + b["n"] - 2
    pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / df
    se = math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
    t = (a["mean"] - b["mean"]) / se if se else math.nan
    return {"test": "t_test", "statistic": t, "p_value": D.t_two_sided(t, df), "df": float(df), "effect_size": cohens_d(a, b), "effect_name": "cohens_d"}


def welch(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    t = (a["mean"] - b["mean"]) / math.sqrt(va + vb) if va + vb else math.nan
    df = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1)) if va + vb else math.nan
    return {"test": "welch", "statistic": t, "p_value": D.t_two_sided(t, df), "df": df, "effect_size": cohens_d(a, b), "effect_name": "cohens_d"}


def mann_whitney(ranks: dict[str, dict[str, Any]], a: str, b: str) -> dict[str, Any]:
    n1, n2 = ranks[a]["n"], ranks[b]["n"]
    u = ranks[a]["rank_sum"] - n1 * (n1 + 1) / 2
    return {"test": "mann_whitney", "statistic": u, "p_value": D.mann_whitney_p(u, n1, n2, ranks[a]["ties"]), "effect_size": 1 - 2 * u / (n1 * n2), "effect_name": "rank_biserial"}


def anova(groups: list[dict[str, Any]]) -> dict[str, Any]:
    n = sum(g["n"] for g in groups)
    grand = sum(g["n"] * g["mean"] for g in groups) / n
    between = sum(g["n"] * (g["mean"] - grand) ** 2 for g in groups)
    within = sum((g["n"] - 1) * (g["var"] or 0.0) for g in groups)
    d1, d2 = len(groups) - 1, n - len(groups)
    f = (between / d1) / (within / d2) if within and d2 else math.nan
    return {"test": "anova", "statistic": f, "p_value": D.f_sf(f, d1, d2) if f == f else math.nan, "df": [d1, d2], "effect_size": between / (between + within) if between + within else 0.0, "effect_name": "eta_squared", "mse": within / d2 if d2 else math.nan}


def kruskal(ranks: list[dict[str, Any]]) -> dict[str, Any]:
    n, ties = ranks[0]["total"], ranks[0]["ties"]
    h = 12 / (n * (n + 1)) * sum(r["rank_sum"] ** 2 / r["n"] for r in ranks) - 3 * (n + 1)
    correction = 1 - ties / (n**3 - n)
    h = h / correction if correction else math.nan
    return {"test": "kruskal", "statistic": h, "p_value": D.chi2_sf(h, len(ranks) - 1) if h == h else math.nan, "df": len(ranks) - 1, "effect_size": h / (n - 1), "effect_name": "epsilon_squared"}


def table_of(cells: list[dict[str, Any]]) -> tuple[list[str], list[str], np.ndarray]:
    rows, columns = sorted({c["g"] for c in cells}), sorted({c["m"] for c in cells})
    out = np.zeros((len(rows), len(columns)))
    for c in cells:
        out[rows.index(c["g"]), columns.index(c["m"])] = c["n"]
    return rows, columns, out


def chi_square(table: np.ndarray) -> dict[str, Any]:
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    gap = np.abs(table - expected)
    if dof == 1:
        gap = gap - np.minimum(0.5, gap)
    chi = float((gap**2 / expected).sum()) if dof else 0.0
    v = math.sqrt(chi / (table.sum() * max(min(table.shape) - 1, 1)))
    return {"test": "chi_square", "statistic": chi, "p_value": D.chi2_sf(chi, dof) if dof else 1.0, "df": dof, "effect_size": v, "effect_name": "cramers_v", "expected_min": float(expected.min())}


def fisher(table: np.ndarray) -> dict[str, Any]:
    a, b, c, d = (int(x) for x in table.ravel())
    odds = a * d / (b * c) if b * c else (math.inf if a * d else math.nan)
    return {"test": "fisher_exact", "statistic": odds, "p_value": D.hypergeometric_two_sided(a, b, c, d), "effect_size": odds, "effect_name": "odds_ratio"}


def _dicts(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.orderBy("g").collect()]


def shapiro_by_group(pairs: DataFrame, labels: list[str]) -> dict[str, float | None]:
    """Shapiro-Wilk p by group; above SHAPIRO_ROWS values a sample is tested.

    The sample is of the least hashes of a value and its number among equal values, so it hangs on the values alone,
    not on how rows are partitioned or ordered.
    """
    n = {r["g"]: r["n"] for r in pairs.groupBy("g").agg(F.count("x").alias("n")).collect()}
    share = F.element_at(F.create_map(*[F.lit(v) for g, k in n.items() for v in (g, min(1.0, 1.2 * SHAPIRO_ROWS / k))]), F.col("g")) if n else F.lit(1.0)
    # equal values are numbered from their counts; no row is moved for it
    equal = pairs.groupBy("g", "x").agg(F.count(F.lit(1)).alias("copies"))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)), lambda i: i * COPIES)
    blocks = equal.withColumn("from", F.explode(steps))
    numbered = blocks.withColumn("no", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1)))
    u = (F.xxhash64("x", "no") / F.lit(float(2**64)) + 0.5).alias("u")
    rows = numbered.select("g", "x", "no", u).where(F.col("u") <= share)
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("u", "x", "no"))).where(F.col("k") <= SHAPIRO_ROWS).select("g", "x").collect()
    out: dict[str, float | None] = {}
    for g in labels:
        found = D.shapiro_wilk([r["x"] for r in top if r["g"] == g])
        out[g] = None if found is None else found[1]
    return out


def levene(pairs: DataFrame) -> dict[str, Any]:
    return anova([g for g in _dicts(moments(median_deviations(pairs)))]) | {"test": "levene"}


def select_test(k: int, shapiro: list[float | None], levene_p: float) -> str:
    if any(p is not None and p < 0.05 for p in shapiro):
        return "mann_whitney" if k == 2 else "kruskal"
    if k == 2:
        return "welch" if levene_p < 0.05 else "t_test"
    return "anova"


def run_test(pairs: DataFrame, kind: str, labels: list[str]) -> dict[str, Any]:
    """One test over (g, x) restricted to ``labels``."""
    own = pairs.where(F.col("g").isin(labels))
    if kind in ("t_test", "welch", "anova"):
        stats = {m["g"]: m for m in _dicts(moments(own))}
        missing = [g for g in labels if g not in stats or stats[g]["n"] < 2]
        if missing:
            raise ValueError(f"insufficient_group_size: {missing}")
        groups = [stats[g] for g in labels]
        return anova(groups) if kind == "anova" else (student if kind == "t_test" else welch)(*groups)
    if kind in ("mann_whitney", "kruskal"):
        ranks = {r["g"]: r for r in _dicts(rank_sums(own))}
        if any(g not in ranks for g in labels):
            raise ValueError("insufficient_group_size")
        return mann_whitney(ranks, *labels) if kind == "mann_whitney" else kruskal([ranks[g] for g in labels])
    if kind == "ks":
        row = ks_distance(own, *labels).first()
        if row is None or not row["n_a"] or not row["n_b"]:
            raise ValueError("insufficient_group_size")
        return {"test": "ks", "statistic": row["d"], "p_value": D.ks_p(row["d"], row["n_a"], row["n_b"]), "effect_size": row["d"], "effect_name": "ks_d"}
    raise ValueError("invalid_kind")


def compare(df: DataFrame, group: str, metric: str, groups: list[str] | None, numeric: bool) -> dict[str, Any]:
    """compare_groups: assumption checks choose the test."""
    if not numeric:
        rows, columns, table = table_of([r.asDict() for r in contingency(df, group, metric, groups).collect()])
        if min(table.shape, default=0) < 2:
            raise ValueError("insufficient_group_size")
        chi = chi_square(table)
        found = fisher(table) if table.shape == (2, 2) and chi["expected_min"] < 5 else chi
        check = {"name": "expected_cell_min", "value": chi["expected_min"], "violated": chi["expected_min"] < 5, "consequence": "fisher_exact" if found["test"] == "fisher_exact" else None}
        return found | {"groups": rows, "categories": columns, "table": table.astype(int).tolist(), "assumption_checks": [check]}
    counts = [(r["g"], r["n"]) for r in label_counts(df, group).collect()]
    labels = [str(g) for g in groups] if groups else (sorted(g for g, _ in counts) if len(counts) > 2 else [g for g, _ in counts[:2]])
    unknown = [g for g in labels if g not in dict(counts)]
    if unknown or len(labels) < 2:
        raise ValueError(f"group_not_found: {unknown}" if unknown else "too_few_groups")
    total = df.where(col(group).cast("string").isin(labels)).count()
    pairs = labelled(df, group, metric, labels)
    normal = shapiro_by_group(pairs, labels)
    spread = levene(pairs)
    kind = select_test(len(labels), list(normal.values()), spread["p_value"])
    found = run_test(pairs, kind, labels)
    stats = {m["g"]: m for m in _dicts(moments(pairs))}
    low = min((p for p in normal.values() if p is not None), default=None)
    checks = [
        {"name": "normality_test", "method": "shapiro", "p_values": normal, "violated": low is not None and low < 0.05, "consequence": "rank-based test" if low is not None and low < 0.05 else None},
        {"name": "equal_variances_test", "method": "levene", "p_value": spread["p_value"], "violated": spread["p_value"] < 0.05, "consequence": "welch" if kind == "welch" else None},
    ]
    text = f"{found['test']}: p = {found['p_value']:.4g}; {'evidence of' if found['p_value'] < 0.05 else 'no evidence of'} a difference in {metric} across {', '.join(labels)} ({found['effect_name']} = {found['effect_size']:.3g})."
    return found | {"groups": [stats[g] for g in labels], "n_dropped": total - sum(stats[g]["n"] for g in labels), "assumption_checks": checks, "interpretation": text}


# --- correlation --------------------------------------------------------------------------------


def correlation_pairs(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r, n for each pair of columns, pairwise complete. Pearson and Spearman; ranks are value-compressed."""
    if method == "spearman":
        return _spearman_pairs(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = as_double(col(a)), as_double(col(b))
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.corr(x, y).alias(f"r{k}"), F.count_if(both).alias(f"n{k}")]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)]))
    return df.agg(*aggs).select(rows.alias("p")).select("p.*")


def _spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = df.select(as_double(col(a)).alias("x"), as_double(col(b)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
            cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
            rank = {c: value_ranks(both, c, []).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")) for c in ("x", "y")}
            ranked = cells.join(rank["x"], "x").join(rank["y"], "y")
            n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
            sums = ranked.agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(F.col("n") * F.col("rx") ** 2).alias("sxx"), F.sum(F.col("n") * F.col("ry") ** 2).alias("syy"))
            r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
            one = sums.select(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), "n")
            out = one if out is None else out.union(one)
    return out


def kendall_tau(df: DataFrame, a: str, b: str) -> float:
    """Tau-b over counts of distinct pairs, with discordances by merge counting: n log n after the aggregate."""
    both = df.select(as_double(col(a)).alias("x"), as_double(col(b)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["x", "y"])
    n = int(cells["n"].sum())
    if n < 2:
        return math.nan
    ties = lambda s: float((s * (s - 1) / 2).sum())
    tx, ty, txy = ties(cells.groupby("x")["n"].sum()), ties(cells.groupby("y")["n"].sum()), ties(cells["n"])
    ys = {v: i + 1 for i, v in enumerate(sorted(cells["y"].unique()))}
    tree = np.zeros(len(ys) + 1)
    discordant, seen = 0.0, 0.0
    for _, group in cells.groupby("x", sort=True):
        for y, k in zip(group["y"], group["n"], strict=True):
            i, low = ys[y], 0.0
            while i:
                low += tree[i]
                i &= i - 1
            discordant += k * (seen - low)
        for y, k in zip(group["y"], group["n"], strict=True):
            i = ys[y]
            while i < len(tree):
                tree[i] += k
                i += i & -i
            seen += k
    total = n * (n - 1) / 2
    concordant = total - tx - ty + txy - discordant
    bottom = math.sqrt((total - tx) * (total - ty))
    return (concordant - discordant) / bottom if bottom else math.nan
