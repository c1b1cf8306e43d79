"""Post-hoc comparisons and p-value adjustment."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from . import groups as G

METHODS = ("bonferroni", "sidak", "holm", "bh", "by")


def adjust(p: list[float], method: str = "bh") -> list[float]:
    """Adjusted p-values in input order."""
    n = len(p)
    if method == "bonferroni":
        return [min(1.0, x * n) for x in p]
    if method == "sidak":
        return [-math.expm1(n * math.log1p(-x)) if x < 1 else 1.0 for x in p]
    order = sorted(range(n), key=p.__getitem__)
    out = [0.0] * n
    if method == "holm":
        top = 0.0
        for k, i in enumerate(order):
            top = max(top, min(1.0, (n - k) * p[i]))
            out[i] = top
        return out
    if method not in ("bh", "by"):
        raise ValueError("unknown_method")
    factor = sum(1 / k for k in range(1, n + 1)) if method == "by" else 1.0
    low = 1.0
    for k in range(n - 1, -1, -1):
        i = order[k]
        low = min(low, p[i] * n * factor / (k + 1))
        out[i] = low
    return out


def adjusted(table: DataFrame, p: str, method: str) -> DataFrame:
    """Add ``adjusted`` to a table of p-values, as windows over their order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    value = F.col(p)
    if method == "bonferroni":
        return table.withColumn("adjusted", F.least(F.lit(1.0), value * n))
    if method == "sidak":
        return table.withColumn("adjusted", 1 - F.pow(1 - value, n))
    order = Window.partitionBy(F.lit(0)).orderBy(p)
    k = F.row_number().over(order)
    if method == "holm":
        own = table.withColumn("__a", F.least(F.lit(1.0), (n - k + 1) * value))
        return own.withColumn("adjusted", F.max("__a").over(order)).drop("__a")
    factor = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i) if method == "by" else F.lit(1.0)
    own = table.withColumn("__f", factor).withColumn("__a", value * n * F.col("__f") / F.rank().over(order)).withColumn("__k", k)
    # of equal p-values the last rank counts
    own = own.withColumn("__a", F.min(value * n * F.col("__f") / F.col("__k")).over(Window.partitionBy(p)))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc(p))
    return own.withColumn("adjusted", F.least(F.lit(1.0), F.min("__a").over(down))).drop("__a", "__f", "__k")


def dunn_pairs(pairs: DataFrame) -> DataFrame:
    """a, b, z for every pair of groups, from pooled value-compressed ranks."""
    r = G.rank_sums(pairs).select("g", "n", (F.col("rank_sum") / F.col("n")).alias("m"), "total", "ties")
    x, y = r.alias("x"), r.alias("y")
    n = F.col("x.total")
    var = (n * (n + 1) / 12 - F.col("x.ties") / (12 * (n - 1))) * (1 / F.col("x.n") + 1 / F.col("y.n"))
    return x.join(F.broadcast(y), F.col("x.g") < F.col("y.g")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), ((F.col("y.m") - F.col("x.m")) / F.sqrt(var)).alias("z"))


def dunn(pairs: DataFrame, labels: list[str], p_adjust: str = "holm", alpha: float = 0.05) -> dict[str, Any]:
    rows = dunn_pairs(pairs).orderBy("a", "b").collect()
    p = [2 * D.norm_sf(abs(r["z"])) for r in rows]
    fixed = adjust(p, p_adjust)
    ranks = {r["g"]: r for r in G._dicts(G.rank_sums(pairs))}
    found = [{"group_a": r["a"], "group_b": r["b"], "statistic": r["z"], "p_value": q, "p_adjusted": f, "reject": f <= alpha} for r, q, f in zip(rows, p, fixed, strict=True)]
    return {"method": "dunn", "p_adjust": p_adjust, "omnibus": G.kruskal([ranks[g] for g in labels]), "comparisons": found}


def tukey(pairs: DataFrame, labels: list[str], alpha: float = 0.05) -> dict[str, Any]:
    stats = {m["g"]: m for m in G._dicts(G.moments(pairs))}
    whole = G.anova([stats[g] for g in labels])
    k, df = len(labels), whole["df"][1]
    critical = D.studentized_range_ppf(1 - alpha, k, df)
    found = []
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            estimate = stats[b]["mean"] - stats[a]["mean"]
            se = math.sqrt(whole["mse"] / 2 * (1 / stats[a]["n"] + 1 / stats[b]["n"]))
            p = D.studentized_range_sf(abs(estimate) / se, k, df)
            found.append({"group_a": a, "group_b": b, "estimate": estimate, "p_value": p, "p_adjusted": p, "ci": [estimate - critical * se, estimate + critical * se], "reject": p <= alpha})
    return {"method": "tukey", "omnibus": whole, "comparisons": found}
