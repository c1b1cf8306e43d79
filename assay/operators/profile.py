"""Profiles: per-column counts, numeric, string and temporal statistics, distributions, flags."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import RID, as_double, col, exact_quantiles, is_numeric, is_string, is_temporal, user_columns

#: Rows up to which one aggregate may hold a column's values.
SMALL_ROWS = 200_000
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def groupable(df: DataFrame, name: str) -> Column:
    """The column, nested values as JSON so that they can be grouped."""
    return F.to_json(col(name)) if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) else col(name)


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: column, n_rows, n_null, n_distinct - one scan, partial aggregates per (column, value)."""
    columns = columns or user_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.sha2(groupable(df, c).cast("string"), 256).alias("value")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column", "p.value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"))


def numeric_stats(df: DataFrame, name: str, most: int = SMALL_ROWS) -> DataFrame:
    """One row: min, max, mean, median, stddev, p25, p75, p99, zeros, negatives, n.

    Up to ``most`` rows one aggregate answers all; beyond, quantiles come from bracketed selection, which gathers no value list.
    """
    c, wanted = as_double(col(name)), [0.25, 0.5, 0.75, 0.99]
    large = df.count() > most
    q = F.array(*[F.lit(v).cast("double") for v in exact_quantiles(df, name, wanted, most)]) if large else F.percentile(c, F.array(*[F.lit(p) for p in wanted]))
    one = df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), *([] if large else [q.alias("q")]), F.count_if(c == 0).alias("zeros"), F.count_if(c < 0).alias("negatives"))
    if large:
        one = one.withColumn("q", q)
    return one.select("n", "min", "max", "mean", "stddev", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), F.col("q")[3].alias("p99"), "zeros", "negatives")


def string_stats(df: DataFrame, name: str) -> DataFrame:
    c = col(name).cast("string")
    size = F.length(c)
    return df.agg(F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length"), F.count_if(c == "").alias("n_empty"), F.count_if(F.trim(c) == "").alias("n_whitespace"))


def temporal_stats(df: DataFrame, name: str) -> DataFrame:
    """min, max, span_days (day boundaries crossed), modal_weekday (Sunday 0; ties to the smallest), n_null."""
    c = col(name)
    days = df.groupBy((F.dayofweek(c) - 1).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    some = F.when(F.col("d").isNotNull(), F.struct(F.col("n"), (-F.col("d")).alias("d")))
    return days.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.max(some).alias("m"), F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("n_null")).select("min", "max", F.datediff("max", "min").alias("span_days"), (-F.col("m.d")).alias("modal_weekday"), "n_null")


def shape(df: DataFrame, name: str) -> DataFrame:
    """Bias-corrected skewness and kurtosis from population moments."""
    c = as_double(col(name))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return df.agg(F.count(c).cast("double").alias("n"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2")).select(skew.alias("skewness"), kurt.alias("kurtosis"))


def quantiles(df: DataFrame, name: str, probabilities: tuple[float, ...] = QUANTILES) -> dict[str, float | None]:
    return dict(zip([f"p{round(100 * p)}" for p in probabilities], exact_quantiles(df, name, list(probabilities)), strict=True))


def histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """Dense equal-width bins: bin, lo, hi, n. A constant column is one full first bin; no values give no rows."""
    spark = df.sparkSession
    v = df.select(as_double(col(name)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    found = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    return grid.join(F.broadcast(found), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, name: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties in ascending order."""
    v = groupable(df, name)
    return df.where(col(name).isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def value_counts(df: DataFrame, name: str, cap: int = 50) -> DataFrame:
    """value, n, and the entropy in bits over all values; the list ends at ``cap`` values."""
    found = df.where(col(name).isNotNull()).groupBy(groupable(df, name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s")).select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))
    return found.orderBy(F.desc("n"), "value").limit(cap).crossJoin(F.broadcast(total))


def temporal_buckets(df: DataFrame, name: str) -> DataFrame:
    """unit, bucket, n for year, month, weekday (Sunday 0) and hour, in one scan."""
    c = col(name)
    units = {"year": F.year(c), "month": F.month(c), "weekday": F.dayofweek(c) - 1, "hour": F.hour(c.cast("timestamp_ntz"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), e.cast("int").alias("bucket")) for u, e in units.items()]))
    return df.where(c.isNotNull()).select(pairs.alias("p")).groupBy("p.unit", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def outlier_counts(df: DataFrame, columns: list[str], most: int = SMALL_ROWS) -> DataFrame:
    """Per column: q1, q3, n outside the 1.5 IQR band, n beyond three standard deviations."""
    large = df.count() > most
    aggs = []
    for i, name in enumerate(columns):
        c = as_double(col(name))
        if not large:
            aggs.append(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}"))
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
    stats = df.agg(*aggs)
    if large:
        for i, name in enumerate(columns):
            stats = stats.withColumn(f"q{i}", F.array(*[F.lit(v).cast("double") for v in exact_quantiles(df, name, [0.25, 0.75], most)]))
    tests = []
    for i, name in enumerate(columns):
        c, q = as_double(col(name)), F.col(f"q{i}")
        iqr = q[1] - q[0]
        tests.append(F.struct(F.lit(name).alias("column"), q[0].alias("q1"), q[1].alias("q3"), ((c < q[0] - 1.5 * iqr) | (c > q[1] + 1.5 * iqr)).alias("iqr"), ((F.col(f"s{i}") > 0) & (F.abs(c - F.col(f"m{i}")) > 3 * F.col(f"s{i}"))).alias("z")))
    long = df.crossJoin(F.broadcast(stats)).select(F.explode(F.array(*tests)).alias("t")).select("t.*")  # stats is one row
    return long.groupBy("column").agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.count_if("iqr").alias("n_iqr"), F.count_if("z").alias("n_z"))


def flags(df: DataFrame, name: str, n_rows: int, n_null: int, n_distinct: int) -> dict[str, bool]:
    present = n_rows - n_null
    text = is_string(df, name)
    return {
        "mostly_null": n_rows > 0 and n_null / n_rows > 0.5,
        "looks_like_id": text and present > 100 and n_distinct / present >= 0.95,
        "looks_like_categorical": text and n_distinct <= 50 and present > n_distinct,
        "looks_like_timestamp": is_temporal(df, name),
        "high_cardinality": present > 100 and n_distinct / present > 0.9,
        "constant": n_distinct == 1,
        "mixed_dtype_suspect": False,
    }


def _row(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def profile(df: DataFrame, sample_rows: int = 5) -> dict[str, Any]:
    """Everything about every column: counts in one scan, then a block by type."""
    found = {r["column"]: r for r in counts(df).collect()} if user_columns(df) else {}
    n_rows = next((r["n_rows"] for r in found.values()), df.count() if not found else 0)
    out = []
    for name in user_columns(df):
        r = found.get(name)
        null, distinct = (r["n_null"], r["n_distinct"]) if r else (0, 0)
        block: dict[str, Any] = {"name": name, "dtype": df.schema[name].dataType.simpleString(), "null_count": null, "null_fraction": null / n_rows if n_rows else 0.0, "distinct_count": distinct, "flags": flags(df, name, n_rows, null, distinct), "top_values": [x.asDict() for x in top_values(df, name).collect()]}
        if is_numeric(df, name):
            stats = _row(numeric_stats(df, name))
            if stats["n"]:
                block["numeric"] = stats | {"outliers": _row(outlier_counts(df, [name]))}
        elif is_string(df, name):
            block["string"] = _row(string_stats(df, name))
        elif is_temporal(df, name):
            block["temporal"] = _row(temporal_stats(df, name))
        elif isinstance(df.schema[name].dataType, T.BooleanType):
            block["boolean"] = _row(df.agg(F.count_if(col(name)).alias("n_true"), F.count_if(~col(name)).alias("n_false")))
        out.append(block)
    head = df.orderBy(RID) if RID in df.columns else df
    return {"row_count": n_rows, "column_count": len(out), "columns": out, "sample": [r.asDict(True) for r in head.select(*[col(c) for c in user_columns(df)]).limit(sample_rows).collect()], "suggestions": suggestions(out)}


def suggestions(columns: list[dict[str, Any]]) -> list[str]:
    """At most three next steps: a mostly null column, a small categorical one, the first numeric one."""
    out = []
    null = next((c for c in columns if c["flags"]["mostly_null"]), None)
    if null:
        out.append(f"analyze_missingness: {null['name']} is mostly null")
    small = next((c for c in columns if c["flags"]["looks_like_categorical"] and c["distinct_count"] <= 10), None)
    if small:
        out.append(f"compare_groups by {small['name']}")
    numeric = next((c for c in columns if "numeric" in c), None)
    if numeric:
        out.append(f"describe_column {numeric['name']}")
    return out[:3]


def describe(df: DataFrame, name: str, bins: int = 20) -> dict[str, Any]:
    """The distribution of one column, by its type."""
    if is_numeric(df, name):
        return {"kind": "numeric", "quantiles": quantiles(df, name), **_row(shape(df, name)), "histogram": [r.asDict() for r in histogram(df, name, bins).orderBy("bin").collect()]}
    if is_temporal(df, name):
        rows = temporal_buckets(df, name).orderBy("unit", "bucket").collect()
        return {"kind": "temporal", "buckets": {u: [{"bucket": r["bucket"], "n": r["n"]} for r in rows if r["unit"] == u] for u in ("year", "month", "weekday", "hour")}}
    rows = value_counts(df, name).collect()
    return {"kind": "categorical", "value_counts": [{"value": r["value"], "n": r["n"]} for r in rows], "entropy": rows[0]["entropy"] if rows else 0.0}


def group_profile(df: DataFrame, group: str, metric: str) -> DataFrame:
    """n, min, max, mean, stddev and median of a metric by group."""
    c = as_double(col(metric))
    return df.groupBy(col(group).alias("grp")).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.percentile(c, F.lit(0.5)).alias("median"))


def by_rank(df: DataFrame, name: str, descending: bool = True) -> DataFrame:
    """Distinct values with their dense rank."""
    values = df.groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n") if descending else F.asc("n"))))
