"""Column expressions and plans that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The row ordinal of a snapshot; data sets with a column of this name are refused.
RID = "__assay_ordinal"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRING = (T.StringType, T.BinaryType)
#: Rows of distinct values that one task orders when prefix sums are taken over a whole column.
BUCKET_ROWS = 200_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TEMPORAL)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, STRING)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name != RID]


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def as_double(c: Column) -> Column:
    return c.cast("double")


def exact_quantiles(df: DataFrame, name: str, probabilities: list[float], most: int = 200_000) -> list[float | None]:
    """Linear-interpolation quantiles, exact, without gathering the column.

    Up to ``most`` rows one aggregate answers. Beyond that, an approximate quantile brackets each wanted rank,
    one pass counts what lies below and inside the brackets, and brackets are narrowed until few rows are left.
    """
    values = df.select(as_double(col(name)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if n == 0:
        return [None] * len(probabilities)
    if n <= most:
        return list(values.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probabilities]))).first()[0])
    ranks = sorted({r for p in probabilities for r in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})
    found = _order_statistics(values, ranks, n, most)
    out = []
    for p in probabilities:
        at = (n - 1) * p
        low, high = found[int(at)], found[min(n - 1, int(at) + 1)]
        out.append(low + (high - low) * (at - int(at)))
    return out


def _order_statistics(values: DataFrame, ranks: list[int], n: int, most: int) -> dict[int, float]:
    """Values at zero-based ranks."""
    accuracy = 10_000
    slack = 2.0 * n / accuracy + 2
    ends = [(max(0.0, (r - slack) / n), min(1.0, (r + slack) / n)) for r in ranks]
    bounds = values.agg(F.percentile_approx("v", F.array(*[F.lit(x) for pair in ends for x in pair]), accuracy)).first()[0]
    brackets = [(min(a, b), max(a, b)) for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
    lows = values.agg(*[F.count_if(F.col("v") < F.lit(a)).alias(f"b{i}") for i, (a, _) in enumerate(brackets)], *[F.count_if((F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b))).alias(f"i{i}") for i, (a, b) in enumerate(brackets)]).first()
    out: dict[int, float] = {}
    small: list[int] = []
    for i, rank in enumerate(ranks):
        low, high = brackets[i]
        below, inside = lows[f"b{i}"], lows[f"i{i}"]
        if not below <= rank < below + inside:  # the approximation was off: go on in the side it missed
            side = values.where(F.col("v") < F.lit(low)) if rank < below else values.where(F.col("v") > F.lit(high))
            at = rank if rank < below else rank - below - inside
            out[rank] = next(iter(_order_statistics(side, [at], side.count(), most).values()))
        elif low == high:
            out[rank] = low
        elif inside <= most // max(1, len(ranks)):
            small.append(i)
        else:
            own = values.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
            out[rank] = next(iter(_order_statistics(own, [rank - below], inside, most).values()))
    if small:  # few values are left around these ranks: count them all at once
        near = F.lit(False)
        for i in small:
            near = near | ((F.col("v") >= F.lit(brackets[i][0])) & (F.col("v") <= F.lit(brackets[i][1])))
        counts = [(x["v"], x["n"]) for x in values.where(near).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()]
        for i in small:
            seen = lows[f"b{i}"]
            for v, k in counts:
                if brackets[i][0] <= v <= brackets[i][1]:
                    seen += k
                    if ranks[i] < seen:
                        out[ranks[i]] = v
                        break
    return out


def cumulative(df: DataFrame, order: str, count: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``count`` over rows whose ``order`` is no larger. ``order`` is distinct.

    Large inputs are cut into value ranges; sums run inside each range and the totals of earlier ranges are added.
    """
    n = df.count()
    if n <= BUCKET_ROWS:
        return df.withColumn(name, F.sum(count).over(Window.partitionBy(F.lit(0)).orderBy(order)))
    buckets = min(1000, -(-n // BUCKET_ROWS))
    cuts = sorted(set(df.agg(F.percentile_approx(order, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000)).first()[0]))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: x < F.col(order)))
    cut = df.withColumn("__b", bucket)
    totals = cut.groupBy("__b").agg(F.sum(count).alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))  # at most `buckets` rows
    inside = F.sum(count).over(Window.partitionBy("__b").orderBy(order))
    return cut.withColumn("__c", inside).join(F.broadcast(bases), "__b").withColumn(name, F.col("__c") + F.col("__base")).drop("__b", "__c", "__base")


def value_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Average ranks without ranking rows: per distinct value its ``rank`` and ``ties``, joined to the counts ``n`` by group.

    Returns v, ties, rank and, for each combination of ``by``, its count n of that value.
    """
    counts = df.select(*by, as_double(col(value)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("v").agg(F.sum("n").alias("ties"))
    ranked = cumulative(values, "v", "ties", "upto").select("v", "ties", (F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).alias("rank"))
    return counts.join(ranked, "v")
