"""Named queries over the driver's tables: each operator applied to whole tables, with the same answer in SQL where SQL can give it.

Floating-point results are rounded on both sides, since sums are added up in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import RID, cumulative, exact_quantiles
from .operators import groups as G
from .operators import missing, models, outliers, plots, posthoc, power, profile, scoring
from .plans import guard
from .sources import provenance, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def rounded(table_: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """All double columns rounded; ``other`` names columns with digits of their own."""
    return table_.select(*[r(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in table_.dtypes])


def rows(spark: SparkSession, found: list[dict[str, Any]], schema: str) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]
    return spark.createDataFrame([tuple(float(x[n]) if "double" in t and x[n] is not None else x[n] for n, t in zip(names, schema.split(", "), strict=True)) for x in found], schema)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with gaps by rule: the driver's tables have none."""
    gap = lambda c, key, k: F.when(F.col(key) % k != 0, F.col(c)).alias(c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", gap("l_tax", "l_orderkey", 7), gap("l_discount", "l_partkey", 11), gap("l_quantity", "l_suppkey", 13), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("l_extendedprice"))


GAPS = """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax,
  CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS l_extendedprice FROM lineitem) """


# --- profiles --------------------------------------------------------------------------------------


@query("""SELECT count(o_totalprice) AS n, round(min(o_totalprice), 4) AS "min", round(max(o_totalprice), 4) AS "max", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev,
  round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.99), 4) AS p99,
  count(*) FILTER (o_totalprice = 0) AS zeros, count(*) FILTER (o_totalprice < 0) AS negatives FROM orders""")
def profile_numeric_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.numeric_stats(table(spark, d, "orders"), "o_totalprice"), 4)


@query("""SELECT count(l_extendedprice) AS n, round(min(l_extendedprice), 3) AS "min", round(max(l_extendedprice), 3) AS "max", round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS stddev,
  round(quantile_cont(l_extendedprice, 0.25), 3) AS p25, round(quantile_cont(l_extendedprice, 0.5), 3) AS median, round(quantile_cont(l_extendedprice, 0.75), 3) AS p75, round(quantile_cont(l_extendedprice, 0.99), 3) AS p99,
  count(*) FILTER (l_extendedprice = 0) AS zeros, count(*) FILTER (l_extendedprice < 0) AS negatives FROM lineitem""")
def profile_numeric_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """The same by the way of large tables: quantiles by bracketed selection."""
    return rounded(profile.numeric_stats(table(spark, d, "lineitem"), "l_extendedprice", most=5_000), 3)


@query("""SELECT o_orderstatus AS grp, count(o_totalprice) AS n, round(min(o_totalprice), 4) AS "min", round(max(o_totalprice), 4) AS "max", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY o_orderstatus""")
def profile_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.group_profile(table(spark, d, "orders"), "o_orderstatus", "o_totalprice"), 4)


_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _COLUMNS))
def profile_all_columns_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return profile.counts(table(spark, d, "lineitem"))


@query("SELECT min(length(p_name))::INT AS min_length, max(length(p_name))::INT AS max_length, round(avg(length(p_name)), 6) AS mean_length, count(*) FILTER (p_name = '') AS n_empty, count(*) FILTER (trim(p_name) = '') AS n_whitespace FROM part")
def profile_strings_part(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.string_stats(table(spark, d, "part"), "p_name"))


@query("""SELECT min(o_orderdate) AS "min", max(o_orderdate) AS "max", date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS span_days,
  (SELECT dayofweek(o_orderdate)::INT FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS modal_weekday, count(*) - count(o_orderdate) AS n_null FROM orders""")
def profile_temporal_orders(spark: SparkSession, d: str) -> DataFrame:
    return profile.temporal_stats(table(spark, d, "orders"), "o_orderdate")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_values_priority(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "orders"), "o_orderpriority")


@query("""WITH c AS (SELECT 'c_custkey' AS "column", FALSE AS is_text, count(*) AS n, count(DISTINCT c_custkey) AS k FROM customer UNION ALL SELECT 'c_name', TRUE, count(*), count(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'c_nationkey', FALSE, count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', FALSE, count(*), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', TRUE, count(*), count(DISTINCT c_mktsegment) FROM customer)
  SELECT "column", is_text AND n > 100 AND k / n::DOUBLE >= 0.95 AS looks_like_id, is_text AND k <= 50 AND n > k AS looks_like_categorical, n > 100 AND k / n::DOUBLE > 0.9 AS high_cardinality, k = 1 AS constant FROM c""")
def column_flags_customer(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    found = []
    for x in profile.counts(df).collect():
        f = profile.flags(df, x["column"], x["n_rows"], x["n_null"], x["n_distinct"])
        found.append({"column": x["column"]} | f)
    return rows(spark, found, "column string, looks_like_id boolean, looks_like_categorical boolean, high_cardinality boolean, constant boolean")


@query("""WITH v AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT round(-sum(n / s * log2(n / s)), 6) AS entropy FROM v, (SELECT sum(n)::DOUBLE AS s FROM v))
  SELECT value, n, entropy FROM v, t ORDER BY n DESC, value LIMIT 50""")
def value_counts_entropy_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.value_counts(table(spark, d, "customer"), "c_mktsegment"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
  SELECT g::INT AS bin, round(lo + g * ((hi - lo) / 20), 4) AS lo, round(lo + (g + 1) * ((hi - lo) / 20), 4) AS hi, coalesce(n, 0) AS n FROM e, range(20) t(g) LEFT JOIN c ON c.bin = g""")
def histogram_price_20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20), 4)


_Q = "[0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]"


@query(f"SELECT unnest({_Q})::DOUBLE AS p, round(unnest(quantile_cont(l_extendedprice, {_Q})), 3) AS value FROM lineitem")
def quantiles_price(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles by bracketed selection: beyond the small-table bound no value list is gathered."""
    found = exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", list(profile.QUANTILES), most=20_000)
    return rows(spark, [{"p": p, "value": v} for p, v in zip(profile.QUANTILES, found, strict=True)], "p double, value double").withColumn("value", r("value", 3))


@query("SELECT round(skewness(l_extendedprice), 6) AS skewness, round(kurtosis(l_extendedprice), 6) AS kurtosis FROM lineitem")
def skew_kurt_price(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.shape(table(spark, d, "lineitem"), "l_extendedprice"))


@query("SELECT 'year' AS unit, year(ts)::INT AS bucket, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'month', month(ts)::INT, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'weekday', dayofweek(ts)::INT, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'hour', hour(ts)::INT, count(*) FROM events GROUP BY 2")
def temporal_buckets_events(spark: SparkSession, d: str) -> DataFrame:
    return profile.temporal_buckets(table(spark, d, "events"), "ts")


def _outlier_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_iqr, count(*) FILTER (sd > 0 AND abs({c} - m) > 3 * sd) AS n_z
  FROM customer JOIN orders ON c_custkey = o_custkey, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS sd FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY q1, q3"""


@query(_outlier_sql("c_acctbal") + " UNION ALL " + _outlier_sql("o_totalprice"))
def iqr_outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rounded(profile.outlier_counts(joined.select("c_acctbal", "o_totalprice"), ["c_acctbal", "o_totalprice"]), 4)


# --- guarded SQL -----------------------------------------------------------------------------------


def guarded(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    """``sql`` after the plan guard, over views of the tables."""
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    guard.check(spark, sql)
    return spark.sql(sql)


def _both(name: str, spark_sql: str, tables: tuple[str, ...], duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return guarded(spark, d, spark_sql, *tables)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = duck_sql or spark_sql


_both("query_join_on_filter", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name", ("customer", "orders", "nation"))
_both("query_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("lineitem",))
_both("query_rollup_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", ("orders",))
_both("query_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT 'without', count(*) FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", ("customer", "orders"), "SELECT 'with' AS kind, count(*) AS n FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT 'without', count(*) FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey")
_both("query_full_outer", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey", ("supplier", "customer"))
_both("query_range_join", "SELECT band, count(*) AS n FROM orders JOIN (SELECT * FROM VALUES (0, 0D, 100000D), (1, 100000D, 250000D), (2, 250000D, 1000000D) AS b(band, lo, hi)) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band", ("orders",), "SELECT band, count(*) AS n FROM orders JOIN (VALUES (0, 0.0, 100000.0), (1, 100000.0, 250000.0), (2, 250000.0, 1000000.0)) b(band, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band")
_both("query_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", ("customer", "supplier", "nation"))
_both("query_window_frames", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank FROM orders", ("orders",), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS k, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INT AS priority_rank FROM orders")
_both("query_qualify", "SELECT * FROM (SELECT o_orderstatus, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3", ("orders",), "SELECT o_orderstatus, o_orderkey, o_totalprice, (rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey))::INT AS k FROM orders QUALIFY k <= 3")
_both("query_json_props", "SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2", ("events",), "SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
_both("query_listagg", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", ("nation", "region"), "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_both("query_recursive_cte", "WITH RECURSIVE t(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 12) SELECT i, f FROM t", ())
_both("query_aggregates", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS dearest, bool_and(o_totalprice > 0) AS positive, count(DISTINCT o_custkey) AS customers, count_if(o_totalprice > 100000) AS large, round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_samp(o_totalprice, o_custkey), 0) AS cov FROM orders GROUP BY 1", ("orders",), "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS dearest, bool_and(o_totalprice > 0) AS positive, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice > 100000) AS large, round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_samp(o_totalprice, o_custkey), 0) AS cov FROM orders GROUP BY 1")
_both("query_lateral", "SELECT n_name, best FROM nation, LATERAL (SELECT max(c_acctbal) AS best FROM customer WHERE c_nationkey = n_nationkey) ", ("nation", "customer"))
_both("query_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", ("orders",), "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
_both("query_dates", "SELECT extract(YEAR FROM l_shipdate) AS y, extract(MONTH FROM l_shipdate) AS m, count(*) AS n, max(datediff(l_shipdate, DATE'1992-01-01')) AS days FROM lineitem GROUP BY 1, 2", ("lineitem",), "SELECT extract(YEAR FROM l_shipdate)::INT AS y, extract(MONTH FROM l_shipdate)::INT AS m, count(*) AS n, max(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate))::INT AS days FROM lineitem GROUP BY 1, 2")
_both("query_date_parsing", "SELECT CAST(d AS STRING) AS d, count(*) AS n FROM (SELECT coalesce(try_to_timestamp(t, 'yyyy-MM-dd'), try_to_timestamp(t, 'dd/MM/yyyy'), try_to_timestamp(t, 'MMM d, yyyy'))::DATE AS d FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'MMM d, yyyy') END AS t FROM orders)) GROUP BY 1", ("orders",), "SELECT d::VARCHAR AS d, count(*) AS n FROM (SELECT coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%b %-d, %Y'))::DATE AS d FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS t FROM orders)) GROUP BY 1")


@query("SELECT event_id, user_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS last_order FROM events")
def asof_emulated(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's latest order until then: both sides in one ordered window, no range join."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("timestamp_ntz").alias("at"))
    o = table(spark, d, "orders").select(F.lit(None).cast("bigint").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.col("o_orderdate").alias("at"))
    last = F.last("at", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return e.union(o).withColumn("last_order", last).where("side = 1").select("event_id", "user_id", "last_order")


@query("WITH a AS (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT n_name, count(*) AS n, round(avg(total), 4) AS mean_total FROM a JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def materialize_chain(spark: SparkSession, d: str) -> DataFrame:
    """A derived data set as a snapshot with an ordinal, and a query over it."""
    first = guarded(spark, d, "SELECT c_custkey, c_nationkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL", "customer", "orders")
    readers.snapshot(first, "derived").drop(RID).createOrReplaceTempView("derived_totals")
    return guarded(spark, d, "SELECT n_name, count(*) AS n, round(avg(total), 4) AS mean_total FROM derived_totals JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "nation")


def _written(spark: SparkSession, d: str, name: str, ending: str) -> DataFrame:
    """A table written in another format and read back by the engine's reader."""
    path = f"{readers.store_root(spark)}/scan-{uuid.uuid4().hex}.{ending}"
    df = table(spark, d, name)
    if ending in ("csv", "tsv"):
        df.write.option("header", True).option("sep", "\t" if ending == "tsv" else ";").csv(path)
    elif ending == "parquet":
        df.write.parquet(path)
    else:
        df.write.json(path)
    return readers.read(spark, path).select(df.columns)


@query("SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d, "customer", "csv")


@query("SELECT p_partkey::INT AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d, "part", "tsv")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d, "supplier", "jsonl")


# --- tests -----------------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return G.labelled(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return G.labelled(table(spark, d, "lineitem"), "l_linestatus", "l_quantity")


@query("SELECT o_orderstatus AS g, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 0) AS var FROM orders GROUP BY 1")
def group_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.moments(_orders(spark, d)), 4, var=0)


_TWO = "WITH s AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM s WHERE g = 'F'), b AS (SELECT * FROM s WHERE g = 'O') "
_SP = "(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))"


@query(_TWO + f"SELECT round((a.m - b.m) / sqrt({_SP} * (1 / a.n + 1 / b.n)), 6) AS statistic, a.n + b.n - 2 AS df, round((a.m - b.m) / sqrt({_SP}), 8) AS effect_size FROM a, b")
def student_stat_cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.run_test(_lines(spark, d), "t_test", ["F", "O"])], "statistic double, df double, effect_size double"), 6, effect_size=8)


@query(_TWO + "SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df FROM a, b")
def welch_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.run_test(_lines(spark, d), "welch", ["F", "O"])], "statistic double, df double"), 6, df=4)


def _ranks(cols: str) -> str:
    return f"WITH x AS (SELECT {cols}), k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk FROM x), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), s AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS rs FROM k GROUP BY g), n AS (SELECT count(*)::DOUBLE AS nn FROM x) "


@query(_ranks("l_linestatus AS g, l_quantity AS v FROM lineitem") + "SELECT round(a.rs - a.n * (a.n + 1) / 2, 1) AS statistic, round(1 - 2 * (a.rs - a.n * (a.n + 1) / 2) / (a.n * b.n), 8) AS effect_size FROM s a, s b WHERE a.g = 'F' AND b.g = 'O'")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.run_test(_lines(spark, d), "mann_whitney", ["F", "O"])], "statistic double, effect_size double"), 1, effect_size=8)


@query(_ranks("o_orderstatus AS g, o_totalprice AS v FROM orders") + ", h AS (SELECT (12 / (nn * (nn + 1)) * (SELECT sum(rs * rs / n) FROM s) - 3 * (nn + 1)) / (1 - ties / (nn ** 3 - nn)) AS h, nn FROM n, t) SELECT round(h, 5) AS statistic, round(h / (nn - 1), 9) AS effect_size FROM h")
def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.run_test(_orders(spark, d), "kruskal", ["F", "O", "P"])], "statistic double, effect_size double"), 5, effect_size=9)


_F = ", w AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k FROM s), z AS (SELECT (SELECT sum(n * (m - gm) ** 2) FROM s, w) AS b, (SELECT sum((n - 1) * v) FROM s) AS i) SELECT round((b / (k - 1)) / (i / (nn - k)), 6) AS statistic, round(b / (b + i), 8) AS effect_size FROM z, w"


@query("WITH s AS (SELECT o_orderstatus AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)" + _F)
def anova_f_eta2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.run_test(_orders(spark, d), "anova", ["F", "O", "P"])], "statistic double, effect_size double"), 6, effect_size=8)


@query("WITH q AS (SELECT o_orderstatus AS g, median(o_totalprice) AS md FROM orders GROUP BY 1), y AS (SELECT g, abs(o_totalprice - md) AS x FROM orders JOIN q ON g = o_orderstatus), s AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM y GROUP BY 1)" + _F)
def levene_w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, [G.levene(_orders(spark, d))], "statistic double, effect_size double"), 6, effect_size=8)


@query("""WITH c AS (SELECT l_quantity AS x, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), u AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER ()::DOUBLE AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)
  SELECT max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, round(max(abs(fa - fb)), 8) AS d FROM u""")
def ks_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.ks_distance(_lines(spark, d), "F", "O"), 8)


@query("SELECT o_orderstatus AS g, o_orderpriority AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH o AS (SELECT o_orderstatus AS g, o_orderpriority AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM o), e AS (SELECT o.n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY m) / (SELECT t FROM t) AS ex FROM o), c AS (SELECT sum((n - ex) ** 2 / ex) AS chi FROM e)
  SELECT round(chi, 6) AS statistic, 8 AS df, round(sqrt(chi / (t * 2)), 8) AS effect_size FROM c, t""")
def chi2_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    cells = [x.asDict() for x in G.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").collect()]
    return rounded(rows(spark, [G.chi_square(G.table_of(cells)[2])], "statistic double, df int, effect_size double"), 6, effect_size=8)


@query("""WITH x AS (SELECT (l_returnflag = 'R')::VARCHAR AS g, l_linestatus AS m FROM lineitem), c AS (SELECT count(*) FILTER (g = 'false' AND m = 'F')::DOUBLE AS a, count(*) FILTER (g = 'false' AND m = 'O')::DOUBLE AS b, count(*) FILTER (g = 'true' AND m = 'F')::DOUBLE AS c, count(*) FILTER (g = 'true' AND m = 'O')::DOUBLE AS d FROM x)
  SELECT round(a * d / (b * c), 8) AS odds_ratio FROM c""")
def fisher_odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("r"), "l_linestatus")
    found = G.table_of([x.asDict() for x in G.contingency(own, "r", "l_linestatus").collect()])[2]
    return rows(spark, [{"odds_ratio": round(float(found[0, 0] * found[1, 1] / (found[0, 1] * found[1, 0])), 8)}], "odds_ratio double")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(GAPS + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM g" for a, b in _PAIRS))
def corr_pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.correlation_pairs(gaps(spark, d), _CORR), 8)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 8) AS r, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb FROM lineitem)" for a, b in _PAIRS[:3]))
def corr_spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    out = None
    for a, b in _PAIRS[:3]:
        one = G.correlation_pairs(df, [a, b], "spearman")
        out = one if out is None else out.union(one)
    return rounded(out, 8)


@query("""WITH p AS (SELECT sign(a.s_acctbal - b.s_acctbal) * sign(a.s_nationkey - b.s_nationkey) AS s, (a.s_acctbal = b.s_acctbal)::INT AS tx, (a.s_nationkey = b.s_nationkey)::INT AS ty FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey)
  SELECT round(sum(s) / sqrt((count(*) - sum(tx))::DOUBLE * (count(*) - sum(ty))), 8) AS tau FROM p""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [{"tau": round(G.kendall_tau(table(spark, d, "supplier"), "s_acctbal", "s_nationkey"), 8)}], "tau double")


@query(_ranks("o_orderpriority AS g, o_totalprice AS v FROM orders") + "SELECT a.g AS a, b.g AS b, round((b.rs / b.n - a.rs / a.n) / sqrt((nn * (nn + 1) / 12 - ties / (12 * (nn - 1))) * (1 / a.n + 1 / b.n)), 6) AS z FROM s a JOIN s b ON a.g < b.g, t, n")
def dunn_z_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(posthoc.dunn_pairs(G.labelled(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")))


@query("WITH s AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT a.g AS group_a, b.g AS group_b, round(b.m - a.m, 4) AS estimate FROM s a JOIN s b ON a.g < b.g")
def tukey_mean_diff_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.labelled(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    labels = sorted(x["g"] for x in pairs.select("g").distinct().collect())
    return rounded(rows(spark, posthoc.tukey(pairs, labels)["comparisons"], "group_a string, group_b string, estimate double"), 4)


_P = "WITH p AS (SELECT s_suppkey AS k, ((s_suppkey * 7919) % 10007) / 100070.0::DOUBLE AS p, count(*) OVER () AS n FROM supplier), o AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i FROM p) "
_ADJUST = {
    "bonferroni": "SELECT k, round(least(1.0, p * n), 8) AS adjusted FROM p",
    "sidak": "SELECT k, round(1 - (1 - p) ** n, 8) AS adjusted FROM p",
    "holm": "SELECT k, round(max(least(1.0, (n - i + 1) * p)) OVER (ORDER BY i), 8) AS adjusted FROM o",
    "bh": "SELECT k, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC)), 8) AS adjusted FROM o",
    "by": "SELECT k, round(least(1.0, min(p * n * (SELECT list_sum(list_transform(range(1, max(n) + 1), lambda x: 1.0::DOUBLE / x)) FROM p) / i) OVER (ORDER BY i DESC)), 8) AS adjusted FROM o",
}


def _adjusting(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (((F.col("s_suppkey") * 7919) % 10007) / 100070.0).alias("p"))
        return posthoc.adjusted(p, "p", method).select("k", r("adjusted", 8).alias("adjusted"))

    run.__name__ = f"p_adjust_{method}"
    QUERIES[run.__name__], SQL[run.__name__] = run, _P + _ADJUST[method]


for _m in posthoc.METHODS:
    _adjusting(_m)


@query(None)
def power_table(spark: SparkSession, d: str) -> DataFrame:
    found = [power.analyse("two_sample_t", effect_size=e, power=p) | {"e": e} for e in (0.2, 0.5, 0.8) for p in (0.8, 0.9)]
    return rows(spark, found, "effect_size double, power double, n double, n_total int")


# --- missingness -----------------------------------------------------------------------------------

_GAP = ["l_tax", "l_discount", "l_quantity", "l_extendedprice"]


@query(GAPS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*)::DOUBLE, 8) AS fraction FROM g" for c in _GAP))
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(missing.null_counts(gaps(spark, d), _GAP), 8)


@query(GAPS + "SELECT (l_tax IS NULL)::INT::VARCHAR || (l_discount IS NULL)::INT::VARCHAR || (l_quantity IS NULL)::INT::VARCHAR || (l_extendedprice IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def null_patterns(spark: SparkSession, d: str) -> DataFrame:
    return missing.patterns(gaps(spark, d), _GAP)


@query(GAPS + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 8) AS phi FROM g" for i, a in enumerate(_GAP) for b in _GAP[i + 1 :]))
def null_phi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(missing.phi(gaps(spark, d), _GAP), 8)


@query(GAPS + "SELECT l_returnflag AS grp, count(*) AS n, " + ", ".join(f"round(avg(({c} IS NULL)::INT), 8) AS f{i}" for i, c in enumerate(_GAP)) + " FROM g GROUP BY 1")
def null_grouping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(missing.grouped_nulls(gaps(spark, d), "l_returnflag", _GAP), 8)


@query(GAPS + "SELECT count(*) FILTER (l_tax IS NOT NULL AND l_discount IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS n_complete, count(*) AS n_rows FROM g")
def rows_complete(spark: SparkSession, d: str) -> DataFrame:
    return missing.complete_rows(gaps(spark, d), _GAP)


@query(GAPS + ", p AS (SELECT (l_tax IS NOT NULL)::INT::VARCHAR || (l_discount IS NOT NULL)::INT::VARCHAR || (l_quantity IS NOT NULL)::INT::VARCHAR AS pattern, * FROM g) SELECT pattern, count(*) AS n, round(avg(l_tax), 8) AS m0, round(avg(l_discount), 8) AS m1, round(avg(l_quantity), 6) AS m2 FROM p GROUP BY 1 HAVING count(*) >= 2 AND contains(pattern, '1')")
def mcar_pattern_means(spark: SparkSession, d: str) -> DataFrame:
    found, mean, _ = missing.mcar_moments(gaps(spark, d), ["l_tax", "l_discount", "l_quantity"])
    found = [x for x in found if x["n"] >= 2]
    own = [{"pattern": x["pattern"], "n": x["n"]} | {f"m{i}": None if x[f"s{i}"] is None else x[f"s{i}"] / x["n"] + mean[i] for i in range(3)} for x in found]
    return rounded(rows(spark, own, "pattern string, n long, m0 double, m1 double, m2 double"), 8, m2=6)


@query(None)
def little_mcar(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [missing.little_mcar(gaps(spark, d), ["l_tax", "l_discount", "l_quantity"])], "statistic double, df int, p_value double, n_patterns int")


# --- outliers --------------------------------------------------------------------------------------


def _skewed(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a long tail, their key as ordinal."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias(RID), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 97 == 0, 9).otherwise(1)).alias("price"), (F.col("o_custkey") * F.when(F.col("o_orderkey") % 89 == 0, -4).otherwise(1)).cast("double").alias("cust"))


_SKEWED = "WITH k AS (SELECT o_orderkey AS row_index, o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE 1 END AS price, (o_custkey * CASE WHEN o_orderkey % 89 = 0 THEN -4 ELSE 1 END)::DOUBLE AS cust FROM orders) "


@query(_SKEWED + ", s AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(cust, 0.25) AS c, quantile_cont(cust, 0.75) AS e FROM k), x AS (SELECT row_index, price, cust, greatest(a - 1.5 * (b - a) - price, price - (b + 1.5 * (b - a))) / (b - a) AS sp, greatest(c - 1.5 * (e - c) - cust, cust - (e + 1.5 * (e - c))) / (e - c) AS sc FROM k, s) SELECT row_index, round(price, 6) AS price, cust, round(greatest(sp, sc), 6) AS score FROM x WHERE greatest(sp, sc) > 0 ORDER BY greatest(sp, sc) DESC, row_index LIMIT 50")
def outliers_iqr_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.top(outliers.iqr(_skewed(spark, d), ["price", "cust"]), 50).drop("per_column_flags"))


@query(_SKEWED + ", s AS (SELECT avg(price) AS mp, stddev_samp(price) AS dp, avg(cust) AS mc, stddev_samp(cust) AS dc FROM k), x AS (SELECT row_index, price, cust, abs(price - mp) / dp AS sp, abs(cust - mc) / dc AS sc FROM k, s) SELECT row_index, round(price, 6) AS price, cust, round(greatest(CASE WHEN sp > 3 THEN sp ELSE 0 END, CASE WHEN sc > 3 THEN sc ELSE 0 END), 6) AS score FROM x WHERE sp > 3 OR sc > 3")
def outliers_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.zscore(_skewed(spark, d), ["price", "cust"]).drop("per_column_flags"))


@query(_SKEWED + ", s AS (SELECT avg(price) AS mp, avg(cust) AS mc, var_samp(price) AS a, var_samp(cust) AS c, covar_samp(price, cust) AS b FROM k), x AS (SELECT row_index, price, cust, (c * (price - mp) ** 2 - 2 * b * (price - mp) * (cust - mc) + a * (cust - mc) ** 2) / (a * c - b * b) AS score FROM k, s) SELECT row_index, round(price, 6) AS price, cust, round(score, 5) AS score FROM x WHERE score > -2 * ln(0.025)")
def outliers_mahalanobis_2d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.mahalanobis(_skewed(spark, d), ["price", "cust"])[0], 5, price=6, cust=6)


@query(None)
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return outliers.isolation_forest(_skewed(spark, d), ["price", "cust"])


# --- splits and checksums --------------------------------------------------------------------------


@query("WITH h AS (SELECT (('0x' || substr(sha256('42|' || o_orderkey::VARCHAR), 1, 8))::BIGINT < 1073741824) AS test FROM orders) SELECT test AS is_test, count(*) AS n FROM h GROUP BY 1")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return scoring.hash_split(table(spark, d, "orders"), F.col("o_orderkey")).groupBy(F.col(scoring.TEST).alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, round_even(n * 0.25, 0)::BIGINT AS test, n - round_even(n * 0.25, 0)::BIGINT AS train FROM n")
def stratified_counts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn(RID, F.col("o_orderkey"))
    marked, _ = scoring.split_rows(df, 0.25, 42, "o_orderstatus")
    return marked.groupBy(F.col("o_orderstatus").alias("value")).agg(F.count_if(scoring.TEST).alias("test"), F.count_if(~F.col(scoring.TEST)).alias("train"))


@query(None)
def split_seeded(spark: SparkSession, d: str) -> DataFrame:
    marked, _ = scoring.split_rows(table(spark, d, "orders").withColumn(RID, F.col("o_orderkey")), 0.25, 42)
    return marked.select("o_orderkey", F.col(scoring.TEST).alias("is_test"))


@query("WITH h AS (SELECT sha256(s_suppkey::VARCHAR || '|' || s_name) AS h FROM supplier) SELECT count(*) AS n, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS xor_a, bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS xor_b, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS sum_a, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS sum_b FROM h")
def membership_checksum(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "supplier").select(F.sha2(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name"), 256).alias("h"))
    return provenance.checksum_parts(h).withColumns({c: F.col(c).cast("string") for c in ("sum_a", "sum_b")})


@query(None)
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [{"digest": provenance.table_digest(readers.snapshot(table(spark, d, "nation"), "nation"))}], "digest string")


# --- models ----------------------------------------------------------------------------------------


def _line_model(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(RID), "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", (F.col("l_extendedprice") / 1000 + 3 * F.col("l_quantity") - 40 * F.col("l_tax")).alias("y"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), "l_linenumber")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 10) AS r2, count(*) AS n FROM lineitem")
def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.simple_regression(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 6, intercept=4, r2=10)


_MULTI = """WITH v AS (SELECT l_extendedprice / 1000 + 3 * l_quantity - 40 * l_tax AS y, l_quantity AS a, l_tax AS b FROM lineitem), m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS n, var_pop(y) AS yy FROM v),
  c AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b2, * FROM m), k AS (SELECT my - ba * ma - b2 * mb AS b0, * FROM c) """


@query(_MULTI + "SELECT 'Intercept' AS name, round(b0, 6) AS estimate FROM k UNION ALL SELECT 'l_quantity', round(ba, 6) FROM k UNION ALL SELECT 'l_tax', round(b2, 6) FROM k")
def ols_multi_normal_eq(spark: SparkSession, d: str) -> DataFrame:
    fitted = models.fit(_line_model(spark, d), "y ~ l_quantity + l_tax")
    return rounded(rows(spark, fitted.coefficients(), "name string, estimate double"))


@query(_MULTI + ", e AS (SELECT y - b0 - ba * a - b2 * b AS e FROM v, k), s AS (SELECT count(*)::DOUBLE AS n, avg(e) AS m, avg(e ** 2) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4 FROM e) SELECT round(s.n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 3) AS jarque_bera, round(1 / (1 - (ab * ab) / (aa * bb)), 8) AS vif, round(1 - (SELECT sum(e * e) FROM e) / (k.n * yy), 8) AS r_squared FROM s, k")
def ols_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    df = _line_model(spark, d)
    fitted = models.fit(df, "y ~ l_quantity + l_tax")
    found = models.diagnostics(fitted, df)
    return rounded(rows(spark, [{"jarque_bera": found["jarque_bera"]["statistic"], "vif": found["vif"]["l_tax"], "r_squared": fitted.extra["r_squared"]}], "jarque_bera double, vif double, r_squared double"), 8, jarque_bera=3)


@query("WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders), e AS (SELECT o_orderkey, o_totalprice - i - s * o_custkey AS e FROM orders, m), l AS (SELECT e, e - lag(e) OVER (ORDER BY o_orderkey) AS d FROM e) SELECT round(sum(d * d) / sum(e * e), 8) AS durbin_watson FROM l")
def durbin_watson(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn(RID, F.col("o_orderkey"))
    fitted = models.fit(df, "o_totalprice ~ o_custkey")
    e = models.residuals(fitted, df).select("row_index", "resid")
    total = e.agg(F.sum(F.col("resid") ** 2)).first()[0]
    return rows(spark, [{"durbin_watson": round(models.lag_sum(e, "row_index", "resid") / total, 8)}], "durbin_watson double")


@query("WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i, avg(o_custkey) AS mx, regr_sxx(o_totalprice, o_custkey) AS sxx, count(*)::DOUBLE AS n FROM orders), e AS (SELECT o_orderkey AS row_index, o_totalprice - i - s * o_custkey AS e, 1 / n + (o_custkey - mx) ** 2 / sxx AS h, n FROM orders, m), v AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM e) SELECT row_index, round(h, 10) AS leverage, round(e * e / s2 / (1 - h) * h / (2 * (1 - h)), 10) AS cooks FROM e, v")
def leverage_cooks(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn(RID, F.col("o_orderkey"))
    return rounded(plots.cooks_distance(models.fit(df, "o_totalprice ~ o_custkey"), df).select("row_index", "leverage", "cooks"), 10)


@query("WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders) SELECT o_orderkey AS row_index, round(i + s * o_custkey, 4) AS prediction FROM orders, m WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50")
def predict_page(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn(RID, F.col("o_orderkey"))
    scored = scoring.predictions(models.fit(df, "o_totalprice ~ o_custkey"), df)
    return rounded(scored.where("row_index >= 100").orderBy("row_index").limit(50), 4)


def _logit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and scores of a given logistic model; scores are rounded so that ties are the same everywhere."""
    eta = 0.4 - 0.02 * F.col("l_quantity") - 8 * F.col("l_tax")
    return table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.round(1 / (1 + F.exp(-eta)), 6).alias("p"))


_LOGIT = "WITH s AS (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, round(1 / (1 + exp(-(0.4 - 0.02 * l_quantity - 8 * l_tax))), 6) AS p FROM lineitem) "


@query(_LOGIT + "SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(_logit_pairs(spark, d))


@query(_LOGIT + ", k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM s), a AS (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM k), c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), u AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS top FROM c) SELECT round(auc, 8) AS roc_auc, round((SELECT sum(pos * tp / top) / sum(pos) FROM u), 8) AS average_precision FROM a")
def roc_auc_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.rank_metrics(_logit_pairs(spark, d)), 8)


@query(_LOGIT + "SELECT round(avg((p - y) ** 2), 8) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss FROM s")
def brier_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.losses(_logit_pairs(spark, d)), 8)


@query(_LOGIT + ", e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e, min(p) AS lo, max(p) AS hi FROM s), b AS (SELECT len(list_filter(e, lambda x: x < p AND x > lo AND x < hi))::INT AS bin, p, y FROM s, e) SELECT bin, round(avg(p), 8) AS mean_predicted, round(avg(y), 8) AS observed, count(*) AS n FROM b GROUP BY 1")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.calibration(_logit_pairs(spark, d), 10), 8)


@query("WITH s AS (SELECT l_linenumber::DOUBLE AS y, exp(1.4 - 0.001 * l_quantity) AS p FROM lineitem) SELECT count(*) AS n, round(sqrt(avg((y - p) ** 2)), 8) AS rmse, round(avg(abs(y - p)), 8) AS mae, round(sum((y - p) ** 2 / p), 4) AS pearson_chi2, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END - (y - p)), 4) AS deviance FROM s")
def poisson_metrics(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), F.exp(1.4 - 0.001 * F.col("l_quantity")).alias("p"))
    return rounded(rows(spark, [scoring.metrics(pairs, "poisson", 2)], "n long, rmse double, mae double, pearson_chi2 double, deviance double"), 8, pearson_chi2=4, deviance=4)


@query("""WITH f AS (SELECT o_orderkey % 5 AS fold, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders), m AS (SELECT k AS fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f, range(5) r(k) WHERE fold <> k GROUP BY k)
  SELECT fold::INT AS fold, count(*) AS n, round(sqrt(avg((y - i - s * x) ** 2)), 3) AS rmse FROM f JOIN m USING (fold) GROUP BY 1""")
def cv_ols_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Fold fits by subtracting each fold's cross-products from the whole's, in one grouped pass."""
    data = table(spark, d, "orders").select(F.lit(1.0).alias("x0"), F.col("o_custkey").cast("double").alias("x1"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))
    design = models.formulas.Design("y", "y", True, [["x1"]], names=["Intercept", "x1"])
    folds = scoring._ols_folds(data, design, 5)
    beta = F.create_map(*[v for f, b in folds.items() for v in (F.lit(f), F.array(*[F.lit(float(x)) for x in b]))])
    fit = F.element_at(beta, F.col("fold"))
    return rounded(data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y") - fit[0] - fit[1] * F.col("x1")) ** 2)).alias("rmse")), 3)


def _coefficients(spark: SparkSession, fitted: models.Fitted) -> DataFrame:
    return rows(spark, fitted.coefficients(), "name string, estimate double, std_err double, statistic double, p_value double")


@query(None)
def logit_fit(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, models.fit(_line_model(spark, d), "returned ~ l_quantity + l_tax", "logistic"))


@query(None)
def poisson_fit(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, models.fit(_line_model(spark, d), "l_linenumber ~ l_quantity + C(l_returnflag)", "poisson"))


@query(None)
def negbin_fit(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, models.fit(_line_model(spark, d), "l_quantity ~ l_linenumber", "negbin"))


@query(None)
def ols_robust_fit(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, models.fit(_line_model(spark, d), "y ~ l_quantity + l_tax", "ols", robust=True))


@query(None)
def cross_validate_ols(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.cross_validate(_line_model(spark, d), "y ~ l_quantity + l_tax", "ols")
    return rows(spark, found["per_fold"], "fold int, n long, rmse double, mae double, r_squared double")


# --- plot reductions -------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 200")
def bar_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.bars(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("WITH q AS (SELECT c_mktsegment AS grp, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1), x AS (SELECT q.*, c_acctbal AS v, c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM customer JOIN q ON grp = c_mktsegment) SELECT grp, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_fliers FROM x GROUP BY grp")
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.box_stats(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), 4)


@query("SELECT v AS a, w AS b, round(r, 8) AS r, n FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS v, '{b}' AS w, corr({a}, {b}) AS r, count(*) AS n FROM part" for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))) + ")")
def heatmap_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rows(spark, plots.plot_data(table(spark, d, "part"), "heatmap")["cells"], "a string, b string, r double, n long"), 8)


@query("WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT v, n, sum(n) OVER (ORDER BY v)::BIGINT AS upto FROM c")
def ecdf_quantity(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, "v", "n", "upto")


@query(None)
def scatter_sample(spark: SparkSession, d: str) -> DataFrame:
    return plots.sample_points(_line_model(spark, d).select(RID, "l_quantity", "y")).drop(RID)


@query(None)
def violin_density(spark: SparkSession, d: str) -> DataFrame:
    found = plots.violin(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rows(spark, [{"grp": v["group"], "x": x, "density": y} for v in found for x, y in zip(v["x"], v["density"], strict=True)], "grp string, x double, density double")


