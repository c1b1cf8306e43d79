"""Every query against its SQL in DuckDB on the smallest tables, and invariance under repartitioning."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from assay import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    norm = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted((tuple(norm(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, sf, duck):
    found = Q.QUERIES[name](spark, sf).toPandas()
    assert len(found) or name in ("outliers_zscore",)
    if name in Q.SQL:
        wanted = duck.execute(Q.SQL[name]).df()
        assert plain(found) == plain(wanted)


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_and_partitions_do_not_matter(spark, sf):
    from assay.operators import groups as G

    df = spark.read.parquet(f"{sf}/orders.parquet")
    one = G.run_test(G.labelled(df, "o_orderstatus", "o_totalprice"), "kruskal", ["F", "O", "P"])
    many = G.run_test(G.labelled(df.repartition(7).sortWithinPartitions("o_totalprice"), "o_orderstatus", "o_totalprice"), "kruskal", ["F", "O", "P"])
    assert one["statistic"] == pytest.approx(many["statistic"], rel=1e-12)


def test_quantiles_by_selection_equal_the_sorted_column(spark, sf):
    from assay.functions.columns import exact_quantiles

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    for name in df.columns:
        values = sorted(r[0] for r in df.select(name).collect())
        for p, found in zip((0.0, 0.013, 0.5, 0.99, 1.0), exact_quantiles(df, name, [0.0, 0.013, 0.5, 0.99, 1.0], most=50), strict=True):
            at = (len(values) - 1) * p
            wanted = values[int(at)] + (values[min(len(values) - 1, int(at) + 1)] - values[int(at)]) * (at - int(at))
            assert found == pytest.approx(wanted) and not math.isnan(found)


def test_cumulative_in_buckets(spark, monkeypatch):
    from assay.functions import columns

    monkeypatch.setattr(columns, "BUCKET_ROWS", 100)
    df = spark.range(1000).selectExpr("cast(id * 7 % 1000 as double) as v", "id % 5 + 1 as n")
    rows = {r["v"]: r for r in columns.cumulative(df, "v", "n", "c").collect()}
    total = 0
    for v in sorted(rows):
        total += rows[v]["n"]
        assert rows[v]["c"] == total


def test_outlier_counts_of_large_tables(spark, sf):
    from assay.operators import profile

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_tax")
    both = [sorted(map(tuple, profile.outlier_counts(df, df.columns, most).collect())) for most in (10, 10**6)]
    assert both[0] == [pytest.approx(r) for r in both[1]]
