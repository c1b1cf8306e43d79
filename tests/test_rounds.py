"""Files with line breaks in quotes, limits, splits and folds by force, samples that hold still, names that clash."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.columns import RID
from assay.operators import groups, scoring
from assay.plans import guard
from assay.session import Session


@pytest.fixture()
def s(spark):
    return Session(spark)


@pytest.mark.parametrize("folder", [False, True])
def test_quoted_line_breaks_anywhere(s, tmp_path, folder):
    plain = "".join(f"{i},word {i}\n" for i in range(20_000))
    text = "i,t\n" + plain + '20000,"two\nlines"\n20001,"a ""quoted"" word"\n'
    at = tmp_path / "many.csv"
    if folder:
        at.mkdir()
        (at / "part.csv").write_text(text)
    else:
        at.write_text(text)
    out = s.load_dataset(str(at), "d")
    assert out["rows"] == 20_002 and out["columns"][0]["dtype"] == "int", out
    found = s.query("select t from d where i >= 20000 order by i")["rows"]
    assert found == [{"t": "two\nlines"}, {"t": 'a "quoted" word'}]
    if not folder:
        assert s.load_dataset(str(at), "e", {"skip": 1})["error"]["type"] == "bad_read_option"
        assert s.load_dataset(str(at), "f", {"auto_detect": False})["columns"][0]["dtype"] == "string"


def test_the_texts_limit_wins(s):
    s.register_frame(pd.DataFrame({"i": range(200)}), "d")
    assert s.query("select i from d limit 120")["row_count"] == 120
    out = s.query("with w as (select i from d) select i from w order by i limit 7", limit=3)
    assert out["row_count"] == 7 and not out["truncated"]
    assert s.query("select i from (select i from d limit 90)")["row_count"] == 50
    assert s.query("select i from d limit 0")["row_count"] == 0
    assert guard.own_limit(s.spark, "select i from d -- limit 5") is None


@pytest.mark.parametrize("stratified", [False, True])
def test_split_by_force(spark, monkeypatch, stratified):
    monkeypatch.setattr(scoring, "CHUNK", 10)
    dice = np.random.default_rng(4)
    labels = [None if x == "n" else str(x) for x in dice.choice(list("abn"), 95, p=[0.6, 0.3, 0.1])] + ["single"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], f"{RID} long, c string").repartition(3)
    marked, small = scoring.split_rows(df, 0.25, 7, "c" if stratified else None)
    found = {r[RID]: r[scoring.TEST] for r in marked.collect()}
    order = ["a", "b", "single", None] if stratified else [""]
    rows = [[i for i, c in enumerate(labels) if c == v or not stratified] for v in order]
    masks, lone = scoring.seeded_membership([(v, len(r)) for v, r in zip(order, rows)], 0.25, 7)
    assert small == lone and len(found) == 96
    assert found == {i: bool(m) for r, mask in zip(rows, masks) for i, m in zip(r, mask)}
    plan = marked._jdf.queryExecution().sparkPlan().toString()  # only counts of chunks, not rows, may meet in one task
    assert plan.count("Window [row_number()") == 1
    plain = scoring.split_rows(df.drop("c"), 0.25, 7)[0]._jdf.queryExecution().executedPlan().toString().split("\n")
    assert all("HashAggregate" in b for a, b in zip(plain, plain[1:]) if "SinglePartition" in a and "plan_id" in a)


def test_split_is_atomic_and_keeps_names(s, monkeypatch):
    s.register_frame(pd.DataFrame({"__rid": range(40), "__test": range(40), "__k": range(40)}), "d")
    out = s.split_dataset("d")
    assert out["ok"] and s.query("select * from d_train")["columns"] == ["__rid", "__test", "__k"]
    assert s.register_frame(pd.DataFrame({RID: [1]}), "x")["error"]["type"] == "reserved_column"
    before, stage = s.revision, s._stage

    def failing(name, *a, **k):
        if name == "second":
            raise OSError("disk")
        return stage(name, *a, **k)

    monkeypatch.setattr(s, "_stage", failing)
    assert not s.split_dataset("d", train_name="first", test_name="second")["ok"]
    assert "first" not in s.datasets and s.revision == before and len(s.journal) == 2


def test_samples_hold_still(spark):
    values = np.random.default_rng(1).standard_normal(8000).round(2)
    rows = [("a", float(x)) for x in values] + [("b", 1.0)] * 30_000 + [("b", float(x)) for x in range(50)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = [groups.shapiro_by_group(df.repartition(n, "x").orderBy(F.rand(n)) if n > 1 else df, ["a", "b"]) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and found[0]["a"] is not None


def test_groups_beyond_the_commonest(s):
    many = [f"g{i:04d}" for i in range(1200) for _ in range(4)] + ["rare"] * 3
    s.register_frame(pd.DataFrame({"g": many, "v": np.arange(len(many), dtype=float)}), "d")
    out = s.pairwise_comparisons("d", "g", "v", groups=["g0001", "g0002", "rare"])
    assert out["ok"] and out["n_comparisons"] == 3
    assert s.pairwise_comparisons("d", "g", "v")["error"]["type"] == "too_many_groups"
    assert s.pairwise_comparisons("d", "g", "v", groups=["g0001", "g0002", "none"])["error"]["type"] == "group_not_found"
    drawn = s.plot("d", "bar", x="g")["data"]
    assert drawn["truncated"] and len(drawn["bars"]) == 200
