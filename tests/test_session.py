"""The tools on small frames with known answers, their errors, and the round trip through a notebook."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from assay.session import Session


@pytest.fixture()
def s(spark):
    return Session(spark)


def load(s, name, frame):
    out = s.register_frame(pd.DataFrame(frame), name)
    assert out["ok"], out


def two(a, b):
    return {"g": ["A"] * len(a) + ["B"] * len(b), "v": [float(x) for x in [*a, *b]]}


def test_two_sample_tests(s):
    load(s, "d", two(range(1, 6), range(3, 8)))
    t = s.test_hypothesis("d", "t_test", "g", "v")
    assert (t["statistic"], t["df"]) == pytest.approx((-2.0, 8)) and t["p_value"] == pytest.approx(0.0805162380) and t["effect_size"] == pytest.approx(-1.2649110641)
    u = s.test_hypothesis("d", "mann_whitney", "g", "v")
    assert u["statistic"] == 4.5 and u["p_value"] == pytest.approx(0.1138462980) and u["effect_size"] == pytest.approx(0.64)
    load(s, "w", two([1, 2, 3, 4, 5], [3, 4, 5, 6, 7, 10, 12, 15]))
    w = s.test_hypothesis("w", "welch", "g", "v")
    assert w["statistic"] == pytest.approx(-2.8878943875) and w["df"] == pytest.approx(9.6645412575)
    load(s, "k", two(range(1, 6), range(2, 7)))
    k = s.test_hypothesis("k", "ks", "g", "v")
    assert k["statistic"] == pytest.approx(0.2) and k["p_value"] == pytest.approx(1.0)
    assert s.test_hypothesis("d", "nope", "g", "v")["error"]["type"] == "invalid_kind"
    assert s.test_hypothesis("d", "t_test", "g", "zzz")["error"]["type"] == "column_not_found"


def test_three_groups(s):
    load(s, "d", {"g": ["A"] * 5 + ["B"] * 5 + ["C"] * 5, "v": [1.0, 2, 3, 4, 5, 3, 4, 5, 6, 7, 5, 6, 7, 8, 9]})
    f = s.test_hypothesis("d", "anova", "g", "v")
    assert f["statistic"] == pytest.approx(8) and f["p_value"] == pytest.approx(0.0061963978) and f["effect_size"] == pytest.approx(0.5714285714)
    h = s.test_hypothesis("d", "kruskal", "g", "v")
    assert h["statistic"] == pytest.approx(8.1159420290) and h["effect_size"] == pytest.approx(0.5797101449)
    pairs = {(c["group_a"], c["group_b"]): c for c in s.pairwise_comparisons("d", "g", "v", method="tukey")["comparisons"]}
    assert pairs["A", "B"]["p_value"] == pytest.approx(0.1545799684, abs=1e-7) and pairs["A", "B"]["ci"] == pytest.approx([-0.6678636566, 4.6678636566], abs=1e-5)
    assert pairs["A", "C"]["p_value"] == pytest.approx(0.0046340806, abs=1e-7)
    found = s.compare_groups("d", "g", "v")
    assert found["test"] == "anova" and len(found["assumption_checks"]) == 2


def test_dunn_untied_and_tied(s):
    load(s, "d", {"g": list("AAABBBCCC"), "v": [float(x) for x in range(1, 10)]})
    pairs = {(c["group_a"], c["group_b"]): c for c in s.pairwise_comparisons("d", "g", "v", method="dunn")["comparisons"]}
    assert pairs["A", "B"]["statistic"] == pytest.approx(1.3416407865) and pairs["A", "B"]["p_adjusted"] == pytest.approx(0.3594249898)
    assert pairs["A", "C"]["p_value"] == pytest.approx(0.0072903581) and pairs["A", "C"]["p_adjusted"] == pytest.approx(0.0218710743)


def test_pairwise_errors(s):
    load(s, "d", {"g": list("AABBCC"), "v": [1.0, 2, 3, 4, 5, 6], "t": list("xyzxyz")})
    kinds = [
        (dict(metric_column="t"), "metric_not_numeric"),
        (dict(alpha=2), "invalid_alpha"),
        (dict(groups=["A", "A", "B"]), "duplicate_groups"),
        (dict(groups=["A", "B"]), "too_few_groups"),
        (dict(groups=["A", "B", "Z"]), "group_not_found"),
        (dict(method="x"), "invalid_method"),
        (dict(p_adjust="x"), "invalid_p_adjust"),
        (dict(method="tukey", p_adjust="bh"), "p_adjust_not_applicable"),
    ]
    for change, error in kinds:
        assert s.pairwise_comparisons(**({"name": "d", "group_column": "g", "metric_column": "v"} | change))["error"]["type"] == error


def test_tables(s):
    rows = [("r1", "a")] * 10 + [("r1", "b")] * 20 + [("r1", "c")] * 30 + [("r2", "a")] * 6 + [("r2", "b")] * 9 + [("r2", "c")] * 17
    load(s, "t", {"r": [x for x, _ in rows], "c": [y for _, y in rows]})
    chi = s.test_hypothesis("t", "chi_square", "r", "c")
    assert chi["statistic"] == pytest.approx(0.2715746515) and chi["effect_size"] == pytest.approx(0.0543313757)
    load(s, "f", {"r": ["x"] * 10 + ["y"] * 6, "c": ["p"] * 8 + ["q"] * 2 + ["p"] + ["q"] * 5})
    fisher = s.compare_groups("f", "r", "c")
    assert fisher["test"] == "fisher_exact" and fisher["statistic"] == pytest.approx(20) and fisher["p_value"] == pytest.approx(0.0349650350)


def test_correlations(s):
    load(s, "d", {"x": [1, 2, 3, 4, 5], "y": [2, 4, 5, 4, 5], "z": [5, 7, 6, 9, 8]})
    for method, wanted in (("pearson", 0.7745966692), ("spearman", 0.7378647874), ("kendall", 0.6708203932)):
        assert s.correlate("d", method=method, plot=False)["matrix"]["x"]["y"] == pytest.approx(wanted)
    load(s, "gap", {"x": [1.0, 2, 3, None], "y": [2.0, 4, 6, 1]})
    assert s.correlate("gap", plot=False)["matrix"]["x"]["y"] == pytest.approx(1.0)  # pairwise complete
    assert s.correlate("d", columns=["x"])["error"]["type"] == "no_numeric_columns"


def test_mahalanobis(s):
    x = np.vstack([np.random.default_rng(42).standard_normal(size=(50, 2)), [5.0, 5.0]])
    load(s, "d", {"x": x[:, 0], "y": x[:, 1]})
    out = s.find_outliers("d", ["x", "y"], "mahalanobis")
    assert out["n_outliers"] == 2 and out["outliers"][0]["row_index"] == 50
    assert out["outliers"][0]["score"] == pytest.approx(28.2406675648) and out["threshold_used"] == pytest.approx(7.3777589082)
    assert s.find_outliers("d", ["x", "y"], "isolation_forest", contamination=0.05)["outliers"][0]["row_index"] == 50
    assert s.find_outliers("d", ["x"], "iqr")["outliers"][0]["row_index"] == 50


def test_logit_and_poisson(s):
    dice = np.random.default_rng(20260511)
    x, z = dice.standard_normal(500), dice.standard_normal(500)
    y = (dice.random(500) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x - 0.8 * z)))).astype(int)
    load(s, "l", {"y": y, "x": x, "z": z})
    m = s.fit_model("l", "y ~ x + z", "logistic", model_name="m")
    assert [c["estimate"] for c in m["coefficients"]] == pytest.approx([-0.2936185311, 1.1464343597, -0.7152252266], abs=1e-7)
    assert m["coefficients"][1]["std_err"] == pytest.approx(0.12914932615, abs=1e-7)
    assert m["fit"]["aic"] == pytest.approx(552.8780655, abs=1e-5) and m["fit"]["pseudo_r_squared"] == pytest.approx(0.1996690625, abs=1e-8)
    p = s.predict("m", "l", limit=500)
    eta = -0.2936185311 + 1.1464343597 * x - 0.7152252266 * z
    assert [r["prediction"] for r in p["rows"]] == pytest.approx((1 / (1 + np.exp(-eta))).tolist(), abs=1e-6)
    e = s.evaluate_model("m", "l")
    score = np.array([r["prediction"] for r in p["rows"]])
    wins = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    assert e["roc_auc"] == pytest.approx(wins) and e["brier"] == pytest.approx(((score - y) ** 2).mean())
    dice = np.random.default_rng(20260511)
    x = dice.standard_normal(400)
    load(s, "p", {"y": dice.poisson(np.exp(0.5 + 0.7 * x)), "x": x})
    q = s.fit_model("p", "y ~ x", "poisson")
    assert [c["estimate"] for c in q["coefficients"]] == pytest.approx([0.4955550345, 0.7087011623], abs=1e-7)
    assert q["fit"]["aic"] == pytest.approx(1261.6421455, abs=1e-5) and q["fit"]["pseudo_r_squared"] == pytest.approx(0.2467755286, abs=1e-8)


def test_ols_against_numpy_and_cross_validation(s):
    dice = np.random.default_rng(1)
    x, g = dice.standard_normal(120), dice.choice(["a", "b", "c"], 120)
    y = 2 + 0.5 * x + (g == "b") - 2 * (g == "c") + 0.3 * dice.standard_normal(120)
    load(s, "d", {"y": y, "x": x, "g": g})
    m = s.fit_model("d", "y ~ x * C(g)", model_name="m")
    design = np.column_stack([np.ones(120), g == "b", g == "c", x, x * (g == "b"), x * (g == "c")]).astype(float)
    beta, rss, _, _ = np.linalg.lstsq(design, y, rcond=None)
    assert [c["estimate"] for c in m["coefficients"]] == pytest.approx(beta.tolist())
    assert [c["name"] for c in m["coefficients"]][1:4] == ["C(g)[T.b]", "C(g)[T.c]", "x"]
    assert m["fit"]["r_squared"] == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    inverse = np.linalg.inv(design.T @ design)
    e, h = y - design @ beta, np.einsum("ij,jk,ik->i", design, inverse, design)
    r = s.fit_model("d", "y ~ x * C(g)", robust=True)
    meat = (design * ((e / (1 - h)) ** 2)[:, None]).T @ design
    assert [c["std_err"] for c in r["coefficients"]] == pytest.approx(np.sqrt(np.diag(inverse @ meat @ inverse)).tolist())
    assert m["diagnostics"]["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    cv = s.cross_validate("d", "y ~ x + C(g)", k=4)
    assert cv["k"] == 4 and len(cv["per_fold"]) == 4 and cv["metrics"]["rmse"]["mean"] == pytest.approx(0.3, abs=0.1)


def test_model_errors(s):
    load(s, "d", {"y": [0, 0, 0, 1, 1, 1], "x": [1.0, 2, 3, 10, 11, 12], "n": [-1, 2, 3, 4, 5, 6]})
    assert s.fit_model("d", "y ~ x", "logistic")["error"]["type"] == "perfect_separation"
    assert s.fit_model("d", "y ~ q")["error"]["type"] == "formula_error"
    assert s.fit_model("d", "y ~", "ols")["error"]["type"] == "formula_error"
    assert s.fit_model("d", "n ~ x", "negbin")["error"]["type"] == "negbin_requires_nonneg_int"
    assert s.fit_model("d", "y ~ x", "logistic", robust=True)["error"]["type"] == "robust_not_supported"
    assert s.fit_model("d", "y ~ x", "zzz")["error"]["type"] == "invalid_kind"
    assert s.fit_model("zz", "y ~ x")["error"]["type"] == "not_found"
    assert s.fit_model("d", "y ~ x", model_name="1x")["error"]["type"] == "model_name_invalid"
    assert s.predict("zz", "d")["error"]["type"] == "model_not_found"
    assert s.cross_validate("d", "y ~ x", k=1)["error"]["type"] == "k_out_of_range"


def test_missingness(s):
    region = ["EMEA", "APAC", "AMER", "EMEA"] * 100
    load(s, "d", {"id": range(400), "region": region, "email": [None if r == "EMEA" else "x@y" for r in region], "v": [float(i) if i % 10 else None for i in range(400)]})
    out = s.analyze_missingness("d")
    per = {c["column"]: c for c in out["per_column"]}
    assert per["email"]["grouped_by"] == "region" and per["v"]["n_null"] == 40 and per["id"]["grouped_by"] is None
    assert sum(p["n"] for p in out["patterns"]) == 400
    assert s.analyze_missingness("d", columns=["zz"])["error"]["type"] == "unknown_columns"


def test_split_is_numpys_permutation_and_repeats(s, spark):
    load(s, "d", {"i": range(100)})
    one = s.split_dataset("d", 0.25, 42)
    assert (one["train"]["rows"], one["test"]["rows"]) == (75, 25)
    wanted = sorted(np.random.RandomState(42).permutation(100)[:25].tolist())
    assert sorted(r["i"] for r in s.datasets["d_test"].df.collect()) == wanted
    again = s.split_dataset("d", 0.25, 42, overwrite=True)
    assert again["checksums"] == one["checksums"]
    assert s.split_dataset("d", 0.25, 43, overwrite=True)["checksums"] != one["checksums"]
    assert s.split_dataset("d")["error"]["type"] == "dataset_name_collision"
    assert s.split_dataset("d", 2)["error"]["type"] == "test_fraction_out_of_range"


def test_guard(s):
    load(s, "d", {"i": range(3)})
    for sql in ("DROP VIEW d", "insert into d values (1)", "with x as (select 1) insert into d select * from x", "select reflect('java.lang.Runtime', 'getRuntime')", "select * from (select java_method('a', 'b'))", "select * from csv.`/etc/passwd`", "set a=b", "cache table d", "create table t as select 1", "-- x\n drop view d", "/* a */ refresh table d", "select (select max(reflect('a', 'b')) from d)"):
        assert s.query(sql)["error"]["type"] == "write_not_allowed", sql
    for sql in ("select 1; drop view d", "select from where", "select * from nowhere"):
        assert s.query(sql)["error"]["type"] == "query_error", sql
    assert s.query("select i from d order by i -- limit 1", limit=2)["rows"] == [{"i": 0}, {"i": 1}]
    page = s.query("select i from d order by i", limit=2)
    assert page["truncated"] and page["total_rows"] == 3 and s.query("select i from d order by i", limit=2, cursor=page["next_cursor"])["rows"] == [{"i": 2}]
    for sql in ("describe d", "show tables", "explain select * from d", "values (1), (2)"):
        assert s.query(sql)["ok"], sql


def test_readers(s, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;name ;v\n1;a;1.5\n2;\"b;c\";\n".encode())
    out = s.load_dataset(str(tmp_path / "a.csv"))
    assert [c["name"] for c in out["columns"]] == ["id", "name ", "v"] and out["rows"] == 2
    (tmp_path / "b.tsv").write_text("x\ty\n1\tu\n")
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert s.load_dataset(str(tmp_path / "b.tsv"))["rows"] == 1
    assert s.load_dataset(str(tmp_path / "c.json"))["rows"] == 2
    assert s.load_dataset(str(tmp_path / "d.jsonl"))["rows"] == 3
    assert s.load_dataset(str(tmp_path / "x.doc"))["error"]["type"] == "unsupported_format"
    assert s.load_dataset(str(tmp_path / "x.csv"))["error"]["type"] == "file_not_found"
    assert s.load_dataset(str(tmp_path / "a.csv"), "z", {"evil); drop": 1})["error"]["type"] == "bad_read_option"
    assert s.load_dataset(str(tmp_path / "a.csv"), "z", {"all_varchar": True, "delim": ";"})["columns"][0]["dtype"] == "string"


def test_profile_of_awkward_columns(s):
    load(s, "d", {"flat": [1.0] * 5, "none": pd.Series([None] * 5, dtype="float64"), "flag": [True, False, None, True, True], "text": ["a", " ", "", None, "b"], "list": [[1], [1, 2], [], None, [1]]})
    out = s.profile_dataset("d")
    assert out["ok"], out
    by = {c["name"]: c for c in out["columns"]}
    assert by["flat"]["flags"]["constant"] and by["none"]["flags"]["mostly_null"] and by["text"]["string"]["n_whitespace"] == 2 and by["flag"]["boolean"]["n_true"] == 3
    assert sum(b["n"] for b in s.describe_column("d", "flat")["histogram"]) == 5
    assert s.describe_column("d", "none")["ok"]


def test_notebook_round_trip_and_tampering(s, spark, tmp_path):
    (tmp_path / "a.csv").write_text("g,v\n" + "".join(f"{'ab'[i % 2]},{i * 1.5 + (i % 3)}\n" for i in range(60)))
    assert s.load_dataset(str(tmp_path / "a.csv"), "d")["ok"]
    assert s.materialize_query("select g, v from d where v > 3", "big")["ok"]
    assert s.split_dataset("big", stratify_by="g")["ok"]
    assert s.fit_model("big_train", "v ~ C(g)", model_name="m")["ok"]
    book = str(tmp_path / "n.ipynb")
    assert s.emit_notebook(book)["resumable"]
    t = Session(spark)
    out = t.load_session_from_notebook(book)
    assert out["ok"], out
    assert out["models"] == ["m"] and t.query("select count(*) as n from big_test")["ok"]
    assert t.load_session_from_notebook(book)["error"]["type"] == "session_not_empty"
    raw = json.loads(open(book).read())
    for cell in raw["cells"]:
        if cell["cell_type"] == "code":
            compile("".join(cell["source"]), "cell", "exec")

    def damaged(change, name):
        copy = json.loads(json.dumps(raw))
        change(copy)
        path = str(tmp_path / f"{name}.ipynb")
        open(path, "w").write(json.dumps(copy))
        return Session(spark).load_session_from_notebook(path)["error"]["type"]

    manifest = lambda b: b["metadata"]["assay"]["manifest"]
    assert damaged(lambda b: b["cells"][0].update(source=["# other"]), "cells") == "notebook_modified"
    assert damaged(lambda b: b["metadata"].pop("assay"), "none") == "manifest_missing"
    assert damaged(lambda b: manifest(b).update(version=9), "version") == "manifest_version_unsupported"
    assert damaged(lambda b: manifest(b)["journal"][0].pop("digest"), "schema") == "manifest_invalid"
    assert damaged(lambda b: manifest(b)["journal"][-1].update(params=[1.0, 2.0]), "model") == "model_drift"
    assert damaged(lambda b: manifest(b)["journal"][1].update(digest="0"), "digest") == "state_digest_mismatch"
    assert damaged(lambda b: manifest(b)["journal"][2]["checksums"].update(big_test="0"), "split") == "split_drift"
    (tmp_path / "a.csv").write_text("g,v\na,1\n")
    assert Session(spark).load_session_from_notebook(book)["error"]["type"] == "source_drift"
    assert Session(spark).load_session_from_notebook(str(tmp_path / "zz.ipynb"))["error"]["type"] == "notebook_not_found"


def test_plots_are_bounded_and_png(s):
    load(s, "d", {"x": np.arange(3000) * 1.0, "y": np.arange(3000) % 7 * 1.0, "g": ["a", "b", "c"] * 1000})
    for kind, args in (("hist", {"x": "x"}), ("bar", {"x": "g"}), ("line", {"x": "x", "y": "y"}), ("scatter", {"x": "x", "y": "y", "hue": "g"}), ("box", {"y": "y", "x": "g"}), ("violin", {"y": "y"}), ("heatmap", {})):
        out = s.plot("d", kind, **args)
        assert out["ok"] and out["image"]["png_base64"].startswith("iVBORw0KGgo"), (kind, out)
        assert len(out["data"].get("points", [])) <= 2000
    assert s.plot("d", "line", x="x")["error"]["type"] == "missing_required_param"
    assert s.plot("d", "pie")["error"]["type"] == "invalid_kind"


def test_codings(s):
    dice = np.random.default_rng(3)
    g = np.array(list("abc") * 20)
    y = dice.standard_normal(60) + (g == "b") * 2 - (g == "c")
    load(s, "d", {"y": y, "g": g, "t": y > 0})
    mean = {v: y[g == v].mean() for v in "abc"}
    grand = np.mean(list(mean.values()))
    fit = lambda f: {c["name"]: c["estimate"] for c in s.fit_model("d", f)["coefficients"]}
    assert fit("y ~ C(g, Treatment('b'))")["C(g, Treatment('b'))[T.a]"] == pytest.approx(mean["a"] - mean["b"])
    found = fit("y ~ C(g, Sum)")
    assert found["Intercept"] == pytest.approx(grand) and found["C(g, Sum)[S.a]"] == pytest.approx(mean["a"] - grand)
    assert fit("y ~ C(g, Diff)")["C(g, Diff)[D.a]"] == pytest.approx(mean["b"] - mean["a"])
    assert fit("y ~ C(g, Helmert)")["C(g, Helmert)[H.b]"] == pytest.approx((mean["b"] - mean["a"]) / 2)
    assert fit("y ~ C(g, Poly)")["C(g, Poly).Linear"] == pytest.approx((mean["c"] - mean["a"]) / np.sqrt(2))
    assert fit("y ~ 0 + C(g)") == pytest.approx({f"C(g)[{v}]": m for v, m in mean.items()})
    assert s.fit_model("d", "y ~ C(g, Nope)")["error"]["type"] == "formula_error"
    assert s.fit_model("d", "t ~ C(g)")["warnings"][-1]["type"] == "boolean_outcome_lpm"


def test_workbook(s, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="one"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>id</t></si><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>')
    out = s.load_dataset(str(tmp_path / "b.xlsx"))
    assert out["columns"] == [{"name": "id", "dtype": "bigint"}, {"name": "name", "dtype": "string"}] and s.query("select * from b order by id")["rows"] == [{"id": 1, "name": "x"}, {"id": 2, "name": None}]


def test_stream_window(s, spark, tmp_path):
    from assay.streaming.windows import take_available

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert take_available(stream, str(tmp_path / "out"), str(tmp_path / "mark")).count() == 10


def test_empty_tables_and_odd_names(s, spark):
    empty = spark.createDataFrame([], "x double, g string, t timestamp, b boolean")  # of another session
    assert s.register_frame(empty, "e")["ok"] and s.query("select * from e")["rows"] == []
    assert s.profile_dataset("e")["row_count"] == 0 and s.analyze_missingness("e")["ok"]
    assert all(s.describe_column("e", c)["ok"] for c in "xgtb")
    assert s.find_outliers("e", ["x"])["n_outliers"] == 0
    assert s.find_outliers("e", ["x"], "mahalanobis")["error"]["type"] == "insufficient_rows"
    assert s.compare_groups("e", "g", "x")["error"]["type"] == "too_few_groups"
    assert s.fit_model("e", "x ~ C(g)")["error"]["type"] == "formula_error"
    assert s.split_dataset("e")["error"]["type"] == "dataset_too_small"
    load(s, "w", {"a b": [1.0, 2, 3, 4], "c.d": [1, 2, 3, 5], "e`f": list("xyxy")})
    assert s.profile_dataset("w")["ok"] and s.analyze_missingness("w")["ok"]
    assert s.fit_model("w", 'Q("a b") ~ Q("c.d")', model_name="q")["ok"] and s.predict("q", "w")["n_scored"] == 4
    assert s.split_dataset("w", 0.5, stratify_by="e`f")["test"]["rows"] == 2
    assert s.plot("w", "box", x="e`f", y="a b")["ok"] and s.find_outliers("w", ["a b", "c.d"])["ok"]
