"""An analysis session: named datasets and models, a journal of what made them, and the public tools.

Every tool returns ``{"ok": True, ...}`` or ``{"ok": False, "error": {"type", "message", "hint"}}`` and never raises.
Data stay distributed; what a tool returns is bounded.
"""

from __future__ import annotations

import functools
import math
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import RID, col, is_numeric, numeric_columns, user_columns
from .operators import formula as formulas
from .operators import groups, missing, models, outliers, plots, posthoc, power, profile, scoring
from .plans import guard
from .sources import provenance, readers

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class ToolError(Exception):
    def __init__(self, kind: str, message: str, hint: str = ""):
        super().__init__(message)
        self.kind, self.hint = kind, hint


@dataclass
class Dataset:
    name: str
    df: DataFrame
    rows: int
    format: str
    path: str | None = None
    read_options: dict[str, Any] | None = None
    source_hash: str | None = None
    digest: str = ""
    revision: int = 0
    registered_at: float = field(default_factory=time.time)

    @property
    def columns(self) -> list[dict[str, str]]:
        return [{"name": c, "dtype": self.df.schema[c].dataType.simpleString()} for c in user_columns(self.df)]


@dataclass
class Model:
    name: str
    dataset: str
    revision: int
    fitted: models.Fitted


def build_error(kind: str, message: str, hint: str = "") -> dict[str, Any]:
    return {"ok": False, "error": {"type": kind, "message": message, "hint": hint}}


def tool(record: bool = True) -> Callable:
    """Wrap a method: errors become envelopes, calls become notebook cells."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(self: Session, *args: Any, **kwargs: Any) -> dict[str, Any]:
            with self.lock:
                try:
                    before = len(self.journal)
                    out = {"ok": True} | readers.json_safe(f(self, *args, **kwargs))
                except ToolError as e:
                    return build_error(e.kind, str(e), e.hint)
                except (readers.ReadError, models.FitError) as e:
                    return build_error(e.kind, str(e), e.hint)
                except formulas.FormulaError as e:
                    return build_error("formula_error", str(e))
                except guard.WriteNotAllowed as e:
                    return build_error("write_not_allowed", str(e))
                except guard.BadQuery as e:
                    return build_error("query_error", str(e))
                except ValueError as e:
                    kind, _, rest = str(e).partition(": ")
                    return build_error(kind, rest or kind) if re.fullmatch(r"[a-z0-9_]+", kind) else build_error("internal", str(e))
                except PySparkException as e:
                    return build_error("query_error", str(e).split("\n")[0])
                except Exception as e:
                    return build_error("internal", f"{type(e).__name__}: {e}"[:500])
                if record:
                    op = self.journal[-1]["op_id"] if len(self.journal) > before else None
                    self.recorder.append({"tool": f.__name__, "args": list(args), "kwargs": kwargs, "op_id": op})
                return out

        return run

    return wrap


#: Rows of one answer.
MOST_ROWS = 10_000


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.lock = threading.RLock()
        self.reset()

    def reset(self) -> None:
        for name in getattr(self, "datasets", {}):
            self.spark.catalog.dropTempView(name)
        self.datasets: dict[str, Dataset] = {}
        self.models: dict[str, Model] = {}
        self.journal: list[dict[str, Any]] = []
        self.recorder: list[dict[str, Any]] = []
        self.revision = 0

    # --- registry ---

    def dataset(self, name: str, kind: str = "not_found") -> Dataset:
        if name not in self.datasets:
            raise ToolError(kind, f"no dataset {name!r}", f"registered: {', '.join(sorted(self.datasets)) or 'none'}")
        return self.datasets[name]

    def _columns(self, d: Dataset, names: list[str], kind: str = "column_not_found") -> None:
        unknown = [c for c in names if c not in user_columns(d.df)]
        if unknown:
            raise ToolError(kind, f"no column {unknown[0]!r} in {d.name}", f"columns: {', '.join(user_columns(d.df))}")

    def _publish(self, name: str, df: DataFrame, **more: Any) -> Dataset:
        """Stage the snapshot fully, then swap it in: a failure before this changes nothing."""
        if RID.lower() in (c.lower() for c in df.columns):
            raise ToolError("reserved_column", f"{RID} is the name of the row ordinal", "rename the column")
        return self._install(self._stage(name, df, **more))

    def _stage(self, name: str, df: DataFrame, **more: Any) -> Dataset:
        stored = readers.snapshot(df, name, self.spark)
        return Dataset(name, stored, stored.count(), digest=provenance.table_digest(stored), **more)

    def _install(self, made: Dataset) -> Dataset:
        made.df.drop(RID).createOrReplaceTempView(made.name)  # users do not see the ordinal
        self.revision += 1
        made.revision = self.revision
        self.datasets[made.name] = made
        return made

    def _journal(self, op: str, **evidence: Any) -> str:
        op_id = f"op{len(self.journal) + 1}"
        self.journal.append({"op_id": op_id, "op": op, "revision": self.revision} | evidence)
        return op_id

    def _named(self, name: str) -> str:
        if not NAME.fullmatch(name or ""):
            raise ToolError("invalid_name", f"{name!r} is not an identifier")
        return name

    # --- datasets ---

    @tool()
    def load_dataset(self, path: str, name: str | None = None, read_options: dict[str, Any] | None = None) -> dict[str, Any]:
        kind = readers.format_of(path)
        name = name or re.sub(r"\W", "_", Path(path.rstrip("/")).name.split(".")[0])
        self._named(name)
        df = readers.read(self.spark, path, read_options)
        made = self._publish(name, df, format=kind, path=path, read_options=readers.check_options(read_options), source_hash=provenance.source_hash(path))
        self._journal("load", name=name, path=path, read_options=made.read_options, source_hash=made.source_hash, rows=made.rows, digest=made.digest)
        return {"name": name, "rows": made.rows, "columns": made.columns, "format": kind, "source_hash": made.source_hash}

    @tool()
    def register_frame(self, df: Any, name: str) -> dict[str, Any]:
        """A pandas or Spark frame as a dataset; it cannot be replayed from a file."""
        frame = df
        if not isinstance(df, DataFrame):  # in pandas a missing number is NaN
            frame = self.spark.createDataFrame(df)
            frame = frame.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if t in ("double", "float") else col(c) for c, t in frame.dtypes])
        made = self._publish(self._named(name), frame, format="dataframe")
        self._journal("frame", name=name, rows=made.rows, digest=made.digest)
        return {"name": name, "rows": made.rows, "columns": made.columns}

    @tool(record=False)
    def list_datasets(self) -> dict[str, Any]:
        return {"datasets": [{"name": d.name, "rows": d.rows, "format": d.format, "path": d.path, "columns": d.columns, "revision": d.revision} for d in self.datasets.values()]}

    @tool()
    def profile_dataset(self, name: str, sample_rows: int = 5) -> dict[str, Any]:
        if not 0 <= sample_rows <= 100:
            raise ToolError("invalid_inputs", "sample_rows must be 0 to 100")
        return {"name": name} | profile.profile(self.dataset(name).df, sample_rows)

    @tool(record=False)
    def describe_column(self, name: str, column: str, bins: int = 20) -> dict[str, Any]:
        d = self.dataset(name)
        self._columns(d, [column])
        if not 1 <= bins <= 200:
            raise ToolError("invalid_inputs", "bins must be 1 to 200")
        return {"name": name, "column": column} | profile.describe(d.df, column, bins)

    @tool()
    def analyze_missingness(self, name: str, columns: list[str] | None = None, pattern_top_k: int = 10, pairwise_corr_threshold: float = 0.1, run_mcar_test: bool = True) -> dict[str, Any]:
        d = self.dataset(name, "dataset_not_found")
        self._columns(d, columns or [], "unknown_columns")
        if not 1 <= pattern_top_k <= 100:
            raise ToolError("pattern_top_k_out_of_range", "pattern_top_k must be 1 to 100")
        if not 0 <= pairwise_corr_threshold <= 1:
            raise ToolError("pairwise_corr_threshold_out_of_range", "the threshold must be 0 to 1")
        return missing.analyse(d.df, columns or user_columns(d.df), pattern_top_k, pairwise_corr_threshold, run_mcar_test)

    @tool()
    def find_outliers(self, name: str, columns: list[str], method: str = "iqr", threshold: float | None = None, contamination: float = 0.05, limit: int = 50) -> dict[str, Any]:
        d = self.dataset(name)
        self._columns(d, columns)
        bad = [c for c in columns if not is_numeric(d.df, c)]
        if bad:
            raise ToolError("non_numeric_column", bad[0])
        if not columns or not 1 <= limit <= 10_000 or not 0 < contamination < 0.5:
            raise ToolError("invalid_inputs", "columns, limit or contamination out of range")
        more: dict[str, Any] = {}
        if method == "iqr":
            found = outliers.iqr(d.df, columns, threshold if threshold is not None else 1.5)
        elif method == "zscore":
            found = outliers.zscore(d.df, columns, threshold if threshold is not None else 3.0)
        elif method == "mahalanobis":
            found, more = outliers.mahalanobis(d.df, columns, threshold=threshold)
        elif method == "isolation_forest":
            found = outliers.isolation_forest(d.df, columns, contamination)
        else:
            raise ToolError("invalid_inputs", f"unknown method {method!r}")
        n = found.count()
        used = more.get("cutoff", threshold if threshold is not None else {"iqr": 1.5, "zscore": 3.0}.get(method))
        return {"method": method, "n_outliers": n, "threshold_used": used, "outliers": [r.asDict(True) for r in outliers.top(found, limit).collect()], "truncated": n > limit} | more

    # --- queries ---

    @tool()
    def query(self, sql: str, limit: int = 50, cursor: int = 0) -> dict[str, Any]:
        if not 1 <= limit <= MOST_ROWS or cursor < 0:
            raise ToolError("invalid_inputs", "limit must be 1 to 10000")
        kind = guard.check(self.spark, sql)
        own = guard.own_limit(self.spark, sql)
        limit = limit if own is None else min(max(own, 1), MOST_ROWS)  # the text's LIMIT wins, in pages of MOST_ROWS
        start = time.time()
        df = self.spark.sql(sql)
        rows = [r.asDict(True) for r in (df.offset(cursor) if cursor else df).limit(limit + 1).collect()]
        took = (time.time() - start) * 1000
        more = len(rows) > limit
        total = cursor + len(rows) if not more else df.count() if kind == "query" else None
        return {"columns": df.columns, "rows": rows[:limit], "row_count": min(len(rows), limit), "total_rows": total, "truncated": more, "next_cursor": cursor + limit if more else None, "execution_time_ms": took}

    @tool()
    def materialize_query(self, sql: str, name: str, overwrite: bool = False) -> dict[str, Any]:
        self._named(name)
        if guard.check(self.spark, sql) != "query":
            raise ToolError("write_not_allowed", "only queries can be materialised")
        if name in self.datasets and not overwrite:
            raise ToolError("dataset_name_collision", f"{name!r} exists", "pass overwrite=True")
        made = self._publish(name, self.spark.sql(sql), format="derived")
        self._journal("materialize", name=name, sql=sql, overwrite=overwrite, rows=made.rows, digest=made.digest)
        return {"name": name, "rows": made.rows, "columns": made.columns}

    @tool()
    def split_dataset(self, name: str, test_fraction: float = 0.25, seed: int = 42, stratify_by: str | None = None, train_name: str | None = None, test_name: str | None = None, overwrite: bool = False) -> dict[str, Any]:
        d = self.dataset(name, "dataset_not_found")
        train, test = self._named(train_name or f"{name}_train"), self._named(test_name or f"{name}_test")
        if len({train, test, name}) < 3:
            raise ToolError("split_name_conflict", "the parts need names of their own")
        if not 0 < test_fraction < 1:
            raise ToolError("test_fraction_out_of_range", "test_fraction must lie between 0 and 1")
        if stratify_by is not None:
            self._columns(d, [stratify_by], "stratify_column_missing")
        if d.rows < 2:
            raise ToolError("dataset_too_small", "a split needs two rows")
        taken = [n for n in (train, test) if n in self.datasets]
        if taken and not overwrite:
            raise ToolError("dataset_name_collision", f"{taken[0]!r} exists", "pass overwrite=True")
        if stratify_by and d.df.groupBy(col(stratify_by)).count().where("count > 1").limit(1).count() == 0:
            raise ToolError("stratification_too_sparse", f"every value of {stratify_by!r} stands once")
        marked, small = scoring.split_rows(d.df, test_fraction, seed, stratify_by)
        parts = {}
        for label, side in ((train, False), (test, True)):
            parts[label] = self._stage(label, marked.where(F.col(scoring.TEST) == side).drop(scoring.TEST).orderBy(RID), format="split")
        checks = {n: provenance.membership_checksum(p.df) for n, p in parts.items()}
        for part in parts.values():  # both are written by now
            self._install(part)
        params = {"test_fraction": test_fraction, "seed": seed, "stratify_by": stratify_by, "train_name": train, "test_name": test}
        self._journal("split", name=name, params=params, overwrite=overwrite, checksums=checks, digests={n: p.digest for n, p in parts.items()})
        out: dict[str, Any] = {"train": {"name": train, "rows": parts[train].rows}, "test": {"name": test, "rows": parts[test].rows}, "checksums": checks, "small_strata": small}
        if stratify_by:
            counts = marked.groupBy(col(stratify_by).cast("string").alias("value")).agg(F.count_if(~F.col(scoring.TEST)).alias("train"), F.count_if(scoring.TEST).alias("test"))
            out["strata"] = [r.asDict() for r in counts.orderBy(F.asc_nulls_last("value")).collect()]
        return out

    # --- statistics ---

    @tool()
    def correlate(self, name: str, columns: list[str] | None = None, method: str = "pearson", plot: bool = True) -> dict[str, Any]:
        d = self.dataset(name)
        self._columns(d, columns or [])
        names = [c for c in columns or numeric_columns(d.df) if is_numeric(d.df, c)]
        if len(names) < 2:
            raise ToolError("no_numeric_columns", "two numeric columns are needed")
        if method not in ("pearson", "spearman", "kendall"):
            raise ToolError("invalid_inputs", f"unknown method {method!r}")
        if method == "kendall":
            cells = [{"a": a, "b": b, "r": groups.kendall_tau(d.df, a, b)} for i, a in enumerate(names) for b in names[i + 1 :]]
        else:
            cells = [r.asDict() for r in groups.correlation_pairs(d.df, names, method).collect()]
        matrix = {a: {b: 1.0 if a == b else None for b in names} for a in names}
        for c in cells:
            matrix[c["a"]][c["b"]] = matrix[c["b"]][c["a"]] = c["r"]
        out: dict[str, Any] = {"method": method, "columns": names, "matrix": matrix, "pairs": cells}
        return out | ({"plot": plots.render({"columns": names, "cells": cells})} if plot else {})

    @tool()
    def compare_groups(self, name: str, group_column: str, metric_column: str, groups: list[str] | None = None) -> dict[str, Any]:
        d = self.dataset(name)
        self._columns(d, [group_column, metric_column])
        return _compare(d.df, group_column, metric_column, groups)

    @tool()
    def pairwise_comparisons(self, name: str, group_column: str, metric_column: str, groups: list[str] | None = None, method: str = "auto", p_adjust: str | None = None, alpha: float = 0.05) -> dict[str, Any]:
        d = self.dataset(name)
        self._columns(d, [group_column, metric_column])
        if not is_numeric(d.df, metric_column):
            raise ToolError("metric_not_numeric", metric_column)
        if not 0 < alpha < 1:
            raise ToolError("invalid_alpha", "alpha must lie between 0 and 1")
        if method not in ("auto", "tukey", "dunn"):
            raise ToolError("invalid_method", method)
        if p_adjust is not None and p_adjust not in posthoc.METHODS:
            raise ToolError("invalid_p_adjust", p_adjust)
        if p_adjust is not None and method == "tukey":
            raise ToolError("p_adjust_not_applicable", "Tukey's p-values are simultaneous already")
        return _pairwise(d.df, group_column, metric_column, groups, method, p_adjust, alpha)

    @tool()
    def test_hypothesis(self, name: str, kind: str, group_column: str | None = None, metric_column: str | None = None, groups: list[str] | None = None, row_column: str | None = None, column_column: str | None = None) -> dict[str, Any]:
        d = self.dataset(name)
        if kind in ("chi_square", "fisher"):
            a, b = row_column or group_column, column_column or metric_column
            self._columns(d, [x for x in (a, b)])
            table = _groups.table_of([r.asDict() for r in _groups.contingency(d.df, a, b).collect()])[2]
            if min(table.shape, default=0) < 2 or kind == "fisher" and table.shape != (2, 2):
                raise ToolError("invalid_inputs", f"the table is {table.shape}")
            return _groups.chi_square(table) if kind == "chi_square" else _groups.fisher(table)
        if kind not in ("t_test", "welch", "mann_whitney", "ks", "anova", "kruskal"):
            raise ToolError("invalid_kind", kind)
        self._columns(d, [x for x in (group_column, metric_column)])
        pairs = _groups.labelled(d.df, group_column, metric_column, groups)
        labels = [str(g) for g in groups] if groups else sorted(r["g"] for r in pairs.select("g").distinct().collect())
        if kind in ("t_test", "welch", "mann_whitney", "ks") and len(labels) != 2 or len(labels) < 2:
            raise ToolError("invalid_inputs", f"{kind} does not take {len(labels)} groups")
        return _groups.run_test(pairs, kind, labels) | {"groups": labels}

    @tool()
    def adjust_pvalues(self, p_values: list[float], method: str = "bh", alpha: float = 0.05, labels: list[str] | None = None) -> dict[str, Any]:
        if method not in posthoc.METHODS:
            raise ToolError("unknown_method", method)
        if any(isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1 for p in p_values):
            raise ToolError("invalid_p_value", "p-values must lie in [0, 1]")
        if not 0 < alpha < 1:
            raise ToolError("invalid_alpha", "alpha must lie between 0 and 1")
        if labels is not None and len(labels) != len(p_values):
            raise ToolError("length_mismatch", "labels and p_values differ in length")
        fixed = posthoc.adjust(p_values, method)
        rows = [{"label": labels[i] if labels else str(i), "p_value": p, "p_adjusted": f, "reject": f <= alpha} for i, (p, f) in enumerate(zip(p_values, fixed, strict=True))]
        return {"method": method, "alpha": alpha, "results": rows, "n_rejected": sum(r["reject"] for r in rows)}

    @tool()
    def power_analysis(self, **inputs: Any) -> dict[str, Any]:
        return power.analyse(**inputs)

    # --- models ---

    @tool()
    def fit_model(self, name: str, formula: str, kind: str = "ols", robust: bool = False, model_name: str | None = None) -> dict[str, Any]:
        d = self.dataset(name)
        if model_name is not None and not NAME.fullmatch(model_name):
            raise ToolError("model_name_invalid", model_name)
        if model_name in self.models:
            raise ToolError("model_name_collision", f"{model_name!r} exists")
        fitted = models.fit(d.df, formula, kind, robust)
        found = models.diagnostics(fitted, d.df) if kind == "ols" else None
        label = model_name or f"model_{len(self.models) + 1}"
        self.models[label] = Model(label, name, d.revision, fitted)
        self._journal("fit", name=label, dataset=name, dataset_revision=d.revision, formula=formula, kind=kind, robust=robust, params=fitted.params, std_errors=fitted.se)
        return {"model_name": label, "kind": kind, "formula": formula, "coefficients": fitted.coefficients(), "fit": models.fit_block(fitted), "diagnostics": found, "warnings": models.warnings_of(fitted, found) + models.outcome_notes(fitted, d.df), "interpretation": models.interpretation(fitted), "n_dropped": d.rows - fitted.n_obs}

    @tool(record=False)
    def list_models(self) -> dict[str, Any]:
        return {"models": [{"name": m.name, "kind": m.fitted.kind, "formula": m.fitted.formula, "dataset": m.dataset, "n_obs": m.fitted.n_obs} for m in self.models.values()]}

    def _model(self, name: str) -> Model:
        if name not in self.models:
            raise ToolError("model_not_found", f"no model {name!r}")
        return self.models[name]

    @tool()
    def predict(self, model_name: str, dataset: str, output: str = "response", threshold: float = 0.5, limit: int = 50, cursor: int | None = None, include_se: bool = False) -> dict[str, Any]:
        if not 0 <= threshold <= 1:
            raise ToolError("threshold_out_of_range", "threshold must be 0 to 1")
        m, d = self._model(model_name), self.dataset(dataset, "dataset_not_found")
        if output not in ("response", "link", "class"):
            raise ToolError("invalid_output", output)
        if output == "class" and m.fitted.kind != "logistic":
            raise ToolError("class_output_requires_logistic", m.fitted.kind)
        if include_se and m.fitted.kind != "ols":
            raise ToolError("include_se_requires_ols", m.fitted.kind)
        if cursor is not None and (isinstance(cursor, bool) or not isinstance(cursor, int) or cursor < 0):
            raise ToolError("invalid_cursor", str(cursor))
        absent = [c for c in m.fitted.design.sources if c not in d.df.columns]
        if absent:
            raise ToolError("missing_predictors", ", ".join(absent))
        scored = scoring.predictions(m.fitted, d.df, output, threshold, include_se)
        rows, following = scoring.page(scored, limit, cursor)
        n = scored.count()
        return {"rows": rows, "n_scored": n, "n_dropped": d.rows - n, "next_cursor": following, "truncated": following is not None}

    @tool()
    def evaluate_model(self, model_name: str, dataset: str, threshold: float = 0.5, n_calibration_bins: int = 10) -> dict[str, Any]:
        if not 2 <= n_calibration_bins <= 50:
            raise ToolError("n_calibration_bins_out_of_range", "n_calibration_bins must be 2 to 50")
        m, d = self._model(model_name), self.dataset(dataset, "dataset_not_found")
        wrong = models.outcome_type(d.df, m.fitted)
        if wrong:
            raise ToolError(wrong, m.fitted.design.outcome_source)
        absent = [c for c in m.fitted.design.sources if c not in d.df.columns]
        if absent:
            raise ToolError("prediction_failed", f"missing {', '.join(absent)}")
        return {"model_name": model_name, "kind": m.fitted.kind, "notes": models.outcome_notes(m.fitted, d.df)} | scoring.evaluate(m.fitted, d.df, threshold, n_calibration_bins)

    @tool()
    def cross_validate(self, name: str, formula: str, kind: str = "ols", robust: bool = False, k: int = 5, seed: int = 42, threshold: float = 0.5) -> dict[str, Any]:
        d = self.dataset(name, "dataset_not_found")
        if kind not in models.KINDS:
            raise ToolError("invalid_kind", kind)
        if not 2 <= k <= 20:
            raise ToolError("k_out_of_range", "k must be 2 to 20")
        if not 0 <= threshold <= 1:
            raise ToolError("threshold_out_of_range", "threshold must be 0 to 1")
        return scoring.cross_validate(d.df, formula, kind, robust, k, seed, threshold)

    # --- plots ---

    @tool()
    def plot(self, name: str, kind: str, x: str | None = None, y: str | None = None, hue: str | None = None, title: str | None = None, bins: int = 20) -> dict[str, Any]:
        data = plots.plot_data(self.dataset(name).df, kind, x, y, hue, bins)
        return {"title": title, "data": data, "image": plots.render(data)}

    @tool()
    def regression_line(self, model_name: str, predictor: str, title: str | None = None) -> dict[str, Any]:
        m = self._model(model_name)
        line = plots.regression_line(m.fitted, self.dataset(m.dataset).df, predictor)
        return {"title": title, "line": line, "image": plots.render({"line": line})}

    @tool()
    def residual_diagnostic(self, model_name: str, kind: str = "all", title: str | None = None) -> dict[str, Any]:
        m = self._model(model_name)
        data = plots.residual_data(m.fitted, self.dataset(m.dataset).df, kind)
        return {"title": title, "data": data, "image": plots.render(data)}

    # --- notebooks ---

    @tool(record=False)
    def emit_notebook(self, path: str | None = None, include_outputs: bool = False) -> dict[str, Any]:
        from . import notebook

        target = path or f"analysis-{time.strftime('%Y%m%d-%H%M%S')}.ipynb"
        try:
            book = notebook.write(self, target)
        except OSError as e:
            raise ToolError("write_failed", str(e)) from e
        return {"path": target, "cells": len(book["cells"]), "resumable": book["metadata"]["assay"]["manifest"]["resumable"]}

    @tool(record=False)
    def load_session_from_notebook(self, path: str) -> dict[str, Any]:
        from . import notebook

        return notebook.resume(self, path)


_groups = groups


def _compare(df: DataFrame, group: str, metric: str, labels: list[str] | None) -> dict[str, Any]:
    return _groups.compare(df, group, metric, labels, is_numeric(df, metric))


def _pairwise(df: DataFrame, group: str, metric: str, labels: list[str] | None, method: str, p_adjust: str | None, alpha: float) -> dict[str, Any]:
    if labels is not None and len(set(labels)) < len(labels):
        raise ToolError("duplicate_groups", "a group is named twice")
    counts = _groups.label_counts(df, group)
    if labels:
        chosen = sorted(str(g) for g in labels)
        if len(chosen) <= 20:
            known = {r["g"] for r in counts.where(F.col("g").isin(chosen)).collect()}
    else:  # one label more than are compared settles it
        chosen = sorted(r["g"] for r in counts.limit(21).collect())
        known = set(chosen)
    if len(chosen) < 3:
        raise ToolError("too_few_groups", "three groups are needed")
    if len(chosen) > 20:
        raise ToolError("too_many_groups", "at most 20 groups")
    unknown = [g for g in chosen if g not in known]
    if unknown:
        raise ToolError("group_not_found", unknown[0])
    pairs = _groups.labelled(df, group, metric, chosen)
    stats = {r["g"]: r.asDict() for r in _groups.moments(pairs).collect()}
    small = [g for g in chosen if g not in stats or stats[g]["n"] < 2]
    if small:
        raise ToolError("insufficient_group_size", small[0])
    if all(not s["var"] for s in stats.values()) and len({s["mean"] for s in stats.values()}) == 1:
        raise ToolError("constant_metric", metric)
    normal = _groups.shapiro_by_group(pairs, chosen)
    spread = _groups.levene(pairs)["p_value"]
    broken = any(p is not None and p < 0.05 for p in normal.values()) or (not math.isnan(spread) and spread < 0.05)
    requested = method
    if method == "auto":
        method = "dunn" if broken else "tukey"
    found = posthoc.tukey(pairs, chosen, alpha) if method == "tukey" else posthoc.dunn(pairs, chosen, p_adjust or "holm", alpha)
    return found | {"method_requested": requested, "estimate_name": "mean_diff" if method == "tukey" else "mean_rank_diff", "n_comparisons": len(found["comparisons"]), "alpha": alpha, "groups": [stats[g] for g in chosen], "assumption_checks": {"normality": normal, "equal_variances_p": spread, "violated": broken}}
