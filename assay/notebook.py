"""Notebooks: a session as runnable PySpark cells with a manifest of evidence, and verified resumption from one."""

from __future__ import annotations

import hashlib
import json
import os
import time
from typing import TYPE_CHECKING, Any

import pyspark

from .sources import provenance, readers
from .sources.provenance import evidence_equal

if TYPE_CHECKING:
    from .session import Session

VERSION = 1
#: Bounds of what is resumed: bytes of a notebook and of its manifest, cells, operations, characters of a text, seconds.
MOST_BYTES, MOST_MANIFEST, MOST_CELLS, MOST_OPS, MOST_TEXT, MOST_SECONDS = 32 << 20, 8 << 20, 2000, 500, 100_000, 300
OPS = {
    "load": {"name", "path", "read_options", "source_hash", "rows", "digest"},
    "frame": {"name", "rows", "digest"},
    "materialize": {"name", "sql", "overwrite", "rows", "digest"},
    "split": {"name", "params", "overwrite", "checksums", "digests"},
    "fit": {"name", "dataset", "dataset_revision", "formula", "kind", "robust", "params", "std_errors"},
}


def _call(cell: dict[str, Any]) -> str:
    args = [repr(a) if not hasattr(a, "columns") else "frame" for a in cell["args"]] + [f"{k}={v!r}" for k, v in cell["kwargs"].items() if not hasattr(v, "columns")]
    return f"s.{cell['tool']}({', '.join(args)})"


def _setup(session: Session) -> str:
    lines = ["from pyspark.sql import SparkSession", "from assay.session import Session", "from assay.sources.provenance import source_hash", "", "spark = SparkSession.builder.getOrCreate()", "s = Session(spark)"]
    for op in session.journal:
        if op["op"] == "load" and not op["source_hash"].startswith("sentinel:"):
            lines.append(f"assert source_hash({op['path']!r}) == {op['source_hash']!r}, 'the source has changed'")
    return "\n".join(lines)


def _cell(kind: str, source: str, **metadata: Any) -> dict[str, Any]:
    out = {"cell_type": kind, "metadata": metadata, "source": source.splitlines(keepends=True), "id": hashlib.sha256((kind + source + json.dumps(metadata)).encode()).hexdigest()[:12]}
    return out | ({"execution_count": None, "outputs": []} if kind == "code" else {})


def _fingerprint(cells: list[dict[str, Any]]) -> str:
    return hashlib.sha256(json.dumps([[c["cell_type"], "".join(c["source"])] for c in cells]).encode()).hexdigest()


def _final(session: Session) -> dict[str, Any]:
    return {
        "datasets": {d.name: {"format": d.format, "rows": d.rows, "columns": d.columns, "digest": d.digest, "revision": d.revision} for d in session.datasets.values()},
        "models": {m.name: {"kind": m.fitted.kind, "formula": m.fitted.formula, "dataset": m.dataset, "n_obs": m.fitted.n_obs, "revision": m.revision} for m in session.models.values()},
    }


def build(session: Session) -> dict[str, Any]:
    cells = [_cell("markdown", "# Analysis"), _cell("code", _setup(session), role="setup")]
    for k, c in enumerate(session.recorder):
        cells.append(_cell("markdown", f"## {k + 1}. {c['tool'].replace('_', ' ')}"))
        cells.append(_cell("code", _call(c), tool=c["tool"], op_id=c["op_id"]))
        if c["op_id"]:
            op = next(o for o in session.journal if o["op_id"] == c["op_id"])
            if op["op"] == "split":
                checks = "\n".join(f"assert membership_checksum(s.datasets[{n!r}].df) == {v!r}" for n, v in op["checksums"].items())
                cells.append(_cell("code", "from assay.sources.provenance import membership_checksum\n" + checks, op_id=c["op_id"]))
    manifest = {"version": VERSION, "engine": {"pyspark": pyspark.__version__}, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "resumable": all(o["op"] != "frame" for o in session.journal), "journal": session.journal, "final": _final(session), "cells": session_cells(session), "cells_sha256": _fingerprint(cells)}
    return {"nbformat": 4, "nbformat_minor": 5, "metadata": {"kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"}, "language_info": {"name": "python"}, "assay": {"manifest": manifest}}, "cells": cells}


def session_cells(session: Session) -> list[dict[str, Any]]:
    return [{"tool": c["tool"], "args": [a if not hasattr(a, "columns") else None for a in c["args"]], "kwargs": {k: v for k, v in c["kwargs"].items() if not hasattr(v, "columns")}, "op_id": c["op_id"]} for c in session.recorder]


def write(session: Session, path: str) -> dict[str, Any]:
    book = build(session)
    staged = f"{path}.part"
    with open(staged, "w", encoding="utf-8") as f:
        json.dump(book, f, indent=1)
    os.replace(staged, path)
    return book


def _texts(value: Any):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _texts(v)
    elif isinstance(value, list):
        for v in value:
            yield from _texts(v)


def load(path: str) -> dict[str, Any]:
    """The manifest of a notebook, strictly checked."""
    from .session import ToolError

    if not os.path.isfile(path):
        raise ToolError("notebook_not_found", path)
    if os.path.getsize(path) > MOST_BYTES:
        raise ToolError("notebook_invalid", "the notebook is too large")
    try:
        with open(path, encoding="utf-8") as f:
            book = json.load(f)
        cells = book["cells"]
        assert isinstance(cells, list) and book["nbformat"] == 4
    except (ValueError, KeyError, AssertionError, TypeError) as e:
        raise ToolError("notebook_invalid", "this is not a notebook of format 4") from e
    manifest = book.get("metadata", {}).get("assay", {}).get("manifest")
    if manifest is None:
        raise ToolError("manifest_missing", "the notebook has no manifest")
    if not isinstance(manifest, dict) or manifest.get("version") != VERSION:
        raise ToolError("manifest_version_unsupported", str(manifest.get("version") if isinstance(manifest, dict) else None))
    try:
        journal = manifest["journal"]
        good = len(json.dumps(manifest)) <= MOST_MANIFEST and len(cells) <= MOST_CELLS and len(journal) <= MOST_OPS and all(len(t) <= MOST_TEXT for t in _texts(manifest))
        good = good and set(manifest) == {"version", "engine", "created_at", "resumable", "journal", "final", "cells", "cells_sha256"}
        good = good and all(set(o) - {"op_id", "op", "revision"} == OPS.get(o["op"]) for o in journal)
        good = good and [o["op_id"] for o in journal] == [f"op{i + 1}" for i in range(len(journal))] and all(a["revision"] <= b["revision"] for a, b in zip(journal, journal[1:], strict=False))
        good = good and {c["op_id"] for c in manifest["cells"] if c["op_id"]} <= {o["op_id"] for o in journal}
    except (KeyError, TypeError, AttributeError):
        good = False
    if not good:
        raise ToolError("manifest_invalid", "the manifest does not follow its schema")
    if _fingerprint(cells) != manifest["cells_sha256"]:
        raise ToolError("notebook_modified", "cells differ from what was recorded")
    return manifest


def resume(session: Session, path: str) -> dict[str, Any]:
    """Validate, replay into a session of its own, compare all evidence, then install the whole state at once."""
    from .session import Session as Fresh
    from .session import ToolError

    if session.datasets or session.models or session.journal:
        raise ToolError("session_not_empty", "resume needs an empty session")
    if any(t.isTemporary for t in session.spark.catalog.listTables()):
        raise ToolError("catalog_not_empty", "temporary views exist")
    manifest = load(path)
    began = time.time()
    journal = manifest["journal"]
    frames = [o["name"] for o in journal if o["op"] == "frame"]
    if frames:
        raise ToolError("unreplayable_dataset", f"{frames[0]!r} came from memory")
    for o in journal:
        if o["op"] == "load" and not o["source_hash"].startswith("sentinel:"):
            if not provenance.is_remote(o["path"]) and not os.path.exists(o["path"].removeprefix("file://")):
                raise ToolError("source_drift", f"{o['path']} is gone")
            if provenance.source_hash(o["path"]) != o["source_hash"]:
                raise ToolError("source_drift", f"{o['path']} has changed")
    made = Fresh(session.spark)
    for o in journal:
        if time.time() - began > MOST_SECONDS:
            raise ToolError("resume_budget_exceeded", f"more than {MOST_SECONDS} s")
        _apply(made, o)
    if not evidence_equal(_final(made), manifest["final"]):
        raise ToolError("registry_mismatch", "the replayed registry differs")
    for name, d in made.datasets.items():
        d.df.drop(readers.RID).createOrReplaceTempView(name)
    state = ("datasets", "models", "journal", "revision", "spark")
    for key in state:
        setattr(session, key, getattr(made, key))
    session.recorder = [dict(c) for c in manifest["cells"]]
    return {"datasets": sorted(session.datasets), "models": sorted(session.models), "operations": len(journal)}


def _apply(made: Session, o: dict[str, Any]) -> None:
    from .session import ToolError

    if o["op"] == "load":
        out = made.load_dataset(o["path"], o["name"], o["read_options"] or None)
    elif o["op"] == "materialize":
        out = made.materialize_query(o["sql"], o["name"], o["overwrite"])
    elif o["op"] == "split":
        p = o["params"]
        out = made.split_dataset(o["name"], p["test_fraction"], p["seed"], p["stratify_by"], p["train_name"], p["test_name"], o["overwrite"])
    else:
        out = made.fit_model(o["dataset"], o["formula"], o["kind"], o["robust"], o["name"])
    if not out["ok"]:
        raise ToolError("resume_failed", f"{o['op_id']}: {out['error']['type']}: {out['error']['message']}")
    again = made.journal[-1]
    if o["op"] in ("load", "materialize") and (again["digest"] != o["digest"] or again["rows"] != o["rows"]):
        raise ToolError("state_digest_mismatch", f"{o['name']!r} differs from what was recorded")
    if o["op"] == "split" and (again["checksums"] != o["checksums"] or again["digests"] != o["digests"]):
        raise ToolError("split_drift", f"the parts of {o['name']!r} differ")
    if o["op"] == "fit" and not evidence_equal([again["params"], again["std_errors"]], [o["params"], o["std_errors"]], 1e-6, 1e-9):
        raise ToolError("model_drift", f"{o['name']!r} has other coefficients")


