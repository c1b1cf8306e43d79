"""Readers: CSV and TSV with a sniffed delimiter, Parquet, JSON and JSON lines, Excel; snapshots with a row ordinal."""

from __future__ import annotations

import csv
import datetime as dt
import os
import re
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import RID
from .provenance import is_remote

FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "xlsx"}
#: Reader options by the names that analysts use, and what they are called here.
OPTIONS = {"delim": "sep", "sep": "sep", "nullstr": "nullValue", "quote": "quote", "escape": "escape", "header": "header", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "compression": "compression", "encoding": "encoding", "comment": "comment"}
SPECIAL = {"all_varchar", "names", "columns", "types", "ignore_errors", "skip", "sample_size", "auto_detect", "sheet"}
TYPES = {"VARCHAR": "string", "TEXT": "string", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "DOUBLE": "double", "FLOAT": "float", "REAL": "float", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "BLOB": "binary"}
SNIFF_BYTES = 64 << 10


class ReadError(ValueError):
    def __init__(self, kind: str, message: str, hint: str = ""):
        super().__init__(message)
        self.kind, self.hint = kind, hint


def format_of(path: str) -> str:
    name = path.rstrip("/").lower()
    ending = os.path.splitext(re.sub(r"\.(gz|bz2|zst)$", "", name))[1]
    if ending not in FORMATS:
        raise ReadError("unsupported_format", f"{ending or 'no extension'} is not one of {', '.join(sorted(FORMATS))}")
    return FORMATS[ending]


def check_options(options: dict[str, Any] | None) -> dict[str, Any]:
    out = {}
    for key, value in (options or {}).items():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) or key.lower() not in OPTIONS.keys() | SPECIAL:
            raise ReadError("bad_read_option", f"unknown option {key!r}")
        if not isinstance(value, (str, int, float, bool, list, dict)):
            raise ReadError("bad_read_option", f"{key} has a value of type {type(value).__name__}")
        out[key.lower()] = value
    return out


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of a file's beginning; a comma where it cannot be told."""
    if is_remote(path) or re.search(r"\.(gz|bz2|zst)$", path.lower()):
        return _delimiter([r["value"] for r in spark.read.text(path).where("trim(value) != ''").limit(50).collect()])
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        local = next((os.path.join(local, f) for f in sorted(os.listdir(local)) if not f.startswith((".", "_"))), "")
    try:
        with open(local, encoding="utf-8-sig", errors="replace", newline="") as f:
            head = f.read(SNIFF_BYTES)
    except OSError:
        return ","
    lines = head.split("\n")
    return _delimiter([x for x in (lines[:-1] if len(head) == SNIFF_BYTES else lines) if x.strip()][:50])


def _delimiter(lines: list[str]) -> str:
    best = (0, 0, ",")
    for rank, mark in enumerate(",;\t|"):
        widths = [len(r) for r in csv.reader(lines, delimiter=mark)]
        if widths and widths[0] > 1:
            best = max(best, (sum(w == widths[0] for w in widths), -rank, mark))
    return best[2]


def read(spark: SparkSession, path: str, options: dict[str, Any] | None = None) -> DataFrame:
    """A lazily read file. Types are inferred from all rows, whatever ``sample_size`` allows; nothing else is coerced."""
    kind, options = format_of(path), check_options(options)
    if not is_remote(path) and not os.path.exists(path.removeprefix("file://")):
        raise ReadError("file_not_found", path)
    if kind == "xlsx":
        return _excel(spark, path, options)
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(path)
    known = {OPTIONS[k]: v for k, v in options.items() if k in OPTIONS}
    detect = bool(options.get("auto_detect", True))
    known.setdefault("sep", "\t" if kind == "tsv" else sniff(spark, path) if detect else ",")
    header = str(known.pop("header", True)).lower() != "false" and "names" not in options
    skip = int(options.get("skip", 0))
    broken = _has_quoted_newline(spark, path, known)
    if skip and broken:
        raise ReadError("bad_read_option", "skip counts lines, and some values of this file run over several")
    reader = reader.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in known.items()}).option("header", header).option("samplingRatio", 1.0).option("escape", known.get("escape", '"')).option("multiLine", broken)
    reader = reader.option("mode", "DROPMALFORMED" if options.get("ignore_errors") else "PERMISSIVE").option("inferSchema", detect and not options.get("all_varchar", False))
    types = options.get("columns") or options.get("types")
    source: Any = path
    if skip:
        lines = spark.read.text(path).rdd.zipWithIndex().filter(lambda r: r[1] >= skip).map(lambda r: r[0][0])
        source = lines
    if isinstance(types, dict):
        reader = reader.schema(", ".join(f"`{k.replace('`', '``')}` {TYPES.get(str(v).upper(), str(v))}" for k, v in types.items()))
    df = reader.csv(source)
    if "names" in options:
        if len(options["names"]) != len(df.columns):
            raise ReadError("bad_read_option", "names does not match the number of columns")
        df = df.toDF(*options["names"])
    return df


def _has_quoted_newline(spark: SparkSession, path: str, known: dict[str, Any]) -> bool:
    """Whether some line of the files holds an odd number of quotes; only then do files stop being splittable.

    Every line is looked at, in one distributed scan that moves nothing. Lines of another encoding are not told.
    """
    if str(known.get("encoding", "utf-8")).lower().replace("-", "") not in ("utf8", "ascii", "usascii"):
        return True
    quote, escape = str(known.get("quote", '"')), str(known.get("escape", '"'))
    if not quote:
        return False
    line = F.col("value")
    if escape and escape != quote:
        line = F.replace(F.replace(line, F.lit(escape * 2), F.lit("")), F.lit(escape + quote), F.lit(""))
    odd = (F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))) % (2 * len(quote)) != 0
    return not spark.read.text(path).where(odd).limit(1).isEmpty()


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _excel(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    """The first (or named) sheet of a workbook, by the zip and XML of its format; dates stay serial numbers unless formatted."""
    try:
        with zipfile.ZipFile(path.removeprefix("file://")) as book:
            names = book.namelist()
            shared = [("".join(t.text or "" for t in s.iter(_CELL + "t"))) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(_CELL + "si")] if "xl/sharedStrings.xml" in names else []
            sheets = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(_CELL + "sheet")]
            at = sheets.index(options["sheet"]) if options.get("sheet") in sheets else 0
            root = ET.fromstring(book.read(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))[at]))
    except (OSError, KeyError, zipfile.BadZipFile, ET.ParseError, IndexError) as e:
        raise ReadError("query_error", f"not a readable workbook: {e}") from e
    rows: list[dict[int, Any]] = []
    for r in root.iter(_CELL + "row"):
        row: dict[int, Any] = {}
        for c in r.iter(_CELL + "c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            place = 0
            for ch in letters:
                place = place * 26 + ord(ch) - 64
            v, inline = c.find(_CELL + "v"), c.find(_CELL + "is")
            kind = c.get("t", "n")
            text = "".join(t.text or "" for t in inline.iter(_CELL + "t")) if inline is not None else v.text if v is not None else None
            if text is not None:
                row[place - 1] = shared[int(text)] if kind == "s" else text == "1" if kind == "b" else text if kind in ("str", "inlineStr", "e", "d") else float(text)
        rows.append(row)
    if not rows:
        raise ReadError("query_error", "the sheet is empty")
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    header = [str(rows[0].get(i, f"column{i}")) for i in range(width)]
    columns = []
    for i in range(width):
        values = [r.get(i) for r in rows[1:]]
        present = [v for v in values if v is not None]
        if present and all(isinstance(v, bool) for v in present):
            columns.append(("boolean", values))
        elif present and all(isinstance(v, float) for v in present):
            whole = all(v == int(v) for v in present)
            columns.append(("bigint", [None if v is None else int(v) for v in values]) if whole else ("double", values))
        else:
            columns.append(("string", [None if v is None else (repr(v) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)) for v in values]))
    schema = ", ".join(f"`{h.replace('`', '``')}` {t}" for h, (t, _) in zip(header, columns, strict=True))
    return spark.createDataFrame(list(zip(*[c for _, c in columns], strict=True)), schema)


def store_root(spark: SparkSession) -> str:
    """Where snapshots go: the shared checkpoint folder if the cluster names one, else a folder of this machine's own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named.rstrip("/") if named else "file://" + os.path.join(tempfile.gettempdir(), "assay-store")


def snapshot(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once and read it back with a dense ordinal in RID: the row order in which it was written.

    The ordinal is partition start + place in the partition, so nothing moves to one task. ``spark`` is the
    session that the result belongs to, where it is not the frame's own.
    """
    spark = spark or df.sparkSession
    path = f"{store_root(spark)}/{re.sub(r'[^A-Za-z0-9_]', '_', label)}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    plain = df.drop(RID) if RID in df.columns else df
    plain.withColumn(RID, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftrightunsigned(RID, 33)
    sizes = sorted((r["p"], r["n"]) for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    bases = spark.createDataFrame(starts, "__assay_part long, __assay_start long")
    place = F.col(RID).bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("__assay_part", part).join(F.broadcast(bases), "__assay_part").withColumn(RID, place + F.col("__assay_start")).drop("__assay_part", "__assay_start")


def json_safe(value: Any) -> Any:
    """Dates as ISO text, NaN and infinities as None, decimals as numbers; containers by element."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime, dt.time)):
        return value.isoformat()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    try:
        return json_safe(value.asDict(True)) if hasattr(value, "asDict") else json_safe(value.item()) if hasattr(value, "item") else float(value)
    except (TypeError, ValueError):
        return str(value)
