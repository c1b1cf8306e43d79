"""Where data came from and what it is: source hashes, ordered digests, membership checksums."""

from __future__ import annotations

import hashlib
import os
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import RID, col, user_columns

HASH_BYTES = 100 << 20
CHUNK = 1 << 20
DIGEST_ROWS = 8192


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def source_hash(path: str) -> str:
    """SHA-256 of a file's or folder's bytes up to 100 MB; above, of path, size and time; a marker for remote paths."""
    if is_remote(path):
        return f"sentinel:{path}"
    local = path.removeprefix("file://")
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(local) for f in names if not f.startswith((".", "_"))) if os.path.isdir(local) else [local]
    try:
        size = sum(os.path.getsize(f) for f in files)
        if size > HASH_BYTES:
            stamp = "|".join(f"{f}:{os.stat(f).st_mtime_ns}:{os.path.getsize(f)}" for f in files)
            return "fallback:" + hashlib.sha256(stamp.encode()).hexdigest()
        h = hashlib.sha256()
        for f in files:
            with open(f, "rb") as data:
                while block := data.read(CHUNK):
                    h.update(block)
        return h.hexdigest()
    except OSError:
        return f"sentinel:{path}"


def _encoded(df: DataFrame, name: str) -> Column:
    """A value as type, length and text, so that neighbours cannot run together; null has a mark of its own."""
    dtype = df.schema[name].dataType
    value = F.to_json(col(name)) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else F.hex(col(name)) if isinstance(dtype, T.BinaryType) else col(name).cast("string")
    return F.coalesce(F.concat(F.lit(f"{dtype.simpleString()}:"), F.length(value).cast("string"), F.lit(":"), value), F.lit("\x00"))


def row_hash(df: DataFrame) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[_encoded(df, c) for c in user_columns(df)]), 256)


def table_digest(df: DataFrame) -> str:
    """Order-sensitive SHA-256 over schema and rows: chunks of rows are digested apart, then the chunks' digests in order."""
    rows = df.select(F.col(RID).alias("r"), row_hash(df).alias("h"))
    chunks = rows.groupBy(F.floor(F.col("r") / DIGEST_ROWS).alias("c")).agg(F.array_sort(F.collect_list(F.struct("r", "h"))).alias("rows"))
    digests = chunks.select("c", F.sha2(F.array_join(F.transform("rows", lambda x: x["h"]), ""), 256).alias("d")).orderBy("c")
    h = hashlib.sha256("|".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in user_columns(df)).encode())
    for r in digests.toLocalIterator():
        h.update(r["d"].encode())
    return h.hexdigest()


def checksum_parts(hashes: DataFrame, name: str = "h") -> DataFrame:
    """n, xor and sum of the leading and following 60 bits of SHA-256 texts: independent of order, aware of repeats."""
    high, low = (F.conv(F.substring(name, at, 15), 16, 10).cast("bigint") for at in (1, 16))
    wide = "decimal(38,0)"
    return hashes.select(high.alias("a"), low.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("xor_a"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("xor_b"), F.coalesce(F.sum(F.col("a").cast(wide)), F.lit(0)).cast(wide).alias("sum_a"), F.coalesce(F.sum(F.col("b").cast(wide)), F.lit(0)).cast(wide).alias("sum_b"))


def membership_checksum(df: DataFrame) -> str:
    r = checksum_parts(df.select(row_hash(df).alias("h"))).first()
    return f"{r['n']}:{r['xor_a']:015x}{r['xor_b']:015x}:{int(r['sum_a']):x}.{int(r['sum_b']):x}"


def evidence_equal(a: Any, b: Any, rtol: float = 1e-7, atol: float = 1e-10) -> bool:
    """Nested numbers alike up to rounding; NaN equals NaN."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(evidence_equal(a[k], b[k], rtol, atol) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(evidence_equal(x, y, rtol, atol) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) or isinstance(b, float):
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            return False
        return a == b or a != a and b != b or abs(a - b) <= atol + rtol * abs(b)
    return a == b
