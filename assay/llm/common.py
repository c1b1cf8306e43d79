"""Shared plumbing of the corpus operators: scratch tables, batch sizes, joins by hot keys, fitting samples."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of one Arrow batch handed to a Python worker. Texts run from a word to megabytes, so rows alone do not bound a batch.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: A key of more rows than this may be hot; at most so many keys are taken as hot.
HOT_ROWS, HOT_KEYS = 1_000, 100_000

_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker process keeps from task to task for ``owner``; what it kept for any other is let go.

    Spark hands a worker on from stage to stage, so the caches of all operators would add up in it.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or set as the checkpoint folder; in local mode, where driver and executors are one process, a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    path = tempfile.mkdtemp(prefix="assay-")
    atexit.register(shutil.rmtree, path, True)
    return "file://" + path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/assay-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and, where this Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_of_id(col: Column) -> Column:
    """crc32 of the id as text, as the contracts' folds use it."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(stem: str, *taken: DataFrame) -> str:
    """``stem``, lengthened until no column of ``taken`` is called so."""
    names = {c.lower() for df in taken for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def is_hot(total: int) -> Column:
    """Whether a key that n of ``total`` rows have is a common one."""
    return F.col("n") > max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join by ``key`` with ``groups`` (key, n = how many rows have it, and more) in which no common key meets in one task.

    Keys of more than ``HOT_ROWS`` rows, and more than a HOT_KEYS-th of all ``total`` rows, are broadcast: there
    are fewer than HOT_KEYS of them, however large the tables. The others are joined by a shuffle.
    """
    common, others = groups.where(is_hot(total)), groups.where(~is_hot(total))
    if total <= HOT_ROWS or common.isEmpty():
        return rows.join(groups, key)
    return rows.join(F.broadcast(common), key).unionByName(rows.join(F.broadcast(common.select(key)), key, "left_anti").join(others, key))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run: those with the smallest hash of ``key``.

    A hash threshold sized from the count leaves about 1.2 times ``rows`` before the exact top-k,
    so the sort only sees a bounded number of candidates per task.
    """
    n, h = df.count(), free_name("__h", df)
    hashed = df.withColumn(h, F.xxhash64(key, F.lit("sample")))
    if n > rows:
        share = min(1.0, 1.2 * rows / n + 10.0 / n)
        hashed = hashed.where(F.col(h) < F.lit(int(-(2**63) + share * (2**64 - 1))))
        hashed = hashed.orderBy(h).limit(rows)
    return hashed.drop(h)


def fitting_rows(texts: DataFrame, marks: DataFrame | None, rows: int, chars: int) -> pd.DataFrame:
    """The bounded sample that a model is fitted on: whole rows of ``texts`` (id, text, ...) whose id is in ``marks`` (id, ...), or of any id.

    At most ``rows`` ids, the same ones on every run (least hash first), and of these as many as hold ``chars`` characters
    in all; ids whose rows are longer than what is left are passed over. Null ids and texts teach nothing.
    """
    known = texts.where("id IS NOT NULL AND text IS NOT NULL")
    # lengths, not texts, are shuffled; written first, so that no plan moves the texts below the length
    sizes = materialise(known.select("id", F.length("text").cast("long").alias("n")).groupBy("id").agg(F.sum("n").alias("n")), "fitting-sizes")
    sizes = sizes if marks is None else sizes.join(marks.select("id").distinct(), "id", "left_semi")
    listed = bounded_sample(sizes, F.col("id"), rows).select("id", "n", F.xxhash64("id", F.lit("sample")).alias("h")).toPandas().sort_values("h", kind="stable")
    chosen, left = [], chars
    for i, n in zip(listed["id"], listed["n"], strict=True):
        if n <= left:
            chosen.append((i,))
            left -= int(n)
    kind = next(f.dataType for f in texts.schema if f.name == "id")
    picked = texts.sparkSession.createDataFrame(chosen, StructType([StructField("id", kind)]))
    out = known.join(F.broadcast(picked), "id")
    return (out if marks is None else out.join(F.broadcast(marks.join(F.broadcast(picked), "id", "left_semi")), "id")).toPandas()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last coefficient is the intercept, which goes unpenalised."""
    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    if not len(x):
        return beta
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
