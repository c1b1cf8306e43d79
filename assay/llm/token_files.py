"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped for reading.

A data set is a folder of shards. Shard ``k`` holds ``k.ids`` (little-endian unsigned ids, 16 or 32 bits
wide), ``k.off`` (n + 1 signed 64-bit offsets, in ids, within the shard) and ``k.doc`` (the n document
ids, signed 64-bit). Documents stand in ascending id order, so shards are ranges of ids; the place of a
shard in the whole is the prefix sum of the shards before it.

Documents are encoded where they lie, and only their ids, not the texts, are dealt by range. The ranges come from a
bounded sample of document ids weighted by text bytes (it steers sizes, never which rows are written); an id that
fills several ranges is cut at even steps of its documents' crc32.

Defined cases: null text is empty and has the end id alone; a null document id sorts first and is read
back as null; repeated ids stand side by side in the order of their ids' crc32, and one id's documents are dealt
over several shards where there are many; texts of any length are read whole; an empty table makes no shard; ids that
the width does not hold, by the vocabulary's largest id or the end id, are refused; further columns may have any name.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches
from .tokens import END_ID, default_tokenizer, encoder

NULL_ID = -(2**63)
#: Text bytes meant for one shard, the most shards, and the rows of the sample that the ranges come from.
SHARD_BYTES, MOST_SHARDS, SAMPLE_ROWS = 16 << 20, 10_000, 100_000
SHARD_SCHEMA = "shard string, n_docs long, n_ids long, first_id long, first_tie long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@dataclass(frozen=True)
class TokenSet:
    """A written set: its folder, id width in bytes, and per shard (name, documents, ids, base)."""

    folder: str
    width: int
    shards: list[tuple[str, int, int, int]]

    @property
    def n_ids(self) -> int:
        return sum(s[2] for s in self.shards)


def cuts(pairs: DataFrame, partitions: int | None = None) -> list[tuple[int, int]]:
    """Where each shard but the first begins, as (document id, crc32 of its ids), in ascending order."""
    n = pairs.count()
    share = min(1.0, 1.1 * SAMPLE_ROWS / max(n, 1))
    sized = pairs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    found = (sized.sample(share, seed=0) if share < 1 else sized).toPandas().sort_values("doc_id", kind="stable")
    total = found["size"].cumsum().to_numpy()
    if not len(total):
        return []
    shards = partitions or int(np.clip(-(-total[-1] / share // SHARD_BYTES), 1, MOST_SHARDS))
    # the sampled row that holds each even step of all bytes begins a shard
    ids = found["doc_id"].to_numpy()[np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)]
    out = []
    for doc_id, times in zip(*np.unique(ids, return_counts=True), strict=True):
        out += [(int(doc_id), step * 2**32 // (int(times) + 1)) for step in range(1, int(times) + 1)]
    return out


def shard_of(begins: list[tuple[int, int]], doc_id: int, tie: int) -> int:
    """The shard of a document: how many of ``begins`` do not lie after it."""
    return bisect.bisect_right(begins, (doc_id, tie))


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, width: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> TokenSet:
    """Encode ``docs`` and write them below ``folder``, a place that all executors reach.

    A task writes files of a name of its own, and only the names that successful tasks return count, so a
    lost executor or a second attempt leaves at most files that nobody reads.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    kind = {2: "<u2", 4: "<u4"}[width]
    highest = max(encoder(path).highest, end_id)
    if highest >= 1 << (8 * width):
        raise ValueError(f"ids up to {highest} do not fit in {width} bytes; take width=4")
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    begins = cuts(pairs, partitions)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            flat = [tool.encode(t if isinstance(t, str) else None) + end for t in batch["text"]]
            ties = [zlib.crc32(x) for x in flat]
            shard = [shard_of(begins, NULL_ID if pd.isna(d) else int(d), t) for d, t in zip(batch["doc_id"], ties, strict=True)]
            yield pd.DataFrame({"shard": shard, "doc_id": batch["doc_id"].astype("Int64"), "tie": ties, "ids": [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in flat]})

    made = pairs.mapInPandas(encoded, "shard int, doc_id long, tie long, ids binary")
    ranged = made.repartitionById(len(begins) + 1, "shard").drop("shard")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(folder)
        name = uuid.uuid4().hex
        out, lengths, ids, ties = None, [], [], []
        for batch in batches:
            for doc_id, tie, flat in zip(batch["doc_id"], batch["tie"], batch["ids"], strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}.ids", buffer_size=1 << 20)
                out.write(flat)
                lengths.append(len(flat) // width)
                ids.append(NULL_ID if pd.isna(doc_id) else int(doc_id))
                ties.append(int(tie))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        for ending, values in (("off", offsets), ("doc", np.asarray(ids, "<i8"))):
            with system.open_output_stream(f"{root}/{name}.{ending}") as side:
                side.write(values.tobytes())
        yield pd.DataFrame({"shard": [name], "n_docs": [len(ids)], "n_ids": [int(offsets[-1])], "first_id": [ids[0]], "first_tie": [ties[0]]})

    made = ranged.sortWithinPartitions("doc_id", "tie").mapInPandas(task, SHARD_SCHEMA).collect()  # a row per shard
    shards, base = [], 0
    for row in sorted(made, key=lambda r: (r.first_id, r.first_tie)):
        shards.append((row.shard, row.n_docs, row.n_ids, base))
        base += row.n_ids
    return TokenSet(folder, width, shards)


def open_shard(folder: str, name: str, width: int):
    """(ids, offsets, document ids) of a shard: memory maps on a local file system, else read once."""
    system, root = _files(folder)
    kinds = {"ids": {2: "<u2", 4: "<u4"}[width], "off": "<i8", "doc": "<i8"}
    if system.type_name == "local":
        return tuple(np.memmap(f"{root}/{name}.{k}", v, "r") for k, v in kinds.items() if os.path.getsize(f"{root}/{name}.{k}"))
    out = []
    for k, v in kinds.items():
        with system.open_input_file(f"{root}/{name}.{k}") as f:
            out.append(np.frombuffer(f.read(), v))
    return tuple(out)


def read(spark: SparkSession, tokens: TokenSet) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    folder, width = tokens.folder, tokens.width

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["shard"], batch["base"], strict=True):
                ids, offsets, docs = open_shard(folder, name, width)
                for at in range(0, len(docs), 4096):
                    cut = offsets[at : at + 4097]
                    own = docs[at : at + 4096]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array([None if d == NULL_ID else d for d in own.tolist()], "Int64"), "start": cut[:-1] + base, "n_tokens": np.diff(cut), "ids_crc32": np.asarray(crcs, "int64")})

    listed = spark.createDataFrame([(s[0], s[3]) for s in tokens.shards], "shard string, base long")
    return listed.repartition(max(1, len(tokens.shards)), "shard").mapInPandas(task, READ_SCHEMA)


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` into the session's shared folder and read the digest of every document back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "tokens"), **options))
