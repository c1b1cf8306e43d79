"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Pieces of one length are alike, so the packing needs only how many there are of each length. The driver
runs best-fit decreasing over that histogram (at most ``capacity`` lengths): open bins are kept by
remaining capacity in a segment tree, which finds the tightest bin that still fits in logarithmic time;
bins with one history stay together as a range of sequence numbers, so a length with a billion pieces
costs as much as one with ten. The outcome is a list of rank ranges per length; each piece looks its
rank up in it. Ranks come from bounded groups and prefix sums, so no length, however common, meets in
one task.

Defined cases: a null or empty text is the end id alone; repeated documents are packed once each; pieces of equal
length are ranked by a hash of document, piece and ids, and of bins with equal room the last opened is filled first;
texts of any length are encoded whole and cut; a null id is kept; an empty table packs to no rows; further columns of
``docs`` may have any name and are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .tokens import END_ID, default_tokenizer, encoder

CAPACITY = 1024
#: Pieces ranked by one window group.
GROUP_ROWS = 2_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


class TightestFit:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins that have that much left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, left: int, bins: int) -> None:
        node = left + self.leaves
        while node:
            self.sums[node] += bins
            node >>= 1

    def at_least(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that some open bin has."""
        node = need + self.leaves
        if self.sums[node]:
            return need
        while node > 1:
            if not node & 1 and self.sums[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.sums[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: (length, first rank, pieces, first sequence, offset).

    The pieces of such a run take consecutive sequences, one each, at the same offset.
    """
    tree = TightestFit(capacity)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges (first sequence, bins)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                # each new bin takes as many of this length as fit before the next one opens
                each = capacity // length
                full, rest = divmod(left, each)
                for bins, take in ((full, each), (1 if rest else 0, rest)):
                    for k in range(take if bins else 0):
                        out.append((length, rank, bins, sequences, k * length))
                        rank += bins
                    if bins:
                        remaining = capacity - take * length
                        open_bins[remaining].append((sequences, bins))
                        tree.add(remaining, bins)
                        sequences += bins
                left = 0
                continue
            first, bins = open_bins[room].pop()
            # a bin that can hold more of this length is the tightest again after each piece, so it fills up first
            each = room // length
            take = min(bins, left // each)
            if not take:
                take, each = 1, left
            for k in range(each):
                out.append((length, rank, take, first, capacity - room + k * length))
                rank += take
            left -= take * each
            tree.add(room, -take)
            tree.add(room - each * length, take)
            open_bins[room - each * length].append((first, take))
            if take < bins:
                open_bins[room].append((first + take, bins - take))
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and cut: only documents over ``capacity`` are cut, the first piece takes what is left over."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text if isinstance(text, str) else None
                ids = tool.encode(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                tie = zlib.crc32(ids)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), tie))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(task, PIECE_SCHEMA)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, tie)."""
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    starts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in made:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    for length, runs in by_length.items():
        starts[length] = tuple(np.asarray(x, "int64") for x in zip(*sorted(runs), strict=True))
    lookup = spark.sparkContext.broadcast(starts)  # bounded by the lengths and capacities, not by the documents

    groups = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-c // GROUP_ROWS))]) if counts else F.create_map(F.lit(0), F.lit(1)).cast("map<bigint,int>")
    keyed = cut.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.element_at(groups.cast("map<bigint,bigint>"), F.col("length"))))
    sizes = keyed.groupBy("length", "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__g").orderBy("doc_id", "piece", "tie")
    ranked = keyed.withColumn("__r", F.row_number().over(inside) - 1).join(bases, ["length", "__g"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        of, at = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(of), "int64"), np.zeros(len(of), "int64")
        for n in np.unique(of):
            own = of == n
            ranks, first, offs = lookup.value[int(n)]
            k = np.searchsorted(ranks, at[own], "right") - 1
            sequence[own] = first[k] + at[own] - ranks[k]
            offset[own] = offs[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__p", place("length", (F.col("__base") + F.col("__r")).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__p.sequence_id").alias("sequence_id"), F.col("__p.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, **options), capacity)
