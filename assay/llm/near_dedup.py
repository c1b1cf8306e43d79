"""Near-duplicate detection by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct w-word shingles. Its signature has k minima cut to 16 bits. Signatures
are split into m chunks of ``CHUNK`` minima; two signatures that differ in at most d = 2m - 1 places agree
in some chunk but for one minimum (pigeonhole), so each chunk is listed once for each minimum left out:
documents that share such a key are compared, and go on where their signatures differ in at most ``most``
places. Both numbers follow from the threshold: a pair right on it shares no key, or differs in more places,
with a chance of at most ``MISS`` altogether. ``most`` is above d (24 of 60 at 0.85, 37 of 78 at 0.8): up to d
places a shared key is certain, beyond it likely.

The join never expands groups into pairs:

1. Equal sets collapse to their smallest document id (a partial aggregate).
2. Only keys that two sets share go on. Within a key, signatures are compared breadth-first and only a
   spanning forest of the near ones comes out.
3. The forest's components are candidate groups: no link leads out of one. Only their documents' texts
   are read again, and links are confirmed on the full sets, again breadth-first.

A key, or candidate group, of more than ``BLOCK`` sets is dealt out in blocks, each joined by the same few
``PIVOTS``. Near copies of one text come together there, through the pivots. Only sets that are then still apart
from the group's largest class meet all blocks, so no link is missed and a task holds a bounded part of a group.
Keys and prints that many rows share are joined by broadcasts of a bounded number of such keys, never in one task.

Defined cases: letters A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer words than w make one
shingle; no words or null text make the empty set, which is linked with nothing; a null id is no document's
partner; rows that repeat an id with the same text are one node, and with differing texts share a component; of
equal sets the smallest id is kept; texts of any length are read whole; further columns of ``docs`` may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_hot, join_hot, materialise, small_batches
from .components import connected_components

CHUNK = 6
MISS = 1e-6
#: Sets, and shingles, of one block of a shared key or of a candidate group.
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
#: Sets of a large group that all its blocks hold.
PIVOTS = 16
#: Candidate documents up to which their ids are broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words whose hashes a worker keeps.
CACHE_WORDS = 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and exactly the six white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        out = np.full(n, len(words) if len(words) < width else width, np.uint64)
        for k in range(min(width, len(h))):
            out = _mixed(out * _M2 + h[k : k + n])
    return np.unique(out)


def chunks_for(threshold: float) -> int:
    """Chunks so that a pair of this similarity shares no key with a chance of at most MISS."""
    alike = threshold**CHUNK + CHUNK * (1 - threshold) * threshold ** (CHUNK - 1)
    return max(2, math.ceil(math.log(MISS) / math.log(1 - alike)))


def most_apart(threshold: float, m: int) -> int:
    """Least distance of 6m minima so that a pair of this similarity shares no key or lies farther apart with a chance of at most MISS."""
    k, alike = m * CHUNK, threshold**CHUNK + CHUNK * (1 - threshold) * threshold ** (CHUNK - 1)
    left = MISS - (1 - alike) ** m
    beyond = 0.0
    for d in range(k, 0, -1):
        beyond += math.comb(k, d) * (1 - threshold) ** d * threshold ** (k - d)
        if beyond > left:
            return d
    return 0


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """k minima cut to 16 bits."""
    out = np.full(len(multipliers), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (multipliers[:, None] * shingles[None, at : at + 2048]).min(axis=1), out=out)
        return ((out * _M2) >> np.uint64(48)).astype(np.uint16)


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, m * CHUNK) signed 64-bit keys: each chunk with each of its minima left out, salted by both numbers."""
    n, k = signatures.shape
    out = []
    wide = signatures.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c in range(k // CHUNK):
            for gone in range(CHUNK):
                key = np.full(n, c * CHUNK + gone + 1, np.uint64)
                for j in range(CHUNK):
                    if j != gone:
                        key = _mixed(key * _M2 + wide[:, c * CHUNK + j])
                out.append(key)
    return np.stack(out, axis=1).view(np.int64) if out else np.empty((n, 0), np.int64)


def _spread(first: int, n: int, near) -> list[tuple[int, int]]:
    """Breadth-first forest over 0..n-1: near(i, candidates) says which of the not yet reached ones i reaches."""
    rest, edges = np.arange(n), []
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            hit = near(at, rest)
            found = rest[hit]
            if len(found):
                edges += [(root, int(x)) for x in found]
                queue += found.tolist()
                rest = rest[~hit]
    return edges


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups, many at a time, from batches sorted by ``by``; only an unfinished group is carried on."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[by].iloc[-1].to_numpy()
        same = (batch[by].to_numpy() == last).all(axis=1)
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True) if held else batch.iloc[:cut]
            held = [batch.iloc[cut:]]
        else:
            if held and (held[-1][by].iloc[-1].to_numpy() != last).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _bounds(frame: pd.DataFrame, by: list[str]) -> list[int]:
    keys = frame[by].to_numpy()
    return [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(frame)]


def _in_groups(rows: DataFrame, large: DataFrame, payload: str, forest: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Classes (node, component) of the links within groups.

    ``rows``: group, blocks and n (sets) of it, id, weight (in blocks) and the payload; ``large``: group, blocks of
    those with several; ``forest`` turns rows sorted by (group, at) into links (a, b) among those alike in both.
    """

    def linked(dealt: DataFrame) -> DataFrame:
        return dealt.select("group", "at", "id", payload).repartition("group", "at").sortWithinPartitions("group", "at").mapInPandas(forest, "a long, b long")

    several = F.col("blocks") > 1
    block = lambda of: F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(of, F.lit(1))).cast("int")
    share = F.least(PIVOTS / F.col("n"), 0.25 / F.col("blocks"))
    pivot = several & (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
    places = F.when(pivot, F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(block(F.col("blocks"))))
    classes = connected_components(linked(rows.withColumn("at", F.explode(places))))
    if large.isEmpty():
        return classes
    big = rows.where(several)
    labels = big.select("group", "id", "weight").join(classes.withColumnRenamed("node", "id"), "id", "left").select("group", "id", "weight", F.coalesce("component", "id").alias("label"))
    labels = materialise(labels, "labels")
    total = labels.count()
    tops = labels.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    tops = materialise(tops, "tops")
    apart = materialise(join_hot(labels, tops, "group", total).where("label <> top").select("group", "id", "weight"), "apart")
    if apart.isEmpty():
        return classes
    # place chunk * of + block holds the block's sets and the chunk's strays
    chunks = apart.groupBy("group").agg(F.greatest(F.ceil(F.sum("weight")), F.lit(1)).cast("int").alias("chunks"))
    chunks = materialise(chunks.join(tops, "group").join(large.withColumnRenamed("blocks", "of"), "group").select("group", "n", "chunks", "of"), "chunks")
    members = join_hot(big.select("group", "id", payload), chunks, "group", total)
    strays = members.join(apart.select("group", "id").distinct(), ["group", "id"], "left_semi")
    home, own = block(F.col("of")), F.pmod(F.xxhash64("id", F.lit(13)), F.col("chunks")).cast("int")
    every = members.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c * F.col("of") + home)))
    guests = strays.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda b: own * F.col("of") + b))).where(F.col("at") % F.col("of") != home)
    return connected_components(classes.select("node", "component").union(linked(every.union(guests))).toDF("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    small_batches(spark)
    m = chunks_for(percent / 100)
    k, most = m * CHUNK, most_apart(percent / 100, m)
    multipliers = _multipliers(k)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sizes, prints, signed = [], [], []
            for text in batch["text"]:
                s = shingle_hashes(text if isinstance(text, str) else None, width, hashes)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    prints.append(np.array([_mixed(s * _M2).sum(), np.bitwise_xor.reduce(_mixed(s + _M1)) if len(s) else 0], np.uint64).tobytes() if len(s) else None)
                signed.append(signature(s, multipliers).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": sizes, "print": prints, "signature": signed})

    made = materialise(texts.mapInPandas(features, "doc_id long, n_shingles long, print binary, signature binary"), "near-features")
    usable = made.where("print IS NOT NULL AND doc_id IS NOT NULL")
    same = usable.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    sets = materialise(same, "near-sets")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                signatures = np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(-1, k)
                listed = signature_keys(signatures)
                yield pd.DataFrame({"key": listed.ravel(), "id": np.repeat(batch["id"].to_numpy("int64"), listed.shape[1])})

    listed = materialise(sets.select("id", "signature").mapInPandas(keys, "key long, id long"), "near-keys")
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "near-shared")
    members = materialise(join_hot(listed, shared, "key", listed.count()).withColumnRenamed("key", "group"), "near-members")
    rows = members.join(sets.select("id", "signature"), "id").withColumn("weight", F.lit(1 / BLOCK))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["group", "at"]
        seen: set[tuple[int, int]] = set()
        for frame in _groups(batches, by):
            ids = frame["id"].to_numpy("int64")
            signatures = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, k)
            bounds = _bounds(frame, by)
            edges: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = signatures[a:b]
                if b - a == 2:
                    found = [(0, 1)] if (own[0] != own[1]).sum() <= most else []
                else:
                    found = _spread(0, b - a, lambda i, rest, own=own: (own[rest] != own[i]).sum(axis=1) <= most)
                edges += [(int(ids[a + x]), int(ids[a + y])) for x, y in found]
            fresh = list({e for e in edges if e not in seen})
            if len(seen) > 500_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                yield pd.DataFrame(fresh, columns=["a", "b"])

    grouped = _in_groups(rows, shared.where("blocks > 1").select(F.col("key").alias("group"), "blocks"), "signature", candidates)

    sized = grouped.join(sets.select(F.col("id").alias("node"), "n_shingles"), "node")
    sized = materialise(sized.withColumn("weight", F.col("n_shingles") / BLOCK_SHINGLES + 1 / BLOCK), "near-grouped")
    weights = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("weight")).cast("int").alias("blocks"))
    weights = materialise(weights, "near-weights")
    n_sized = sized.count()
    suspects = join_hot(sized, weights, "component", n_sized).select(F.col("component").alias("group"), "blocks", "n", "weight", F.col("node").alias("id"))
    suspects = materialise(suspects, "near-suspects")
    few = n_sized <= BROADCAST_ROWS
    rows = texts.withColumnRenamed("doc_id", "id").join(F.broadcast(suspects) if few else suspects, "id")

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["group", "at"]
        hashes = WordHashes()
        for frame in _groups(_shingled(batches, width, hashes), by):
            ids, shingles = frame["id"].to_numpy("int64"), frame["shingles"].tolist()
            bounds = _bounds(frame, by)
            edges = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                edges += [(int(ids[a + x]), int(ids[a + y])) for x, y in _linked(shingles[a:b], percent)]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    linked = _in_groups(rows, weights.where("blocks > 1").select(F.col("component").alias("group"), "blocks"), "text", confirmed)

    # only repeated or linked sets need a look-up; others, and empty ones, are their own class
    classes = sets.join(linked.withColumnRenamed("node", "id"), "id", "left").where("component IS NOT NULL OR n > 1")
    classes = materialise(classes.select("print", "n", F.coalesce("component", "id").alias("component_id")), "near-classes")
    total, full = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], made.where("print IS NOT NULL AND doc_id IS NOT NULL")
    found = join_hot(full, classes, "print", total).select("doc_id", "n_shingles", "component_id")
    hot = classes.where(is_hot(total)).select("print")
    alone = full.join(F.broadcast(hot), "print", "left_anti").join(classes.select("print"), "print", "left_anti")
    alone = alone.unionByName(made.where("print IS NULL OR doc_id IS NULL")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _shingled(batches: Iterator[pd.DataFrame], width: int, hashes: WordHashes) -> Iterator[pd.DataFrame]:
    """Texts give way to their shingle hashes as they come in."""
    for batch in batches:
        batch = batch.assign(shingles=[shingle_hashes(t if isinstance(t, str) else None, width, hashes) for t in batch["text"]])
        yield batch.drop(columns="text")


def _linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the exact links among sets of shingle hashes."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both and 100 * both >= percent * (sizes.sum() - both) else []
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)
        own = rest[fits]
        if not len(own) or not sizes[i]:
            return np.zeros(len(rest), bool)
        values = np.concatenate([flat[starts[j] : starts[j + 1]] for j in own.tolist()])
        at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[own])[:-1]]))
        hit = np.zeros(len(rest), bool)
        hit[fits] = 100 * both >= percent * (sizes[own] + sizes[i] - both)
        return hit

    return _spread(0, len(sets), near)


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns; rows without an id stay."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    gone = materialise(found.where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "near-gone")
    few = gone.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(F.broadcast(gone) if few else gone, "id", "left_anti").select("row.*")


#: The query of width 3 and 85 percent as SQL over ``documents`` (ids are distinct there).
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN edges ON b = x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""
