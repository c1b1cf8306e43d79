"""Benchmark decontamination: a prefix-filtered join of document shingles with item windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``WINDOW`` consecutive
words of an item; an item of fewer words, but not none, is one window. A window's tokens are its
``GRAM``-word shingles (a shorter window is its own), ordered by how rare they are in all documents.
To hold the window in full a document must hold each of its tokens, so the necessary prefix is the rarest
one: only that is joined. The place of the token inside the window and the document's length bound where
the window could stand (position and length filters); a match is verified word by word, in place.

Items come in blocks of bounded size, each of which is broadcast; every document is held against every
block, and its hits are merged by document where there is more than one block.

Defined cases: null or empty texts have no words and are never contaminated; null or wordless items match
nothing; a null item id counts as the empty string; repeated items count once per distinct id; repeated
documents give a row each (with several blocks, rows alike in id and text share one result); texts of any length
are read whole; a hit on exactly a 20th of the words contaminates; further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .words import gram_hashes, word_hashes

WINDOW = 13
GRAM = 3
#: Windows of one block of items: what a worker holds, and the bound of a broadcast.
BLOCK_WINDOWS = 400_000

#: Bytes of texts hashed at once.
PART_BYTES = 1 << 19

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BETWEEN = np.arange(256) == 32


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def _grams(words: list[bytes], n: int) -> np.ndarray:
    return gram_hashes(word_hashes(b" ".join(words), _BETWEEN)[2], n)


class Words:
    """The words of some texts in one buffer: bounds and hashes of all words, and where each text's begin."""

    def __init__(self, texts: list[str | None]):
        own = [(t or "").encode("utf-8", "surrogatepass").translate(_KEEP) for t in texts]
        self.buffer = b" ".join(own)
        self.starts, self.ends, self.hashes = word_hashes(self.buffer, _BETWEEN)
        ends = np.cumsum([len(o) + 1 for o in own]) - 1
        self.upto = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)

    def grams(self, n: int) -> np.ndarray:
        return gram_hashes(self.hashes, n)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that each word position belongs to."""
        return np.searchsorted(self.upto, at, "right") - 1

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]


def parted(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, a bounded number of bytes at a time (a longer text by itself)."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class Windows:
    """The distinct windows of a block of items, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add("" if item_id is None else str(item_id))
        self.words = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.words]
        self.tokens = [_grams(list(w), min(GRAM, len(w))) for w in self.words]
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})

    def token_list(self) -> np.ndarray:
        return np.unique(np.concatenate(self.tokens)) if self.tokens else np.empty(0, np.uint64)

    def index(self, seen: dict[int, int]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(sorted prefix tokens, for each the windows and the token's place in them)."""
        places: dict[int, list[tuple[int, int]]] = {}
        for w, tokens in enumerate(self.tokens):
            rarity = [(seen.get(t, 0), t) for t in tokens.tolist()]
            at = min(range(len(rarity)), key=rarity.__getitem__)
            places.setdefault(rarity[at][1], []).append((w, at))
        order = sorted(places)
        return np.asarray(order, np.uint64), [places[t] for t in order]


def _present(tokens: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``tokens`` that stand in the sorted ``listed``, and where there."""
    if not len(listed) or not len(tokens):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    hit = np.flatnonzero(listed[at] == tokens)
    return hit, at[hit]


def _token_counts(texts: DataFrame, listed: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each token of the items stands in all documents: a sum per task, then over tasks."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((listed, sizes))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, grams = shared.value
        counts = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in parted([t if isinstance(t, str) else None for t in batch["text"]]):
                words = Words(part)
                for n in grams:
                    hit, at = _present(words.grams(n), tokens)
                    inside = words.text_of(hit) == words.text_of(hit + n - 1)
                    counts += np.bincount(at[inside], minlength=len(tokens))
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"token": tokens[some].view(np.int64), "n": counts[some]})

    summed = texts.select("text").mapInPandas(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"] % 2**64: r["n"] for r in summed.collect()}  # at most the tokens of one block of items


def find_spans(words: Words, windows: Windows, prefix: np.ndarray, places: list[list[tuple[int, int]]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per text all occurrences of windows: word spans in the buffer, and the ids of the items they belong to."""
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in range(len(words.upto) - 1)]
    for n in windows.sizes:
        positions, at = _present(words.grams(n), prefix)
        owners = words.text_of(positions)
        for p, k, t in zip(positions.tolist(), at.tolist(), owners.tolist(), strict=True):
            low, high = words.upto[t], words.upto[t + 1]
            for w, place in places[k]:
                own, start = windows.words[w], p - place
                # position and length bounds, then word by word
                if start >= low and start + len(own) <= high and all(words.word(start + j) == x for j, x in enumerate(own)):
                    out[t][0].append((start, start + len(own)))
                    out[t][1].update(windows.owners[w])
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, int, str, bool]:
    n_hit = covered(spans)
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items as they come, a block of bounded windows at a time: the driver never holds more than one."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct().toLocalIterator():
        block.append((row["i"], row["t"]))
        size += max(1, (row["t"] or "").count(" ") - window + 2)
        if size >= block_windows:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``carry`` instead the rows of ``docs`` that are not contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    blocks = []
    for block in item_blocks(items, item_col, item_text_col, window, block_windows):
        windows = Windows(block, window)
        counts = _token_counts(texts, windows.token_list(), windows.sizes)
        blocks.append(spark.sparkContext.broadcast((windows, *windows.index(counts))))
    if len(blocks) <= 1:
        only = blocks[0] if blocks else None

        @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
        def judge(column: pd.Series) -> pd.DataFrame:
            rows = []
            for part in parted([t if isinstance(t, str) else None for t in column]):
                words = Words(part)
                found = find_spans(words, *only.value) if only else [([], set())] * len(part)
                rows += [_verdict(int(n), *f) for n, f in zip(np.diff(words.upto), found, strict=True)]
            return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        if carry:
            return docs.where(~judge(F.col(text_col).cast("string"))["contaminated"])
        judged = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col).cast("string")).alias("j"))
        return judged.select("doc_id", "j.*")
    return _by_blocks(docs, blocks, id_col, text_col, carry)


def _spotter(block):
    """A pandas UDF from text to its words, spans (flat) and items in one block."""

    @F.pandas_udf("n long, spans array<bigint>, items array<string>")
    def spot(column: pd.Series) -> pd.DataFrame:
        rows = []
        for part in parted([t if isinstance(t, str) else None for t in column]):
            words = Words(part)
            found = find_spans(words, *block.value)
            rows += [(int(n), [x - int(at) for s in spans for x in s], sorted(items)) for n, at, (spans, items) in zip(np.diff(words.upto), words.upto, found, strict=False)]
        return pd.DataFrame(rows, columns=["n", "spans", "items"])

    return spot


def _by_blocks(docs: DataFrame, blocks: list, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Each block finds its spans on its own; they are merged by document (id and text, as a digest)."""
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.coalesce(F.col(text_col).cast("string"), F.lit("\x01"))), 256)
    keyed = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("row")] if carry else []))
    found = None
    for block in blocks:
        part = keyed.select("key", _spotter(block)("text").alias("s")).select("key", "s.*").dropDuplicates(["key"])  # spans are shuffled, not texts
        part = materialise(part, "spans")  # one broadcast at a time is in use
        found = part if found is None else found.union(part)

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    def judge(n: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = [_verdict(int(a), list(zip(b[::2], b[1::2], strict=True)), set(c)) for a, b, c in zip(n, spans, items, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    merged = found.groupBy("key").agg(F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    judged = merged.select("key", judge("n", "spans", "items").alias("j")).select("key", "j.*")
    if carry:
        return keyed.select("key", "row").join(judged.where("contaminated").select("key"), "key", "left_anti").select("row.*")
    return keyed.select("key", "doc_id").join(judged, "key").drop("key")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return contamination(docs, items, carry=True, **options)


#: The query as SQL over ``documents`` and ``benchmark`` (document ids are distinct there).
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)
), hits AS (
  SELECT doc_id, grams.l, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.l = windows.l
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, l, i FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""
