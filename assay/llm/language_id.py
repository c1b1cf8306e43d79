"""Language identification by cross-parsing entropy.

For each language a suffix automaton of bounded labelled text is built. A text is parsed by it into
longest matches: a phrase runs on while the automaton holds it and a new one starts where it fails.
The language that needs the fewest phrases, normalised by text length and training length, wins.

Parsing needs forward moves only, so an automaton becomes a table (state, letter) -> state; it is kept sparse, so
that many languages can be held. Texts are cut into segments of ``SEGMENT``
letters, each parsed on its own, and all segments of a batch move through the table in step, as one array: whole
texts, no per-letter Python.

Letters are lower-cased; everything else is a space, and runs of spaces are one. The ``OWN_CODES`` most
frequent letters of the training text have a code each, all others share ``SHARED_CODES``.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is every text if nothing is
labelled. Ties go to the language that sorts first. Repeated rows are predicted alike. Texts of any length are parsed
whole; a language is learned from at most ``TRAIN_LETTERS`` letters, ``TRAIN_ROWS`` documents, and documents of up to
``TRAIN_CHARS`` characters where there are any. Further columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, small_batches

#: Training text of a language: at most this many letters, from at most so many documents of at most so many characters.
TRAIN_LETTERS = 40_000
TRAIN_ROWS = 200
TRAIN_CHARS = 20_000
SEGMENT = 512
SLOTS = 2
OWN_CODES, SHARED_CODES = 90, 16
UNKNOWN = "und"


class Letters:
    """Code points to codes: 0 is the space, 1.. the frequent letters, then the shared codes."""

    def __init__(self, texts: list[str]):
        seen: Counter[str] = Counter()
        for t in texts:
            seen.update(t.lower())
        own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:OWN_CODES]
        self.size = 1 + OWN_CODES + SHARED_CODES
        self.table = np.zeros(0x10000, np.uint8)
        self.low = {}
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                self.table[c] = 1 + OWN_CODES + ord(ch.lower()[0]) % SHARED_CODES
        for k, ch in enumerate(own):
            for form in {ch, ch.upper()}:
                if len(form) == 1 and ord(form) < len(self.table):
                    self.table[ord(form)] = k + 1

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.where(points < 0x10000, self.table[np.minimum(points, 0xFFFF)], (1 + OWN_CODES + points % SHARED_CODES).astype(np.uint8))
        space = out == 0
        keep = ~space
        keep[1:] |= ~space[:-1]
        return out[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    following, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


class Moves:
    """The automaton's moves, nearly as sparse as itself: up to ``SLOTS`` moves of a state as (letter, next state), of the few others a row each.

    A suffix automaton of n letters has less than 2n states and 3n moves, so a language's tables grow with its
    training text alone. Where a state lacks a letter, a phrase ends and the start's moves hold; a letter that the
    start lacks too leads to one more state, which has no moves.
    """

    def __init__(self, following: list[dict[int, int]], size: int):
        states = len(following) + 1
        wide = [s for s, moves in enumerate(following) if len(moves) > SLOTS]
        self.size = size
        self.letters = np.full((SLOTS, states), 255, np.uint8)
        self.nexts = np.zeros((SLOTS, states), np.int32)
        self.row = np.zeros(states, np.int32)  # row 0 has no moves
        self.rows = np.full((len(wide) + 1, size), -1, np.int32)
        self.begin = np.full(size, states - 1, np.int32)
        for c, t in following[0].items():
            self.begin[c] = t
        for k, s in enumerate(wide):
            self.row[s] = k + 1
            for c, t in following[s].items():
                self.rows[k + 1, c] = t
        for s, moves in enumerate(following):
            if len(moves) <= SLOTS:
                for j, (c, t) in enumerate(moves.items()):
                    self.letters[j, s], self.nexts[j, s] = c, t
        self.rows = self.rows.ravel()

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase ended before the letter."""
        to = self.rows[self.row[state] * self.size + letter]
        for letters, nexts in zip(self.letters, self.nexts, strict=True):
            to = np.where(letters[state] == letter, nexts[state], to)
        ended = to < 0
        return np.where(ended, self.begin[letter], to), ended


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        self.letters = Letters([t for n in self.names for t in texts[n]])
        self.tables: list[Moves] = []
        self.norm: list[float] = []
        for n in self.names:
            codes = np.concatenate([self.letters.codes(t + " ") for t in texts[n]])[:TRAIN_LETTERS]
            self.tables.append(Moves(suffix_automaton(codes.tolist()), self.letters.size))
            self.norm.append(math.log2(len(codes) + 2))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text, all segments of all texts in step."""
        counts = [max(1, -(-len(t) // SEGMENT)) for t in texts]
        total = sum(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        grid = np.zeros((total, SEGMENT), np.uint8)
        lengths, at = np.zeros(total, np.int64), 0
        for t, n in zip(texts, counts, strict=True):
            flat = grid[at : at + n].reshape(-1)
            flat[: len(t)] = t
            lengths[at : at + n] = np.clip(len(t) - SEGMENT * np.arange(n), 0, SEGMENT)
            at += n
        order = np.argsort(-lengths, kind="stable")
        steps = np.ascontiguousarray(grid[order].T).astype(np.int32)
        active = np.searchsorted(-lengths[order], -np.arange(SEGMENT), "left")
        out = np.zeros((len(texts), len(self.names)))
        for k, moves in enumerate(self.tables):
            state, ends = np.zeros(total, np.int32), np.zeros(total, np.int32)
            for i in range(SEGMENT):
                n = active[i]
                if not n:
                    break
                state[:n], ended = moves.step(state[:n], steps[i, :n])
                if i:
                    ends[:n] += ended
            ends += lengths[order] > 0
            out[:, k] = np.bincount(owner[order], ends, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.letters.codes(t) if t else np.empty(0, np.uint8) for t in texts]
        known = [i for i, c in enumerate(codes) if self.names and len(c) and c.any()]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            lengths = np.array([len(codes[i]) for i in known], float)
            entropy = self.phrases([codes[i] for i in known]) * np.asarray(self.norm) / lengths[:, None]
            best = entropy.argmin(1)
            # likelihoods of whole short texts, tempered so that long ones do not all round to 1
            weight = np.minimum(lengths, 40.0)[:, None] * (entropy - entropy.min(1, keepdims=True))
            share = 1 / np.exp2(-weight).sum(1)
            for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = self.names[b], float(min(1.0, s))
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2) -> LanguageModel:
    """Learn from the documents with a language whose crc32(id as text) mod 4 is not ``held_out``."""
    marked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_of_id(F.col(id_col)) % 4 != held_out))
    text = F.col(text_col).cast("string")
    marked = marked.where(F.length(text) > 0).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), text.alias("t"), (F.length(text) <= TRAIN_CHARS).alias("short"))
    found = marked.groupBy("lang").agg(F.count_if("short").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    if not found:
        return LanguageModel({})
    # where a language has long documents only, the beginnings of these teach it
    counts = {r["lang"]: r["n"] or r["all"] for r in found}
    long = [r["lang"] for r in found if not r["n"]]
    marked = marked.where(F.col("short") | F.col("lang").isin(long)) if long else marked.where("short")
    marked = marked.select("i", "lang", F.substring("t", 1, TRAIN_CHARS).alias("t"))
    # a hash threshold per language, sized from its count, leaves about TRAIN_ROWS documents of each
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * TRAIN_ROWS / n))]), F.col("lang"))
    hashed = F.pmod(F.xxhash64("i", F.lit("train")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = marked.where(hashed < share).select("lang", "i", "t").toPandas().sort_values(["lang", "i", "t"])
    texts: dict[str, list[str]] = {}
    for lang, own in rows.groupby("lang"):
        # near copies would fill the bounded text with one passage: take beginnings that differ
        fresh = own.assign(head=own["t"].str[:40]).drop_duplicates("head")["t"].tolist()[:TRAIN_ROWS]
        each = max(200, TRAIN_LETTERS // max(1, len(fresh)))
        texts[lang] = [t if len(t) <= 4 * each else t[: 4 * each] for t in fresh]
    return LanguageModel(texts)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            names, scores = model.predict([t if isinstance(t, str) and any(map(str.isalpha, t)) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = docs.select(F.col(id_col).alias("doc_id"), (crc_of_id(F.col(id_col)) % 4 == 2).alias("held_out"), predict(F.col(text_col).cast("string")).alias("__p"))
    return out.select("doc_id", "held_out", "__p.lang_pred", "__p.score")
