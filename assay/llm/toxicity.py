"""Toxicity after noisy-channel deobfuscation.

1. A character trigram model is counted over every document (a sum per task, then over tasks).
2. A token that may be disguised - letters mixed with digits or signs, signs that imitate letters, a letter three
   times or more in a row, or single characters with white space between them - is a lattice: each character may
   stand for itself or for the letters it imitates, a sign between letters may be nothing, a run of one letter may
   be one or two. Viterbi finds the best path under the trigram model and the channel's costs. A word with doubled
   letters is decoded where some reading of its runs could show a marker; other tokens are their own only path.
3. The restored words are scored. Markers are learned from labelled documents by repeated covering: the marker
   that explains most toxic documents not yet explained comes first, so copies of one document cannot make its
   rare words look toxic. A marker is a word, or a beginning that one, two or three different words of a document
   must share: the more of them, the fewer documents show that it is no accident. A logistic regression over how
   many markers a document holds, and how densely, gives the score.

Defined cases: null and empty texts score as documents without markers; with no labelled rows, or with
labels of one kind only, the score is the smoothed share of toxic labels; repeated rows are scored alike;
where an id has several labels the highest holds; equal markers go by name; texts of any length are read whole
(and learned from while they fit in ``FIT_CHARS``); numbers are read as numbers; further columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, fit_logistic, fitting_rows, kept, sigmoid, small_batches

#: Labelled documents that the markers and the regression are fitted on, and the most characters of these in all.
FIT_ROWS, FIT_CHARS = 6_000, 60_000_000
#: What a character may imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "×": "x", "*": "aeiou"}
#: Signs that may stand between letters for nothing.
FILLERS = set(".-_*~'`^=/\\,:;#%&\u200b\u200c\u200d\u00ad")
#: Costs of the channel, as natural logarithms.
COST_IMITATE, COST_FILLER, COST_COLLAPSE, COST_DOUBLE = 0.7, 1.5, 0.2, 4.0
#: A marker must explain this share of the toxic documents not yet explained often enough, and at least so many: by how many words of a document must show it.
MARKER_SHARE, MARKER_LEAST = 0.004, {0: 4, 1: 4, 2: 3, 3: 2}
#: A toxic document counts as explained once this many markers stand in it.
COVER = 3
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words that a worker keeps: as read, and as restored.
CACHE_WORDS, CACHE_RESTORED = 100_000, 50_000

ALPHABET = 64
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?=[.,;:!?]*(?!\S))")
_WORDS = re.compile(r"\S+")


def _codes() -> np.ndarray:
    """Code points to 1..ALPHABET-1; 0 is a word's edge. Letters a-z have a code each, other letters share the rest."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(len(out)):
        ch = chr(c).lower()
        if len(ch) == 1 and "a" <= ch <= "z":
            out[c] = ord(ch) - 96
        elif chr(c).isalpha():
            out[c] = 27 + ord(ch[0]) % (ALPHABET - 27)
    return out


_TABLE = _codes()


def code_of(ch: str) -> int:
    return int(_TABLE[ord(ch)]) if ord(ch) < len(_TABLE) else (27 + ord(ch) % (ALPHABET - 27) if ch.isalpha() else 0)


def trigram_counts(texts: list[str]) -> np.ndarray:
    flat = np.frombuffer("  ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0, 0], np.where(flat < len(_TABLE), _TABLE[np.minimum(flat, len(_TABLE) - 1)], 27 + flat % (ALPHABET - 27)), [0, 0]]).astype(np.int64)
    return np.bincount((codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:], minlength=ALPHABET**3)


class CharModel:
    """Interpolated character trigram model over letters and word edges."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        three[0, 0, 0] = 0
        two, one = three.sum(0), three.sum((0, 1))
        total = max(1.0, one.sum())
        p1 = (one + 0.5) / (total + 0.5 * ALPHABET)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3)


def _segments(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of one character, its readings (letters or nothing) and their costs."""
    out, at, n = [], 0, len(token)
    letters_after = [False] * (n + 1)
    for k in range(n - 1, -1, -1):
        letters_after[k] = letters_after[k + 1] or token[k].isalnum()
    seen = False
    while at < n:
        ch, end = token[at], at + 1
        while end < n and token[end] == ch:
            end += 1
        run, options = end - at, []
        single = [(ch, 0.0)] if ch.isalpha() else [(x, COST_IMITATE) for x in IMITATES.get(ch, "")]
        for letter, cost in single:
            # two alike are most likely meant, three or more are not
            options.append((letter, cost + (COST_DOUBLE if run == 2 else COST_COLLAPSE * (run > 2))))
            if run > 1:
                options.append((letter * 2, cost + COST_COLLAPSE * (run > 2)))
        if not options or not ch.isalnum() and (ch in FILLERS or not seen or not letters_after[end]):
            options.append(("", COST_FILLER))
        seen = seen or ch.isalnum()
        out.append(options)
        at = end
    return out


def restore(token: str, model: CharModel) -> str:
    """The best reading of a lower-cased token: exact Viterbi over the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    log = model.log
    for options in _segments(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in options:
                x, y, s = a, b, score - cost
                for ch in letters:
                    c = code_of(ch)
                    s += log[x, y, c]
                    x, y = y, c
                kept = following.get((x, y))
                if kept is None or s > kept[0]:
                    following[(x, y)] = (s, (path, letters) if letters else path)
        states = following
    best = max(states.items(), key=lambda kv: kv[1][0] + log[kv[0][0], kv[0][1], 0])
    parts, path = [], best[1][1]
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def _bare(word: str) -> str:
    """Without signs around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "@$"):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] in "$@"):
        b -= 1
    return word[a:b]


def _suspect(word: str) -> bool:
    if word.isalpha():
        return any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2))
    letters = sum(c.isalpha() for c in word)
    if letters:
        return len(word) >= 3
    return len(word) >= 4 and not word.isdigit() and all(c in IMITATES or c in FILLERS for c in word) and any(c in IMITATES and not c.isdigit() for c in word)


_RUN = re.compile(r"(.)\1+")


def _single(word: str) -> str:
    """Each run of one character as one: all readings of a word's runs agree in it."""
    return _RUN.sub(r"\1", word)


class Restorer(dict):
    """Word to restored word, kept while there is room."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> str:
        low = word.lower()
        if low.isalpha() and not _suspect(low):
            value = low
        else:
            bare = _bare(low)
            value = restore(bare, self.model) if _suspect(bare) else bare
            # signs at the edges may themselves be letters ("$cum", "tras#")
            if not value and low:
                value = low
        if len(word) <= 40 and len(self) < CACHE_RESTORED:
            self[word] = value
        return value

    def spaced(self, text: str) -> list[str]:
        """Restored runs of single characters; a run of one repeated character is no word."""
        out = []
        for run in _SPACED.findall(text):
            joined = "".join(run.split()).lower()
            if len(set(joined)) > 2:
                out.append(restore(joined, self.model))
        return out


#: A word, or a beginning, and how many different words of a document must show it (0: the whole word).
Marker = tuple[str, int]


def features_of(word: str) -> list[Marker]:
    """A restored word and its beginnings."""
    return [(word, 0)] + [(word[:n], 1) for n in PREFIXES if len(word) >= n]


def shown_by(words: set[str]) -> set[Marker]:
    """The words of a document, and their beginnings once for each number of words (up to three) that share them."""
    counts = Counter(f for w in words if len(w) >= 3 for f in features_of(w))
    return set(counts) | {(f, k) for (f, prefix), n in counts.items() if prefix for k in (2, 3) if n >= k}


class Markers:
    """Learned markers and the regression over them."""

    def __init__(self, markers: set[Marker], beta: np.ndarray, base: float):
        self.markers, self.beta, self.base = markers, beta, base
        self.least = {(f, min(1, times)): max(1, times) for f, times in markers}
        self.singles = {_single(f) for f, _ in markers}
        self.lengths = sorted({len(x) for x in self.singles})

    def holds(self, word: str) -> tuple[Marker, ...]:
        """The markers that a restored word shows, however many words must."""
        return tuple(f for f in features_of(word) if f in self.least)

    def may_hold(self, word: str) -> bool:
        """Whether some reading of a word's runs of letters could show a marker."""
        single = _single(word)
        return any(single[:n] in self.singles for n in self.lengths)

    def hits(self, shown: dict[str, tuple[Marker, ...]]) -> list[Marker]:
        """From the markers of a document's different restored words: one per word that shows a marker shown often enough."""
        counts = Counter(f for found in shown.values() for f in found)
        return [enough[0] for found in shown.values() if (enough := [f for f in found if counts[f] >= self.least[f]])]

    def inside(self, joined: str) -> list[Marker]:
        """Markers inside a restored run of single characters, which has lost its word edges."""
        return [m for m, times in self.least.items() if times == 1 and len(m[0]) >= 4 and m[0] in joined]

    @staticmethod
    def row(hits: list[Marker], n_words: int) -> list[float]:
        # whether there is any marker counts most; how many and how densely refine it (smaller columns shrink more)
        return [float(bool(hits)), 0.1 * math.log1p(len(set(hits))), 0.1 * min(1.0, 20 * len(hits) / max(1, n_words))]

    def score(self, hits: list[Marker], n_words: int) -> float:
        if not self.markers:
            return self.base
        return float(sigmoid(np.asarray([*self.row(hits, n_words), 1.0]) @ self.beta))


def _varied(holders: np.ndarray, words: list[set[str]], dice: np.random.Generator) -> bool:
    """Whether documents that hold a marker are otherwise unlike each other, not copies of one."""
    pairs = [dice.choice(holders, 2, replace=False) for _ in range(9)]
    alike = [len(words[a] & words[b]) / max(1, len(words[a] | words[b])) for a, b in pairs]
    return float(np.median(alike)) < 0.3


def _akin(a: Marker, b: Marker) -> bool:
    return a[0].startswith(b[0]) or b[0].startswith(a[0])


def learn(texts: list[str], labels: list[int], restorer: Restorer) -> Markers:
    """Markers by repeated covering, then the regression; texts that begin or end alike count once for the markers."""
    shown, seen = [], set()
    base = (sum(labels) + 0.5) / (len(labels) + 1) if labels else 0.5 * 0.2
    rows = []
    for text, label in zip(texts, labels, strict=True):
        raw = _WORDS.findall(text)
        words = {restorer[w] for w in raw}
        rows.append((words, restorer.spaced(text), len(raw), label))
        low = text.lower().split()
        edges = {("head", *low[:8]), ("tail", *low[-8:])}
        if len(low) < 12 or not edges & seen:
            seen |= edges
            shown.append((words, label))
    clean: Counter[Marker] = Counter()
    holders: dict[Marker, list[int]] = defaultdict(list)
    toxic, toxic_words = 0, []
    for words, label in shown:
        found = shown_by(words)
        if label:
            for f in found:
                holders[f].append(toxic)
            toxic_words.append(words)
            toxic += 1
        else:
            clean.update(found)
    n_clean = max(1, len(shown) - toxic)
    need = np.full(toxic, COVER)
    least = {times: max(n, MARKER_SHARE * toxic) for times, n in MARKER_LEAST.items()}
    pure = {f: np.asarray(h) for f, h in holders.items() if len(h) >= least[f[1]] and clean[f] / n_clean < 0.002 and (clean[f] + 0.5) / (len(h) + 1) <= 0.17}
    markers: set[Marker] = set()
    # of beginnings that stand in the same documents the longest is as good and says most; beginnings before words
    gains = {f: len(h) for f, h in pure.items()}
    dice = np.random.default_rng(7)
    while gains:
        best = max(gains, key=lambda f: (gains[f], len(f[0]), f[1] == 1, f))
        gain = int((need[pure[best]] > 0).sum())
        if gain < least[best[1]]:
            del gains[best]
            continue
        if gain < gains[best]:
            gains[best] = gain
            continue
        del gains[best]
        if not _varied(pure[best], toxic_words, dice):
            continue
        markers.add(best)
        need[pure[best]] -= 1
        for f in [f for f in gains if _akin(f, best)]:
            del gains[f]  # the same marker, cut elsewhere
    for f in sorted(pure):  # explained by others already, but plain enough
        if len(pure[f]) >= max(20, 0.02 * toxic) and not clean[f] and not any(_akin(f, m) for m in markers) and _varied(pure[f], toxic_words, dice):
            markers.add(f)
    fitted = Markers(markers, np.zeros(4), base)
    if not markers:
        return fitted
    x, y = [], []
    for words, spaced, n, label in rows:
        hits = fitted.hits({w: m for w in words if (m := fitted.holds(w))}) + [m for j in spaced for m in fitted.inside(j)]
        x.append(Markers.row(hits, n))
        y.append(label)
    fitted.beta = fit_logistic(np.asarray(x), np.asarray(y, float), l2=0.05)
    return fitted


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Count character trigrams over all documents."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if isinstance(t, str)]
            for at in range(0, len(texts), 64):
                counts += trigram_counts(texts[at : at + 64])
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"gram": some, "n": counts[some]})

    summed = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ALPHABET**3)
    counts[summed["gram"].to_numpy("int64")] = summed["n"].to_numpy("float64")  # at most ALPHABET ** 3 rows
    return CharModel(counts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_of: int = 5) -> tuple[CharModel, Markers]:
    """Learn from labelled documents outside the held-out fold (crc32 of the id as text, modulo ``held_out_of``, is 0)."""
    small_batches(docs.sparkSession)
    model = char_model(docs, text_col)
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where(crc_of_id(F.col("id")) % held_out_of != 0).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = fitting_rows(texts, marked, FIT_ROWS, FIT_CHARS).sort_values(["id", "text"])
    return model, learn(rows["text"].tolist(), rows["label"].tolist(), Restorer(model))


def scorer(docs: DataFrame, labels: DataFrame, **options):
    """A pandas UDF from text to score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, markers = shared.value
        words = _worker_words(model, markers)
        return pd.Series([_score(t if isinstance(t, str) else "", words, markers) for t in texts], dtype="float64")

    return score


class _Shown(dict):
    """Word to (restored word, the markers it shows), or None where it shows none; kept while there is room."""

    def __init__(self, restorer: Restorer, markers: Markers):
        super().__init__()
        self.restorer, self.markers = restorer, markers

    def __missing__(self, word: str) -> tuple[str, tuple[Marker, ...]] | None:
        restored = self.restorer[word]
        found = self.markers.holds(restored)
        if not found and _RUN.search(restored) and restored.isalpha() and self.markers.may_hold(restored):
            restored = restore(restored, self.restorer.model)
            found = self.markers.holds(restored)
        value = (restored, found) if found else None
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _worker_words(model: CharModel, markers: Markers) -> _Shown:
    """One cache per worker and model; in it the restorer keeps disguised words only."""
    own = kept("toxicity")
    if own.get("markers") is not markers:
        own |= {"markers": markers, "words": _Shown(Restorer(model), markers)}
    return own["words"]


def _score(text: str, words: _Shown, markers: Markers) -> float:
    raw = text.split()
    distinct = set(raw)
    hits = markers.hits(dict(m for m in map(words.__getitem__, distinct) if m is not None))
    if " " in text and _may_be_spaced(raw):
        hits += [m for joined in words.restorer.spaced(text) for m in markers.inside(joined)]
    return markers.score(hits, len(raw))


def _may_be_spaced(raw: list[str]) -> bool:
    """Three single characters in a row."""
    run = 0
    for w in raw:
        run = run + 1 if len(w) == 1 else 0
        if run == 3:
            return True
    return False


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    score = scorer(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (crc_of_id(F.col(id_col)) % 5 == 0).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score(F.col(text_col).cast("string")) < 0.5)
