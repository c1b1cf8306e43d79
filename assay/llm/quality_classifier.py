"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

Both start from labelled documents. In each round each view labels the documents of an unlabelled pool
that it is sure of, by probabilities calibrated on rows it was not trained on, and hands them to the other
view. At the end each view's log odds are calibrated on true labels and a logistic regression combines
them; that model scores every document.

Defined cases: null text is empty; null metadata are values of their own; with no labels, or labels of one
kind only, every score is the smoothed share of good labels; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, fit_logistic, sigmoid, small_batches

#: Labelled and unlabelled documents that the views are fitted on, and the longest of them in characters.
FIT_ROWS, POOL_ROWS, FIT_CHARS = 4_000, 4_000, 200_000
ROUNDS = 5
#: A pseudo-label needs this calibrated probability; a round hands over at most so many, the surest first.
SURE, PER_ROUND = 0.97, 400
BIGRAMS, SOURCES = 64, 64
TEXT_WIDTH, META_WIDTH = 14 + BIGRAMS, 6 + 2 * SOURCES

_SYMBOLS = str.maketrans("", "", "#*$%&|<>@^~=_\\{}[]+")
_STOPS = str.maketrans("", "", ".,;:!?'\"()-")
_DIGITS = str.maketrans("", "", "0123456789")


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(TEXT_WIDTH)
    words = (text or "").split()
    if not words:
        out[0] = 1.0
        return out
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    upper = int(((points >= 65) & (points <= 90)).sum())
    out[1] = np.log1p(n) / 10
    out[2] = (chars - len(text.translate(_SYMBOLS))) / chars
    out[3] = min(1.0, (chars - len(text.translate(_SYMBOLS))) / n)
    out[4] = upper / chars
    out[5] = min(1.0, text.count("!") / n)
    out[6] = (chars - len(text.translate(_DIGITS))) / chars
    out[7] = (chars - len(text.translate(_STOPS))) / chars
    out[8] = min(1.0, chars / n / 20)
    out[9] = len(set(words)) / n
    out[10] = sum(map(str.__eq__, words, words[1:])) / n
    out[11] = 1 - len(set(lines)) / max(1, len(lines))
    out[12] = float(n < 20)
    out[13] = float(n < 60)
    pairs = np.bincount((points[:-1] * 31 + points[1:]) % BIGRAMS, minlength=BIGRAMS) if len(points) > 1 else np.zeros(BIGRAMS)
    out[14:] = np.sqrt(pairs / max(1, pairs.sum()))
    return out


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META_WIDTH)
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, float(n_chars))) if known else 0.0
    out[:6] = [float(not known), size / 10, float(known and n_chars < 200), float(known and n_chars < 1000), float(known and n_chars > 5000), float(known and n_chars > 20000)]
    for k, value in enumerate((lang, source)):
        out[6 + k * SOURCES + zlib.crc32(("\x00" if value is None else "v" + str(value)).encode()) % SOURCES] = 1.0
    return out


class View:
    """A logistic regression whose log odds are calibrated by a second one on rows kept aside."""

    def __init__(self, l2: float):
        self.l2 = l2
        self.beta: np.ndarray | None = None
        self.scale = np.array([1.0, 0.0])

    def train(self, x: np.ndarray, y: np.ndarray, aside_x: np.ndarray, aside_y: np.ndarray) -> None:
        self.beta = fit_logistic(x, y, self.l2)
        self.scale = fit_logistic(self.raw(aside_x)[:, None], aside_y, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.scale[0] + self.scale[1]


class CoTrained:
    def __init__(self, base: float):
        self.base = base
        self.views: list[View] = []
        self.mix = np.zeros(3)
        self.handed: list[tuple[int, int]] = []

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.views:
            flat = np.full(len(views[0]), self.base)
            return flat, [flat, flat]
        odds = [v.odds(x) for v, x in zip(self.views, views, strict=True)]
        return sigmoid(np.stack(odds, 1) @ self.mix[:-1] + self.mix[-1]), [sigmoid(o) for o in odds]


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """``labelled`` and ``pool``: a feature matrix for each of the two views."""
    model = CoTrained((y.sum() + 0.5) / (len(y) + 1))
    if len(y) < 8 or y.min() == y.max():
        return model
    aside = np.arange(len(y)) % 4 == 3  # for calibration; sampling left the order random
    if y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside = np.ones(len(y), bool)
    learn = ~aside if not aside.all() else aside
    train = [(x[learn], y[learn]) for x in labelled]
    model.views = [View(0.1), View(2.0)]
    open_rows = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    for r in range(rounds + 1):
        for view, (x, t), kept in zip(model.views, train, labelled, strict=True):
            view.train(x, t, kept[aside], y[aside])
        if r == rounds or not len(pool[0]):
            break
        handed = []
        for k in (0, 1):
            p = sigmoid(model.views[k].odds(pool[k]))
            sure = np.flatnonzero(open_rows[k] & (np.maximum(p, 1 - p) >= SURE))
            sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][:PER_ROUND]
            # hand over both kinds as they occur, so that the other's base rate stays
            open_rows[k][sure] = False
            handed.append((sure, (p[sure] >= 0.5).astype(float)))
        for k in (0, 1):
            rows, marks = handed[1 - k]
            if len(rows):
                train[k] = (np.vstack([train[k][0], pool[k][rows]]), np.concatenate([train[k][1], marks]))
        model.handed.append((len(handed[0][0]), len(handed[1][0])))
    odds = np.stack([v.odds(x[aside]) for v, x in zip(model.views, labelled, strict=True)], 1)
    model.mix = fit_logistic(odds, y[aside], 0.1)
    return model


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    text = [text_features(t if isinstance(t, str) else None) for t in frame["text"]]
    none = lambda v: v if isinstance(v, str) else None
    meta = [meta_features(none(a), none(b), c) for a, b, c in zip(frame["lang"], frame["source"], frame["n_chars"].astype(float), strict=True)]
    return [np.asarray(text).reshape(-1, TEXT_WIDTH), np.asarray(meta).reshape(-1, META_WIDTH)]


def quality_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_of: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, text_score, meta_score, score, predicted.

    ``docs``: doc_id, text, lang, source, n_chars. Nothing is learned from documents whose
    crc32(id as text) mod ``held_out_of`` is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars")]
    own = docs.select(*columns)
    usable = own.where((crc_of_id(F.col("doc_id")) % held_out_of != 0) & (F.length(F.coalesce("text", F.lit(""))) <= FIT_CHARS))
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("__y"))
    chosen = bounded_sample(marked.where(crc_of_id(F.col("__id")) % held_out_of != 0), F.col("__id"), FIT_ROWS)
    known = usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id").toPandas()
    ids = bounded_sample(usable.select("doc_id").join(marked, F.col("doc_id") == F.col("__id"), "left_anti"), F.col("doc_id"), POOL_ROWS)
    pool = usable.join(F.broadcast(ids.distinct().withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).drop("__id").toPandas()
    shuffled = lambda f: f.iloc[np.argsort([zlib.crc32(f"co{i}".encode()) for i in f["doc_id"]], kind="stable")] if len(f) else f
    known, pool = shuffled(known), shuffled(pool)
    shared = spark.sparkContext.broadcast(co_train(_matrices(known), known["__y"].to_numpy(float), _matrices(pool)))

    @F.pandas_udf("text_score double, meta_score double, score double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in batches:
            score, (a, b) = shared.value.score(_matrices(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars})))
            yield pd.DataFrame({"text_score": a, "meta_score": b, "score": score})

    out = own.select("doc_id", (crc_of_id(F.col("doc_id")) % held_out_of == 0).alias("held_out"), run("text", "lang", "source", "n_chars").alias("__s"))
    return out.select("doc_id", "held_out", "__s.*", (F.col("__s.score") >= 0.5).cast("int").alias("predicted"))
