"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (``FEATURES``), each number a bin. Training goes
round the features again and again; a tree of at most three leaves over one
feature's bins, fitted to the gradients, is added to that feature's lookup table
at a small rate. Pairs whose joint bins explain most of what is left then get
tables of their own in the same way. A score is the sum of an intercept and one
table entry per feature and pair, through the logistic function: for a whole
batch, a few vectorised additions.

The model is fitted on a bounded sample of the labelled rows: at most
``MAX_TRAINING_ROWS`` of them, those of least id hash, so the driver holds that
many rows of ``len(FEATURES)`` numbers at most. Their texts are read in place (the
sample of ids is what travels) and scoring is a projection: no shuffle of texts.

Defined cases: null and empty texts have all features 0 and a score like any
text; a null label counts for nothing; rows of one ``doc_id`` with several labels
count as 1 if at least half of them do; a null ``doc_id`` is hashed like an empty
text and matches no label; without labels every score is 0.5, with labels of one
kind it lies close to that kind; repeated documents get a row each; long texts
are read whole; texts with equal features get equal scores, and of equally good cuts of a part
(ties) the first is taken; no documents give no rows; other columns pass through
where rows are kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table

MAX_TRAINING_ROWS = 40_000
THRESHOLD = 0.3
FOLDS = 5  # rows of fold 0 are held out

FEATURES = [
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits", "symbols", "bars",
    "stops", "lines_distinct", "log_line_length", "short_lines", "beyond_ascii", "words_with_symbol_end",
]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?"
_PLAIN = _LETTERS + _DIGITS + _STOPS + b" \t\r\n'\"-()" + bytes(range(128, 256))
_SYMBOL_ENDS = tuple("%&$*#!|@~^=<>+_\\/")


def features_of(text: str | None) -> list[float]:
    """The numbers of ``FEATURES`` for one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    size, words, lines = len(raw), text.split(), text.split("\n")
    n = max(1, len(words))

    def share(signs: bytes) -> float:
        return (size - len(raw.translate(None, signs))) / size

    counts = Counter(words)
    plain = share(_PLAIN)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        share(_UPPER),
        share(_DIGITS),
        1 - plain,
        raw.count(b"|") / size,
        share(_STOPS),
        len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        sum(len(line) < 20 for line in lines) / len(lines),
        share(bytes(range(128, 256))),
        sum(map(str.endswith, words, [_SYMBOL_ENDS] * len(words))) / n,
    ]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features_of(text) for text in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables over bins of features and of pairs of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.intercept)
        for j, table_ in enumerate(self.tables):
            score += table_[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), table_ in zip(self.pairs, self.pair_tables):
            score += table_[coarse[a], coarse[b]]
        return score

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between about equally full bins."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g / (h + smooth)


def _best_split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + smooth) + (total_g - left_g) ** 2 / (total_h - left_h + smooth) - total_g**2 / (total_h + smooth)
    place = int(np.argmax(gain))
    return float(gain[place]), place + 1


def _tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """A value for each bin: a tree of at most three leaves."""
    out = np.empty(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        gains = [(*_best_split(g[a:b], h[a:b], smooth), a, b) for a, b in parts]
        gain, place, a, b = max(gains)
        if gain <= 1e-9 or not place:
            break
        parts.remove((a, b))
        parts += [(a, a + place), (a + place, b)]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one feature once and each side once along the other."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            gain, values = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                a, b = gg[part].sum(axis=0), hh[part].sum(axis=0)
                more, place = _best_split(a, b, smooth)
                gain += more + a.sum() ** 2 / (b.sum() + smooth)
                for side in (slice(0, place), slice(place, None)):
                    if a[side].size:
                        values[part, side] = _leaf(a[side].sum(), b[side].sum(), smooth)
            if gain > best:
                best, out = gain, (values.T if turned else values)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 48, pair_bins: int = 8, rate: float = 0.1, smooth: float = 5.0) -> AdditiveModel:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return AdditiveModel()
    y = y.astype(np.float64)
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(
        [_cuts(x[:, j], bins) for j in range(x.shape[1])], [_cuts(x[:, j], pair_bins) for j in range(x.shape[1])], float(np.log(base / (1 - base)))
    )
    binned = [np.searchsorted(edges, x[:, j], side="right") for j, edges in enumerate(model.edges)]
    model.tables = [np.zeros(len(edges) + 1) for edges in model.edges]
    raw = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(binned):
            residual, weight = gradients()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(at, residual, size), np.bincount(at, weight, size), smooth)
            model.tables[j] += step
            raw += step[at]

    coarse = [np.searchsorted(edges, x[:, j], side="right") for j, edges in enumerate(model.pair_edges)]
    width = [len(edges) + 1 for edges in model.pair_edges]

    def pair_sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        residual, weight = gradients()
        at, shape = coarse[a] * width[b] + coarse[b], (width[a], width[b])
        return np.bincount(at, residual, shape[0] * shape[1]).reshape(shape), np.bincount(at, weight, shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _pair_tree(*pair_sums(a, b), smooth)[0] for a, b in combinations(range(x.shape[1]), 2) if width[a] > 1 and width[b] > 1}
    model.pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:n_pairs]
    model.pair_tables = [np.zeros((width[a], width[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * _pair_tree(*pair_sums(a, b), smooth)[1]
            model.pair_tables[k] += step
            raw += step[coarse[a], coarse[b]]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """The model of at most ``max_rows`` labelled rows of all folds but the one held out."""
    ship_package(docs.sparkSession)
    chosen = (
        labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg((F.avg(F.col(target)) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series(list(feature_matrix(texts)))

    # At most max_rows small rows on the broadcast side.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", numbers("text").alias("x"))
    sample = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    if not len(sample):
        return AdditiveModel()
    return fit(np.stack(sample["x"].to_numpy()), sample["label"].to_numpy())


def scorer(spark: SparkSession, model: AdditiveModel):
    """A function of a text column: score from 0 to 1."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(feature_matrix(texts)))

    return score


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, as they are."""
    return docs.filter(scorer(docs.sparkSession, train(docs, labels))(F.col("text")) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
