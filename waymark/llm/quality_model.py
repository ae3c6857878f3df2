"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits one shallow tree to the present gradients over the
feature's bins and adds it to the feature's lookup table. When the tables stand, the feature pairs whose cuts would
gain most get tables of their own, boosted the same way. A score is the sum of one bin of each table, so scoring is
a look-up and an addition per feature, vectorised over a batch. Features are built-in expressions over the whole
text; neither labels nor language, source or id are among them.

The fit uses at most `max_rows` labelled rows, those of least hash: their number doesn't grow with the corpus, nor
does what the driver holds. All documents are scored.

Defined results: a null text is empty, and is scored like an empty one; a null doc_id is never held out; labels
repeated for one id count once, by their least quality; without labels every score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import words

MAX_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LAMBDA = 120, 60, 0.15, 1.0
FOLDS = 5


def _features() -> dict[str, Column]:
    """Expressions over `text`, its words `w` and lines `l`; ratios are zero where nothing is counted."""
    n = F.size("w")
    chars = F.length("text")
    per = lambda x, d: F.when(d > 0, x.cast("double") / d).otherwise(F.lit(0.0))
    count = lambda p: F.regexp_count("text", F.lit(p))
    lengths = F.transform("w", lambda x: F.length(x))
    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": per(chars, n),
        "short_words": per(F.size(F.filter(lengths, lambda x: x <= 3)), n),
        "longest_word": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "distinct_words": per(F.size(F.array_distinct("w")), n),
        "symbols": per(count(r"[#*$%&|<>]"), n),
        "capitals": per(count("[A-Z]"), chars),
        "digits": per(count("[0-9]"), chars),
        "exclamations": per(count("!"), n),
        "stops": per(count("[.,;:?]"), n),
        "not_ascii": per(F.octet_length("text") - chars, chars),
        "duplicate_lines": per(F.size("l") - F.size(F.array_distinct("l")), F.size("l")),
        "line_words": per(n, F.size("l")),
    }


NAMES = tuple(
    "log_words word_length short_words longest_word distinct_words symbols capitals digits exclamations stops not_ascii duplicate_lines line_words".split()
)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = text.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    made = _features()
    return parts.select("doc_id", *(made[k].alias(k) for k in NAMES))


@dataclass
class Model:
    """Bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + LAMBDA)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree of at most four leaves over a row of bins."""
    out = np.empty(len(g))
    _, middle = _best_cut(g, h)
    for a, b in ((0, middle), (middle, len(g))):
        if a == b:
            continue
        gain, cut = _best_cut(g[a:b], h[a:b])
        cut = a + cut if gain > 0 else b
        for c, d in ((a, cut), (cut, b)):
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + LAMBDA)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def four(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    parts_g, parts_h = four(cg), four(ch)
    gains = sum(_gain(x, y) for x, y in zip(parts_g, parts_h, strict=True)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = [x[i, j] / (y[i, j] + LAMBDA) for x, y in zip(parts_g, parts_h, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts tables for features (rows by columns) and labels 0 and 1."""
    if not len(y):
        return Model()
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(intercept=float(np.log(rate / (1 - rate))))
    z = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            z += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grids(i, j):
        g, h = slopes()
        at, shape = coarse[i] * width[j] + coarse[j], (width[i], width[j])
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    every = [(i, j) for i in range(x.shape[1]) for j in range(i)]
    chosen = sorted(every, key=lambda p: -_quadrants(*grids(*p)[1:])[0])[:PAIRS]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            at, g, h = grids(i, j)
            step = RATE * _quadrants(g, h)[1]
            table += step
            z += step.ravel()[at]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_rows labelled documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = features(docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id")
    table = rows.select(*NAMES, "quality").toArrow()
    columns = [np.asarray(c, dtype=float) for c in (table.column(n).to_numpy() for n in table.column_names)]
    x = np.column_stack(columns)
    # the order of rows decides how sums round: make it that of the values
    x = x[np.lexsort(x.T)] if len(x) else x.reshape(0, len(NAMES) + 1)
    return x[:, :-1], x[:, -1]


def _score(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = features(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(_score(model), "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(*training_rows(docs, labels)))
