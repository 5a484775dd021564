"""Quality by a generalised additive model with pairwise interactions.

Every document is reduced to a few figures of its whole text. Each figure is cut into bins at
quantiles, and cyclic boosting gives every figure a lookup table of bins: in each round, figure after
figure, a shallow tree is fitted to what the tables so far leave, and a small part of it is added.
The pairs of figures whose joint bins explain most of the rest get tables of their own in the same
way. A score is the logistic of an intercept plus one entry of each table, added over whole batches.

The model is fitted on a bounded sample of labelled documents (``PER_CLASS`` of each class, least by
a hash of the id), weighted back to the labels' class shares; every document is scored.

Defined results: null and empty texts have all figures 0 and are scored like any other. Without a
labelled document of each class every score is 0.5. Repeated rows are scored each. An empty table
gives no rows. Extra columns pass through; ``score`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import fresh, labelled_sample

#: labelled documents of each class that the model is fitted on, at most
PER_CLASS = 10_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 200, 60, 6, 0.1, 3
#: a leaf holds at least this share of the weight
LEAF = 0.002

FIGURES = ["words", "characters", "word_length", "distinct_words", "capitals", "digits", "marks", "symbols", "bars", "exclamations", "sentence_ends", "lines", "line_length", "repeated_lines",
           "short_words", "odd_words", "capital_words", "most_common"]
MARK, SYMBOL, CAPITAL = re.compile(r"[.,;:!?'\"()-]"), re.compile(r"[#$%&*@^~+=<>/\\|_{}\[\]`]"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
ODD = re.compile(r"[^\W\d_](?=[#$%&*@^~+=<>/\\|_{}\[\]`!?])")
DIGIT, SENTENCE = re.compile(r"[0-9]"), re.compile(r"[.!?](?=\s|\Z)")


def figures(text: str) -> list[float]:
    """One number for each of ``FIGURES``."""
    words = text.split()
    if not words:
        return [0.0] * len(FIGURES)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    many = lambda p: len(p.findall(text))
    return [float(n), float(chars), sum(map(len, words)) / n, len(counts) / n, many(CAPITAL) / chars, many(DIGIT) / chars, many(MARK) / n, many(SYMBOL) / n, text.count("|") / n, text.count("!") / n,
            many(SENTENCE) / n, float(len(lines)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(len(w) <= 3 for w in words) / n, many(ODD) / n, many(CAPITALS) / n, max(counts.values()) / n]


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables and len(x):
            bins = self.bins(x)
            for f, t in enumerate(self.tables):
                total += t[bins[:, f]]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                total += t[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _tree(g: np.ndarray, h: np.ndarray, least: float, leaves: int = LEAVES) -> np.ndarray:
    """Step of each bin: the axis is split where the fit gains most, until there are ``leaves`` runs of bins."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1e-3)
    runs = [(0, len(g))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(runs):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(ch[cuts] - ch[a] >= least) & (ch[b] - ch[cuts] >= least)]
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), r, int(cuts[i]))
        if best[1] is None:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in runs:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1e-3)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree of depth two on two axes: one cut of the first, then a cut of the second on either side, or the other way round."""
    best, gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            step, worth = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[part].sum(axis=0), hh[part].sum(axis=0)
                s = _tree(sg, sh, least, 2)
                step[part] = s
                worth += float((s * sg).sum())
            if worth > gain:
                best, gain = (step.T if flip else step), worth
    return best, gain


def fit_model(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
    """Cyclic boosting of the single tables, choice of pairs, cyclic boosting of the pair tables."""
    if len(set(y.tolist())) < 2:
        return Model()
    w = w * len(y) / w.sum()
    prior = float((w * y).sum() / w.sum())
    m = Model(intercept=float(np.log(prior / (1 - prior))))
    m.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = m.bins(x)
    sizes = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in sizes]
    m.coarse = [np.arange(s) * min(PAIR_BINS, s) // s for s in sizes]
    total, least = np.full(len(y), m.intercept), LEAF * len(y)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return w * (y - p), w * p * (1 - p)

    for _ in range(ROUNDS):
        for f, s in enumerate(sizes):
            g, h = slopes()
            step = RATE * np.clip(_tree(np.bincount(bins[:, f], g, s), np.bincount(bins[:, f], h, s), least / 4), -4, 4)
            m.tables[f] += step
            total += step[bins[:, f]]
    low = [c[bins[:, f]] for f, c in enumerate(m.coarse)]
    wide = [int(c[-1]) + 1 for c in m.coarse]

    def joint(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = low[a] * wide[b] + low[b]
        return (np.bincount(cell, v, wide[a] * wide[b]).reshape(wide[a], wide[b]) for v in (g, h))

    gains = sorted(((-_pair_tree(*joint(a, b), least / 4)[1], a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if wide[a] > 1 and wide[b] > 1))
    m.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    m.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(m.pairs, m.pair_tables):
            step = RATE * np.clip(_pair_tree(*joint(a, b), least / 4)[0], -4, 4)
            t += step
            total += step[low[a], low[b]]
    return m


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [figures(t.as_py() or "") for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, trains: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """The model; ``trains`` says which label rows may be used."""
    sample = labelled_sample(labels, label_col, trains, per_class, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select("text", "y")
    seen = texts.mapInArrow(_figures, "y int, x array<double>").toPandas()
    if not len(seen):
        return Model()
    every = {r.y: r.n for r in labels.where(trains).groupBy(F.col(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    y = seen.y.to_numpy()
    weight = np.array([every.get(c, 0) / max(int((y == c).sum()), 1) for c in (0, 1)])
    x = np.stack(seen.x.to_numpy())
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of rows
    return fit_model(x[order], y[order].astype(float), weight[y[order]])


def _scores(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        x = np.array([figures(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(FIGURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all if None) with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c != "score"]
    (text,) = fresh(docs, "_scored")
    rows = docs.select(*keep, F.col(text_col).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: _scores(sent, b), f"{schema}{', ' if keep else ''}score double")
