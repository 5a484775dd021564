"""Toxicity by class-conditional Kneser-Ney models.

Two character models spell the words of toxic and of ordinary documents: how likely a letter is after
up to ``ORDER`` - 1 others of its word. Both back off to one shared distribution after three letters,
which counts every distinct word of the corpus once (what Kneser and Ney call continuations), so a
spelling that neither class has seen often has the same back-off in both and weighs little. A document's evidence is the
difference of its two log-likelihoods divided by its number of words; a logistic curve, fitted on
labelled documents that the models have not counted, turns it into a score.

Class counts come from a bounded sample of labelled documents (``PER_CLASS`` of each class, least by
a hash of the id). The shared counts cover the words of every document and grow with the corpus; they
stay in Spark, where only the sample's spellings are joined to them. The broadcast model holds every
spelling and context that the sample has ``LEAST`` times, as sorted 64-bit hashes with a float each.
Whole texts are scored.

Defined results: a null or empty text, or one without words, has evidence 0. Without a labelled
document of each class every score is just below 0.5, so nothing is rejected. Repeated rows are
scored each. An empty table gives no rows. Extra columns pass through; ``score`` and ``evidence``
replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import fresh, labelled_sample, small_batches, tidy

#: labelled documents of each class that are counted or calibrated on, at most
PER_CLASS = 8_000
#: one in so many of them calibrates and is not counted
HELD = 5
#: letters of a spelling, the last included; letters of a shared one
ORDER, SHARED = 8, 4
#: spellings and contexts seen less often in the sample are rare
LEAST = 3
DISCOUNT = 0.75
#: counts leave a task when it holds so many different words or spellings; a worker keeps the values of so many words
FLUSH, KNOWN = 200_000, 200_000
#: texts scored together; words hashed together
TEXTS, WORDS = 64, 20_000
SEED, MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def spellings(word: str, order: int) -> list[str]:
    """Each letter with up to ``order`` - 1 letters before it; ^ starts and $ ends a word."""
    w = f"^{word}$"
    return [w[max(0, i + 1 - order):i + 1] for i in range(1, len(w))]


def hashes(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At each letter of all strings: hash of it with up to ``ORDER`` - 1 before it, hash of those before alone, place in its string; lengths."""
    letters = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h = np.full(len(letters), SEED)
    for back in range(ORDER - 1, -1, -1):
        before = h
        x = (h[back:] ^ letters[:max(len(letters) - back, 0)]) * MULTIPLIER
        h = np.concatenate((h[:back], np.where(at[back:] >= back, x ^ (x >> np.uint64(32)), h[back:])))
    return h.view(np.int64), before.view(np.int64), at, lengths


Table = tuple[np.ndarray, np.ndarray]  # sorted hashes and their values
NONE: Table = (np.empty(0, np.int64), np.empty(0))


def look_up(table: Table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none), and where there is one."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[i] == wanted
    return np.where(found, values[i], 0.0), found


class Model:
    """Log-likelihood differences: of known spellings, and of back-off from known contexts."""

    def __init__(self, grams: Table = NONE, contexts: Table = NONE, slope: float = 0.0, offset: float = -1e-6):
        self.grams, self.contexts, self.slope, self.offset = grams, contexts, slope, offset
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def values(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        full, before, at, lengths = hashes([f"^{w}$" for w in words])
        spelled = at > 0
        value, found = look_up(self.grams, full[spelled])
        behind, _ = look_up(self.contexts, before[spelled])
        return np.add.reduceat(np.where(found, value, behind), np.cumsum(lengths - 1) - (lengths - 1))

    def word(self, word: str) -> float:
        return float(self.values([word])[0])

    def evidences(self, texts: list[str | None]) -> list[float]:
        """Differences of the log-likelihoods for each word; each new word is looked up once."""
        out: list[float] = []
        for at in range(0, len(texts), TEXTS):
            found = [words_of(t or "") for t in texts[at:at + TEXTS]]
            every = set().union(*found)
            if len(self.known) > KNOWN:
                self.known.clear()
            new = list(every - self.known.keys())
            for k in range(0, len(new), WORDS):
                part = new[k:k + WORDS]
                self.known.update(zip(part, self.values(part).tolist()))
            out += [math.fsum(map(self.known.__getitem__, words)) / len(words) if words else 0.0 for words in found]
        return out

    def evidence(self, text: str) -> float:
        """Difference of the log-likelihoods for each word."""
        return self.evidences([text])[0]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def _count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> counts of spellings by class."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        grams = list(counts[0].keys() | counts[1].keys())
        rows = [pa.array(grams, pa.string()), *(pa.array([c[g] for g in grams], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(rows, ["gram", "ordinary", "toxic"])

    for batch in batches:
        words: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            words[y].update(words_of(text.as_py() or ""))
        for y in (0, 1):
            for word, n in words[y].items():
                for g in spellings(word, ORDER):
                    counts[y][g] += n
                if len(counts[y]) > FLUSH:
                    yield flush()
    yield flush()


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            seen.update(words_of(text.as_py() or ""))
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])
                seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words -> counts of shared spellings."""
    counts: Counter = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])
    for batch in batches:
        for word in batch.column(0).to_pylist():
            counts.update(spellings(word, SHARED))
        if len(counts) > FLUSH:
            yield flush()
            counts.clear()
    yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spelling, value) -> (hash, value)."""
    for batch in batches:
        full, _, _, lengths = hashes(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(full[np.cumsum(lengths) - 1], pa.int64()), batch.column(1)], ["hash", "value"])


def collected(pairs: DataFrame) -> Table:
    """(spelling, value) rows as sorted hashes and values."""
    got = pairs.mapInArrow(lambda b: tidy(_hashed(b)), "hash bigint, value double").toArrow()
    keys, values = got.column("hash").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def head(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 1, char_length({gram}) - 1)")


def shared_model(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tail, p): P(letter | up to three letters before it) of each wanted tail, lower orders by continuations.

    ``counts`` has (gram, n). Level k holds the spellings without their first k letters; a single letter
    above the last level, and what lies below it, has the same probability for each letter.
    """
    levels = [counts.select(F.lit(0).alias("level"), "gram", "n")]
    while len(levels) < SHARED:
        levels.append(levels[-1].where("char_length(gram) > 1").groupBy(F.lit(len(levels)).alias("level"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    tables = levels[0]
    for t in levels[1:]:
        tables = tables.unionByName(t)
    tables = tables.persist()
    sums = tables.groupBy("level", head().alias("h")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    letters = tables.where("level = 0").agg(F.countDistinct(F.expr("right(gram, 1)"))).first()[0] + 1
    asked = wanted.select(F.explode(F.expr(f"transform(sequence(0, {SHARED - 1}), k -> named_struct('level', k, 'gram', substring(tail, k + 1)))")).alias("x")).select("x.*")
    asked = asked.where(f"char_length(gram) > 1 or char_length(gram) = 1 and level = {SHARED - 1}").distinct().withColumn("h", head())
    pieces = asked.join(tables, ["level", "gram"], "left").join(sums, ["level", "h"], "left").persist()
    p = None
    for level in range(SHARED - 1, -1, -1):
        at = pieces.where(F.col("level") == level).select("gram", "n", "total", "kinds")
        at = at.withColumn("below", F.lit(1 / letters)) if p is None else at.join(p, F.expr("substring(gram, 2)") == F.col("tail"), "left").withColumn("below", F.coalesce("p", F.lit(1 / letters)))
        p = at.select(F.col("gram").alias("tail"), F.when(F.col("total") > 0, (F.greatest(F.coalesce("n", F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * F.col("kinds") * F.col("below")) / F.col("total")).otherwise(F.col("below")).alias("p"))
    p = p.persist()
    p.count()
    pieces.unpersist()
    tables.unpersist()
    return p


def fit(docs: DataFrame, labels: DataFrame, trains: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """The models and their calibration; ``trains`` says which label rows may be used."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(labels, label_col, trains, per_class, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col)
    held = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(HELD)) == 0

    grams = texts.where(~held).select("text", "y").mapInArrow(lambda b: tidy(_count_sample(b)), "gram string, ordinary bigint, toxic bigint").groupBy("gram").agg(
        F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).persist()
    seen = grams.agg(F.sum("o").alias("o"), F.sum("t").alias("t")).first()
    if not (seen.o and seen.t):
        grams.unpersist()
        return Model()
    n = F.col("o") + F.col("t")
    contexts = grams.groupBy(head().alias("h")).agg(
        *[f.alias(name) for c in "ot" for f, name in ((F.sum(c), c), (F.sum((F.col(c) > 0).cast("long")), f"kinds_{c}"))]).where(n >= LEAST)
    known = grams.where(n >= LEAST).withColumn("tail", F.expr(f"right(gram, {SHARED})"))
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: tidy(_distinct_words(b)), "word string").distinct()
    shared = words.mapInArrow(lambda b: tidy(_count_words(b)), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    base = shared_model(shared, known.select("tail").distinct())
    model = Model(*map(collected, differences(contexts, known, base)))
    base.unpersist()
    grams.unpersist()
    sent = spark.sparkContext.broadcast(model)
    seen = texts.where(held).select("text", "y").mapInArrow(lambda b: tidy(_evidence(sent, b)), "y int, evidence double").toPandas()
    sent.destroy()
    every = {r.y: r.n for r in labels.where(trains).groupBy(F.col(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    model.slope, model.offset = calibrate(seen.evidence.to_numpy(), seen.y.to_numpy(), every)
    return model


def differences(contexts: DataFrame, known: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of known spellings and of back-off behind known contexts: log-probability if toxic less that if ordinary."""
    weight = {c: F.when(F.col(c) > 0, F.lit(DISCOUNT) * F.col(f"kinds_{c}") / F.col(c)).otherwise(1.0) for c in "ot"}
    contexts = contexts.select("h", *(F.greatest(F.col(c), F.lit(1)).alias(f"total_{c}") for c in "ot"), *(weight[c].alias(f"weight_{c}") for c in "ot"))
    p = {c: F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0)) / F.col(f"total_{c}") + F.col(f"weight_{c}") * F.col("p") for c in "ot"}
    grams = known.join(contexts, head() == F.col("h")).join(base, "tail").select("gram", (F.log(p["t"]) - F.log(p["o"])).alias("value"))
    return grams, contexts.select("h", (F.log("weight_t") - F.log("weight_o")).alias("value"))


def calibrate(evidence: np.ndarray, y: np.ndarray, every: dict[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve; classes weigh as often as they are labelled."""
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    r1, r0 = max(every.get(1) or 0, 1), max(every.get(0) or 0, 1)
    w = np.where(y == 1, r1 / n1, r0 / n0) * (len(y) / (r1 + r0))
    scale = float(np.std(evidence)) or 1.0
    x = np.stack([evidence / scale, np.ones(len(y))], axis=1)
    beta = np.array([1.0, math.log(r1 / r0)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - y)) + 0.05 * beta * (1, 0)
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-6])
        step = np.linalg.solve(bend, slope)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _evidence(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.evidences(batch.column(0).to_pylist()), pa.float64())], ["y", "evidence"])
    model.known.clear()


def _scores(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns, the text last, with evidence and score; a helper text column is dropped."""
    model = sent.value
    for batch in batches:
        evidence = model.evidences(batch.column(batch.num_columns - 1).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(evidence, pa.float64()), pa.array([model.score(e) for e in evidence], pa.float64())], [*batch.schema.names[:-1], "evidence", "score"])
    # the worker stays, with its copy of the model
    model.known.clear()


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all if None) with ``evidence`` and ``score``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c not in ("evidence", "score")]
    (text,) = fresh(docs, "_scored")
    rows = docs.select(*keep, F.col(text_col).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: tidy(_scores(sent, b)), f"{schema}{', ' if keep else ''}evidence double, score double")
