"""Quality classifier by co-training: one view reads the text, the other the document's metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, hold, split_words

SOURCES, LANGS, SIZES = 64, 16, 24  # hash slots of the source and the language, powers of two of the size


@dataclass(frozen=True)
class CoTraining:
    """How much is sampled and exchanged. Both samples are bounded in rows whatever the size of the tables."""

    labelled_rows: int = 12_000  # labelled documents that the views are fitted on, drawn by a hash of the key
    pool_rows: int = 12_000  # further documents for pseudo-labels, drawn the same way
    held_out: float = 0.25  # of the labelled rows: for calibration and for combining the views
    rounds: int = 4
    exchange: int = 400  # pseudo-labels of each class that a view hands over in a round, at most
    sure: float = 0.97  # probability from which a pseudo-label is confident
    ridge: float = 1.0
    threshold: float = 0.5  # a document that scores less is rejected


def text_features(text: Column) -> Column:
    """The text view: twelve shares and logarithms, each bounded, computed inside the row."""

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        same = F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1)))
        return F.array(F.log1p(F.size(w).cast("double")), F.size(F.array_distinct(w)) / n, same / n)

    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    solid = F.length(F.regexp_replace(t, WHITE, ""))
    stats = F.array(
        count("#*$%&|<>") / n, count("|•»") / n, count("0123456789") / n, count(".!?") / n, count(",;:") / n,
        count("\n") / n, solid / n, F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
    )
    words = F.transform(F.array(split_words(text)), of_words)[0]
    return F.transform(F.concat(words, stats), lambda x: x.cast("double"))


def meta_slots(source: Column, lang: Column, size: Column) -> Column:
    """The metadata view: one slot for the source, one for the language, one for the size's power of two."""
    slot = lambda c, n: F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n)).cast("int")
    power = F.floor(F.log2(F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)).cast("int")
    return F.array(slot(source, SOURCES), slot(lang, LANGS) + SOURCES, F.least(power, F.lit(SIZES - 1)) + SOURCES + LANGS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression, the last one free of the ridge, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Log-odds of good quality: text weights on raw features, metadata weights by slot, and how the views are combined."""

    text: tuple[float, ...]  # weights, then the constant; calibrated
    meta: tuple[float, ...]
    combine: tuple[float, float, float]


def learn(text: np.ndarray, slots: np.ndarray, label: np.ndarray, folds: np.ndarray, how: CoTraining) -> Model | None:
    """Fit both views. ``label`` is 1, 0 or -1 for none; ``folds`` in [0, 1) picks the held-out rows. None without both classes."""
    known, kept_back = label >= 0, folds < how.held_out
    fit, held, pool = known & ~kept_back, known & kept_back, ~known
    if any(len(np.unique(label[part])) < 2 for part in (fit, held)):
        return None
    mean, scale = text[fit].mean(axis=0), text[fit].std(axis=0) + 1e-9
    meta = np.zeros((len(slots), SOURCES + LANGS + SIZES))
    meta[np.arange(len(slots))[:, None], slots] = 1
    views = [(text - mean) / scale, meta]
    labels = [np.where(fit, label, -1) for _ in views]
    for turn in range(how.rounds + 1):
        weights, odds = [], []
        for x, y in zip(views, labels):
            used = y >= 0
            w = _logistic(x[used], y[used], how.ridge)
            z = x @ w[:-1] + w[-1]
            a, b = _logistic(z[held][:, None], label[held], 0.01)  # calibration on rows that no view was fitted on
            weights.append((np.append(w[:-1] * a, w[-1] * a + b)))
            odds.append(a * z + b)
        if turn == how.rounds:
            break
        for mine, other in ((0, 1), (1, 0)):  # confident labels of one view teach the other
            p = _sigmoid(odds[mine])
            for value, sure in ((1, p), (0, 1 - p)):
                new = np.flatnonzero(pool & (labels[other] < 0) & (sure >= how.sure))
                new = new[np.argsort(-sure[new], kind="stable")][: how.exchange]
                labels[other][new] = value
    both = _logistic(np.column_stack([z[held] for z in odds]), label[held], 0.1)
    both[:2] = np.maximum(both[:2], 0)  # a view that says nothing counts nothing
    w = weights[0]
    raw = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    return Model(tuple(map(float, raw)), tuple(map(float, weights[1])), tuple(map(float, both)))


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    blank = F.lit(None).cast("string")
    meta = [F.col(c) if c in docs.columns else blank for c in ("source", "lang", "n_chars")]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), meta_slots(*meta).alias("slots"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", how: CoTraining = CoTraining()) -> Model | None:
    """Fit on bounded samples of labelled and other documents; every row has the same chance, by a hash of its key.

    ``labels`` holds key and quality (1 good, 0 bad). Rows without key or label
    are ignored; a document with several labels counts as good if all are 1, and of
    rows that repeat a key the one with the smallest features is taken.
    """
    share = lambda n, rows: int(2**30 * min(1.0, rows / max(n, 1)))
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(2**30))
    marks = labels.select(F.col(key).alias("k"), F.col("quality").cast("int").alias("q")).filter("k is not null and q in (0, 1)")
    marks = marks.groupBy("k").agg(F.min("q").alias("q"))
    chosen = marks.filter(draw(1) < share(marks.count(), how.labelled_rows))
    rows = _columns(docs, key, text).filter("k is not null")
    rows = rows.join(F.broadcast(chosen), "k", "left")  # at most about labelled_rows rows
    sample = rows.filter(F.col("q").isNotNull() | (draw(2) < share(docs.count(), how.pool_rows)))
    sample = sample.select("k", "q", "slots", text_features(F.col("t")).alias("f"), (draw(3) / 2**30).alias("fold"))
    got = sample.groupBy("k").agg(F.min(F.struct("q", "slots", "f", "fold")).alias("x")).select("k", "x.*").orderBy("k").toPandas()
    if not len(got):
        return None
    return learn(np.array(got["f"].tolist()), np.array(got["slots"].tolist()), got["q"].fillna(-1).to_numpy(int), got["fold"].to_numpy(), how)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", how: CoTraining = CoTraining()) -> DataFrame:
    """Per row of ``docs``: key, text_score, meta_score, score (probabilities of good quality) and kept.

    Everything is computed inside the row. Null texts and null or missing metadata
    have defined features; without a model (no labels of both kinds) all scores
    are null and every document is kept.
    """
    rows = _columns(docs, key, text)
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")]
        return rows.select(F.col("k").alias(key), *none, F.lit(True).alias("kept"))
    rows = rows.select("k", "slots", text_features(F.col("t")).alias("f"))
    z = F.lit(model.text[-1])
    for i, w in enumerate(model.text[:-1]):
        z = z + F.col("f")[i] * F.lit(w)
    slot = F.array(*map(F.lit, model.meta[:-1]))
    m = F.lit(model.meta[-1])
    for i in range(3):
        m = m + F.get(slot, F.col("slots")[i])
    rows = rows.select("k", z.alias("zt"), m.alias("zm"))
    a, b, c = model.combine
    odds = F.lit(a) * F.col("zt") + F.lit(b) * F.col("zm") + F.lit(c)
    p = lambda x: 1 / (1 + F.exp(-x))
    rows = rows.select(F.col("k").alias(key), p(F.col("zt")).alias("text_score"), p(F.col("zm")).alias("meta_score"), p(odds).alias("score"))
    return rows.withColumn("kept", F.col("score") >= how.threshold)


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", how: CoTraining = CoTraining()) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    whole, body = free_name(docs, "__row"), free_name(docs, "__body")
    extra = [F.col(c) for c in ("source", "lang", "n_chars") if c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(text).alias(body), *extra)
    return hold(score(rows, model, whole, body, how), "kept").filter("kept").select(*[F.col(whole)[c].alias(c) for c in docs.columns])
