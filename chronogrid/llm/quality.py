"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good texts, the rest of the web text is unlabelled. A linear model on text statistics
minimises the non-negative unbiased risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-)); the class prior pi is estimated from a
first positive-against-unlabelled fit: any set of texts holds at least pi times its share of the positives among the
unlabelled, so the least ratio over score thresholds bounds pi.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name, held_out
from chronogrid.shared import materialise

#: Rows of each of the two samples for the gradient steps.
SAMPLE_ROWS = 12_000
SYMBOLS = "!?.,;:'\"()[]{}<>|/\\#$%&*+-=_@^~`"
WORD = re.compile(r"\S+")
#: Characters in a window of the local statistics.
WINDOW = 4096


def _table() -> np.ndarray:
    """Class of each code point up to U+FFFF: 0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 space, 6.. symbols."""
    held = getattr(_table, "held", None)
    if held is None:
        held = np.zeros(1 << 16, dtype=np.uint8)
        for c in range(1 << 16):
            s = chr(c)
            held[c] = 1 if s.islower() else 2 if s.isupper() else 3 if s.isalpha() else 4 if s.isdigit() else 5 if s.isspace() else 0
        for i, s in enumerate(SYMBOLS):
            held[ord(s)] = 6 + i
        _table.held = held
    return held


N_CLASS = 6 + len(SYMBOLS)
#: Features of a text.
WIDTH = N_CLASS + 22


def features(text: str | None) -> np.ndarray:
    """Statistics of the whole text; all zero but the first for an empty one."""
    text = text or ""
    out = np.zeros(WIDTH)
    n = len(text)
    out[0] = math.log1p(n)
    if not n:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _table()[np.minimum(points, 0xFFFF)]
    share = np.bincount(kind, minlength=N_CLASS) / n
    out[1 : 1 + N_CLASS] = np.sqrt(share)
    at = 1 + N_CLASS
    space = kind == 5
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True])
    words = max(len(starts), 1)
    if len(starts):
        length = ends - starts + 1
        upper = np.add.reduceat((kind == 2).astype(np.int32), starts)
        letters = np.add.reduceat(((kind >= 1) & (kind <= 3)).astype(np.int32), starts)
        symbols = np.add.reduceat((kind >= 6).astype(np.int32), starts)
        out[at : at + 10] = [
            length.mean() / 10, length.std() / 10, (length > 20).mean(), (length <= 2).mean(), (upper == length - symbols)[letters > 1].mean() if (letters > 1).any() else 0,
            (symbols > 0).mean(), (symbols > 1).mean(), (letters == 0).mean(), (kind[ends] >= 6).mean(), math.log1p(words),
        ]
        # repetition: of words, of word pairs, of four-word runs
        lower = text.split()
        ids: dict[str, int] = {}
        codes = np.array([ids.setdefault(w, len(ids)) for w in lower], dtype=np.int64)
        k = len(codes)
        out[at + 10] = len(ids) / k
        out[at + 11] = math.log1p(len(ids)) / math.log1p(k)
        if k >= 8:
            four = ((codes[:-3] * 1_000_003 + codes[1:-2]) * 1_000_003 + codes[2:-1]) * 1_000_003 + codes[3:]
            out[at + 12] = 1 - len(np.unique(four)) / len(four)
        top = np.bincount(codes)
        out[at + 13] = top.max() / k
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[at + 14] = 1 - len(set(lines)) / len(lines)
        out[at + 15] = len(lines) / words
        out[at + 16] = sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines)
        out[at + 17] = math.log1p(n / len(lines)) / 5
    out[at + 18] = np.mean(kind[1:] == kind[:-1]) if n > 1 else 0
    out[at + 19] = np.mean(points[1:] == points[:-1]) if n > 1 else 0
    out[at + 20] = np.mean(points > 127)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.abs(z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -40, 40)))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on (weights, bias)."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _apart(p: np.ndarray, u: np.ndarray, keep: np.ndarray, l2: float) -> np.ndarray:
    """Weights that tell positives from unlabelled rows."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + l2 * w * keep

    return _descend(gradient, p.shape[1], 200, 0.05)


def _estimated_prior(scored: DataFrame) -> float:
    """scored: (margin, positive) of all training rows. The least share of unlabelled over that of positives among the best
    scored; few rows make it noisy."""
    marks = scored.filter("positive").agg(F.percentile_approx("margin", [float(1 - q) for q in np.linspace(0.02, 0.6, 30)], 10_000)).first()[0]
    above = [F.sum((F.col("margin") >= float(m)).cast("long")) for m in marks]
    rows = {r["positive"]: r for r in scored.groupBy("positive").agg(F.count("*").alias("n"), F.array(*above).alias("above")).collect()}
    n = rows[True]["n"] + rows.get(False, {"n": 0})["n"]
    unlabelled = np.array(rows[True]["above"]) + (np.array(rows[False]["above"]) if False in rows else 0)
    ratios = (unlabelled / n + math.sqrt(1 / n)) / (np.array(rows[True]["above"]) / rows[True]["n"])
    return float(np.clip(ratios.min(), 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, model: Model, prior, l2: float = 3e-2) -> Model:
    """positive, unlabelled: feature rows, for the gradient steps. model: with the moments of all rows. prior: a function of
    the weights that tell the two apart."""
    p, u = (np.hstack([model.expand(x), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    keep = np.ones(p.shape[1])
    keep[-1] = 0
    w = _apart(p, u, keep, l2)
    model.weights, model.bias = w[:-1], float(w[-1])
    prior = model.prior = prior(model)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()  # noqa: E731  of calling it negative
        negative_u, negative_p = u.T @ su / len(u), p.T @ sp / len(p)
        rest = loss(su) - prior * loss(sp)
        if rest < 0:  # over-fitted: climb back on the negative part
            return -(negative_u - prior * negative_p)
        return -prior * (p.T @ (1 - sp) / len(p)) + negative_u - prior * negative_p + l2 * w * keep

    w = _descend(risk, p.shape[1], 500, 0.03)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def _matrix(rows: DataFrame) -> np.ndarray:
    got = rows.select("x").toPandas()["x"]
    return np.vstack(list(got)) if len(got) else np.zeros((0, WIDTH))


def _margins(model: Model):
    @F.pandas_udf("double")
    def look(rows: pd.Series) -> pd.Series:
        return pd.Series(model.expand(np.vstack(list(rows))) @ model.weights + model.bias if len(rows) else [], dtype=float)

    return look


def feature_column(text_col: str) -> Column:
    """The features of each text, of all of it."""

    @F.pandas_udf("array<double>")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return look(F.col(text_col))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """rows (luck long, positive boolean, x array): all training rows.

    Feature moments and the class prior come from all of them; the gradient steps use two samples of about ``sample_rows``,
    chosen by luck. Without any positive, or any row, every score is 0.5.
    """
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 0.5)
    moments = rows.select("positive", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n"), F.count_if("positive").alias("p")).collect()
    if not moments or not moments[0]["p"]:
        return model
    for r in moments:
        model.mean[r["i"]], model.scale[r["i"]] = r["m"], r["s"] + 1e-3
    share = F.pmod("luck", F.lit(1 << 24)) / float(1 << 24)
    n, positives = moments[0]["n"], moments[0]["p"]
    p = _matrix(rows.filter("positive").filter(share < sample_rows / positives).orderBy("luck", "x"))
    u = _matrix(rows.filter(share < sample_rows / n).orderBy("luck", "x"))
    if not len(p) or not len(u):
        return model
    return fit_pu(p, u, model, lambda m: _estimated_prior(rows.select("positive", _margins(m)("x").alias("margin"))))


def _scored(rows: DataFrame, x: str, model: Model, keep: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def look(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.vstack(list(x))) if len(x) else [], dtype=float)

    seen = free_name(rows, "_seen")
    return rows.withColumn(seen, look(F.col(x))).select(*keep, F.col(seen).alias("score"), F.when(F.col(seen) >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the text, with held_out, score and predicted: fitted outside the held-out fold, every row scored.

    Texts are read once, into a written table of features. labels: (id, quality); null labels and ids teach nothing, and of
    an id's differing labels 1 counts. Null texts count as empty; equal texts get equal scores; repeated rows stay; an empty
    table gives an empty result; columns with the names given here are replaced.
    """
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("held_out", "score", "predicted")]
    x, good, luck = free_name(docs, "_x"), free_name(docs, "_good"), free_name(docs, "_luck")
    seen = docs.select(*keep, held_out(id_col).alias("held_out"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)).alias(luck), feature_column(text_col).alias(x))
    seen = materialise(seen)
    marked = labels.filter((F.col("quality") == 1) & ~held_out(id_col)).select(F.col(id_col).alias(good)).dropna().distinct()
    train = seen.filter("not held_out").join(marked, F.col(id_col) == F.col(good), "left")
    train = materialise(train.select(F.col(luck).alias("luck"), F.col(good).isNotNull().alias("positive"), F.col(x).alias("x")))
    return _scored(seen, x, fit(train, sample_rows), [*keep, "held_out"])
