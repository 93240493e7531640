"""Quality scores: ridge regression on random Fourier features of document statistics.

Statistics of the whole text (lengths, kinds of characters, repeated words and lines,
word ends) are standardised and mapped by random Fourier features, whose inner product
approximates a Gaussian kernel. The ridge weights solve the normal equations, which are
summed per partition and then by cell, so the driver gets a matrix of fixed size. The
raw scores of rows kept from the regression then fit an isotonic curve, on counts by
score bin, and the curve, made strictly increasing by interpolation, gives scores from
0 to 1.

Labels are read only for rows whose crc32(id as text) mod 3 is not 1. Of those, one in
``CALIBRATE`` by another hash of the id fits the curve, the rest fit the weights; all of
them are used, without a sample.

Defined results. A null text is an empty one and is scored like any text. A document
with several labels counts once for each; null labels and null ids count not at all.
Without labels of both kinds every score is the share of label 1, or 0.5 without any.
Rows that repeat are scored each; their order does not matter. An empty table gives no
rows. Columns other than id and text are never read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scriptorium.llm.lean import release
from scriptorium.plans.workspace import Workspace

#: Random features, ridge penalty, bins of the isotonic fit; one labelled row in CALIBRATE fits the curve.
FEATURES, RIDGE, BINS, CALIBRATE = 256, 1.0, 512, 5
SEED = 20240229

_KIND = np.full(256, 7, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[*b"0123456789"]] = 2
_KIND[[*b" \t\r\f\v"]] = 3
_KIND[[10]] = 4
_KIND[[*b".,;:'\"()-"]] = 5
_KIND[[*b"!?"]] = 6
_KIND[128:192] = 8  # further bytes of a character
_KIND[192:] = 9  # letters beyond ASCII, mostly

N_STATS = 20


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    text = text or ""
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=10).astype(float)
    chars = max(1.0, kinds.sum() - kinds[8])
    words = text.split()
    n = max(1, len(words))
    count = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = Counter([w[-2:] for w in words])
    odd = sum(k for e, k in ends.items() if len(e) == 2 and not e.isalnum() and not e[0].isalnum())
    lines = [x for x in text.split("\n") if x]
    bare = sum(k for w, k in count.items() if not any(map(str.isalnum, w)))
    half = words[: len(words) // 2]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        kinds[0] / chars, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[5] / chars, kinds[6] / chars, kinds[7] / chars, kinds[9] / chars,
        len(count) / n, max(count.values(), default=0) / n, odd / n, bare / n,
        len(set(lines)) / max(1, len(lines)), len(set(words[len(words) // 2 :]).intersection(half)) / max(1, len(count)),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    out = texts.map(statistics)
    release()
    return out


@dataclass(frozen=True)
class Model:
    """A fitted scorer; all arrays are small and of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase), np.ones(len(z))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)

    def column(self, text: Column, measured: bool = False) -> Column:
        """The score of each text, or of its statistics where these are ``measured``."""
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            out = pd.Series(model.scores(np.array([x if measured else statistics(x) for x in texts]).reshape(-1, N_STATS)))
            release()
            return out

        return score(text)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean x, mean y) of the pools, for x in ascending order."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def held_out(id_: Column) -> Column:
    """True for rows whose labels are never read."""
    return F.crc32(id_.cast("string")) % 3 == 1


def _equations(model: Model):
    size = len(model.phase) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                total += z.T @ np.c_[z, np.array(batch.column(1).to_pylist(), float)]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], ["row", "cells"])

    return sums


def measure(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids and, in place of the texts, their statistics, written once for fitting and scoring."""
    return Workspace(spark, "quality").save(docs.select(id_col, _statistics(F.col(text_col)).alias(text_col)), "statistics", 1000)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE, measured: bool = False) -> Model:
    """Fit on the documents that have a label and are not held out. measured: docs is what measure() gave."""
    ws = Workspace(spark, "quality")
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null").where(~held_out(F.col("id")))
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", (F.col("t") if measured else _statistics("t")).alias("x"))
    rows = ws.save(x.join(y, "id").select("id", "x", "y", (F.pmod(F.xxhash64("id"), F.lit(CALIBRATE)) == 0).alias("curve")), "rows", 1000)

    moments = [f(F.element_at("x", i + 1)) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    *m, n, share = rows.agg(*moments, F.count("*"), F.avg("y")).first()
    rng = np.random.default_rng(SEED)
    frequency, phase = rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, features)
    level = 0.5 if share is None else float(share)
    flat = Model(np.zeros(N_STATS), np.ones(N_STATS), frequency, phase, np.zeros(features + 1), np.array([0.0]), np.array([level]))
    if not n or level in (0.0, 1.0):
        return flat
    mean, scale = np.array(m[0::2]), np.array(m[1::2])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), frequency, phase, flat.weights, flat.knots, flat.levels)

    size = features + 1
    summed = rows.where("not curve").select("x", "y").mapInArrow(_equations(model), "row int, cells array<double>")
    cells = summed.select("row", F.posexplode("cells").alias("column", "cell")).groupBy("row", "column").agg(F.sum("cell").alias("cell"))
    got = cells.toPandas()  # (features + 1) * (features + 2) rows at any input size
    full = np.zeros((size, size + 1))
    full[got["row"], got["column"]] = got["cell"]
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(full[:, :-1] + penalty, full[:, -1])
    model = Model(model.mean, model.scale, frequency, phase, weights, flat.knots, flat.levels)

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(x.tolist()).reshape(-1, N_STATS)))

    at = F.least(F.greatest(F.floor((F.col("r") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    bins = rows.where("curve").select(raw("x").alias("r"), "y").groupBy(at.alias("bin")).agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if not len(bins):
        return Model(model.mean, model.scale, frequency, phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(bins["r"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    low, high = min(knots[0], 0.0) - 1.0, max(knots[-1], 1.0) + 1.0
    return Model(model.mean, model.scale, frequency, phase, weights, np.r_[low, knots, high], np.r_[0.0, np.clip(levels, 1e-6, 1 - 1e-6), 1.0])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", measured: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. measured: docs is what measure() gave."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), model.column(F.col(text_col), measured).alias("score"))
    return x.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least one half, all columns."""
    return docs.where(model.column(F.col(text_col)) >= 0.5)
