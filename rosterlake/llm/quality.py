"""Quality classifier: naive Bayes support vectors over character n-gram indicators.

The indicators of byte n-grams (2 to 4, hashed to CELLS cells), and of how many word bigrams are a word twice (in powers
of two), are scaled by the class log-count ratios, each text is
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve through
the margins of rows kept out of the descent turns margins into scores.

The fit takes at most about `sample` labelled rows, drawn by the hash of their id (a documented bound): their ids are
broadcast, so texts are not shuffled to find them. Their indicators, one row for each
id (of several texts under one id the one of least indicators counts), are written to the shared folder; those of least hash whose
cells are about `numbers` in all are gathered, four bytes a cell, so the driver's memory follows neither the rows nor the length
of texts. The descent runs until no step would move a margin by `tolerance`. Scoring is one narrow stage over all texts.

Defined cases: null and empty texts have no indicators and get the score of the bias; labels that are null or neither
0 nor 1 do not count; an id labelled twice counts with the mean, ties as 1; repeated documents are scored each; with
no labels, or labels of one class, every score is the share of label 1 (1/2 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, prepare, remainder, stored, table

CELLS = 1 << 20


def indicators(text: bytes | None, seen: np.ndarray) -> np.ndarray:
    """Sorted cells of the text's n-grams. `seen` is a scratch array of CELLS False values, left as it was."""
    b = np.frombuffer(text or b"", dtype=np.uint8).astype(np.uint32)
    h, cells = b, []
    for n in range(2, 5):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :] + np.uint32(n)
        cells.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(12))
    if len(b):
        words = text.split()
        cells.append(np.array([sum(map(eq, words, words[1:])).bit_length()], dtype=np.uint32))
    if not cells:
        return np.zeros(0, dtype=np.uint32)
    every = np.concatenate(cells)
    if len(every) < CELLS // 16:
        every.sort()
        return every[np.r_[True, every[1:] != every[:-1]]]
    seen[every] = True  # long texts: a look at all cells costs less than to sort theirs
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.uint32)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, CELLS), smooth)
    for cells, y in zip(rows, labels, strict=True):
        counts[int(y), cells] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, *, cost: float, rounds: int, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; weights already hold the ratios. The bias is one more feature.

    Minimises |w|^2 / 2 + bias^2 / 2 + sum of c_i * max(0, 1 - y_i * (w . x_i + bias)), where the classes weigh alike in c.
    """
    w, bias = np.zeros(CELLS), 0.0
    signs = np.where(labels > 0, 1.0, -1.0)
    values = [ratios[c] for c in rows]
    values = [(v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for v in values]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    share = signs.mean() / 2 + 0.5
    most = np.where(signs > 0, cost * min(4.0, 0.5 / share), cost * min(4.0, 0.5 / (1 - share)))
    for _ in range(rounds):
        most_off = 0.0
        for i in rng.permutation(len(rows)):
            c, v, y = rows[i], values[i], signs[i]
            gradient = y * (w[c] @ v + bias) - 1
            off = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == most[i] else gradient
            most_off = max(most_off, abs(off))
            new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])  # |x|^2 is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[c] += step * v
                bias += step
                alpha[i] = new
        if most_off < tolerance:
            break
    return w, bias


class QualityModel:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, *, cost: float = 4.0, rounds: int = 12):
        self.flat = float(labels.mean()) if len(labels) else 0.5
        self.trained = len(labels) > 0 and 0 < self.flat < 1
        if not self.trained:
            return
        kept_out = np.arange(len(rows)) % 5 == 4
        if len(set(labels[kept_out])) < 2 or len(set(labels[~kept_out])) < 2:
            kept_out[:] = False
        fit = np.flatnonzero(~kept_out)
        self.ratios = log_ratios([rows[i] for i in fit], labels[fit])
        self.weights, self.bias = descend([rows[i] for i in fit], labels[fit], self.ratios, cost=cost, rounds=rounds)
        rest = np.flatnonzero(kept_out) if kept_out.any() else fit
        self.slope, self.shift = logistic(np.array([self.margin(rows[i]) for i in rest]), labels[rest])

    def margin(self, cells: np.ndarray) -> float:
        v = self.ratios[cells]
        return float(self.weights[cells] @ v / max(np.linalg.norm(v), 1e-12) + self.bias)

    def score(self, cells: np.ndarray) -> float:
        if not self.trained:
            return self.flat
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cells) + self.shift, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a weak pull of the slope to 1."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum((p - y) * x) + 0.1 * (a - 1), np.sum(p - y) + 1e-3 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[np.sum(q * x * x) + 0.1, np.sum(q * x)], [np.sum(q * x), np.sum(q) + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, numbers: int = 1 << 24) -> QualityModel:
    """Fits on about `sample` of the labelled rows (doc_id, label) at most, of about `numbers` cells in all."""
    prepare(docs.sparkSession)
    good = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    total = good.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = good if total <= sample else good.filter(place < int((1 << 30) * sample / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, dtype=bool)
        for batch in batches:
            cells = [indicators(x, seen).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, type=pa.binary())], names=["id", "y", "cells"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(drawn), "id").select("id", "y", "text")
    each = stored(rows.mapInArrow(run, "id long, y int, cells binary").groupBy("id", "y").agg(F.min("cells").alias("cells")), "indicators")
    # the rows of least hash before which `numbers` cells have been met; a window over the sample, without its cells
    size = F.length("cells") / 4
    before = Window.orderBy("place", "id", "y").rowsBetween(Window.unboundedPreceding, -1)
    sizes = each.select("id", "y", place.alias("place"), size.alias("size")).withColumn("met", F.coalesce(F.sum("size").over(before), F.lit(0.0)))
    kept = sizes.filter(F.col("met") < numbers).select(F.col("id").alias("_id"), F.col("y").alias("_y"))
    got = each.join(F.broadcast(kept), F.col("id").eqNullSafe(F.col("_id")) & F.col("y").eqNullSafe(F.col("_y")), "left_semi")
    got = sorted((r["id"], r["y"], bytes(r["cells"])) for r in got.collect())
    return QualityModel([np.frombuffer(c, dtype=np.uint32) for _, _, c in got], np.array([y for _, y, _ in got], dtype=float))


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", keep=None) -> DataFrame:
    """`keep` (default: all columns) with the score."""

    def make():
        seen = np.zeros(CELLS, dtype=bool)
        return lambda texts: [[model.score(indicators(x, seen)) for x in texts]]

    return map_texts(docs, text, make, "quality_score double", keep=keep)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    got = score(docs, model, keep=[F.col("doc_id")])
    held = remainder(F.col("doc_id"), 5) == 0
    return got.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
