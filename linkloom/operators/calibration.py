"""Score calibration: fitting on labelled scores, applying, and how good the probabilities are."""

from __future__ import annotations

import datetime
import json
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ISOTONIC_FROM = 500
LEAST_LABELS = 20


@dataclass(frozen=True)
class Identity:
    def apply(self, score: Column) -> Column:
        return score

    def to_json(self) -> str:
        return json.dumps({"type": "identity"})


@dataclass(frozen=True)
class Platt:
    """1 / (1 + exp(a s + b)) of the score clamped to 0 to 1."""

    a: float
    b: float

    def apply(self, score: Column) -> Column:
        clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
        return 1 / (1 + F.exp(F.lit(self.a) * clamped + F.lit(self.b)))

    def to_json(self) -> str:
        return json.dumps({"type": "platt", "a": self.a, "b": self.b})


@dataclass(frozen=True)
class Isotonic:
    """Linear between the blocks' last scores, constant outside them."""

    scores: tuple[float, ...]
    probs: tuple[float, ...]

    def apply(self, score: Column) -> Column:
        """By an array of blocks and a binary search, so that the expression's size does not grow with the blocks."""
        blocks = F.lit([float(x) for x in self.scores]), F.lit([float(p) for p in self.probs])
        n = len(self.scores)
        if n == 1:
            return F.when(score.isNotNull(), F.lit(self.probs[0]))
        # the number of blocks below the score
        halves = F.lit([1 << k for k in range(n.bit_length() - 1, -1, -1)])
        item = lambda items, i: F.get(items, i)
        at = F.aggregate(halves, F.lit(0), lambda low, step: F.when((low + step <= n) & (item(blocks[0], low + step - 1) < score), low + step).otherwise(low))

        def value(i: Column) -> Column:
            x0, x1, p0, p1 = item(blocks[0], i - 1), item(blocks[0], i), item(blocks[1], i - 1), item(blocks[1], i)
            between = p0 + (score - x0) * ((p1 - p0) / (x1 - x0))
            return F.when(i == 0, F.lit(self.probs[0])).when(i == n, F.lit(self.probs[-1])).otherwise(between)

        return F.when(score.isNotNull(), F.get(F.transform(F.array(at), value), F.lit(0)))

    def to_json(self) -> str:
        return json.dumps({"type": "isotonic", "scores": self.scores, "probs": self.probs})


Calibrator = Identity | Platt | Isotonic


def from_json(text: str) -> Calibrator:
    data = json.loads(text)
    kinds = {"identity": lambda: Identity(), "platt": lambda: Platt(data["a"], data["b"]), "isotonic": lambda: Isotonic(tuple(data["scores"]), tuple(data["probs"]))}
    return kinds[data["type"]]()


def fit_platt(score: np.ndarray, match: np.ndarray, weight: np.ndarray, stuck: bool = False) -> Platt:
    """Newton's method on the smoothed targets, at most ten steps, with a and b kept within 10 of zero.

    ``stuck`` gives what a search in the direction of growing loss gives: a = b = 0.
    """
    if stuck:
        return Platt(0.0, 0.0)
    positive, negative = float(weight[match == 1].sum()), float(weight[match == 0].sum())
    target = np.where(match == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.column_stack((score, np.ones(len(score))))
    at = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = np.clip(x @ v, -700, 700)
        return float((weight * (np.logaddexp(0, z) - (1 - target) * z)).sum())

    for _ in range(10):
        p = 1 / (1 + np.exp(np.clip(x @ at, -700, 700)))
        gradient = x.T @ (weight * (target - p))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x
        if abs(np.linalg.det(hessian)) < 1e-10:
            break
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-10 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    a, b = np.clip(at, -10, 10)
    return Platt(float(a), float(b))


def fit_isotonic(score: np.ndarray, matches: np.ndarray, total: np.ndarray) -> Isotonic:
    """Pool adjacent violators over distinct scores with their matches and totals; a block stands at its last score."""
    blocks: list[list[float]] = []  # last score, matches, total
    for s, m, n in sorted(zip(score.tolist(), matches.tolist(), total.tolist(), strict=True)):
        blocks.append([s, m, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2] + 1e-9:
            last = blocks.pop()
            blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return Isotonic(tuple(b[0] for b in blocks), tuple(b[1] / b[2] for b in blocks))


def fit(observed: DataFrame, score: str = "score", match: str = "is_match", stuck: bool = False, isotonic_from: int = ISOTONIC_FROM) -> Calibrator:
    """Platt up to 499 labels, isotonic from ``isotonic_from`` on; an error without labels or with one class only.

    The driver gets one row per distinct score, which rounding to four decimals bounds at 10,001.
    """
    rows = observed.groupBy(F.round(F.col(score), 4).alias("s")).agg(F.sum(F.col(match).cast("int")).alias("m"), F.count("*").alias("n")).orderBy("s").collect()
    s, m, n = (np.array([r[c] for r in rows], float) for c in ("s", "m", "n"))
    if not n.sum():
        raise ValueError("no labels to fit")
    if m.sum() in (0, n.sum()):
        raise ValueError("labels of one class only")
    if n.sum() >= isotonic_from:
        return fit_isotonic(s, m, n)
    return fit_platt(np.concatenate((s, s)), np.repeat((1, 0), len(s)), np.concatenate((m, n - m)), stuck)


def brier(observed: DataFrame, p: Column, y: Column) -> DataFrame:
    """One row: mean squared difference, 0 without rows."""
    return observed.agg(F.coalesce(F.avg((p - y) * (p - y)), F.lit(0.0)).alias("brier"))


def reliability(observed: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y over equal widths; the last bin is closed."""
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")
    return observed.groupBy(at).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(observed: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """One row: differences of the bins' means, weighted by their rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")
    return reliability(observed, p, y, bins).agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def is_monotonic(points: DataFrame, x: str = "score", y: str = "p") -> DataFrame:
    """One row: whether y never falls as x grows, with a small tolerance. Points are a calibrator's, at most 10,001."""
    drop = F.lag(y).over(Window.orderBy(x)) > F.col(y) + 1e-9
    return points.select(drop.alias("drop")).agg((F.count_if("drop") == 0).alias("monotonic"))


def fit_and_measure(observed: DataFrame) -> dict:
    """Fit on what is not held out; Brier score and calibration error before and after on the rest. Needs 20 labels."""
    if observed.limit(LEAST_LABELS).count() < LEAST_LABELS:
        raise ValueError(f"calibration needs {LEAST_LABELS} labels")
    model = fit(observed.filter("NOT held_out"))
    rest, y = observed.filter("held_out"), F.col("is_match")
    raw, new = F.col("score"), model.apply(F.col("score"))
    out = {"model": model}
    for name, p in (("before", raw), ("after", new)):
        out[f"brier_{name}"] = brier(rest, p, y).first()[0]
        out[f"ece_{name}"] = expected_calibration_error(rest, p, y).first()[0]
    return out


MODEL = "model_id string, created_at timestamp, fitted_by string, batch_id string, observations long, positives long, brier double, ece double, model string, active boolean"


def save_model(spark: SparkSession, path: str, model: Calibrator, active: bool = True, **details) -> str:
    """Append a model to the store under ``path``; rows are never changed. An active one takes the place of that before it."""
    now = datetime.datetime.now(datetime.timezone.utc)
    row = {"model_id": f"calib-{time.time_ns()}", "created_at": now, "model": model.to_json(), "active": active} | details
    names = [f.split()[0] for f in MODEL.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], MODEL).coalesce(1).write.mode("append").parquet(path)
    return row["model_id"]


def models(spark: SparkSession, path: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The store's history, newest first, then by larger identifier; of the models saved as active only the last one is."""
    return history(spark.read.schema(MODEL).parquet(path)).orderBy(F.desc("created_at"), F.desc("model_id")).offset(max(offset, 0)).limit(limit if limit > 0 else 20)


def history(saved: DataFrame) -> DataFrame:
    """Saved models, of which the last that was saved as active is the active one."""
    last = saved.filter("active").agg(F.max(F.struct("created_at", "model_id")).alias("last"))
    return saved.join(F.broadcast(last)).withColumn("active", F.coalesce(F.struct("created_at", "model_id") == F.col("last"), F.lit(False))).drop("last")  # one row


def active(saved: DataFrame) -> DataFrame:
    """The active model, or no row."""
    return history(saved).filter("active")


def activate(models: DataFrame, model_id: str) -> DataFrame:
    """The model table with one active row."""
    return models.withColumn("active", F.col("model_id") == model_id)
