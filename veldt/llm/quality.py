"""Quality scores by Bradley-Terry pairwise ranking.

Every text gets surface features. Labelled documents give preference pairs (one of label 1 before one of label
0), and weights are learned by logistic loss on the differences of their features. A document's raw score is
linear in its features; the threshold is the quantile of the labelled scores that parts the labels best, and raw
scores are moved so that it lies at CUT.

Every label and all pairs are learned from: the sums over pairs take time linear in the rows (pairwise.py). Up to LOCAL labelled rows
are fitted on the driver; more stay where they are, and only sums by intervals of scores reach it. Scoring covers every document.
Without labels of both kinds every document scores the cut.

Nulls: a null text is empty and is scored like one; labels that are null or neither 0 nor 1 are not used; a document
without id learns nothing and is not held out; of several rows under one id the first by features learns. Repeated rows are repeated, an empty table gives no rows, other columns are
not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.order import global_running
from veldt.llm import pairwise
from veldt.llm.common import cut, discard, table
from veldt.llm.features import NAMES, dense
from veldt.llm.textops import map_text

#: Labelled rows that the driver fits itself; the sums are the same either way.
LOCAL = 20_000
#: Tasks that add up the tasks' sums before the driver gets them.
ADDERS = 8
CUT = 0.7
RIDGE = 1e-3


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(x: np.ndarray, y: np.ndarray, pairs: int | None = None, seed: int = 5) -> Ranking:
    """Weights by Newton steps on the logistic loss of all pairs (of so many drawn ones, where pairs is given), and the threshold at the best quantile."""
    width = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _undecided(width)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-4)
    z = (x - mean) / scale
    if pairs is None:
        w = pairwise.minimum(width, lambda fn, *args: fn(z, y, *args), RIDGE)
    else:
        w = _drawn(z, good, bad, pairs, seed)
    s = z @ w
    return Ranking(mean, scale, w, _threshold(s, y))


def _undecided(width: int) -> Ranking:
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def _drawn(z: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    width = z.shape[1]
    w = np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        slope = RIDGE * w - d.T @ (1 - p) / pairs
        bend = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The score with the best mean of both labels' hit rates, among all of them; the middle one of equals."""
    at = np.unique(s)
    good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
    right = np.searchsorted(bad, at, "left") * len(good) - np.searchsorted(good, at, "left") * len(bad)
    best = np.flatnonzero(right == right.max())
    return float((at[best[-1]] + at[max(best[0] - 1, 0)]) / 2)


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    def fn(texts):
        x = dense(texts).astype(np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))]

    return map_text(docs, keep, fn, [("x", "array<float>", pa.list_(pa.float32()))])


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y of every labelled row."""
    return labels.select("doc_id", F.col(f"`{column}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()


def _arrays(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of rows with y and x."""
    return b["x"].flatten().to_numpy().reshape(b.num_rows, -1).astype(float), b["y"].to_numpy()


def _sums(rows: DataFrame, fn) -> pairwise.Sums:
    """fn(x, y), arrays by number, added up over all rows: in each task, then in ADDERS tasks, then here. Always in the same order."""
    names = ["part", "key", "width", "v"]

    def out(part, total):
        arrays = [pa.array([part] * len(total), pa.int64()), pa.array(list(total), pa.int64()), pa.array([v.shape[-1] for v in total.values()], pa.int64()), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names)

    def add(total, key, v):
        total[key] = total[key] + v if key in total else v

    def each(batches):
        total = {}
        for b in batches:
            for key, v in fn(*_arrays(b)).items():
                add(total, key, v)
        yield out(TaskContext.get().partitionId(), total)

    def merge(batches):
        found = []
        for b in batches:
            at, v = b["v"].offsets.to_numpy(), b["v"].values.to_numpy()
            found += zip(b["part"].to_pylist(), b["key"].to_pylist(), (v[i:j].reshape(-1, n) for i, j, n in zip(at[:-1], at[1:], b["width"].to_pylist(), strict=True)), strict=True)
        total = {}
        for _, key, v in sorted(found, key=lambda r: r[:2]):
            add(total, key, v)
        return total

    def again(batches):
        yield out(TaskContext.get().partitionId(), merge(batches))

    schema = "part long, key long, width long, v array<double>"
    return merge(rows.mapInArrow(each, schema).repartition(ADDERS).mapInArrow(again, schema).toArrow().to_batches())


def fit_table(rows: DataFrame) -> Ranking:
    """fit() on a table of y and x (an array) that stays where it is. It is read several times a step."""
    n = _sums(rows, lambda x, y: {int(k): np.vstack([np.full(x.shape[1], (y == k).sum()), x[y == k].sum(0)]) for k in np.unique(y)})
    if set(n) != {0, 1}:
        return _undecided(len(NAMES))
    (bad, *_), (good, *_) = n[0][0], n[1][0]
    mean = (n[0][1] + n[1][1]) / (bad + good)
    scale = np.maximum(np.sqrt(_sums(rows, lambda x, y: {0: ((x - mean) ** 2).sum(0)})[0][0] / (bad + good)), 1e-4)
    w = pairwise.minimum(len(mean), lambda fn, *args: _sums(rows, lambda x, y: fn((x - mean) / scale, y, *args)), RIDGE)
    return Ranking(mean, scale, w, _threshold_table(rows, Ranking(mean, scale, w, 0.0), int(good), int(bad)))


def _threshold_table(rows: DataFrame, ranking: Ranking, good: int, bad: int) -> float:
    """_threshold() on a table: a running sum over the distinct scores, by ranges of them."""

    def run(batches):
        for b in batches:
            x, y = _arrays(b)
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(x)), pa.array(np.where(y == 1, -bad, good), pa.int64())], ["s", "v"])

    counts = cut(rows.mapInArrow(run, "s double, v long").groupBy("s").agg(F.sum("v").alias("v")), "scores")
    below = F.col("below") - F.col("v")
    got = global_running(counts, "s", "v", "below").agg(F.max(F.struct(below.alias("e"), "s")).alias("last"), F.max(F.struct(below.alias("e"), (-F.col("s")).alias("s"))).alias("first")).first()
    low = -got["first"]["s"]
    under = counts.where(F.col("s") < low).agg(F.max("s").alias("s")).first()["s"]
    discard(counts)
    return float((got["last"]["s"] + (low if under is None else under)) / 2)


def learn(features: DataFrame, labels: DataFrame, column: str = "quality", local: int = LOCAL) -> Ranking:
    # of several rows under an id the first by features learns
    first = features.where("doc_id is not null").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = cut(first.join(labelled(labels, column), "doc_id").select("doc_id", "y", "x"), "labelled")
    n = rows.count()
    if n > local:
        ranking = fit_table(rows)
    elif n:
        found = rows.toArrow().combine_chunks()
        x, y = _arrays(found.to_batches()[0])
        order = np.lexsort((*x.T[:4], y, found["doc_id"].to_numpy()))
        ranking = fit(x[order], y[order])
    else:
        ranking = _undecided(len(NAMES))
    discard(rows)
    return ranking


def score(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document."""
    features = cut(with_features(docs, ["doc_id"]), "features")
    ranking = learn(features, labels, column)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranking.score(x))], ["doc_id", "score"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    rows = score(table(spark, sf_dir, "documents"), labels)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
