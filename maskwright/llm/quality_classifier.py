"""Operator 10, quality classifier: random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S
from . import text_stats

#: Bins of the raw score for the calibration; raw scores beyond [LOW, HIGH] fall in the outer bins.
BINS, LOW, HIGH = 512, -0.5, 1.5


@dataclass(frozen=True)
class Model:
    """Scales of the features, the random features, ridge weights, and the calibrated steps."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.waves + self.phases
        return np.concatenate([np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated in 0..1; a trace of the raw score keeps the order within a step."""
        raw = np.clip(self.raw(x), LOW, HIGH)
        steps = np.interp(raw, self.knots, self.heights) if len(self.knots) else np.clip(raw, 0, 1)
        return 0.999 * steps + 0.001 * (raw - LOW) / (HIGH - LOW)


def _matrix(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators: the rising sequence closest to good / n."""
    blocks: list[list[float]] = []
    for g, w in zip(good.tolist(), n.tolist(), strict=True):
        blocks.append([g, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + w2, blocks[-1][2] + k2]
    return np.repeat([g / w for g, w, _ in blocks], [int(k) for _, _, k in blocks])


def fit(train: DataFrame, calibrate: DataFrame, waves: int = 128, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on all rows (features array<float>, quality 0/1) of ``train``, calibrate on those of ``calibrate``.

    Every partition sums its part of the normal equations; Spark adds the
    parts, and one matrix of ``waves + 2`` squared numbers reaches the driver.
    """
    k = len(text_stats.FEATURES)
    moments = [f(F.col("features")[i].cast("double")) for i in range(k) for f in (F.avg, F.stddev_pop)]
    row = train.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    stats = np.array([0.0 if v is None else v for v in row]).reshape(k, 2)
    rng = np.random.default_rng(seed)
    model = Model(stats[:, 0], np.maximum(stats[:, 1], 1e-6), rng.normal(0, np.sqrt(2 * gamma), (k, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(0), np.zeros(0))
    sent = train.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((waves + 2, waves + 2))
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([sent.value.lifted(_matrix(batch)), batch.column(1).to_numpy().astype(float)])
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "part": total.ravel()})

    cells = train.select("features", "quality").mapInArrow(sums, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("v")).collect()
    gram = np.zeros((waves + 2) ** 2)
    for cell in cells:
        gram[cell["cell"]] = cell["v"]
    gram = gram.reshape(waves + 2, waves + 2)
    n = max(gram[waves, waves], 1.0)
    weights = np.linalg.solve(gram[:-1, :-1] / n + ridge * np.eye(waves + 1), gram[:-1, -1] / n)
    model = Model(model.mean, model.scale, model.waves, model.phases, weights, model.knots, model.heights)
    sent2 = train.sparkSession.sparkContext.broadcast(model)

    def raws(batch: pa.RecordBatch) -> dict:
        return {"raw": sent2.value.raw(_matrix(batch)), "quality": batch.column(1).cast(pa.float64())}

    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") - LOW) / ((HIGH - LOW) / BINS)))).cast("int")
    rows = S.map_batches(calibrate.select("features", "quality"), raws, "raw double, quality double")
    steps = sorted(rows.groupBy(bin_.alias("bin")).agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect())
    if steps:
        good, count = np.array([s["good"] for s in steps]), np.array([float(s["n"]) for s in steps])
        knots = LOW + (np.array([s["bin"] for s in steps]) + 0.5) * (HIGH - LOW) / BINS
        model = Model(model.mean, model.scale, model.waves, model.phases, weights, knots, isotonic(good, count))
    return model


def learned(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows of ``stats`` (doc_id, features) with a label outside the held-out fold.

    One fold in four of these calibrates and the others fit. Labels without a
    document, null labels and repeated labels are ignored, the last ones down
    to the better label. Without any label every score is one half.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    learn = S.save(stats.join(marks.where(text_stats.remainder("doc_id") != 0), "doc_id").select("features", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")), "labelled")
    if learn.limit(1).count():
        return fit(learn.where("fold <> 0"), learn.where("fold = 0"))
    k = len(text_stats.FEATURES)
    return Model(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.array([0.0, 0.5]), np.zeros(0), np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have the features of an empty text and a score like
    any other; a null id is held out from learning; repeated rows score alike.
    Empty tables give no rows. Labels: see `learned`.
    """
    stats = S.save(text_stats.statistics(docs, id_col, text_col).select("doc_id", "features"), "features")
    sent = docs.sparkSession.sparkContext.broadcast(learned(stats, labels))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": sent.value.score(_matrix(batch))}

    scored = S.map_batches(stats, run, "doc_id long, score double")
    out = F.coalesce(text_stats.remainder("doc_id") == 0, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns and null texts unchanged.

    Rows are saved with their features and judged where they lie, each by its
    own text: repeated rows alike, equal ids with different texts each for
    itself, null ids like others. No text is shuffled. An empty table stays
    empty; columns of any name pass.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([text_stats.describe(t or "")[5] for t in text], dtype=object)

    held = S.save(docs.select(F.struct("*").alias("row"), features("text").alias("features")), "described")
    sent = docs.sparkSession.sparkContext.broadcast(learned(held.select(F.col("row.doc_id").alias("doc_id"), "features"), labels))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.stack(x.to_list()).astype(np.float64)) if len(x) else [], dtype=float)

    return held.where(score("features") >= threshold).select("row.*")
