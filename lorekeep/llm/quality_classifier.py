"""Quality classifier: naive Bayes support vectors over n-gram indicators of the whole text.

Features of a text are indicators of its byte 1-, 2- and 3-grams (the last hashed) and of runs of
1, 2, 3 and 4 repetitions of a word. Each indicator is scaled by its log-count ratio between the
classes and by the text's feature count; a linear hinge-loss model is fitted to them by dual
coordinate descent, and a logistic curve of the margin, fitted on labelled rows kept out of the
descent, gives the score.

Edge cases. A null or empty text has no features and gets the score of the curve's intercept.
Labels that are null, not 0 or 1, contradictory for a doc_id or without a document teach nothing.
With labels of one class only every score is that class (1.0 or 0.0); without labels 0.5. Repeated
rows are scored alike, each on its own row. Very long texts are read whole, in blocks. Columns
other than the id and the text are carried through by `score_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRI_BITS = 17
REPEATS = 4
BASE3 = 256 + 65536
BASE_R = BASE3 + (1 << TRI_BITS)
SIZE = BASE_R + REPEATS
BLOCK = 1 << 20
#: Most labelled documents of each class that the model is fitted on (the smallest by hash of id).
PER_CLASS = 4000
C, EPOCHS = 1.0, 12


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted ids of the features of a text; seen is a scratch array of SIZE False values."""
    for at in range(0, len(text), BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK + 2, len(text) - at), at).astype(np.uint32)
        seen[b] = True
        two = (b[:-1] << 8) | b[1:]
        seen[two + 256] = True
        three = ((two[:-1] << 8) | b[2:]) * np.uint32(2654435761)
        seen[(three >> np.uint32(32 - TRI_BITS)) + BASE3] = True
    run, last = 0, None
    for w in text.split():
        run = run + 1 if w == last else 0
        if run and run <= REPEATS:
            seen[BASE_R + run - 1] = True
        last = w
    ids = np.flatnonzero(seen)
    seen[ids] = False
    return ids


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float) -> tuple[np.ndarray, float, float]:
    """Weights for indicators (log-count ratio included) and slope and intercept of the curve."""
    if not len(y) or y.min() == y.max():
        return np.zeros(SIZE), 0.0, 0.0 if not len(y) else (700.0 if y[0] else -700.0)
    keep_out = np.arange(len(y)) % 5 == 4
    if min(y[~keep_out].sum(), (~y[~keep_out].astype(bool)).sum()) == 0 or not keep_out.any():
        keep_out[:] = False
    fit_on = np.flatnonzero(~keep_out)
    count = np.ones((2, SIZE))
    for i in fit_on:
        count[y[i], rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    norm = np.array([v @ v for v in x])
    sign, w, alpha = np.where(y == 1, 1.0, -1.0), np.zeros(SIZE), np.zeros(len(y))
    share = np.array([(y[fit_on] == k).mean() for k in (0, 1)])
    top = C * 0.5 / share[y]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(fit_on):
            if norm[i] > 0:
                grad = sign[i] * (w[rows[i]] @ x[i]) - 1
                new = min(max(alpha[i] - grad / norm[i], 0.0), top[i])
                if new != alpha[i]:
                    w[rows[i]] += (new - alpha[i]) * sign[i] * x[i]
                    alpha[i] = new
    on = np.flatnonzero(keep_out) if keep_out.any() else fit_on
    m = np.array([w[rows[i]] @ x[i] for i in on])
    t, weight = y[on].astype(float), np.where(y[on] == 1, prior, 1 - prior) / np.maximum(1, np.where(y[on] == 1, y[on].sum(), (y[on] == 0).sum())) * len(on)
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -700, 700)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return w * ratio, float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS):
    """The model (weights, slope, intercept), fitted on at most per_class labelled documents of each class.

    Rows whose crc32(doc_id as text) leaves 1 when divided by 3 are held out.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_y"))
        .where("_id is not null and _y in (0, 1) and pmod(crc32(cast(_id as string)), 3) <> 1")
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    )
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    key = F.xxhash64("_id")
    few = known.where("_y = 0").orderBy(key, "_id").limit(per_class).union(known.where("_y = 1").orderBy(key, "_id").limit(per_class))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(few), "_id")

    def prepare(batches):
        seen = np.zeros(SIZE, bool)
        for b in batches:
            ids = [features((t.as_py() or "").encode(), seen).astype(np.uint32).tobytes() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(ids, pa.binary())], ["_id", "_y", "ids"])

    def learn(batches):
        got = sorted((i, y, x) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        w, a, b = fit([np.frombuffer(x, np.uint32) for *_, x in got], np.array([y for _, y, _ in got], int), prior)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary()), pa.array([a]), pa.array([b])], ["w", "a", "b"])

    taught = rows.mapInArrow(prepare, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _y int, ids binary")
    once = taught.groupBy("_id", "_y").agg(F.min("ids").alias("ids"))  # repeated rows are dropped before the one task, not in it
    model = once.repartition(1).mapInArrow(learn, "w binary, a double, b double").first()
    if model is None:
        return fit([], np.zeros(0, int), 0.5)
    return np.frombuffer(model["w"], np.float64), model["a"], model["b"]


def score_documents(docs: DataFrame, model, score_col: str = "score") -> DataFrame:
    """docs with the score column (double, 0 to 1; replaced if there is one)."""
    w, a, b = model
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out, seen, weight = np.empty(len(texts)), np.zeros(SIZE, bool), shared.value
        for i, t in enumerate(texts):
            ids = features((t or "").encode(), seen)
            out[i] = weight[ids].sum() / max(1.0, np.sqrt(len(ids)))
        return pd.Series(1 / (1 + np.exp(-np.clip(a * out + b, -700, 700))))

    return docs.withColumn(score_col, score("text"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored under 0.5 go."""
    from .common import table

    model = train(docs, table(spark, sf_dir, "labels"))
    name = "_score_of_quality"
    return score_documents(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)
