"""How the settings of ``toxicity`` are chosen: by folds of training labels.

``python -m nodalis.llm.toxicity_folds FOLDER`` prints, for each setting, the
area under the ROC curve of out-of-fold evidence on the sampled training
documents; held-out labels are not read.  With ``--held-out`` it prints one
figure instead: that of op4_toxicity's scores on the held-out labels.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
from pyspark.sql import SparkSession

from nodalis.llm import toxicity as T
from nodalis.llm.common import held_out, table

FOLDS = 4
GRID = {"order": (4, 5, 6), "shared": (1, 2), "discount": (0.75, 1.5), "window": (12, 25, 40, 60)}


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties by halves."""
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = int((y == 1).sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def model_of(texts: list, y: np.ndarray, order: int, shared: int, discount: float) -> T.TwoModels:
    """Both models from texts on the driver."""
    grams: dict = {}
    parts = [list(T.count_grams([t for t, c in zip(texts, y, strict=True) if c == k], order)) for k in (0, 1)]
    for n in range(1, order + 1):
        (_, *own0, c0), (_, *own1, c1) = parts[0][n - 1], parts[1][n - 1]
        gram, first, at = np.unique(np.r_[own0[0], own1[0]], return_index=True, return_inverse=True)
        a, b = np.bincount(at, np.r_[c0, c1 * 0], len(gram)), np.bincount(at, np.r_[c0 * 0, c1], len(gram))
        grams[n] = (gram, np.r_[own0[1], own1[1]][first], np.r_[own0[2], own1[2]][first], a, b)
    return T.TwoModels(grams, order, shared, discount)


def folds(texts: list, y: np.ndarray) -> list[tuple[float, dict]]:
    """(area, setting) of each setting, the best first."""
    part, out = np.arange(len(y)) % FOLDS, []
    for order, shared, discount in itertools.product(*(GRID[k] for k in ("order", "shared", "discount"))):
        found = {w: np.zeros(len(y)) for w in GRID["window"]}
        for f in range(FOLDS):
            fit, test = np.flatnonzero(part != f), np.flatnonzero(part == f)
            m = model_of([texts[i] for i in fit], y[fit], order, shared, discount)
            for w in found:
                found[w][test] = m.evidence([texts[i] for i in test], w)
        out += [(auc(s, y), {"order": order, "shared": shared, "discount": discount, "window": w}) for w, s in found.items()]
    return sorted(out, key=lambda x: -x[0])


def main(folder: str, final: bool) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    labels = table(spark, folder, "labels")
    if final:
        got = T.op4_toxicity(spark, folder).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic").distinct(), "doc_id").select("score", "predicted", "toxic").toPandas()
        y, p = got.toxic.to_numpy(), got.predicted.to_numpy()
        print(f"held out: {len(y)} labelled, {y.sum()} toxic, AUC {auc(got.score.to_numpy(), y):.3f}, toxic found {p[y == 1].sum()}, ordinary marked {p[y == 0].sum()}")
    else:
        _, train = T.sampled(table(spark, folder, "documents").where(~held_out()), labels.where(~held_out()), "doc_id", "text", "toxic", T.TRAIN_ROWS, T.TRAIN_CHARS)
        got = train.orderBy("doc_id").select("_text", "_y").toPandas()
        for area, setting in folds([t or "" for t in got["_text"]], got["_y"].to_numpy()):
            print(f"{area:.4f} {setting}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], "--held-out" in sys.argv)
