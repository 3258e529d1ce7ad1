"""Quality classifier: regularised quadratic discriminant.

Every text becomes a short vector of transformed statistics (logarithms and
square roots keep the tails short). Class means and covariances come from sums
that Spark adds up over all labelled rows; each covariance is shrunk towards a
multiple of the identity and factored once (Cholesky). A score is the logistic
of the difference of the classes' log densities, each a Mahalanobis distance
taken with the factor's inverse, made once, plus the log prior odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.common import id_bucket, map_rows
from reportlake.llm.components import staged
from reportlake.llm.quality_rules import STOP_WORDS

#: Shrinkage of the class covariances, and least variance of a feature before scaling.
SHRINKAGE, LEAST_VARIANCE = 0.2, 1e-3
#: Rows whose id falls into remainder 0 of this modulus teach nothing.
HOLD_OUT = 5
ACCEPT = 0.3

_STOP = frozenset(w for s in STOP_WORDS.values() for w in s.split())
_SYMBOLS, _MARKS, _DIGITS = b"#*$%&|<>", b"!?", b"0123456789"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_STOPS = b".,;:"
FEATURES = ("log_word_length", "symbols", "marks", "digits", "upper", "stops", "pipes", "distinct_words",
            "distinct_triples", "stop_words", "lines")
#: Weight, in words, of the typical value that each ratio is drawn to: short texts say little.
PRIOR_WORDS = 10


def features(text: str) -> list[float]:
    """Transformed statistics of a text; all finite, for the empty text too."""
    raw = text.encode()
    size = len(raw)

    def count(chars: bytes) -> int:
        return size - len(raw.translate(None, chars))

    words = text.split()
    n = len(words)

    def ratio(k: float, typical: float, of: float = n) -> float:
        return (k + typical * PRIOR_WORDS) / (of + PRIOR_WORDS)

    upper, lower = count(_UPPER), count(_LOWER)
    return [
        np.log(ratio(sum(map(len, words)), 5.0)),
        ratio(count(_SYMBOLS), 0.0) ** 0.5, ratio(count(_MARKS), 0.0) ** 0.5,
        ratio(count(_DIGITS), 0.0, size) ** 0.5, ratio(upper, 0.02, upper + lower) ** 0.5,
        ratio(count(_STOPS), 0.15) ** 0.5, ratio(raw.count(b"|"), 0.0) ** 0.5,
        ratio(len(set(words)), 1.0), ratio(len(set(zip(words, words[1:], words[2:]))), 1.0, max(n - 2, 0)),
        ratio(sum(w in _STOP for w in words), 0.25) ** 0.5, ratio(raw.count(b"\n"), 0.02) ** 0.5,
    ]


@dataclass
class Model:
    """Scaling, and per class: mean, inverse of the Cholesky factor, log determinant, log prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score of each row; 0.5 without classes, 0 or 1 with one only."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes))) if self.classes else 0.5)
        z = (x - self.centre) / self.scale
        log = {}
        for label, (mean, unfold, log_det, prior) in self.classes.items():
            d = unfold @ (z - mean).T
            log[label] = prior - 0.5 * log_det - 0.5 * (d * d).sum(axis=0)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def solve_model(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model:
    """Model of per-class (count, sum, sum of outer products)."""
    sums = {k: v for k, v in sums.items() if v[0] > 0}
    d = len(FEATURES)
    if not sums:
        return Model(np.zeros(d), np.ones(d), {})
    n = sum(v[0] for v in sums.values())
    centre = sum(v[1] for v in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(v[2] for v in sums.values())) / n - centre ** 2, LEAST_VARIANCE))
    classes = {}
    for label, (count, total, outer) in sums.items():
        mean = total / count
        cov = (outer / count - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * (max(np.trace(cov), 0.0) / d + LEAST_VARIANCE) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        classes[label] = ((mean - centre) / scale, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()),
                          float(np.log(count / n)))
    return Model(centre, scale, classes)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``features`` of each row (null text: empty)."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "features": [features(t or "") for t in cols["text"]]}

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run,
                    "doc_id bigint, features array<double>")


def fit(feats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Model of the rows of ``document_features`` that ``labels`` (doc_id, 0/1)
    covers and whose id is not held out. Labels other than 0 and 1 and null ids
    are ignored; a repeated label counts as often as it stands. Only sums, of
    the size of the model, reach the driver."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & (id_bucket(F.col("doc_id"), HOLD_OUT) != 0))
    d = len(FEATURES)

    def sums(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"y": [], "k": [], "v": []}
        y, x = np.array(cols["y"]), np.array(cols["features"], dtype=np.float64).reshape(len(cols["y"]), d)
        for label in (0, 1):
            z = x[y == label]
            if len(z):
                v = [float(len(z)), *z.sum(axis=0).tolist(), *(z.T @ z).ravel().tolist()]
                out["y"] += [label] * len(v)
                out["k"] += range(len(v))
                out["v"] += v
        return out

    got = (map_rows(feats.join(rows, "doc_id").select("y", "features"), sums, "y int, k int, v double")
           .groupBy("y", "k").agg(F.sum("v").alias("v")).collect())
    stats = {}
    for label in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in got:
            if r["y"] == label:
                v[r["k"]] = r["v"]
        stats[label] = (v[0], v[1:1 + d], v[1 + d:].reshape(d, d))
    return solve_model(stats)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   accept: float = ACCEPT) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` (0 to 1, higher:
    better), ``predicted`` (1 from ``accept`` on).

    A null text counts as empty; empty texts are scored like any other. A row
    with a null id is held out. Repeated rows get equal scores, an empty table an
    empty result; without usable labels every score is 0.5, with labels of one
    class that class. Other columns are not read, whatever their names. Texts
    are read whole.
    """
    feats = staged(docs.sparkSession, document_features(docs, id_col, text_col), "quality-features")
    model = fit(feats, labels)

    def run(cols: dict[str, list]) -> dict[str, list]:
        x = np.array(cols["features"], dtype=np.float64).reshape(len(cols["doc_id"]), len(FEATURES))
        return {"doc_id": cols["doc_id"], "score": model.score(x).tolist()}

    return map_rows(feats, run, "doc_id bigint, score double").select(
        F.col("doc_id").alias(id_col),
        F.coalesce(id_bucket(F.col("doc_id"), HOLD_OUT) == 0, F.lit(True)).alias("held_out"), "score",
        F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``accept``, unchanged.

    Null and empty texts are scored as empty, rows with a null id like any other;
    repeated rows stay or go together, an empty table gives an empty one. Without
    usable labels every score is 0.5. Other columns may have any name and type.
    """
    from pyspark.sql.types import DoubleType

    model = fit(staged(docs.sparkSession, document_features(docs, id_col, text_col), "quality-features"), labels)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([features(t if isinstance(t, str) else "") for t in texts])))

    return docs.where(score(F.col(text_col)) >= accept)
