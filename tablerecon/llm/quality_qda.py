"""Quality scores from a regularised quadratic discriminant.

Transformed document statistics are taken as Gaussian in each class. Means and covariances
come from one Spark aggregate of fixed width over all labelled rows (moments, not rows, reach
the driver); covariances are shrunk towards the pooled and the diagonal ones. A score is the
posterior from Mahalanobis log-density differences with Cholesky factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_remainder
from .docstats import document_counts

CUTOFF = 0.3


#: transformed statistics, name -> SQL over COUNTS
FEATURES = {
    "length": "ln(1 + n_words)",
    "word_length": "ln((word_chars + 6D) / (n_words + 1))",
    "symbols": "ln(1 + 20D * n_symbols / (n_words + 4))",
    "bangs": "ln(1 + 20D * n_bang / (n_words + 4))",
    "capitals": "ln(1 + 10D * n_upper / (n_letters + 30))",
    "digits": "ln(1 + 10D * n_digits / (word_chars + 50))",
    "echo": "ln(1 + 20D * n_same / (n_words + 4))",
    "repeats": "ln(1 + 10D * n_repeat_words / (n_words + 8))",
    "lines": "ln(1 + 10D * n_dup_lines / (n_lines + 4))",
    "variety": "ln((n_distinct + 4) / pow(n_words + 4, 0.85D))",
}


@dataclass(frozen=True)
class Discriminant:
    mean: np.ndarray  # classes x features
    factor: np.ndarray  # classes x features x features, inverse Cholesky factors
    offset: np.ndarray  # classes, log prior minus half log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 of each row of ``x``."""
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.mean, self.factor, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def column(self):
        """The same score as a column over FEATURES."""
        logs = []
        for m, f, o in zip(self.mean, self.factor, self.offset, strict=True):
            log = F.lit(float(o))
            for i in range(len(m)):  # factors are lower triangular
                z = sum((F.lit(float(f[i, j])) * (F.col(name) - float(m[j])) for j, name in enumerate(FEATURES) if j <= i), F.lit(0.0))
                log = log - 0.5 * z * z
            logs.append(log)
        return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), logs[0] - logs[1]))))


def _featured(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return counts.select("doc_id", *[F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()], *[F.col(c) for c in keep or []])


def fit(counts: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant | None:
    """From ``counts`` (``document_counts``) and ``labels`` (``doc_id, quality``). Rows without
    a label and labels other than 0 and 1 are left out; a document labelled both ways counts
    once each way. None if either class has no row."""
    names = list(FEATURES)
    own = _featured(counts).join(labels.where("quality in (0, 1)").select("doc_id", "quality").distinct(), "doc_id")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = {r["quality"]: r for r in own.groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs]).collect()}
    if set(got) != {0, 1}:
        return None
    n = np.array([got[c]["n"] for c in (0, 1)], float)
    mean = np.array([[got[c][f"s_{a}"] for a in names] for c in (0, 1)]) / n[:, None]
    cov = np.zeros((2, len(names), len(names)))
    for c in (0, 1):
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cov[c, i, j] = cov[c, j, i] = got[c][f"p_{a}_{b}"] / n[c] - mean[c, i] * mean[c, j]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    factor, offset = [], []
    for c in (0, 1):
        m = (1 - shrink) * cov[c] + shrink / 2 * pooled + shrink / 2 * np.diag(np.diag(cov[c])) + ridge * np.eye(len(names))
        chol = np.linalg.cholesky(m)
        factor.append(np.linalg.inv(chol))
        offset.append(np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(mean, np.array(factor), np.array(offset))


def score(counts: DataFrame, model: Discriminant | None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``counts``, then its columns ``keep``;
    without a model every score is 0.5. Empty texts are scored like others."""
    rows = _featured(counts, keep).withColumn("score", model.column() if model else F.lit(0.5))
    return rows.select("doc_id", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), *(keep or []))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id, text``), learned from ``labels``
    (``doc_id, quality``) of the rows that the split rule gives for learning."""
    counts = cut(document_counts(docs))
    return score(counts, fit(counts, labels.where(id_remainder(5) != 0)))
