"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Every text becomes a vector of transformed statistics.  Each class has a mean and a covariance shrunk
towards the pooled covariance and its diagonal; Cholesky factors are computed once and travel with the
model.  A score is the logistic of the scaled difference of the classes' Gaussian log-densities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import crc_mod, small_batches
from cadenza.llm.quality_rules import judge

FEATURES = (
    "log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct", "repeated", "dup_lines", "words_line",
    "lost", "top_word", "lone", "stops",
)
#: Labelled rows that the fit takes at most, in the order of a hash of their ids.
TRAIN_ROWS = 20_000
SHRINK, RIDGE = 0.15, 1e-3
_UPPER, _LOWER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?-_=~@/\\^+"


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return math.log((share + 0.01) / (1.01 - share))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text; a null or empty text has those of no words."""
    text = text or b""
    words: list[bytes] = []
    n, chars, symbols, dup, repeat, _, _, stay = judge(text, words)
    size = max(n, 1)
    upper, lower = (len(text) - len(text.translate(None, s)) for s in (_UPPER, _LOWER))
    digits, marks = (len(text) - len(text.translate(None, s)) for s in (_DIGITS, _MARKS))
    lines = sum(1 for x in text.split(b"\n") if x and not x.isspace())
    counts = Counter(words)
    return [
        math.log1p(n),
        math.log1p(chars / size),
        math.log1p(10 * symbols / size),
        math.log1p(10 * marks / size),
        _logit(upper / max(upper + lower, 1)),
        math.log1p(10 * digits / size),
        math.log(max(len(counts), 1)) / math.log(size + 1),
        _logit(repeat / size),
        _logit(dup / max(lines, 1)),
        math.log1p(n / max(lines, 1)),
        _logit(1 - stay / size),
        _logit(max(counts.values(), default=0) / size),
        _logit(sum(len(w) == 1 for w in counts) / max(len(counts), 1)),
        math.log1p(10 * text.count(b".") / size),
    ]


@dataclass
class Discriminant:
    """prior log-odds, per class: mean, inverse Cholesky factor, log-determinant; then scale and shift of the score."""

    means: list[np.ndarray]
    roots: list[np.ndarray]
    logdets: list[float]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        d = [-0.5 * (((x - m) @ r.T) ** 2).sum(1) - 0.5 * ld for m, r, ld in zip(self.means, self.roots, self.logdets)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """With fewer than two rows of a class every score is the share of label 1 (0.5 without rows)."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant([], [], [], constant=float(y.mean()) if len(y) else 0.5)
    groups = [x[y == k] for k in (0, 1)]
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / len(x)
    means, roots, logdets = [], [], []
    for g in groups:
        own = shrink + (1 - shrink) * x.shape[1] / (x.shape[1] + len(g))  # small classes lean on the pooled shape
        cov = (1 - own) * np.cov(g.T, bias=True) + own * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled)))
        cov += RIDGE * np.eye(x.shape[1])
        root = np.linalg.cholesky(cov)
        means.append(g.mean(0))
        roots.append(np.linalg.inv(root))
        logdets.append(2 * float(np.log(np.diag(root)).sum()))
    model = Discriminant(means, roots, logdets)
    d = np.clip(model.difference(x), -200, 200)
    a, b = 0.1, 0.0  # logistic scale and shift by Newton steps with a small penalty
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([((p - y) * d).sum() + 1e-2 * a, (p - y).sum()])
        hess = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -5, 5))
    model.scale, model.shift = max(a, 1e-4), b
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, held: int, rows: int) -> DataFrame:
    """lid, y, text of at most ``rows`` labelled documents outside the held-out remainder, in the order of an id hash.

    A document with two labels, or two texts under one id, gives a row for each pair; of equal ids the lesser label and
    text come first, so the same rows are taken every time.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where("lid IS NOT NULL AND y IN (0, 1)")
    some = some.where(crc_mod("lid", mod) != held).distinct().orderBy(F.xxhash64("lid"), "lid", "y").limit(rows)
    # at most ``rows`` pairs of numbers: a broadcast of known size
    return docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(some), "lid").select("lid", "y", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        x = [statistics(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["lid", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> Discriminant:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, mod, held, rows).withColumn("text", F.col("text").cast("binary"))
    # ids may repeat: as many as asked for, in a fixed order
    got = sample.mapInArrow(_features, "lid long, y int, x array<double>").orderBy(F.xxhash64("lid"), "lid", "y", "x").limit(rows).collect()
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in got], float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 4, held: int = 2, threshold: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (score >= ``threshold``).

    Null and empty texts are scored like any text.  A null id is not held out.  Without labels of both
    classes the score is the share of label 1.  Only the text enters a score; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, mod, held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows_in = rows_in.select("doc_id", F.coalesce(crc_mod("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
