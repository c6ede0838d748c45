"""Quality rules: logistic regression over hashed word and character n-grams, calibrated, against fixed thresholds.

Features are the relative frequencies, hashed to 2**18 buckets, of words, word bigrams and runs of 3 and 4 bytes of the text
as it stands (case and punctuation tell much about quality).  The model is trained on at most `MAX_LABELLED` labelled rows, those of the
least hashes of their ids; a fifth of them calibrates the probabilities (Platt's sigmoid) and isn't trained on.

Defined cases: null and empty texts have no features and the probability of the intercept; null ids are scored too; rows that
repeat get the same score; without labels, or with labels of one kind only, the probability is the share of good labels
(0.5 without any); an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import ship
from spanforge.llm.textkernel import Block, blocks, ngram_hashes
from spanforge.llm.toxicity import labelled_sample

MAX_LABELLED = 2_000
BITS = 18
#: At KEEP and above a document is kept, below DROP it is dropped, between them it is for review.
KEEP, DROP = 0.5, 0.2
_SIZE = 1 << BITS
_CHARS = (3, 4)
_SCALE = 10.0


def _char_grams(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of n bytes that begin at each byte, and which of them are inside one document."""
    b = block.data.astype(np.uint32)
    m = max(len(b) - n + 1, 0)
    packed = np.zeros(m, np.uint32)
    for k in range(n):
        packed |= b[k : k + m] << np.uint32(8 * k)
    bucket = ((packed * np.uint32(2654435761)) ^ np.uint32(n * 0x9E37)) >> np.uint32(32 - BITS)
    inside = np.ones(m, bool)
    for k in range(1, n):
        cut = block.offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < m)]] = False
    return bucket, inside


def feature_groups(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, bigrams and character n-grams: buckets and documents of all occurrences."""
    starts, ends, docs = block.words()
    words = block.hash_ranges(starts, ends)
    shift = np.uint64(64 - BITS)
    yield (words >> shift).astype(np.uint32), docs
    pairs, pair_docs = ngram_hashes(words, docs, 2)
    same = (words[1:] == words[:-1])[docs[1:] == docs[:-1]]  # a word twice in a row is one feature, whatever the word
    yield np.where(same, np.uint32(_SIZE - 1), (pairs >> shift).astype(np.uint32)), pair_docs
    lengths = np.diff(block.offsets)
    of_byte = np.repeat(np.arange(block.n_docs), lengths)
    for n in _CHARS:
        bucket, inside = _char_grams(block, n)
        yield bucket[inside], of_byte[: len(bucket)][inside]


N_GROUPS = 2 + len(_CHARS)


@dataclass
class QualityModel:
    """weights: a row for each group of features; slope and shift: of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, block: Block) -> np.ndarray:
        out = np.full(block.n_docs, self.intercept)
        for weight, (bucket, docs) in zip(self.weights, feature_groups(block)):
            # documents are in order, so sums between their bounds do
            total = np.zeros(len(bucket) + 1)
            np.cumsum(weight[bucket], dtype=np.float64, out=total[1:])
            at = np.searchsorted(docs, np.arange(block.n_docs + 1))
            count = np.diff(at)
            out += np.where(count > 0, _SCALE * np.diff(total[at]) / np.maximum(count, 1), 0)
        return out

    def probabilities(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(block) + self.shift, -500, 500)))


def platt(logit: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the labels best, with Platt's smoothed targets, by damped Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(logit).mean()), 1e-9)
    x = np.stack([logit / scale, np.ones(len(logit))], axis=1)

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - target * z).sum())

    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -500, 500)))
        g = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), g)
        size = 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    return float(t[0] / scale), float(t[1])


def train(texts: pa.Array, good: np.ndarray, rounds: int = 60) -> QualityModel:
    n = len(good)
    share = float(good.mean()) if n else 0.5
    weights = np.zeros((N_GROUPS, _SIZE), np.float32)
    if n < 10 or good.all() or not good.any():
        p = min(max(share, 0.001), 0.999)
        return QualityModel(weights, float(np.log(p / (1 - p))))
    rows: list[list[np.ndarray]] = [[] for _ in range(N_GROUPS)]
    cols: list[list[np.ndarray]] = [[] for _ in range(N_GROUPS)]
    vals: list[list[np.ndarray]] = [[] for _ in range(N_GROUPS)]
    for block in blocks(texts, fold=False):
        for g, (bucket, docs) in enumerate(feature_groups(block)):
            key, count = np.unique(docs * np.int64(_SIZE) + bucket, return_counts=True)
            d = key // _SIZE
            total = np.bincount(docs, minlength=block.n_docs)
            rows[g].append((d + block.first).astype(np.int32))
            cols[g].append((key % _SIZE).astype(np.int32))
            vals[g].append((_SCALE * count / total[d]).astype(np.float32))
    row = np.concatenate([np.concatenate(x) for x in rows])
    col = np.concatenate([np.concatenate(x) + np.int32(g * _SIZE) for g, x in enumerate(cols)])
    val = np.concatenate([np.concatenate(x) for x in vals])
    del rows, cols, vals
    held = np.arange(n) % 5 == 4
    fit = ~held[row]
    y = good.astype(float)
    balance = np.where(good, 0.5 / share, 0.5 / (1 - share)) * ~held / (~held).sum()
    w, b, g2, gb2 = np.zeros(N_GROUPS * _SIZE), 0.0, np.full(N_GROUPS * _SIZE, 1e-8), 1e-8
    r, c, v = row[fit], col[fit], val[fit].astype(float)
    for _ in range(rounds):  # full-batch AdaGrad
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c] * v, n), -500, 500)))
        e = (p - y) * balance
        g = np.bincount(c, e[r] * v, len(w)) + 1e-6 * w
        g2 += g * g
        w -= 0.05 * g / np.sqrt(g2) * (g2 > 1e-8)
        gb2 += e.sum() ** 2
        b -= 0.05 * e.sum() / np.sqrt(gb2)
    model = QualityModel(w.reshape(N_GROUPS, _SIZE).astype(np.float32), b)
    logit = b + np.bincount(row, w[col] * val, n)
    model.slope, model.shift = platt(logit[held], good[held]) if 0 < good[held].sum() < held.sum() else (1.0, 0.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    sample = labelled_sample(docs, labels, max_labelled, ["quality"]).sort_by("doc_id")
    texts = sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string())
    return train(texts, sample["quality"].to_numpy() == 1)


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, drop: float = DROP, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row for each document: doc_id, the probability that it is good, whether to keep it, and the rule's verdict."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, max_labelled))  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for b in blocks(batch.column(1), fold=False):
                p[b.first : b.last] = model.value.probabilities(b)
            verdict = np.where(p >= keep, "keep", np.where(p < drop, "drop", "review"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array(p >= keep), pa.array(verdict.tolist(), pa.string())], ["doc_id", "quality", "keep", "verdict"]
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, quality double, keep boolean, verdict string")
