"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 to G. One score s(text) is a weighted sum over hashed tokens (log of 1 + the count of each
bucket); ordered thresholds t_1 < ... < t_G cut it, P(grade >= k) = 1 / (1 + exp(t_k - s)). All grades share
the weights, so ratings of every grade inform the order. A text gets its expected grade, the sum of these
tail probabilities, and the last one, P(grade = G), which selects.

Tokens: runs of letters and digits in lower case, runs of other characters as they stand, and a mark for
words in capitals. Weights are learned with an L1 penalty on a sample of at most TRAIN_DOCS rated documents
(picked by a hash of the id) with at most TRAIN_CELLS bucket counts between them, so chance tokens weigh nothing.
Only these counts come to the driver, 8 bytes each.
Scoring is a scan without a shuffle; a text is read whole.

In the query, grades come from labels: 0 low quality, 1 fair but toxic, 2 good.

Defined cases: a null or empty text has score 0 of no tokens; repeated rows score alike; an empty table gives
an empty table; without ratings of two grades every text has the highest grade; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import bounded_sample, text_of, training_set

BUCKETS = 1 << 16
#: Rated documents that the model is fitted on, at most, and their bucket counts in all.
TRAIN_DOCS, TRAIN_CELLS = 4_000, 4_000_000
STEPS, RATE, L1, LEAST_DOCS = 300, 0.05, 4e-4, 3
SELECT = 0.5
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_CACHE_TOKENS = 400_000
_cache: dict[str, tuple[int, ...]] = {}


def _bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


_CAPITALS = _bucket("\x00capitals")


def _ids(token: str) -> tuple[int, ...]:
    if token.isupper() and len(token) > 1:
        return (_bucket(token.lower()), _CAPITALS)
    return (_bucket(token.lower()),)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's tokens, in order of bucket."""
    if len(_cache) > _CACHE_TOKENS:
        _cache.clear()
    tokens = _TOKEN.findall(text)
    for t in set(tokens).difference(_cache):
        _cache[t] = _ids(t)
    flat = [i for t in tokens for i in _cache[t]]
    return np.unique(np.array(flat, dtype=np.int64), return_counts=True)


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        buckets, n = bucket_counts(text)
        return float(self.weights[buckets] @ np.log1p(n))

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k), k from 1 on."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -700, 700)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int) -> Ordinal:
    """Proximal Adam on the mean log-likelihood, classes weighted by the root of their rarity."""
    y = np.array(grades, dtype=np.int64)
    counts = np.bincount(y, minlength=n_grades)
    if not len(y) or (counts > 0).sum() < 2:
        return Ordinal(np.zeros(BUCKETS), np.full(n_grades - 1, -700.0))
    sizes = np.array([len(b) for b, _ in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    bucket, value = np.concatenate([b for b, _ in rows]), np.log1p(np.concatenate([n for _, n in rows]))
    frequent = np.bincount(bucket, minlength=BUCKETS) >= LEAST_DOCS
    on = frequent[bucket]
    of, bucket, value = of[on], bucket[on], value[on]
    weight = np.sqrt(len(y) / np.maximum(counts, 1))[y]
    weight = weight / weight.sum()
    w, mw, vw = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    share = np.clip(np.array([(y >= k).mean() for k in range(1, n_grades)]), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    t = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-2))))  # the first threshold, then logs of gaps
    mt, vt = np.zeros_like(t), np.zeros_like(t)
    inf = np.array([np.inf])
    for step in range(1, STEPS + 1):
        s = np.bincount(of, weights=value * w[bucket], minlength=len(y))
        cuts = np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))
        bounds = np.concatenate((-inf, cuts, inf))
        with np.errstate(over="ignore"):
            high, low = (1 / (1 + np.exp(-(bounds[y + 1] - s))), 1 / (1 + np.exp(-(bounds[y] - s))))
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        gs = weight * (dl - dh)  # of the log-likelihood, by score
        by_cut = np.array([(weight * dh)[y == k - 1].sum() - (weight * dl)[y == k].sum() for k in range(1, n_grades)])
        gt = np.array([by_cut[i:].sum() * (1.0 if i == 0 else np.exp(t[i])) for i in range(len(t))])
        gw = np.bincount(bucket, weights=value * gs[of], minlength=BUCKETS)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(vw / b) + 1e-3)
        w = w + scale * mw / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * L1, 0)
        t = t + RATE * (mt / a) / (np.sqrt(vt / b) + 1e-3)
    return Ordinal(w, np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:])))))


def _counted(text: str) -> tuple[int, bytes]:
    buckets, counts = bucket_counts(text)
    return len(buckets), buckets.astype(np.int32).tobytes() + counts.astype(np.int32).tobytes()


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, train_docs: int = TRAIN_DOCS, train_cells: int = TRAIN_CELLS) -> Ordinal:
    """A model from ratings(doc_id, grade)."""
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("label"))
    found = training_set(docs, bounded_sample(known, ["doc_id"], train_docs), _counted, train_cells)
    both = [np.frombuffer(f, dtype=np.int32).astype(np.int64).reshape(2, -1) for _, f in found]
    return train([(b[0], b[1]) for b in both], [g for g, _ in found], n_grades)


def grade(text: str | Column, model: Ordinal) -> Column:
    """struct<score, expected, tail> of a text column."""
    names = ["score", "expected", "tail"]

    def graded(column: pa.Array) -> pa.Array:
        scores = [model.score(x.as_py()) for x in column]
        tails = [model.tails(s) for s in scores]
        columns = [scores, [float(t.sum()) for t in tails], [float(t[-1]) for t in tails]]
        return pa.StructArray.from_arrays([pa.array(c, type=pa.float64()) for c in columns], names=names)

    return F.arrow_udf(graded, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(text_of(text))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """ratings(doc_id, grade) of labels(doc_id, quality, toxic): 0 low, 1 fair but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("grade"))


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, grades_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    found = docs.select("doc_id", grade("text", model).alias("g"))
    return found.select("doc_id", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("p_good"), (F.col("g.tail") >= SELECT).alias("kept"))
