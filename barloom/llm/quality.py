"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the corpus is unlabelled text, a mixture of good and bad in
an estimated proportion: where scores are so high that only good documents reach them, the share of unlabelled text over
the share of positives is that proportion. A small network is fitted by minimising the non-negative unbiased risk (Kiryo
et al., 2017): prior * loss(positives as good) + max(0, loss(unlabelled as bad) - prior * loss(positives as bad)).
Features are figures of the text alone, its shape and its hashed words, computed for whole Arrow columns at once; only a
bounded sample of feature rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.hashing import LOWER, by_bytes, column_bytes, hash_windows, hash_words, split_words

#: Feature rows that reach the driver: labelled positives and unlabelled documents.
POSITIVES, UNLABELLED = 8_000, 16_000
THRESHOLD = 0.3
FOLDS = 5
HIDDEN = 24
WORD_DIMS = 128
#: Text bytes whose features are computed at once.
BATCH_BYTES = 2 << 20

#: Classes of bytes: upper, lower, digit, stop, other sign, line feed, other white space, not ASCII.
CLASSES = np.full(256, 4, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 0, 1, 2, 7
CLASSES[[ord(c) for c in ".,;:'\"-"]] = 3
CLASSES[10], CLASSES[[9, 11, 12, 13, 32]] = 5, 6
REPEATS = (1, 3, 8)


def features(texts: pa.Array) -> np.ndarray:
    """One row of figures per text, whatever its length; an empty text has zeros but for the constant shape figures."""
    data, offsets = column_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    kinds = np.bincount(rows * 8 + CLASSES[data], minlength=8 * n).reshape(n, 8)
    starts, ends, row = split_words(data, offsets)
    words = np.bincount(row, minlength=n)
    hashes = hash_words(data, starts, ends)
    some, many = np.maximum(1, size)[:, None], np.maximum(1, words)
    out = [np.log1p(size), np.log1p(words), size / many, *(kinds / some).T]
    last, first = CLASSES[data[ends - 1]], CLASSES[data[starts]]
    share = lambda hit: np.bincount(row[hit], minlength=n) / many
    out += [share(last == 4), share(first == 4), share(last == 3), share((first == 0) & (last == 0)), share(ends - starts == 1), share(ends - starts > 24)]
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out.append(share(same))
    for k in REPEATS:  # distinct windows of k words against all
        keys = hash_windows(hashes, k)
        at = row[: len(keys)]
        ok = at == row[k - 1 :] if len(keys) else np.zeros(0, bool)
        keys, at = keys[ok], at[ok]
        order = np.lexsort((keys, at))
        keys, at = keys[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
        total = np.maximum(1, np.bincount(at, minlength=n))
        distinct = np.bincount(at[new], minlength=n)
        out += [distinct / total, np.log1p(distinct)]
    # signed counts of hashed words; A-Z as a-z
    keys = hash_words(LOWER[data], starts, ends)
    sign = np.where(keys >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(row * WORD_DIMS + (keys % np.uint64(WORD_DIMS)).astype(np.int64), weights=sign, minlength=n * WORD_DIMS)
    return np.concatenate([np.stack(out, axis=1), bag.reshape(n, WORD_DIMS) / np.sqrt(many)[:, None]], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.02, seed: int = 5) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; where the bad part falls below 0, it is raised."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    r = np.random.default_rng(seed)
    d = both.shape[1]
    w = [r.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), r.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    z = np.clip((both - mean) / scale, -8, 8)
    p = len(positive)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    good = lambda g: np.logaddexp(0, -g)
    for step in range(1, steps + 1):
        h = np.tanh(z @ w[0] + w[1])
        g = h @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        bad = good(-g[p:]).mean() - prior * good(-g[:p]).mean()
        d_g = np.empty_like(g)
        if bad >= 0:
            d_g[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            d_g[p:] = s[p:] / (len(g) - p)
        else:
            d_g[:p] = prior * s[:p] / p
            d_g[p:] = -s[p:] / (len(g) - p)
        d_h = np.outer(d_g, w[2]) * (1 - h * h)
        grads = [z.T @ d_h + 1e-4 * w[0], d_h.sum(axis=0), h.T @ d_g + 1e-4 * w[2], np.array([d_g.sum()])]
        for k, x in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 1) -> float:
    """The share of good documents among the unlabelled, by two halves that score each other.

    Of the unlabelled documents over a threshold that a share q of the positives reaches, at most prior * q are good and
    the rest bad: the least quotient by q, over thresholds, bounds the prior from above and meets it where no bad
    document reaches the threshold. Small q are left out, as their quotients are noise. 0.5 where a half is too small.
    """
    r = np.random.default_rng(seed)
    halves = [r.permutation(len(x)) % 2 for x in (positive, unlabelled)]
    if min(len(positive), len(unlabelled)) < 40:
        return 0.5
    shares = np.linspace(0.4, 0.98, 40)
    quotients = []
    for k in (0, 1):
        model = fit(positive[halves[0] != k], unlabelled[halves[1] != k], 0.5)
        p, u = model.margin(positive[halves[0] == k]), model.margin(unlabelled[halves[1] == k])
        quotients.append([(u >= np.quantile(p, 1 - q)).mean() / q for q in shares])
    return float(np.clip(np.mean(quotients, axis=0).min(), 0.01, 0.99))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _figures(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the `most` rows (id, text) with the smallest hashes, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", BATCH_BYTES):
                x = [r.tobytes() for r in features(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(x, pa.binary())], names=["h", "x"])

    got = rows.select(F.xxhash64("id", "text").alias("h"), "text").mapInArrow(run, "h long, x binary").orderBy("h", "x").limit(most).collect()
    return np.array([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, len(features(pa.array([""]))[0])), np.float32)


def trained(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """A model fitted to at most `positives` documents labelled 1 and `unlabelled` without label, sampled by hash.

    Held-out rows give neither labels nor text, and labels other than 1 only tell which documents aren't unlabelled. Rows
    with a null label or identifier are no labels; of several labels of an identifier the smallest counts; repeated
    documents count as often. Without positives or unlabelled text the score is 0.5 throughout. Other columns, also of
    clashing names, are ignored. The same rows in any order give the same model.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("y"))
    good = known.where("y = 1")
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # one in so many, so that somewhat more than the sample is left to sort
    pick = lambda key, total, most: F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(max(1, int(total) * 3 // (4 * most)))) == 0
    trusted = good.where(pick(["label_id"], good.count(), positives)).select("label_id")
    # about 4 / 3 of `positives` identifiers: a broadcast of fixed size
    p = _figures(rows.join(F.broadcast(trusted), F.col("id") == F.col("label_id"), "left_semi"), positives)
    some = rows.where(pick(["id", "text"], docs.count(), unlabelled))
    named = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id")).distinct()
    u = _figures(some.join(named, F.col("id") == F.col("label_id"), "left_anti"), unlabelled)
    if not len(p) or not len(u):
        d = len(features(pa.array([""]))[0])
        return Model(np.zeros(d), np.ones(d), [np.zeros((d, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 0.5)
    return fit(p, u, estimated_prior(p, u))


def scored(docs: DataFrame, model: Model, payload: list[str], text_col: str = "text") -> DataFrame:
    """payload (a struct of the columns named) and score of every document; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*payload).alias("payload"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", BATCH_BYTES):
                x = features(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("payload"), pa.array(shared.value.scores(x))], names=["payload", "score"])

    kind = rows.schema["payload"].dataType.simpleString()
    return rows.mapInArrow(run, f"payload {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted; null texts count as empty, equal texts score alike."""
    done = scored(docs, trained(docs, labels), [id_col]).select(f"payload.{id_col}", "score")
    return done.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    return scored(docs, trained(docs, labels), docs.columns).where(F.col("score") >= threshold).select("payload.*")
