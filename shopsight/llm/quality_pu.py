"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are documents labelled good; the unlabelled set is web text as it comes.
A small network is trained on the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss.  The class prior is estimated without negatives: a network that
tells positives from unlabelled text ranks held-back documents of both, and the prior is
the smallest ratio of their upper-tail shares (best-bin estimate).

Only the text enters a score: shares of character classes, word and line repetition,
punctuation, lengths.  Training reads a bounded sample (``n_positive`` and
``n_unlabelled`` rows of smallest id hash, documents of the held-out fifth excluded); its
features, never its texts, reach the driver.  Scoring is one pass over all documents.

Defined cases: null and empty texts get the score of an all-zero feature row; rows without
doc_id are scored, not held out; null labels are ignored; repeated rows score alike;
without positives or unlabelled rows every score is 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shopsight.llm import textarrays as ta

N_POSITIVE, N_UNLABELLED = 4000, 8000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE = 16, 1500, 512, 0.01

CLASSES = {                                   # character classes counted per text
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~+=", "pipe": b"|", "bang": b"!", "stop": b".?", "comma": b",;:", "quote": b"\"'`",
    "bracket": b"()[]{}/\\", "line": b"\n", "high": bytes(range(128, 256)),
}
_TABLE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES.values(), 1):
    _TABLE[list(_chars)] = _k
N_FEATURES = len(CLASSES) - 1 + 9


def features(texts: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES): what a text looks like, independent of its topic or language."""
    data, off = ta.bytes_of(texts)
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES))
    starts, ends, woff = ta.words(data, off)
    n_words = np.diff(woff).astype(float)
    each = np.maximum(n_words, 1)
    kinds = np.bincount(np.repeat(np.arange(n) * 16, np.diff(off)) + _TABLE[data], minlength=16 * n).reshape(n, 16)
    chars = np.maximum(kinds[:, 1:].sum(1), 1)
    for k in range(1, len(CLASSES)):                           # all but the high bytes
        per = chars if k <= 2 else each                        # letters by characters, the rest by words
        out[:, k - 1] = np.minimum(kinds[:, k] / per, 3.0)
    h = ta.fingerprints(data, starts, ends)
    doc = ta.owner(woff)
    lens = (ends - starts).astype(float)
    sum_by = lambda v: np.bincount(doc, v, minlength=n)
    col = len(CLASSES) - 1
    out[:, col] = np.log1p(n_words)
    out[:, col + 1] = np.minimum(sum_by(lens) / each, 20)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, col + 2] = sum_by(same) / each                      # a word right after itself
    keyed = ta.mix(h ^ ta.mix(doc.astype(ta.U)))
    _, first = np.unique(keyed, return_index=True)
    out[:, col + 3] = np.bincount(doc[first], minlength=n) / each                       # distinct words
    pairs = ta.windows(keyed, 4)
    inside = np.flatnonzero(doc[:len(pairs)] == doc[len(doc) - len(pairs):]) if len(pairs) else np.zeros(0, int)
    _, first = np.unique(pairs[inside], return_index=True)
    runs = np.bincount(doc[inside], minlength=n)
    out[:, col + 4] = np.where(runs > 0, np.bincount(doc[inside][first], minlength=n) / np.maximum(runs, 1), 1.0)
    tail = data[ends - 1] if len(ends) else data
    out[:, col + 5] = sum_by(np.isin(_TABLE[tail], (4, 5, 6)).astype(float)) / each     # words ending in symbols
    shout = (data[starts] >= 65) & (data[starts] <= 90) & (lens > 1) if len(starts) else np.zeros(0, bool)
    shout &= (data[np.minimum(starts + 1, max(len(data) - 1, 0))] >= 65) & (data[np.minimum(starts + 1, max(len(data) - 1, 0))] <= 90) \
        if len(starts) else shout
    out[:, col + 6] = sum_by(shout.astype(float)) / each
    out[:, col + 7] = sum_by((lens == 1).astype(float)) / each
    out[:, col + 8] = np.log1p(n_words / (kinds[:, 11] + 1.0))                          # words per line
    out[n_words == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """A network with one hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on the non-negative risk; with ``prior`` None, on plain positive-or-unlabelled loss."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    d = pos.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        xp, xu = zp[rng.integers(0, len(zp), BATCH)], zu[rng.integers(0, len(zu), BATCH)]
        x = np.concatenate([xp, xu])
        hid = np.tanh(x @ theta[0] + theta[1])
        g = hid @ theta[2] + theta[3][0]
        gp, gu = g[:BATCH], g[BATCH:]
        dp_pos, dp_neg, du_neg = -_sigmoid(-gp) / BATCH, _sigmoid(gp) / BATCH, _sigmoid(gu) / BATCH
        if prior is None:
            dg = np.concatenate([dp_pos, du_neg])
        else:
            loss = lambda s: np.logaddexp(0, s).mean()
            negative = loss(gu) - prior * loss(gp)
            if negative >= 0:
                dg = np.concatenate([prior * (dp_pos - dp_neg), du_neg])
            else:                                     # step back from over-fitted unlabelled text
                dg = np.concatenate([prior * dp_neg, -du_neg])
        back = np.outer(dg, theta[2]) * (1 - hid**2)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), hid.T @ dg + 1e-4 * theta[2], np.array([dg.sum()])]
        rate = RATE * (1 - step / (steps + 1))
        for k, gr in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gr
            v[k] = 0.999 * v[k] + 0.001 * gr**2
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior or 0.0)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: smallest ratio of upper tails over held-back
    halves, with a margin for chance."""
    m = train(pos[::2], unl[::2], None, steps=STEPS // 2)
    sp, su = np.sort(m.logit(pos[1::2])), np.sort(m.logit(unl[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    tp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    tu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((tu + margin) / np.maximum(tp, 1e-9))
    # a low prior only scales the scores of good text down a little; a high one lifts junk
    return float(np.clip(0.95 * tu[best] / tp[best], 0.05, 0.98))


def held_out(doc_id: Column) -> Column:
    """One fifth of the ids, by crc32 of their decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in ta.text_batches(batches):
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("good"), ta.list_array(x.ravel(), np.arange(len(x) + 1) * N_FEATURES)], names=["good", "x"])


def fit(docs: DataFrame, labels: DataFrame, n_positive: int = N_POSITIVE,
        n_unlabelled: int = N_UNLABELLED) -> Model | None:
    """A model from the bounded sample, or None without positives or unlabelled rows."""
    open_docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = (labels.filter("quality = 1").select("doc_id").filter(F.col("doc_id").isNotNull())
            .filter(~held_out(F.col("doc_id"))).distinct())
    order = [F.xxhash64("doc_id", F.lit("quality")), "doc_id"]
    pos = good.join(open_docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(n_positive)
    unl = open_docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(n_unlabelled)
    picked = pos.withColumn("good", F.lit(1)).unionByName(unl.withColumn("good", F.lit(0)))   # bounded: broadcast
    rows = (open_docs.join(F.broadcast(picked), "doc_id").select("good", "text")
            .mapInArrow(_extract, "good int, x array<double>").collect())
    x, y = np.array([r.x for r in rows], float).reshape(len(rows), N_FEATURES), np.array([r.good for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    order = np.lexsort(np.c_[x, y].T)                        # the sample in one order, however it arrived
    order = np.random.default_rng(11).permutation(order)
    x, y = x[order], y[order]
    pos, unl = x[y == 1], x[y == 0]
    return train(pos, unl, estimate_prior(pos, unl))


def _scorer(model: Model | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ta.text_batches(batches, "text"):
            s = model.score(features(b.column("text"))) if model else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(s)], names=[*names, "__score"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = rows.mapInArrow(_id_scorer(model), StructType([StructField("doc_id", LongType()),
                                                          StructField("score", DoubleType())]))
    return both.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _id_scorer(model: Model | None):
    inner = _scorer(model, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in inner(batches):
            yield b.rename_columns(["doc_id", "score"])
    return run


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The input rows the model does not reject, with all their columns."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    out = docs.mapInArrow(_scorer(model, names), schema).filter(F.col("__score") >= THRESHOLD)
    return out.select(*[F.col(f"`{c}`") for c in names])
