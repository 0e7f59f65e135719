"""Quality rules with line sequence labelling (operator 4).

Per text: word counts, symbol characters, repeated lines and words inside repeated 8-word
windows, from the whole text.  Each line then becomes a feature row, and a linear-chain
conditional random field over the text's lines marks it content or boilerplate (Viterbi);
the share of words in content lines decides retention.

The field is trained here, on a bounded sample of labelled documents (``per_class`` of each
class by smallest id hash, held-out fifth excluded; of a text with more than ``TRAIN_LINES`` lines
that many adjoining ones, from a place set by its id, and of an id's rows one).  Labels are per document, so training
has two steps: a line classifier from document labels, which relabels lines of bad
documents that look like content, then the field's likelihood by forward-backward.

Defined cases: null and empty texts have no words and fail the base rules; a single line
is a sequence of one; rows without doc_id are judged, not used in training; null labels
are ignored; without labelled lines of both classes the base rules alone decide; repeated
rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from shopsight.llm import textarrays as ta

PER_CLASS = 1500
TRAIN_LINES = 1024            # lines of a text in the training sample
CONTENT_SHARE = 0.5
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
SYMBOL_BYTES = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOL_BYTES)] = True
FEATURES = ("bias", "words", "symbols", "pipes", "bangs", "upper", "digits", "word_length", "repeated_line",
            "word_again", "repeated_words", "sentence_end")


@dataclass(frozen=True)
class Lines:
    """Counts per text and features per line of one batch."""

    counts: np.ndarray        # texts x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    features: np.ndarray      # lines x FEATURES
    words: np.ndarray         # words per line
    offsets: np.ndarray       # n + 1 line offsets of the texts


def measure(texts: pa.Array) -> Lines:
    data, off = ta.bytes_of(texts)
    n = len(off) - 1
    starts, ends, woff = ta.words(data, off)
    doc = ta.owner(woff)
    by_doc = np.repeat(np.arange(n), np.diff(off))
    newline = np.flatnonzero(data == 10)
    line_doc = np.concatenate([np.arange(n), by_doc[newline]])
    ls = np.concatenate([off[:-1], newline + 1])
    order = np.lexsort((ls, line_doc))
    ls, line_doc = ls[order], line_doc[order]
    loff = np.searchsorted(line_doc, np.arange(n + 1))
    le = np.empty_like(ls)
    le[:-1] = ls[1:] - 1
    le[loff[1:] - 1] = off[1:]
    m = len(ls)
    # the last line that starts at or before a byte holds it: empty texts start before the next one
    line = np.searchsorted(ls, starts, "right") - 1 if m else starts
    per_line = np.bincount(line, minlength=m)
    h = ta.fingerprints(data, starts, ends)
    keyed = ta.mix(h ^ ta.mix(doc.astype(ta.U) + ta.U(1)))

    runs = ta.windows(keyed, WINDOW)
    at = np.flatnonzero(doc[:len(runs)] == doc[len(doc) - len(runs):]) if len(runs) else np.zeros(0, np.int64)
    _, inverse, times = np.unique(runs[at], return_inverse=True, return_counts=True)
    again = ta.covered(at[times[inverse] > 1], WINDOW, len(h))

    filled = np.flatnonzero(per_line > 0)
    lh = ta.mix(ta.fingerprints(data, ls[filled], le[filled]) ^ ta.mix(line_doc[filled].astype(ta.U) + ta.U(1)))
    _, first, inverse = np.unique(lh, return_index=True, return_inverse=True)
    dup = np.zeros(m, bool)
    dup[filled[first[inverse] != np.arange(len(filled))]] = True

    inside = ~ta.BLANK[data]
    symbol = _SYMBOL[data]
    count = lambda flags: np.bincount(by_doc[flags], minlength=n)
    counts = np.stack([np.diff(woff), count(inside & ((data & 0xC0) != 0x80)), count(symbol),
                       np.bincount(line_doc[dup], minlength=n), np.bincount(doc[again], minlength=n)], 1)

    byte_line = np.searchsorted(ls, np.flatnonzero(data < 128), "right") - 1 if m else newline
    ascii_ = data[data < 128]
    kind = np.zeros(128, np.int64)
    kind[list(SYMBOL_BYTES)] = 1
    kind[ord("|")], kind[ord("!")] = 2, 3
    kind[65:91], kind[48:58], kind[97:123] = 4, 5, 6
    k = np.bincount(byte_line * 8 + kind[ascii_], minlength=8 * m).reshape(m, 8) if m else np.zeros((0, 8))
    each = np.maximum(per_line, 1)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    tail = np.zeros(m, bool)
    some = filled
    if len(some):
        last_word = np.searchsorted(line, some, "right") - 1
        tail[some] = np.isin(data[ends[last_word] - 1], list(b".?:;\"'"))
    x = np.stack([np.ones(m), np.minimum(np.log1p(per_line), 6) / 3, np.minimum((k[:, 1] + k[:, 2]) / each, 3),
                  np.minimum(k[:, 2] / each, 2), np.minimum(k[:, 3] / each, 2), k[:, 4] / np.maximum(k[:, 4] + k[:, 6], 1),
                  np.minimum(k[:, 5] / each, 3) / 3, np.minimum(np.bincount(line, ends - starts, minlength=m) / each, 20) / 10,
                  dup.astype(float), np.bincount(line, same, minlength=m) / each,
                  np.bincount(line, again, minlength=m) / each, tail.astype(float)], 1)
    x[per_line == 0, 1:] = 0
    return Lines(counts, x, per_line, loff)


@dataclass(frozen=True)
class Field:
    """A linear-chain field of two states (0 content, 1 boilerplate)."""

    weight: np.ndarray        # features: what speaks for boilerplate
    step: np.ndarray          # 2 x 2 transition scores

    def decode(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Most likely states of all sequences at once, a position at a time (Viterbi)."""
        n = np.diff(off)
        order = np.argsort(-n, kind="stable")
        begin, left = off[:-1][order], n[order]
        e = x @ self.weight
        back = np.zeros((len(x), 2), np.int8)
        states = np.zeros(len(x), np.int8)
        live = int((left > 0).sum())
        if not live:
            return states
        score = np.zeros((live, 2))
        score[:, 1] = e[begin[:live]]
        final = np.zeros((live, 2))
        for t in range(1, int(left[0]) + 1):
            now = int((left > t).sum())
            final[now:len(score)] = score[now:]
            if not now:
                break
            ways = score[:now, :, None] + self.step[None]
            back[begin[:now] + t] = ways.argmax(1)
            score = ways.max(1)
            score[:, 1] += e[begin[:now] + t]
        state = final.argmax(1).astype(np.int8)
        for t in range(int(left[0]) - 1, -1, -1):
            now = int((left > t).sum())
            at = begin[:now] + t
            states[at] = state[:now]
            state[:now] = back[at, state[:now]]
        return states


def _expectations(weight, step, x, begin, left):
    """Forward-backward over sequences sorted by length: state and transition marginals."""
    e = np.zeros((len(x), 2))
    e[:, 1] = x @ weight
    alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    alpha[begin] = e[begin]
    longest = int(left[0])
    live = [int((left > t).sum()) for t in range(longest + 1)]
    lse = lambda a, axis: np.logaddexp(*np.moveaxis(a, axis, 0))
    for t in range(1, longest):
        at = begin[:live[t]] + t
        alpha[at] = lse(alpha[at - 1][:, :, None] + step, 1) + e[at]
    for t in range(longest - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        beta[at] = lse(step + (e[at + 1] + beta[at + 1])[:, None, :], 2)
    total = alpha + beta
    marginal = np.exp(total - lse(total, 1)[:, None])
    inner = np.concatenate([begin[:live[t]] + t for t in range(1, longest)]) if longest > 1 else np.zeros(0, np.int64)
    pair = alpha[inner - 1][:, :, None] + step + (e[inner] + beta[inner])[:, None, :]
    z = lse(total, 1)[inner]
    return marginal, np.exp(pair - z[:, None, None]).sum(0), inner


def train(x: np.ndarray, off: np.ndarray, bad: np.ndarray, steps: int = 150) -> Field:
    """``bad``: per line, whether its document is labelled bad."""
    y = bad.astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(400):                                     # line classifier from document labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    y = y * (x @ w > 0)
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    begin, left = off[:-1][order], n[order]
    begin, left = begin[left > 0], left[left > 0]
    step = np.zeros((2, 2))
    state = y.astype(int)
    seen = np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    for t in range(1, steps + 1):                            # the field's likelihood (Adam)
        marginal, pairs, inner = _expectations(w, step, x, begin, left)
        if t == 1 and len(inner):
            np.add.at(seen, (state[inner - 1], state[inner]), 1)
        grads = [x.T @ (marginal[:, 1] - y) / len(y) + 1e-4 * w, (pairs - seen) / len(y) + 1e-3 * step]
        for k, (theta, g) in enumerate(zip((w, step), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g**2
            theta -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Field(w, step)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in ta.text_batches(batches):
        m = measure(b.column("text"))
        k, n = len(FEATURES), np.diff(m.offsets)
        taken = np.minimum(n, TRAIN_LINES)
        begin = m.offsets[:-1] + np.array([zlib.crc32(str(i).encode()) for i in b.column("doc_id").to_pylist()], np.int64) % (n - taken + 1)
        offsets = np.concatenate([[0], np.cumsum(taken)])
        rows = np.repeat(begin - offsets[:-1], taken) + np.arange(offsets[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("quality"), ta.list_array(m.features[rows].ravel(), offsets * k)],
            names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field | None:
    marked = (labels.filter("doc_id is not null and quality in (0, 1)")
              .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
              .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = [F.xxhash64("doc_id", F.lit("lines")), "doc_id"]
    there = marked.join(rows.select("doc_id"), "doc_id", "left_semi")
    picked = there.filter("quality = 0").orderBy(*order).limit(per_class).unionByName(
        there.filter("quality = 1").orderBy(*order).limit(per_class))                      # bounded: broadcast
    got = (rows.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
           .mapInArrow(_lines, "doc_id bigint, quality int, x array<double>")
           .groupBy("doc_id", "quality").agg(F.max("x").alias("x")).collect())             # rows may share an id
    got.sort(key=lambda r: r.doc_id)
    if len({r.quality for r in got}) < 2:
        return None
    x = np.concatenate([np.array(r.x, float).reshape(-1, len(FEATURES)) for r in got])
    sizes = np.array([len(r.x) // len(FEATURES) for r in got])
    bad = np.repeat([r.quality == 0 for r in got], sizes)
    return train(x, np.concatenate([[0], np.cumsum(sizes)]), bad)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, n_content_lines) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ta.text_batches(batches):
            m = measure(b.column("text"))
            c = m.counts
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > REPEAT_PERCENT * c[:, 0])
            n = np.diff(m.offsets)
            content = np.ones(len(m.words), bool) if field is None else field.decode(m.features, m.offsets) == 0
            doc = ta.owner(m.offsets)
            good = np.bincount(doc, content * m.words, minlength=len(n))
            kept = ~failed & (good >= CONTENT_SHARE * c[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(np.ascontiguousarray(c[:, k])) for k in range(5)], pa.array(failed),
                 pa.array(kept), pa.array(n), pa.array(np.bincount(doc, content, minlength=len(n)).astype(np.int64))],
                names=schema.names)

    whole = [StructField(c, LongType()) for c in ("doc_id", *NAMES)]
    schema = StructType([*whole, StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
                         StructField("n_lines", LongType()), StructField("n_content_lines", LongType())])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
