"""Chat formatting: roles recovered by a hidden Markov model (operator 7).

Parsing: a row's text is cut before every line that opens with a speaker marker
("User:", "### Assistant", "<|system|>", "Q:" ...), so a row may be one turn or a whole
pasted transcript.  A segment is observed through its marker, its length, its number of
lines and whether it ends as a question.  States are the roles; start, transition and
emission probabilities are counted on conversations with known roles (held-out fifth
excluded).  Viterbi decoding recovers the role of every segment, and each is rendered as
one canonical turn ``<|role|>\\ntext\\n<|end|>``.

Scale: conversations are never gathered.  Segments are range-partitioned in conversation
order; a task decodes batches of at most 10,000 segments, many conversations at once.  A
conversation cut by a batch edge is decoded in pieces: each piece reports its best score
from every entering to every leaving state (a max-plus matrix), the matrices of a
conversation - one for 10,000 of its rows - are chained, and the pieces are decoded
between the states so found.  The result is the exact Viterbi path.  Texts are joined to
their roles by (conversation, turn, segment, hash), a key without hot values.

Defined cases: rows equal in conversation, turn and text are one turn; null text is the
empty text and still a turn; null turns come first; null conversations are one
conversation; unknown roles are not used in training; without training rows all roles are
equally likely and ties go to the first role; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import staged

ROLES = ("system", "user", "assistant")
# Speaker names as they are written in transcripts.
SPEAKERS = {"system": "system|context|instructions?", "user": "user|human|question|q|customer",
            "assistant": "assistant|ai|bot|answer|a|model|agent"}
_ANY = "|".join(SPEAKERS.values())
OPENING = rf"(?i)^[ \t]*(?:<\|?(?:{_ANY})\|?>|\[(?:{_ANY})\][ \t]*:?|#{{1,4}}[ \t]*(?:{_ANY})[ \t]*:?(?=[ \t]*(?:\n|$))|\**(?:{_ANY})\**[ \t]*:)[ \t]*\n?"
BOUNDARY = rf"(?i)\n(?=[ \t]*(?:<\|?(?:{_ANY})\|?>|\[(?:{_ANY})\]|#{{1,4}}[ \t]*(?:{_ANY})[ \t]*:?[ \t]*\n|\**(?:{_ANY})\**[ \t]*:))"
LENGTHS, LINES = 16, 8
SMOOTH = 0.5
MARKED = 0.1              # prior share of segments that open with their own role's marker


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, h, marker, length, lines, question, body) of every segment."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = (rows.select("conv_id", "turn", text.alias("text")).distinct()
            .select("conv_id", "turn", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", BOUNDARY))
                    .alias("segment", "raw")))
    opening = F.regexp_extract("raw", OPENING, 0)
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(opening.rlike(rf"(?i)(?<![a-z])(?:{SPEAKERS[role]})(?![a-z])"), F.lit(k)).otherwise(marker)
    body = F.trim(F.regexp_replace("raw", OPENING, ""))
    return (each.select("conv_id", "turn", "segment", "h", marker.cast("int").alias("marker"), body.alias("body"))
            .withColumn("length", F.least(F.floor(F.log2(F.length("body") + 1)), F.lit(LENGTHS - 1)).cast("int"))
            .withColumn("lines", F.least(F.length("body") - F.length(F.translate("body", "\n", "")),
                                         F.lit(LINES - 1)).cast("int"))
            .withColumn("question", F.col("body").endswith("?").cast("int")))


@dataclass(frozen=True)
class Hmm:
    """Log probabilities: start (3), step (3 x 3), one emission table a feature (3 x values)."""

    start: np.ndarray
    step: np.ndarray
    emit: dict[str, np.ndarray]

    def score(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.emit[c][:, v].T for c, v in columns.items())


FEATURES = {"marker": len(ROLES) + 1, "length": LENGTHS, "lines": LINES, "question": 2}


def _log(counts: np.ndarray) -> np.ndarray:
    c = counts + SMOOTH
    return np.log(c / c.sum(-1, keepdims=True))


def fit(conversations: DataFrame) -> Hmm:
    """Counts over all training rows; only the count tables reach the driver."""
    known = (conversations.filter(F.col("role").isin(*ROLES))
             .filter(F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 != 0, F.lit(False)))
             .select("conv_id", "turn", "role", "text").distinct())
    index = F.element_at(F.create_map(*[x for k, r in enumerate(ROLES) for x in (F.lit(r), F.lit(k))]), F.col("role"))
    roles = known.select("conv_id", "turn", index.alias("state"), "text")
    seen = segments(known).join(roles.select("conv_id", "turn", "state", F.xxhash64(
        F.coalesce("text", F.lit(""))).alias("h")), ["conv_id", "turn", "h"])
    emit = {}
    for c, n in FEATURES.items():
        table = np.zeros((len(ROLES), n))
        for r in seen.groupBy("state", c).count().collect():          # 3 x n rows
            table[r["state"], r[c]] = r["count"]
        if c == "marker":                     # a marker names its role, also where training text has none
            table[range(len(ROLES)), range(1, len(ROLES) + 1)] += MARKED * (1 + table.sum(1))
            table += MARKED / 50 * (1 + table.sum(1, keepdims=True))
        emit[c] = _log(table)
    before = roles.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("state").alias("last"))
    steps = roles.join(before, ["conv_id", "turn"], "left").groupBy("last", "state").count().collect()
    start, step = np.zeros(len(ROLES)), np.zeros((len(ROLES), len(ROLES)))
    for r in steps:
        if r["last"] is None:
            start[r["state"]] = r["count"]
        else:
            step[r["last"], r["state"]] = r["count"]
    return Hmm(_log(start), _log(step), emit)


def _sequences(same: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal neighbours."""
    return np.concatenate([[0], np.flatnonzero(~same) + 1, [len(same) + 1]])


def forward(e: np.ndarray, off: np.ndarray, first: np.ndarray, step: np.ndarray):
    """Best scores of all sequences at once.  ``first``: sequences x starts x states, the score
    of entering each state from each start.  Returns the final scores and back pointers."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    begin, left = off[:-1][order], n[order]
    score = first[order] + e[begin][:, None, :]
    final = np.empty_like(score)
    back = np.zeros((len(e), first.shape[1], e.shape[1]), np.int8)
    for t in range(1, int(left[0]) + 1):
        now = int((left > t).sum())
        final[now:len(score)] = score[now:]
        if not now:
            break
        ways = score[:now, :, :, None] + step
        back[begin[:now] + t] = ways.argmax(2)
        score = ways.max(2) + e[begin[:now] + t][:, None, :]
    out = np.empty_like(final)
    out[order] = final
    return out, back


def backward(off: np.ndarray, back: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of all sequences from their last states (one start each)."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    begin, left, state = off[:-1][order], n[order], state[order].copy()
    out = np.zeros(int(off[-1]), np.int8)
    for t in range(int(left[0]) - 1, -1, -1):
        now = int((left > t).sum())
        at = begin[:now] + t
        out[at] = state[:now]
        state[:now] = back[at, 0, state[:now]]
    return out


def viterbi(e: np.ndarray, hmm: Hmm) -> np.ndarray:
    """The most likely states of one sequence (used as the plain form in tests)."""
    off = np.array([0, len(e)])
    final, back = forward(e, off, hmm.start[None, None, :], hmm.step)
    return backward(off, back, final[:, 0].argmax(1))


_PIECE_DDL = ("conv_id bigint, turn bigint, segment int, h bigint, part int, batch int, pos int, "
              "marker int, length int, lines int, question int, matrix array<double>")


def _emissions(b, hmm: Hmm) -> np.ndarray:
    return hmm.score({c: b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES})


def _conv_keys(b) -> np.ndarray:
    c = b.column("conv_id")
    return np.stack([c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)], 1)


def _pieces(hmm: Hmm):
    """Every segment with its place, the last one of a piece with the piece's matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(x for x in batches if x.num_rows):
            keys = _conv_keys(b)
            off = _sequences((keys[1:] == keys[:-1]).all(1))
            enter = np.concatenate([hmm.start[None], hmm.step])              # from nothing, or from each state
            final, _ = forward(_emissions(b, hmm), off, np.repeat(enter[None], len(off) - 1, 0), hmm.step)
            n = b.num_rows
            loff = np.zeros(n + 1, np.int32)
            loff[off[1:]] = final[0].size
            valid = np.zeros(n, bool)
            valid[off[1:] - 1] = True
            matrix = pa.ListArray.from_arrays(pa.array(np.cumsum(loff, dtype=np.int32)), pa.array(final.ravel()),
                                              mask=pa.array(~valid))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("segment"), b.column("h"),
                 pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, k, np.int32)),
                 pa.array(np.arange(n, dtype=np.int32)), *[b.column(c) for c in FEATURES], matrix],
                names=["conv_id", "turn", "segment", "h", "part", "batch", "pos", *FEATURES, "matrix"])
    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states on both sides of every piece of one conversation."""
    pdf = pdf.sort_values(["part", "batch"])
    m = np.array(pdf["matrix"].tolist()).reshape(len(pdf), len(ROLES) + 1, len(ROLES))
    score, back = m[0, 0], []
    for x in m[1:, 1:]:
        ways = score[:, None] + x
        back.append(ways.argmax(0))
        score = ways.max(0)
    last = [int(score.argmax())]
    for bp in reversed(back):
        last.append(int(bp[last[-1]]))
    last.reverse()
    return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "batch": pdf["batch"],
                         "enter": [-1, *last[:-1]], "leave": last})


def _decode(hmm: Hmm):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos").combine_chunks()
        keys = _conv_keys(t)
        off = _sequences((keys[1:] == keys[:-1]).all(1))
        enter, leave = (t.column(c).to_numpy()[off[:-1]] for c in ("enter", "leave"))
        first = np.where((enter < 0)[:, None], hmm.start, hmm.step[np.maximum(enter, 0)])
        final, back = forward(_emissions(t, hmm), off, first[:, None, :], hmm.step)
        state = backward(off, back, np.where(leave < 0, final[:, 0].argmax(1), leave))
        return pa.table({"conv_id": t.column("conv_id"), "turn": t.column("turn"), "segment": t.column("segment"),
                         "h": t.column("h"), "role": pa.array([ROLES[s] for s in state.tolist()])})
    return run


def recover(parsed: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, turn, segment, h, role) of all segments."""
    light = parsed.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                          F.col("segment").cast("int").alias("segment"), "h", *FEATURES)
    order = ["conv_id", "turn", "h", "segment"]
    placed = staged(light.repartitionByRange(*order).sortWithinPartitions(*order)
                    .mapInArrow(_pieces(hmm), _PIECE_DDL), "segments")
    ends = placed.filter("matrix is not null").select("conv_id", "part", "batch", "matrix")
    cut = ends.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"))
    chained = (ends.join(cut, ends["conv_id"].eqNullSafe(cut["_c"])).drop("_c")
               .groupBy("conv_id").applyInPandas(_chain, "conv_id bigint, part int, batch int, enter int, leave int"))
    chained = chained.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("batch").alias("_b"),
                             "enter", "leave")
    rows = placed.drop("matrix").join(
        chained, placed["conv_id"].eqNullSafe(chained["_c"]) & (placed["part"] == chained["_p"])
        & (placed["batch"] == chained["_b"]), "left").drop("_c", "_p", "_b")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("enter", "leave")})
    return rows.groupBy("part", "batch").applyInArrow(
        _decode(hmm), "conv_id bigint, turn bigint, segment int, h bigint, role string")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>"))


def format_turns(conversations: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, turn, segment, role, rendered): one canonical turn per segment."""
    parsed = segments(conversations.select("conv_id", "turn", "text"))
    roles = recover(parsed, hmm).select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "segment", "h", "role")])
    keys = [parsed[c].eqNullSafe(roles[f"_{c}"]) for c in ("conv_id", "turn", "segment", "h")]
    same = keys[0] & keys[1] & keys[2] & keys[3]
    return parsed.join(roles, same).select(
        "conv_id", "turn", "segment", F.col("_role").alias("role"), rendered(F.col("_role"), F.col("body")).alias("rendered"))
