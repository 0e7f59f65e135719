"""Vector codes from codebooks that are searched by Orchard's method (operator 11).

Vectors of whole numbers are cut into ``parts`` equal consecutive parts; every part position
has a codebook of up to ``entries`` entries, which starts as that part of the rows with the
smallest vec_ids.  A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of the mean of its parts;
after the rounds, parts are assigned once more and the codes are written.

Orchard search: for every entry there is a list of all entries sorted by their distance from
it.  A search holds the best entry so far and walks along that entry's list, ``STEP`` places
at a time, measuring entries that it has not marked as visited.  A better one takes over at
once, with its own list from the start.  The walk ends at the first entry farther from the best
one than twice the distance to the query: by the triangle inequality nothing from there on is
nearer, nor as near.  Distances are whole numbers, so the comparison (4 times the square) and
the ties are exact.  All searches of a batch of rows advance together as numpy arrays.

At scale: the rows are written once as whole numbers and read once a round; a task returns one
sum per used entry, so that a round shuffles at most parts * entries rows a task and brings
one codebook (parts * entries * entry size numbers) to the driver.  No row is grouped by its
entry, so a crowded entry is not a hot key.  Label sums are aggregated before they are joined
back, by broadcast up to a checked number of labels, else over salted labels.

Defined cases: see ``vectors`` for rows that are dropped or refused; rows without vec_id are
kept and come last in the order of the first codebook, repeated vec_ids are ordered by their
vectors and all keep their row; with fewer rows than entries the codebook is as small as the
table; rows without label share one ``label_error``; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import BROADCAST_ROWS, staged
from shopsight.llm.vectors import dimension, matrix, pieces, sum_lists, whole_numbers

STEP = 16                # list places a search looks at together
ROWS = 4096              # searches that advance together
SALTS = 16


class Orchard:
    """One codebook with its neighbour lists."""

    def __init__(self, entries: np.ndarray):
        n = len(entries)
        gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        near = np.argsort(gap, axis=1, kind="stable")
        sorted_gap = np.take_along_axis(gap, near, 1)
        # past the end of a list: an entry that is visited already, beyond every bound
        self.near = np.concatenate([near, np.repeat(np.arange(n)[:, None], STEP, 1)], 1)
        self.gap = np.concatenate([sorted_gap, np.full((n, STEP), np.iinfo(np.int64).max)], 1)
        self.axis = int(np.argmax(entries.max(0) - entries.min(0))) if entries.shape[1] else 0
        self.along = np.argsort(entries[:, self.axis], kind="stable")
        self.entries, self.size = entries, int(np.abs(entries).max(initial=0))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of every query, its squared distance, and how many distances it took."""
        n, m = len(self.entries), len(queries)
        level = self.entries[self.along, self.axis]
        best = self.along[np.minimum(np.searchsorted(level, queries[:, self.axis]), n - 1)]
        widest = self.size + int(np.abs(queries).max(initial=0))
        kind = np.int32 if widest ** 2 * queries.shape[1] < 1 << 31 else np.int64         # no square overflows
        queries, entries = np.ascontiguousarray(queries, kind), self.entries.astype(kind)
        distance = ((queries - entries[best]) ** 2).sum(1, dtype=np.int64)
        visited = np.zeros((m, n), bool)
        visited[np.arange(m), best] = True
        place, active, measured = np.zeros(m, np.int64), np.arange(m), m
        while len(active):
            at = best[active]
            columns = place[active, None] + np.arange(STEP)
            entry, gap = self.near[at[:, None], columns], self.gap[at[:, None], columns]
            inside = gap <= 4 * distance[active, None]
            row, column = np.nonzero(inside & ~visited[active[:, None], entry])
            found = entry[row, column]
            visited[active[row], found] = True
            measured += len(row)
            away = queries[active[row]] - entries[found]
            d = np.einsum("ij,ij->i", away, away)
            # smallest (distance, index) of each search
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
            who = active[row[first]]
            least = np.minimum.reduceat(d, first) if len(first) else d
            tied = np.where(d == np.repeat(least, np.diff(np.append(first, len(d)))), found, n)
            e = np.minimum.reduceat(tied, first) if len(first) else found
            better = (least < distance[who]) | ((least == distance[who]) & (e < best[who]))
            who, e, d = who[better], e[better], least[better]
            place[active] += STEP
            best[who], distance[who], place[who] = e, d, 0
            jumped = np.zeros(m, bool)
            jumped[who] = True
            active = active[inside[:, -1] | jumped[active]]
        return best, distance, measured


@dataclass(frozen=True)
class Codebooks:
    entries: list[np.ndarray]            # by part: (entries, part size) whole numbers

    def searchers(self) -> list[Orchard]:
        return [Orchard(e) for e in self.entries]

    def digest(self) -> str:
        numbers = ",".join(str(v) for part in self.entries for entry in part.tolist() for v in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def _summer(books: Codebooks, dim: int):
    """(part, entry, n, total) of the parts that a task assigns to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = books.searchers()
        width = dim // len(search)
        total = [np.zeros_like(s.entries) for s in search]
        count = [np.zeros(len(s.entries), np.int64) for s in search]
        for b in pieces(batches, ROWS):
            x = matrix(b, dim)
            for p, s in enumerate(search):
                part = x[:, p * width:(p + 1) * width]
                best = s.search(part)[0]
                np.add.at(total[p], best, part)
                count[p] += np.bincount(best, minlength=len(s.entries))
        for p, (t, c) in enumerate(zip(total, count)):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]),
                 pa.array(t[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    return run


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of staged ``whole_numbers`` rows."""
    dim = dimension(rows)
    if dim % parts:
        raise ValueError(f"vectors of {dim} entries do not fall into {parts} equal parts")
    width = dim // parts
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    books = Codebooks([start[:, p * width:(p + 1) * width].copy() for p in range(parts)])
    for _ in range(rounds if dim else 0):
        sums = rows.select("x").mapInArrow(_summer(books, dim), "part int, entry int, n bigint, total array<bigint>")
        moved = [e.copy() for e in books.entries]
        for r in sum_lists(sums, ["part", "entry"], {"total": width}, ["n"]).collect():
            moved[r.part][r.entry] = [t // r.n for t in r.total]
        books = Codebooks(moved)
    return books


def _coder(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = books.searchers()
        width = dim // len(search)
        hexes = np.array([f"{i:02x}" for i in range(max(256, *[len(s.entries) for s in search]))], object)
        for b in pieces(batches, ROWS):
            x = matrix(b, dim)
            found = [s.search(x[:, p * width:(p + 1) * width]) for p, s in enumerate(search)]
            code = sum([hexes[f[0]] for f in found[1:]], hexes[found[0][0]])
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()),
                                              pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the entry of each part in hex and the squared distances' sum."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint"
    if not sum(e.shape[1] for e in books.entries):
        return rows.sparkSession.createDataFrame([], schema)
    dim = sum(e.shape[1] for e in books.entries)
    return rows.select("vec_id", "label", "x").mapInArrow(_coder(books, dim), schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, x): the entries that the codes name, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("code").to_pylist()
            x = [[v for p, e in enumerate(books.entries) for v in e[int(c[2 * p:2 * p + 2], 16)].tolist()]
                 for c in codes]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(x, pa.list_(pa.int64()))],
                                             names=["vec_id", "x"])
    return coded.select("vec_id", "code").mapInArrow(
        run, f"vec_id {coded.schema['vec_id'].dataType.simpleString()}, x array<bigint>")


def label_errors(coded: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``coded`` with the sum of ``error`` over rows of the same label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= limit:
        return _by_label(coded, F.broadcast(sums))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _by_label(salted, copies, "salt").drop("salt")


def _by_label(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    names = [f"r_{c}" for c in ("label", *more)]
    right = right.select("label_error", *[F.col(c).alias(n) for c, n in zip(("label", *more), names)])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(("label", *more), names)]
    return left.join(right, same).drop(*names)


def codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of an embedding table."""
    numbers = staged(whole_numbers(rows), "vector-numbers")
    books = fit(numbers, parts, entries, rounds)
    coded = staged(encode(numbers, books), "vector-codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error",
                                      F.lit(books.digest()).alias("codebooks_sha256"))
