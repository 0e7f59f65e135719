"""Vector codes (operator 11) and whitening (operator 13) against plain forms."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from shopsight.llm import vector_codes, whitening
from shopsight.llm.bidiagonal import leading
from shopsight.llm.common import staged
from shopsight.llm.vectors import whole_numbers

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                     StructField("label", IntegerType()),
                     # names that operators use inside
                     StructField("x", StringType()), StructField("code", StringType()),
                     StructField("error", StringType()), StructField("salt", StringType()),
                     StructField("n", IntegerType()), StructField("component", StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "c", "e", "s", 1, "k") for r in rows], SCHEMA).repartition(3)


def vectors(n=700, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in np.float32(rng.normal(size=dim) * 0.2)], int(i % 5) if i % 7 else None)
            for i in rng.permutation(n)]
    rows += [(3, rows[10][1], 1), (3, rows[10][1], 1), (None, rows[11][1], None)]          # repeated rows, no id
    rows += [(9000, None, 1), (9001, [None] + rows[0][1][1:], 1), (9002, [float("nan")] * dim, 2),
             (9003, [float("inf")] + [0.0] * (dim - 1), 2), (9004, [], 3)]
    rows += [(9100 + i, rows[20][1], 9) for i in range(250)]                                # a hot vector and label
    return rows


def kept(rows):
    out = []
    for i, v, label in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, [int(np.floor(1024 * float(c))) for c in v], label))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{(vec_id, vector): (code, error)}, label sums and the codebooks' digest, by all distances."""
    rows = kept(rows)
    x = np.array([r[1] for r in rows], np.int64)
    width = x.shape[1] // parts
    codes, errors, books = [""] * len(rows), np.zeros(len(rows), np.int64), []
    for p in range(parts):
        part = x[:, p * width:(p + 1) * width]
        book = part[:entries].copy()
        for k in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            best = d.argmin(1)
            if k < rounds:
                for e in set(best.tolist()):
                    mine = part[best == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        codes = [c + f"{b:02x}" for c, b in zip(codes, best)]
        errors += d.min(1)
        books.append(book)
    labels = defaultdict(int)
    for r, e in zip(rows, errors.tolist()):
        labels[r[2]] += e
    text = ",".join(str(v) for b in books for e in b.tolist() for v in e)
    return (sorted((-1 if r[0] is None else r[0], c, e, labels[r[2]]) for r, c, e in zip(rows, codes, errors.tolist())),
            hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 90, 700])
def test_codes_equal_all_distances(spark, n):
    rows = vectors()[:n] if n < 700 else vectors()
    found = vector_codes.codes(frame(spark, rows)).collect()
    if not n:
        assert not found
        return
    want, digest = plain_codes(rows)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in found) == want
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_orchard_ties_and_size():
    rng = np.random.default_rng(1)
    for dim, high in ((1, 4), (2, 3), (3, 2), (16, 300), (4, 1 << 27)):
        book = rng.integers(-high, high + 1, (200, dim))                    # many equal entries and distances
        queries = rng.integers(-high, high + 1, (500, dim))
        d = ((queries[:, None] - book[None]) ** 2).sum(2)
        best, distance, _ = vector_codes.Orchard(book).search(queries)
        assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_orchard_measures_fewer_than_all():
    rng = np.random.default_rng(2)
    book = rng.integers(0, 10_000, (256, 2))
    queries = rng.integers(0, 10_000, (2000, 2))
    assert vector_codes.Orchard(book).search(queries)[2] < 2000 * 256 / 4


def test_codes_decode_and_salted_labels(spark):
    rows = vectors()
    numbers = staged(whole_numbers(frame(spark, rows)), "t")
    books = vector_codes.fit(numbers, entries=16, rounds=1)
    coded = vector_codes.encode(numbers, books)
    assert {len(r.x) for r in vector_codes.decode(coded, books).collect()} == {8}
    wide, salted = (sorted((str(r.vec_id), str(r.label), r.error, r.label_error)
                           for r in vector_codes.label_errors(coded, limit).collect()) for limit in (100, 0))
    assert wide == salted and len(wide) == len(kept(rows))


def test_refused_vectors(spark):
    with pytest.raises(ValueError, match="parts"):
        vector_codes.codes(frame(spark, [(1, [0.1] * 6, 1)]))
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(frame(spark, [(1, [0.1] * 6, 1), (2, [0.1] * 7, 1)]))
    with pytest.raises(Exception, match="in size"):
        vector_codes.codes(frame(spark, [(1, [3e9] * 8, 1)]))


def _check_whitening(found, rows, components=8):
    rows = kept(rows)
    x = np.array([r[1] for r in rows], np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, x.shape[1])
    assert len(found) == n * count and {r.n for r in found} == {n}
    have = int((values[:count] > 1e-9 * max(values[0], 1e-300)).sum()) if values[0] > 1e-12 else 0
    dev = defaultdict(list)
    for (i, _, _), v in zip(rows, x):
        dev[i].append(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)))
    for i, mine in dev.items():
        assert sorted(r.deviation for r in found if r.vec_id == i and r.component == 1) == sorted(mine)
    by = defaultdict(list)
    for r in found:
        by[r.component].append(r)
    for k in range(1, count + 1):
        part = by[k]
        if k > have:
            assert all(r.whitened is None and r.explained == 0 for r in part)
            continue
        assert part[0].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        want = defaultdict(list)
        for (i, _, _), c in zip(rows, centred @ vectors[:, k - 1] / np.sqrt(values[k - 1])):
            want[i].append(c)
        a = np.array([w for i in sorted(want, key=str) for w in sorted(want[i])])
        got = defaultdict(list)
        for r in part:
            got[r.vec_id].append(r.whitened)
        b = np.array([w for i in sorted(got, key=str) for w in sorted(got[i])])
        if min(abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1) > 1e-4 * values[0]:
            assert min(np.abs(a - b).max(), np.abs(np.sort(a) + np.sort(b)[::-1]).max()) < 1e-7
    if have:
        assert max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 3, 700])
def test_whitening_equals_eigenvectors(spark, n):
    rows = vectors(dim=12)[:n] if n < 700 else vectors(dim=12)
    found = whitening.whiten(frame(spark, rows)).collect()
    if not n:
        assert not found
        return
    _check_whitening(found, rows)


def test_whitening_short_and_constant(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(rng.normal())), 0.5, 0.25], i % 2) for i in range(60)]
    _check_whitening(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_triangles_merge_in_stages(spark):
    rows = frame(spark, vectors()).repartition(40)
    numbers = staged(whole_numbers(rows, whitening.SHIFT), "t")
    w = whitening.fit(numbers)
    r = whitening.triangle(numbers, w.n, w.sums)
    x = np.array([v for _, v, _ in kept(vectors())], float)
    x -= x.mean(0)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-10, atol=1e-6)


def test_deviation_beyond_64_bits():
    x = np.array([[100_000, 100_000], [1 << 40, 5]], np.int64)
    n, s = 1 << 20, [1 << 50, 7]
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert whitening._deviation(x, n, s).to_pylist() == [e if e < 1 << 63 else None for e in exact]


def _matrices():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(200, 64)))[0]
    w = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    yield "random", rng.normal(size=(300, 64))
    yield "graded", rng.normal(size=(300, 64)) * 10.0 ** -np.arange(64)
    yield "identity", np.eye(64)
    yield "isotropic", q @ w.T
    yield "equal values", q @ np.diag([5.0, 5, 5, 3, 3] + [1.0] * 59) @ w.T
    yield "nearly equal", q @ np.diag(1 + 1e-13 * np.arange(64)) @ w.T
    yield "rank 3", rng.normal(size=(100, 3)) @ rng.normal(size=(3, 64))
    yield "constant columns", np.hstack([rng.normal(size=(100, 5)), np.zeros((100, 59))])
    yield "zero", np.zeros((10, 64))
    yield "one row", rng.normal(size=(1, 64))
    for k in range(100):
        yield f"small {k}", rng.integers(-2, 3, (rng.integers(1, 30), rng.integers(1, 20))).astype(float)


@pytest.mark.parametrize("name,x", list(_matrices()))
def test_singular_vectors(name, x):
    dim = x.shape[1]
    values, kept_values, v = leading(whitening._triangle(x), 8)
    want = np.zeros(dim)
    svd = np.linalg.svd(x, compute_uv=False) ** 2
    want[:len(svd)] = svd
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * top
    assert len(kept_values) == min(8, (want > 1e-20 * top).sum() if name == "graded" else (want > 1e-12 * top).sum())
    if len(v):
        assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-9
        assert np.abs(x.T @ (x @ v.T) - v.T * kept_values).max() <= 1e-11 * top
        assert np.abs(kept_values / want[:len(kept_values)] - 1).max() < 1e-9
