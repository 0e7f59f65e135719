"""Exact, near and substring dedup against plain Python."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopsight.llm import components, exact_dedup, near_dedup, substring_dedup
from shopsight.llm import textarrays as ta
from shopsight.llm.common import even_join
from tests.llm import helpers as h


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), keep is not None and i == keep))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_share": 3}, {"hot_share": 1000, "salts": 5}])
def test_exact_classes(spark, how):
    rows = [r[:2] for r in h.corpus()] + [(100, h.corpus()[0][1]), (None, None), (900, None)]
    got = exact_dedup.classes(h.frame(spark, rows), **how).drop("digest").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _exact(rows)))


def test_exact_weak_digest_compares_content(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", None, "", "b", "d"] * 3)]
    weak = lambda text: F.pmod(F.xxhash64(text), F.lit(2))
    got = exact_dedup.classes(h.frame(spark, rows), weak).drop("digest").collect()
    assert sorted(map(tuple, got)) == sorted(_exact(rows))


def test_exact_deduplicate_keeps_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "A")]
    df = h.frame(spark, rows)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6]
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0 and exact_dedup.classes(df.limit(0)).count() == 0


def test_near_classes(spark):
    rows = [r[:2] for r in h.corpus()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(h.frame(spark, rows)).collect()}
    for i, (n, c) in h.near_classes(rows).items():
        assert got[i] == (n, c, i == c), i
    assert got[None][1:] == (None, True)


def test_near_threshold_is_exact(spark):
    # 3 shared of 4, 29 of 39 and 30 of 40 shingles: only 75 % and more are linked
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, h.prose(3, 38)), (4, " ".join(h.prose(3, 38).split()[:33]) + " z1 z2 z3 z4 z5")]
    got = {r.doc_id: r.component_id for r in near_dedup.classes(h.frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in h.near_classes(rows).items()}


def test_near_deduplicate(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (7, ""), (8, None), (9, ""), (None, "a b c d e f g")]
    out = near_dedup.deduplicate(h.frame(spark, rows))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 2, 7, 8, 9]
    assert "kept" in out.columns and near_dedup.classes(out.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(ta.U) for n in (600, 100, 100))
    values = np.concatenate([common, a, common, b])
    sig = near_dedup.signatures(values, np.array([0, 700]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.08


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100 + i, 100) for i in range(1, 20)] + [(200, 119), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(31)) and got[200] == 100 and got[119] == 100
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_substring_digests(spark):
    rows = [(i if r[0] is not None else None, r[1]) for i, r in enumerate(h.corpus())]
    rows += [(900, h.prose(3, 200)), (901, "z " * 34 + "tail"), (902, "q q " * 60)]
    exp = sorted(repr((r[0], n, n - len(k), sha256(" ".join(k).encode()).hexdigest()))
                 for r, (n, k) in zip(rows, h.repeats(rows)))
    got = substring_dedup.digests(h.frame(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == exp


def test_substring_small_windows_and_join_path(spark, monkeypatch):
    rows = [(i, h.prose(i % 9, 40, vocabulary=4)) for i in range(30)]
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    got = {r.doc_id: r.text for r in substring_dedup.deduplicate(h.frame(spark, rows), size=8).collect()}
    assert got == {r[0]: " ".join(k) for r, (_, k) in zip(rows, h.repeats(rows, 8))}
    assert substring_dedup.digests(h.frame(spark, rows).limit(0)).count() == 0


def _joined_frames(spark, monkeypatch, bound, rows):
    """What op 6 reports with broadcasts of at most ``bound`` bytes, and the frames it joined."""
    kind, seen = type(spark.range(0)), []
    plain = kind.mapInArrow
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (seen.append(self), plain(self, *a, **b))[1])
    got = substring_dedup.digests(h.frame(spark, rows)).collect()
    return got, [df for df in seen if "Join" in df._jdf.queryExecution().optimizedPlan().toString()]


def test_substring_texts_are_never_shuffled(spark, monkeypatch):
    """Above the bound the answers still come to the blocks; a shuffle of whole texts took the executors' memory."""
    rows = [(i, h.prose(i % 9, 300)) for i in range(30)] + [(99, "short"), (None, None)]
    got, joined = _joined_frames(spark, monkeypatch, 0, rows)
    exp = sorted(repr((r[0], n, n - len(k), sha256(" ".join(k).encode()).hexdigest()))
                 for r, (n, k) in zip(rows, h.repeats(rows)))
    assert sorted(repr(tuple(r)) for r in got) == exp
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in joined]
    assert plans and not [p for p in plans if "SortMergeJoin" in p or "Exchange hashpartitioning(block" in p]
    ids = [sorted(r.block for r in df.select("block").collect()) for df in joined]
    assert len(ids) > 2 and sorted(sum(ids, [])) == sorted(2 * [*{b for x in ids for b in x}])     # once in each of two steps


def test_substring_broadcasts_count_all_they_hold(spark, monkeypatch):
    """The bits of the windows that may repeat are broadcast too: 500 bytes a block here, with no candidate among them."""
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(400))) for i in range(33)]
    got, joined = _joined_frames(spark, monkeypatch, 1200, rows)
    assert len(got) == 33 and not any(r.n_removed for r in got)
    held = [df.selectExpr("sum(octet_length(maybe))").first()[0] for df in joined if "doc_ids" in df.columns]
    assert sum(held) > 1200 >= max(held)


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(1)
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, rng.integers(1, 12), 300)]
        docs = [" ".join(w[a:b]) for a, b in ((0, 300), (50, 250), (100, 137), (99, 300))] + ["w0 " * 60]
        data, off = ta.bytes_of(pa.array(docs))
        s, e, woff = ta.words(data, off)
        x = ta.fingerprints(data, s, e)
        p, name, at = substring_dedup.window_names(x, ta.owner(woff), woff)
        seen = {}
        for f, n, o in zip(ta.windows(x, 35)[p].tolist(), name.tolist(), (at - p).tolist()):
            assert seen.setdefault(f, (n, o)) == (n, o)


def test_text_arrays():
    texts = ["", None, " a  bb\tccc ", "é|é", "x" * 9000 + " " + "x" * 9000, "a\x00b"]
    data, off = ta.bytes_of(pa.array(texts))
    s, e, woff = ta.words(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(woff, woff[1:])]
    assert got == [h.WORD.findall(t or "") for t in texts]
    f = ta.fingerprints(data, s, e)
    flat = [w for g in got for w in g]
    assert len(set(f.tolist())) == len(set(flat)) and f[flat.index("x" * 9000)] == f[flat.index("x" * 9000) + 1]
    runs = ta.windows(np.arange(9, dtype=ta.U) % ta.U(3), 5)
    assert len(runs) == 5 and runs[0] == runs[3] != runs[1] and len(ta.windows(f[:2], 5)) == 0
    big = pa.RecordBatch.from_arrays([pa.array(["a" * 50] * 10)], names=["text"])
    assert [b.num_rows for b in ta.text_batches([big], max_bytes=120)] == [2, 2, 3, 2, 1]


def test_even_join_splits_a_hot_key(spark):
    """A key with a third of the rows is spread over tasks; the rows are those of a plain join."""
    rows = spark.range(9000).selectExpr("id as node", "case when id % 3 = 0 then -1 else id end as k")
    right = spark.range(-1, 8000).selectExpr("id as k", "id * 2 as v")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            out = even_join(rows, right, "k", "node", counts, 9000, how)
            assert sorted(map(str, out.select("node", "k", "v").collect())) == sorted(
                map(str, rows.join(right, "k", how).select("node", "k", "v").collect()))
            assert out.filter("k = -1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        none = even_join(rows.limit(0), right, "k", "node", counts.limit(0), 0)
        assert none.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
