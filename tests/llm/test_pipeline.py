"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import os
from hashlib import sha256

import pyarrow as pa
import public_tokenizers
import sentencepiece

import corpus_pipeline
from shopsight.llm import exact_dedup, mixing, near_dedup, quality_pu
from tests.llm import helpers as h


def _inputs(spark, tmp_dir, rows):
    sf = os.path.join(tmp_dir, "sf")
    h.frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_pipeline_equals_plain_form(spark, tmp_dir):
    # ids of good documents are labelled good, so the small corpus has positives to learn from
    rows = [(r[0], r[1], r[2]) for r in h.corpus() if r[0] is not None]
    rows += [(500 + i, " ".join(f"{w}***" for w in h.prose(i, 60).split()), "src3") for i in range(12)]
    sf = _inputs(spark, tmp_dir, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_pu.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.score(quality_pu.features(pa.array([r[1] for r in rows])))
    kept = [r for r, s in zip(rows, score) if s >= quality_pu.THRESHOLD]
    last = {}
    for r in kept:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    kept = [r for r in kept if last[r[1] or ""] == r[0]]
    near = h.near_classes(kept)
    kept = [r for r in kept if near[r[0]][1] == r[0]]
    copies = {i: int(taken / n + 0.5) if n else 0 for i, n, _, _, taken in h.mix_plan(kept)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    exp = []
    for r in kept:
        e = sp.encode(r[1] or "", add_eos=True)
        exp += [(r[0], len(e), sha256(" ".join(map(str, e)).encode()).hexdigest(),
                 sha256(sp.decode(e).encode()).hexdigest())] * copies[r[0]]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == sorted(exp) and len(got) > 20


def test_stages_keep_the_columns(spark, tmp_dir):
    sf = _inputs(spark, tmp_dir, h.corpus())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_all_operators_are_registered():
    from shopsight.llm.queries import QUERIES, SQL
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


def _ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_stages_judge_rows_by_id_and_text(spark):
    one, other, third = h.prose(1, 90), h.prose(2, 90), h.prose(3, 80)
    # a text that only a row without id has stays, once
    rows = [(None, one), (None, one), (None, other), (4, other)]
    assert _ids(exact_dedup.deduplicate(h.frame(spark, rows))) == [(-1, one), (4, other)]
    # of two texts under one id, only the copy of another document goes
    rows = [(1, one), (7, one), (7, other), (8, third), (8, third.upper()), (9, "x"), (9, "x")]
    found = _ids(near_dedup.deduplicate(h.frame(spark, rows)))
    assert [r for r in found if r[0] != 8] == [(1, one), (7, other), (9, "x")]
    assert [r[1].lower() for r in found if r[0] == 8] == [third]
    # an id's copies are worked out row by row
    rows = [(1, one), (1, h.prose(4, 110)), (2, other), (3, third), (5, "tiny text"), (5, "tiny text")]
    docs = h.frame(spark, [(i, t, f"s{i % 2}") for i, t in rows])
    for share in (0.2, 0.6, 1.0):
        taken = mixing.mix(docs, share=share).collect()
        want = sorted((r.doc_id, r.size) for r in taken for _ in range(int(r.taken / r.size + 0.5)))
        got = sorted((r.doc_id, len(r.text.split())) for r in mixing.apply_mix(docs, share=share).collect())
        assert got == want
