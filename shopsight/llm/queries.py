"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopsight.llm import (
    byte_codec,
    chat_format,
    exact_dedup,
    line_quality,
    mixing,
    near_dedup,
    piece_codec,
    quality_pu,
    secret_scan,
    substring_dedup,
    token_store,
    vector_codes,
    whitening,
)
from shopsight.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Shingle sets as whole lists of words; links by an equality join on shingles; the smallest
# reachable id by a recursive walk over links.
SQL_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END, ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
      FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM l JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""


@query("op1_minhash_near_dedup", SQL_NEAR)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS marks,
         ((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN greatest(0.05::DOUBLE, 1 - marks::DOUBLE / size) ELSE 0.05::DOUBLE END AS key
      FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
      FROM d GROUP BY source),
b AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER p, 0))
               / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
      FROM b WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, f.level * w) AS target FROM b, f),
c AS (SELECT k.doc_id, k.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - start)))::BIGINT AS taken
FROM c
"""


@query("op2_source_mix", SQL_MIX)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


@query("op4_line_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.judge(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


# Windows of 35 words as joined text, judged on the input; kept words in order.
SQL_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i FROM p JOIN r USING (win)), range(0, 35) t(o)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT w.doc_id, count(g.j) AS n_removed, string_agg(w.word, ' ' ORDER BY w.j) FILTER (g.j IS NULL) AS kept
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.j = w.j GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op6_substring_dedup", SQL_SUBSTRING)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chat_format.format_turns(rows, chat_format.fit(rows))


SQL_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op8_exact_dedup", SQL_EXACT)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(digest)) AS text_sha256")


@query("op9_sentencepiece_codec")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op10_token_store")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _sql_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All distances between parts and entries, round by round."""
    ctes = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x FROM (
      SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
      WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding) AND len(embedding) > 0))""",
            f"""p AS (SELECT r, q AS part, x[q * (len(x) // {parts}) + 1 : (q + 1) * (len(x) // {parts})] AS y
      FROM v, range(0, {parts}) t(q))""",
            f"c0 AS (SELECT part, r - 1 AS entry, y AS e FROM p WHERE r <= {entries})"]
    for k in range(rounds + 1):
        ctes.append(f"""d{k} AS (SELECT r, p.part, entry, y,
        list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM p JOIN c{k} USING (part))""")
        ctes.append(f"""a{k} AS (SELECT r, part, any_value(y) AS y, min({{'d': d, 'entry': entry}}) AS b
      FROM d{k} GROUP BY r, part)""")
        if k < rounds:
            ctes.append(f"""s{k} AS (SELECT part, b.entry AS entry, i, sum(y[i]) AS total, count(*) AS n
      FROM a{k}, range(1, (SELECT max(len(y)) FROM p) + 1) t(i) GROUP BY ALL)""")
            ctes.append(f"""c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN (
        SELECT part, entry, list(((total - ((total % n) + n) % n) / n)::BIGINT ORDER BY i) AS e
        FROM s{k} GROUP BY part, entry) m USING (part, entry))""")
    return "WITH " + ",\n".join(ctes) + f""",
f AS (SELECT r, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error
      FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN f USING (r)
"""


@query("op11_vector_codes", _sql_codes())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe_codec")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
