"""Near-dedup by circulant MinHash (operator 1).

Signature: a shingle's 64-bit fingerprint is permuted once onto 32 bits, and coordinate k
is the minimum of a second permutation of that value shifted circularly by k: two
permutations give all 128 coordinates.  32 bands of 4 coordinates make bucket keys; a pair
at similarity 0.75 misses all bands with probability (1 - 0.75^4)^32 = 5e-6.

Links without all pairs:
1. Equal sets collapse to one node (128-bit set digest, map-side combined).
2. In every bucket each node is paired with the bucket's centre, the node that shares most
   buckets; a node keeps the centre it meets in most bands.  One edge per node, verified by
   exact Jaccard.
3. A bucket whose nodes are all in one component is settled.  The nodes of the others go
   through an exact similarity join by rarest shingles, across components only, and what
   meets there is verified.  So no link between different texts of a shared bucket is lost
   and no group of copies is expanded.
Verification reads the whole sets again, for the texts of some candidate edge only.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of
1 to 4 words is one shingle; rows that repeat a doc_id count by their own text; rows without
doc_id are linked with nothing, have component_id null and are kept; an empty table gives
no rows; extra columns are ignored by ``classes`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm import textarrays as ta
from shopsight.llm.common import even_join, small, staged
from shopsight.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all texts, and the n + 1 set offsets."""
    data, off = ta.bytes_of(texts)
    data = _LOWER[data]
    starts, ends, woff = ta.words(data, off)
    h = ta.fingerprints(data, starts, ends)
    runs = ta.windows(h, SHINGLE)
    sets, sizes = [], np.zeros(len(off), np.int64)
    for i, (lo, hi) in enumerate(zip(woff[:-1].tolist(), woff[1:].tolist())):
        if hi - lo >= SHINGLE:
            s = np.sort(runs[lo:hi - SHINGLE + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif hi > lo:
            s = ta.windows(np.concatenate([h[lo:hi], np.full(1, hi - lo, ta.U)]), hi - lo + 1)
        else:
            continue
        sets.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, ta.U)), np.cumsum(sizes)


def signatures(values: np.ndarray, starts: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of the sets that begin at ``starts``: (sets, count) of uint32."""
    out = np.empty((len(starts), count), np.uint32)
    step = 1 << 17
    cut = np.unique(np.searchsorted(starts, np.arange(0, len(values) + step, step)))
    for lo, hi in zip(cut[:-1], cut[1:]):
        end = starts[hi] if hi < len(starts) else len(values)
        at = starts[lo:hi] - starts[lo]
        base = (ta.mix(values[starts[lo]:end]) >> ta.U(32)).astype(np.uint32)      # first permutation
        x, t = np.empty_like(base), np.empty_like(base)
        for k in range(count):                                                    # second one, shifted by k
            np.add(base, np.uint32(k), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=t)
            np.bitwise_xor(x, t, out=x)
            out[lo:hi, k] = np.minimum.reduceat(x, at)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in ta.text_batches(batches):
        values, off = shingle_sets(b.column("text"))
        sizes = np.diff(off)
        some = np.flatnonzero(sizes)
        starts = off[:-1][some]
        sig = signatures(values, starts)
        keys = np.zeros((len(some), BANDS), ta.U)
        for j in range(ROWS):
            keys = ta.mix(keys * ta.U(3) + sig[:, j::ROWS].astype(ta.U) + ta.U(1))
        keys = ta.mix(keys + np.arange(BANDS, dtype=ta.U) * ta.U(0x9E3779B97F4A7C15))
        total = np.zeros((b.num_rows, 2), np.int64)
        if len(some):
            total[some, 0] = ta.signed(np.add.reduceat(ta.mix(values), starts))
            total[some, 1] = ta.signed(np.add.reduceat(ta.mix(values ^ ta.U(0x5851F42D4C957F2D)), starts))
        boff = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(sizes), *[pa.array(np.ascontiguousarray(total[:, c])) for c in range(2)],
             ta.list_array(ta.signed(keys.ravel()), boff)],
            names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in ta.text_batches(batches):
        values, off = shingle_sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), ta.list_array(ta.signed(values), off)],
                                         names=["id", "shingles"])


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): whole sets of the given documents (ids: staged, distinct)."""
    return staged(docs.join(small(ids), "doc_id", "left_semi")
                  .mapInArrow(_sets, "id bigint, shingles array<bigint>"), "candidate-sets")


def _verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) with Jaccard similarity of 0.75 or more on the whole sets."""
    total = edges.count()
    pairs = edges
    for end, other in (("a", "b"), ("b", "a")):
        whole = sets.select(F.col("id").alias(end), F.col("shingles").alias(f"s{end}"))
        pairs = even_join(pairs, whole, end, other, edges.groupBy(end).agg(F.count("*").alias("n")), total)
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(pairs.withColumn("both", both)
                  .filter(100 * F.col("both") >= 75 * (F.size("sa") + F.size("sb") - F.col("both")))
                  .select("a", "b").distinct(), "links")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, d1, d2): one row per input row; the
    last three name its text and its shingle set."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed = staged(keyed.mapInArrow(_sign, "doc_id bigint, text_key bigint, n_shingles bigint, d1 bigint, d2 bigint, "
                                            "bands array<bigint>"), "signatures")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    nodes = staged(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "nodes")
    reps = (named.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "d1", "d2"])
            .select(F.col("doc_id").alias("node"), "bands"))
    entries = reps.select("node", F.explode("bands").alias("key"))
    sizes = staged(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shared = staged(even_join(entries, sizes, "key", "node", sizes, total), "buckets")
    # a bucket's centre: the node that shares most buckets with most nodes
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    centres = (shared.join(weight, "node").groupBy("key")
               .agg(F.max(F.struct("w", (-F.col("node")).alias("minus"))).alias("c"))
               .select("key", (-F.col("c.minus")).alias("centre"), F.col("c.w").alias("w")))
    met = (even_join(shared, centres, "key", "node", sizes, total).filter("node <> centre")
           .groupBy("node", "centre", "w").agg(F.count("*").alias("hits"))
           .groupBy("node").agg(F.max(F.struct("hits", "w", (-F.col("centre")).alias("minus"))).alias("best")))
    star = staged(met.select(F.col("node").alias("a"), (-F.col("best.minus")).alias("b")), "star")
    ends = star.select(F.col("a").alias("doc_id")).unionByName(star.select(F.col("b").alias("doc_id")))
    first = _verified(star, _sets_of(docs, staged(ends.distinct(), "star-ids")))
    one = components(first)
    links = first.unionByName(_cross_links(docs, shared, one))
    comp = staged(nodes.join(components(links).withColumnRenamed("id", "node"), "node", "left")
                  .select("d1", "d2", "node", F.coalesce("component", "node").alias("component")), "classes")
    rows = signed.drop("bands").join(comp.select("d1", "d2", "component"), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return (rows.withColumn("component_id", component).withColumn("kept", kept)
            .select("doc_id", "n_shingles", "component_id", "kept", "text_key", "d1", "d2"))


def _cross_links(docs: DataFrame, shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Verified links between different components, among the nodes of buckets that hold
    more than one component: an exact similarity join by rarest shingles.

    With shingles in one global order, rarest first, a pair at 0.75 has its first common
    shingle among the first quarter of both sets, early enough that the rest of either set
    can still hold the overlap that the two sizes ask for.  Far copies of one text spend
    these places on their own changes, so they are never paired."""
    marked = staged(shared.join(comp.select(F.col("id").alias("node"), "component"), "node", "left")
                    .select("key", "node", F.coalesce("component", "node").alias("component")), "marked")
    nodes = staged(_several(marked, "key")[0].select("node", "component").distinct(), "open-nodes")
    sets = _sets_of(docs, staged(nodes.select(F.col("node").alias("doc_id")).distinct(), "open-ids"))
    named = sets.select("id", "shingles", F.xxhash64("shingles").alias("set"))     # once a set, not once a shingle
    words = (named.join(nodes, named["id"] == nodes["node"])
             .select("node", "component", "set", F.explode("shingles").alias("s")))
    common = staged(words.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "common-shingles")
    total = common.agg(F.sum("n")).first()[0] or 0
    counted = even_join(words, common.withColumnRenamed("n", "df"), "s", "node", common, total, "left")
    rarest = (counted.groupBy("node", "component", "set")
              .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("w"))
              .withColumn("n", F.size("w")))
    first = F.slice("w", F.lit(1), F.col("n") - F.floor((3 * F.col("n") + 3) / 4).cast("int") + 1)
    places = staged(rarest.select("node", "component", "n", F.posexplode(first).alias("at", "x"))
                    .filter("x.df > 1").select("node", "component", "n", "at", "x.s"), "places")
    rows, sizes = _several(places, "s")
    rows = staged(rows, "meeting-places")
    other = rows.select("s", *[F.col(c).alias(f"y_{c}") for c in ("node", "component", "n", "at")])
    met = even_join(rows, other, "s", "node", sizes, rows.count(), most=32)
    rest = F.least(F.col("n") - F.col("at"), F.col("y_n") - F.col("y_at"))
    near = (F.col("component") < F.col("y_component")) & (175 * rest >= 75 * (F.col("n") + F.col("y_n")))
    pairs = met.filter(near).select(F.greatest("node", "y_node").alias("a"), F.least("node", "y_node").alias("b"))
    return _verified(staged(pairs.distinct(), "cross-pairs"), sets)


def _several(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that hold more than one component, and (key, n) of these keys."""
    keys = staged(rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.count("*").alias("n")), "keys")
    open_keys = keys.filter("lo <> hi")
    return (even_join(rows, open_keys.select(key), key, "node", keys.select(key, "n"), rows.count()),
            open_keys.select(key, "n"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The input rows that stay, one document of each group, with all their columns.

    Rows are known by id and text, so texts that share an id are judged each by its own
    group; of rows that agree in both, or in id and shingle set, one stays."""
    rows = staged(classes(docs), "near-rows")
    least = F.min("text_key").over(Window.partitionBy("doc_id", "d1", "d2"))
    named = rows.filter("doc_id is not null")
    same = named.filter("n_shingles > 0").groupBy("doc_id", "d1", "d2").agg(
        F.count_distinct("text_key").alias("n")).filter("n > 1").select("doc_id", "d1", "d2")
    others = (named.join(same, ["doc_id", "d1", "d2"], "left_semi").select("doc_id", "d1", "d2", "text_key").distinct()
              .withColumn("least", least).filter("text_key <> least").select("doc_id", "text_key"))
    gone = staged(named.filter("not kept").select("doc_id", "text_key").unionByName(others).distinct(), "near-gone")
    twice = staged(named.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"),
                   "near-twice")
    names = docs.columns
    keyed = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn("__key", F.xxhash64("text"))
    out = keyed.join(gone, _same_row(gone), "left_anti")
    if not twice.isEmpty():
        once = out.join(twice, _same_row(twice), "left_semi").dropDuplicates(["__id", "__key"])
        out = out.join(twice, _same_row(twice), "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in names])


def _same_row(rows: DataFrame):
    return (F.col("__id") == rows["doc_id"]) & (F.col("__key") == rows["text_key"])
