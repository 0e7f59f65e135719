"""RFM segmentation operators.

Design for many tenants and skewed tenants:

* Per-tenant statistics (max date, means, deviations, cluster sums) are hash
  aggregates with map-side partial aggregation.  They are joined back by (tenant,
  salt): customers are salted by their hash and the small statistics repeated per
  salt, so one tenant with a third of all customers is spread over ``SALTS`` tasks
  whatever the join strategy.
* Cluster-level work (k clusters per tenant) is packed into one array per
  tenant and evaluated with higher-order functions; nothing pairs data rows.
* The silhouette uses the squared-Euclidean definition (as Spark's
  ``ClusteringEvaluator``), which is exact in linear time from per-cluster sums.
  The plain Euclidean variant needs every pair of points and is not built.
* K-Means is Lloyd's algorithm over all tenants (and all k, all restarts) at
  once: the customers of a tenant are packed into chunks, each pass joins the chunks with
  their tenant's unfinished models, and array operations in the tasks give one row of sums per
  (chunk, cluster) for the averages; finished models are frozen, and the passes end
  when every model has converged.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("recency", "frequency", "monetary")
SALTS = 16
CHUNK = 2048                 # rows of a key that K-Means handles together
FEW_KEYS = 1000              # models of so many keys are broadcast; beyond, the join shuffles


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with one small row per key; a hot key is spread over ``SALTS`` tasks."""
    salt = F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")]), F.lit(SALTS))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return big.withColumn("__salt", salt).join(copies, [*keys, "__salt"]).drop("__salt")


def _keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Grouping keys; with none, a constant key so every step can stay a keyed join."""
    if keys:
        return df, list(keys)
    return df.withColumn("__all", F.lit(0)), ["__all"]


# --- E3: recency ----------------------------------------------------------------

def with_recency(metrics: DataFrame, keys: Sequence[str] = ("tenant_id",),
                 date_col: str = "last_order_date") -> DataFrame:
    """Whole days from the last order to (newest order of the tenant + 1 day)."""
    m, k = _keys(metrics, keys)
    ref = m.groupBy(*k).agg((F.max(date_col) + F.expr("INTERVAL 1 DAY")).alias("__ref"))
    out = salted_join(m, ref, k).withColumn(
        "recency", F.expr(f"timestampdiff(DAY, `{date_col}`, __ref)")).drop("__ref")
    return out if keys else out.drop("__all")


# --- G1 / G2: scaling and weights ---------------------------------------------------

def standardize(df: DataFrame, cols: Sequence[str] = FEATURES,
                keys: Sequence[str] = ("tenant_id",), keep_raw: bool = False) -> DataFrame:
    """z-scores with the population deviation; a constant column is divided by 1."""
    d, k = _keys(df, keys)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}")]
    out = salted_join(d, d.groupBy(*k).agg(*aggs), k)
    for c in cols:
        s = F.col(f"__s_{c}")
        if keep_raw:
            out = out.withColumn(f"raw_{c}", F.col(c))
        out = out.withColumn(c, (F.col(c).cast("double") - F.col(f"__m_{c}"))
                             / F.when(s == 0, F.lit(1.0)).otherwise(s))
    out = out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])
    return out if keys else out.drop("__all")


def weight(df: DataFrame, weights: dict) -> DataFrame:
    """Multiply feature columns by fixed weights (defaults of the reference are 1.0)."""
    for c, w in weights.items():
        df = df.withColumn(c, F.col(c) * F.lit(float(w)))
    return df


# --- D8: correlation -------------------------------------------------------------------

def correlation_matrix(df: DataFrame, cols: Sequence[str] = FEATURES,
                       keys: Sequence[str] = ("tenant_id",), digits: int = 3) -> DataFrame:
    """Pearson r for every ordered pair as rows (keys, feature_a, feature_b, r);
    undefined values (constant column) become 0."""
    d, k = _keys(df, keys)
    aggs = [F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
                        .alias(f"__c_{a}_{b}"))
    stats = d.groupBy(*k).agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            cov = F.col(f"__c_{a}_{b}" if i <= j else f"__c_{b}_{a}")
            r = F.try_divide(cov, F.col(f"__s_{a}") * F.col(f"__s_{b}"))
            r = F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(F.round(r, digits))
            cells.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                  r.alias("r")))
    out = stats.select(*k, F.inline(F.array(*cells)))
    return out if keys else out.drop("__all")


# --- C11: nearest centroid ---------------------------------------------------------------

def _sqdist(x: Sequence[Column], y: Sequence[Column]) -> Column:
    return sum(((a - b) * (a - b) for a, b in zip(x, y)), F.lit(0.0))


def _nearest(cents: Column, cols: Sequence[str]) -> Column:
    """Struct (d, cluster_id) of the closest centroid in an array of centroid structs;
    ties go to the lower cluster id."""
    pairs = F.transform(cents, lambda e: F.struct(
        _sqdist([F.col(c) for c in cols], [e[c] for c in cols]).alias("d"),
        e["cluster_id"].alias("cluster_id")))
    return F.array_min(pairs)


def literal_centroids(centroids: Sequence[Sequence[float]], cols: Sequence[str] = FEATURES) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("cluster_id"),
                              *[F.lit(float(v)).alias(c) for c, v in zip(cols, cent)])
                     for i, cent in enumerate(centroids)])


def pack_centroids(centroids: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key with the key's k centroids as an array (k is small and fixed)."""
    return centroids.groupBy(*keys).agg(
        F.collect_list(F.struct("cluster_id", *cols)).alias("__cents"))


def assign_clusters(df: DataFrame, centroids, cols: Sequence[str] = FEATURES,
                    keys: Sequence[str] = ("tenant_id",), label: str = "cluster_id") -> DataFrame:
    """Label each row with its nearest centroid.

    ``centroids`` is either a list of coordinate tuples shared by all keys (inlined
    as a literal: no join at all) or a DataFrame (keys..., cluster_id, cols...).
    """
    if isinstance(centroids, DataFrame):
        j = salted_join(df, pack_centroids(centroids, cols, keys), list(keys))
        return j.withColumn(label, _nearest(F.col("__cents"), cols)["cluster_id"]).drop("__cents")
    return df.withColumn(label, _nearest(literal_centroids(centroids, cols), cols)["cluster_id"])


# --- D7: cluster summary -------------------------------------------------------------------

def exact_mean_sum(col: str, scale: int = 4) -> Column:
    """Aggregate: the column summed exactly in units of 10^-scale (DECIMAL(38,0)).

    Money and counts have at most ``scale`` decimals, so each double is first
    returned to its exact decimal value; the sum then has no rounding error.
    """
    return F.sum(F.round(F.col(col).cast("double") * 10 ** scale).cast("decimal(38,0)"))


def exact_mean_round(total: str, count: str, digits: int = 2, scale: int = 4) -> Column:
    """Half-up rounding of total / count / 10^scale to ``digits`` with integral division
    (no floating point, so ties such as x.185 round the same everywhere)."""
    q = (f"signum({total}) * ((abs({total}) * {2 * 10 ** digits} + {count} * {10 ** scale}) "
         f"div ({count} * {2 * 10 ** scale}))")
    return F.expr(q).cast("double") / 10 ** digits


def cluster_summary(assigned: DataFrame, keys: Sequence[str] = ("tenant_id",),
                    cols: Sequence[str] = FEATURES, label: str = "cluster_id",
                    digits: int = 2) -> DataFrame:
    """Mean of each feature rounded half-up (exactly, see ``exact_mean_round``) and
    member count per cluster."""
    g = assigned.groupBy(*keys, label).agg(
        *[exact_mean_sum(c).alias(f"__t_{c}") for c in cols],
        F.count(F.lit(1)).alias("customer_count"))
    return g.select(*keys, label,
                    *[exact_mean_round(f"__t_{c}", "customer_count", digits).alias(c)
                      for c in cols],
                    "customer_count")


# --- G5: silhouette (squared Euclidean, linear) ------------------------------------------------

def _cluster_sums(df: DataFrame, cols: Sequence[str], keys: list, label: str) -> DataFrame:
    sq = _sqdist([F.col(c) for c in cols], [F.lit(0.0)] * len(cols))
    stats = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols],
        F.sum(sq).alias("q"))
    return stats.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col(label).alias("cluster_id"), "n", *[f"s_{c}" for c in cols], "q")).alias("__cl"))


def silhouette_points(df: DataFrame, cols: Sequence[str] = FEATURES,
                      keys: Sequence[str] = ("tenant_id",), label: str = "cluster_id") -> DataFrame:
    """Per-row silhouette s = (b - a) / max(a, b) with squared Euclidean distance;
    a point alone in its cluster scores 0."""
    d, k = _keys(df, keys)
    j = salted_join(d, _cluster_sums(d, cols, k, label), k)
    x = [F.col(c) for c in cols]
    xx = _sqdist(x, [F.lit(0.0)] * len(cols))

    def total(e):  # sum over members y of |x - y|^2
        dot = sum((xi * e[f"s_{c}"] for xi, c in zip(x, cols)), F.lit(0.0))
        return F.greatest(F.lit(0.0), e["n"] * xx - 2 * dot + e["q"])

    own = F.filter(F.col("__cl"), lambda e: e["cluster_id"] == F.col(label))[0]
    others = F.filter(F.col("__cl"), lambda e: e["cluster_id"] != F.col(label))
    a = total(own) / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(others, lambda e: total(e) / e["n"]))
    s = (F.when(own["n"] <= 1, F.lit(0.0))
          .when(F.greatest(a, b) == 0, F.lit(0.0))
          .otherwise((b - a) / F.greatest(a, b)))
    out = j.withColumn("silhouette", s).drop("__cl")
    return out if keys else out.drop("__all")


def silhouette(df: DataFrame, cols: Sequence[str] = FEATURES, keys: Sequence[str] = ("tenant_id",),
               label: str = "cluster_id", digits: int = 4) -> DataFrame:
    """Mean silhouette per key (NULL when the key has a single cluster)."""
    pts = silhouette_points(df, cols, keys, label)
    return pts.groupBy(*keys).agg(
        F.when(F.count_distinct(label) > 1, F.round(F.avg("silhouette"), digits)).alias("silhouette"))


# --- G6: Davies-Bouldin -----------------------------------------------------------------------

def davies_bouldin(df: DataFrame, cols: Sequence[str] = FEATURES,
                   keys: Sequence[str] = ("tenant_id",), label: str = "cluster_id",
                   digits: int = 4) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j), Euclidean, centroids = means."""
    d, k = _keys(df, keys)
    cent = d.groupBy(*k, label).agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    disp = (salted_join(d, cent, k + [label])
              .withColumn("__d", F.sqrt(_sqdist([F.col(c) for c in cols],
                                                [F.col(f"m_{c}") for c in cols])))
              .groupBy(*k, label).agg(F.avg("__d").alias("s")))
    per = cent.join(disp, k + [label]).groupBy(*k).agg(F.collect_list(F.struct(
        F.col(label).alias("cluster_id"), "s", *[f"m_{c}" for c in cols])).alias("__cl"))

    def ratio(ei, ej):
        dij = F.sqrt(_sqdist([ei[f"m_{c}"] for c in cols], [ej[f"m_{c}"] for c in cols]))
        return F.when(dij == 0, F.lit(0.0)).otherwise((ei["s"] + ej["s"]) / dij)

    worst = F.transform(F.col("__cl"), lambda ei: F.array_max(F.transform(
        F.filter(F.col("__cl"), lambda ej: ej["cluster_id"] != ei["cluster_id"]),
        lambda ej: ratio(ei, ej))))
    n = F.size(F.col("__cl"))
    db = F.when(n > 1, F.round(F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / n, digits))
    out = per.select(*k, db.alias("davies_bouldin"))
    return out if keys else out.drop("__all")


# --- G7: baseline vs weighted ---------------------------------------------------------------------

def compare_models(base: DataFrame, weighted: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Join two score tables (silhouette, davies_bouldin) and report the differences."""
    b = base.select(*keys, F.col("silhouette").alias("base_silhouette"),
                    F.col("davies_bouldin").alias("base_davies_bouldin"))
    w = weighted.select(*keys, F.col("silhouette").alias("weighted_silhouette"),
                        F.col("davies_bouldin").alias("weighted_davies_bouldin"))
    j = b.join(w, list(keys))
    return (j.withColumn("silhouette_diff", F.round(F.col("weighted_silhouette") - F.col("base_silhouette"), 4))
             .withColumn("davies_bouldin_diff",
                         F.round(F.col("weighted_davies_bouldin") - F.col("base_davies_bouldin"), 4)))


# --- G3 / G4: K-Means (Lloyd) over all keys at once ---------------------------------------------------

def _spread(rows: pd.DataFrame, cols: Sequence[str], most: int, rng: np.random.Generator) -> list[int]:
    """Weighted k-means++ over candidates: indexes of up to ``most`` distinct ones, each the best of
    a few draws by weight times squared distance."""
    x, w = rows[list(cols)].to_numpy(float), rows["__w"].to_numpy(float)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < most and (w * near).sum() > 0:
        p = w * near
        draws = np.unique(rng.choice(len(x), size=2 + int(math.log(most)), p=p / p.sum()))
        left = [np.minimum(near, ((x - x[i]) ** 2).sum(1)) for i in draws]
        best = int(np.argmin([(w * n).sum() for n in left]))
        chosen.append(int(draws[best]))
        near = left[best]
    return chosen


def chunked(base: DataFrame, cols: Sequence[str], keys: Sequence[str], id_col: str, seed: int = 42,
            size: int = CHUNK) -> DataFrame:
    """(keys, __rows): the rows of every key in chunks of about ``size``, so that a pass over them is
    a few array operations a chunk and only joins one row per chunk.  Rows are dealt at random: equal
    ones do not meet in one chunk."""
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    part = F.floor(F.rand(seed) * F.ceil(F.col("__n") / size))
    return (salted_join(base, counts, keys).withColumn("__part", part).groupBy(*keys, "__part")
            .agg(F.collect_list(F.struct(id_col, *cols)).alias("__rows")).drop("__part").checkpoint())


def _with_models(chunks: DataFrame, packed: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Chunks with the packed models ``__ms`` of their key; those of ``few`` keys are broadcast."""
    return chunks.join(F.broadcast(packed), list(keys)) if few else salted_join(chunks, packed, keys)


def _few(chunks: DataFrame, keys: Sequence[str]) -> bool:
    return chunks.select(*keys).distinct().limit(FEW_KEYS + 1).count() <= FEW_KEYS


def _chunks_of(batch: pa.RecordBatch, cols: Sequence[str]) -> Iterable[tuple[int, int, np.ndarray, list]]:
    """(row, first flat position, coordinates, models) of every chunk of an Arrow batch; nulls are NaN."""
    lists = batch.column("__rows")
    at, values = lists.offsets.to_numpy(), lists.values
    points = np.column_stack([pc.struct_field(values, c).to_numpy(zero_copy_only=False).astype(float) for c in cols])
    for i, models in enumerate(batch.column("__ms")):
        yield i, int(at[i]), points[at[i]:at[i + 1]], models.as_py()


def _distances(x: np.ndarray, cents: list, cols: Sequence[str]) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    c = np.array([[e[name] for name in cols] for e in cents], dtype=float)
    d = np.zeros((len(x), len(c)))
    for j in range(len(cols)):
        d += (x[:, j, None] - c[None, :, j]) ** 2
    return d


def _batch(made: list, batch: pa.RecordBatch, keys: Sequence[str], names: Sequence[str], extra: dict) -> pa.RecordBatch:
    """Rows made of a batch: tuples of arrays, the first of which says of which chunk they are."""
    columns = [np.concatenate(c) for c in zip(*made)]
    out = {k: batch.column(k).take(pa.array(columns[0])) for k in keys}
    out.update({n: pa.array(c) for n, c in zip(names, columns[1:])})
    return pa.RecordBatch.from_pydict({**out, **extra})


def _types(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def seeds(base: DataFrame, cols: Sequence[str], keys: Sequence[str], id_col: str, most: int, n_init: int = 3,
          seed: int = 42, passes: int = 3, chunks: DataFrame | None = None) -> DataFrame:
    """k-means||: (keys, __run, __rn, cols), up to ``most`` starting centroids per key and restart.

    Every pass adds the ``2 * most`` rows with the smallest -ln(u) / d, a weighted sample by the
    squared distance d to the candidates so far (u from a seeded hash of the id), taken as the
    smallest of every chunk and the smallest of those.  Then every row counts for its nearest
    candidate, and a weighted k-means++ orders the candidates, 2 * most * passes + 1 of them at
    most, inside one small group.  All keys and restarts go through the same passes.  A key with
    fewer distinct rows than ``most`` repeats its first centroid, up to its number of rows."""
    over, g, keys, cols = 2 * most, [*keys, "__run"], list(keys), list(cols)
    chunks = chunked(base, cols, keys, id_col, seed) if chunks is None else chunks
    few = _few(chunks, keys)

    def hashes(salt: int, run) -> Column:
        """The hashes of a chunk's rows for one pass and restart."""
        return F.transform("__rows", lambda r: F.xxhash64(r[id_col], F.lit(seed), F.lit(salt), run))

    least = F.array_min(F.zip_with(hashes(0, F.col("__run")), "__rows", lambda h, r: F.struct(
        h.alias("h"), r[id_col].alias("id"), F.struct(*[r[c].alias(c) for c in cols]).alias("c"))))
    candidates = (chunks.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))))
                  .select(*g, least.alias("m")).groupBy(*g).agg(F.min("m")["c"].alias("c")).checkpoint())

    def with_candidates() -> DataFrame:
        packed = candidates.groupBy(*g).agg(F.sort_array(F.collect_list("c")).alias("__cs"))
        packed = packed.groupBy(*keys).agg(F.collect_list(F.struct("__run", "__cs")).alias("__ms"))
        return _with_models(chunks, packed, keys, few)

    def draw(batches):
        """Of every chunk and restart the rows that the pass may pick."""
        for b in batches:
            made, picked = [], []
            hashed = b.column("__hs")
            for i, first, x, models in _chunks_of(b, cols):
                drawn = hashed[i].values
                for m in models:
                    d = _distances(x, m["__cs"], cols).min(axis=1)
                    h = drawn[m["__run"]].values.to_numpy()
                    at = np.flatnonzero(d > 0)
                    key = -np.log(((h[at] & ((1 << 52) - 1)) + 0.5) / float(1 << 52)) / d[at]
                    if len(key) > over:                # the smallest, with all that equal the last of them
                        few_at = key <= np.partition(key, over - 1)[over - 1]
                        at, key = at[few_at], key[few_at]
                    made.append((np.full(len(at), i), np.full(len(at), m["__run"], dtype=np.int32), key))
                    picked.append(first + at)
            if picked:
                rows = b.column("__rows").values.take(pa.array(np.concatenate(picked)))
                yield _batch(made, b, keys, ["__run", "__draw"],
                             {n: pc.struct_field(rows, n) for n in (id_col, *cols)})

    def weigh(batches):
        """Numbers of a chunk's rows by nearest candidate."""
        for b in batches:
            made = []
            for i, _, x, models in _chunks_of(b, cols):
                for m in models:
                    n = np.bincount(_distances(x, m["__cs"], cols).argmin(axis=1), minlength=len(m["__cs"]))
                    at = np.flatnonzero(n)
                    made.append((np.full(len(at), i), np.full(len(at), m["__run"], dtype=np.int32), n[at].astype(np.int64),
                                 *[np.array([m["__cs"][j][c] for j in at], dtype=float) for c in cols]))
            if made:
                yield _batch(made, b, keys, ["__run", "__w", *cols], {})

    kinds = [*_types(base, keys), "__run int"]
    for i in range(1, passes + 1):
        runs = F.array(*[hashes(i, F.lit(r)) for r in range(n_init)])
        drawn = with_candidates().withColumn("__hs", runs).mapInArrow(
            draw, ", ".join([*kinds, "__draw double", *_types(base, [id_col, *cols])]))
        nth = F.row_number().over(Window.partitionBy(*g).orderBy("__draw", id_col))
        picked = (drawn.withColumn("__n", nth).filter(F.col("__n") <= over)
                  .select(*g, F.struct(*cols).alias("c")).distinct())
        candidates = candidates.unionByName(picked).checkpoint()
    weights = with_candidates().mapInArrow(weigh, ", ".join([*kinds, "__w bigint", *_types(base, cols)]))
    weights = weights.groupBy(*g, *cols).agg(F.sum("__w").alias("__w"))

    def order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(cols), ignore_index=True)
        rng = np.random.default_rng([seed, int(rows["__run"].iloc[0]), len(rows)])
        at = _spread(rows, cols, most, rng)
        at += [at[0]] * (min(most, int(rows["__w"].sum())) - len(at))
        out = rows.iloc[at].drop(columns="__w")
        out["__rn"] = np.arange(1, len(at) + 1, dtype=np.int32)
        return out

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in weights.schema.fields if f.name != "__w"]
    names = [*g, *cols, "__rn"]
    return weights.groupBy(*g).applyInPandas(lambda k, r: order(k, r)[names], ", ".join([*kinds, "__rn int"]))


def kmeans_fit(df: DataFrame, cols: Sequence[str] = FEATURES, k: int | Iterable[int] = 3,
               keys: Sequence[str] = ("tenant_id",), id_col: str = "buyer_id", seed: int = 42,
               max_iter: int = 300, tol: float = 1e-4, n_init: int = 3,
               order_by: str = "monetary") -> DataFrame:
    """Fit K-Means per key (and per k when ``k`` is a list).

    Initial centroids: k-means|| (``seeds``), the same sequence for every k of a restart.
    Each iteration assigns rows to the nearest centroid and averages per (key, k, restart, cluster); an empty cluster keeps its
    centroid.  A model is finished when no centroid moves by more than ``tol`` (squared)
    or after ``max_iter`` iterations.  The restart with the lowest inertia wins; clusters
    are relabelled 0..k-1 by centroid ``order_by`` descending.

    Returns (keys..., k, cluster_id, cols..., size, inertia, iterations, converged).
    """
    from shopsight.session import checkpoint_dir

    ks = [k] if isinstance(k, int) else sorted(set(k))
    d, kk = _keys(df, keys)
    cols = list(cols)
    checkpoint_dir(d.sparkSession)
    g = kk + ["k", "__run"]
    base = d.select(*kk, id_col, *[F.col(c).cast("double").alias(c) for c in cols]).checkpoint()
    chunks = chunked(base, cols, kk, id_col, seed)
    few = _few(chunks, kk)
    first = (seeds(base, cols, kk, id_col, max(ks), n_init, seed, chunks=chunks)
             .withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).filter(F.col("__rn") <= F.col("k")))
    cluster = F.struct((F.col("__rn") - 1).alias("cluster_id"), *cols)
    models = (first.groupBy(*g).agg(F.sort_array(F.collect_list(cluster)).alias("__cents"))
                   .withColumns({"iterations": F.lit(0), "converged": F.lit(False)}).checkpoint())
    names = ["k", "__run", "cluster_id", "size", "__d", *[f"s_{c}" for c in cols], *[f"n_{c}" for c in cols]]
    kinds = ["k int", "__run int", "cluster_id int", "size bigint", "__d double",
             *[f"`s_{c}` double" for c in cols], *[f"`n_{c}` bigint" for c in cols]]

    def sums(batches):
        """Of every chunk, model and cluster: rows, squared distances, and sums and numbers of coordinates."""
        for b in batches:
            made = []
            for i, _, x, models in _chunks_of(b, cols):
                given = ~np.isnan(x)
                whole, x0 = given.all(), np.where(given, x, 0.0)
                all_d = _distances(x, [c for m in models for c in m["__cents"]], cols)
                lo = 0
                for m in models:
                    n = len(m["__cents"])
                    d, lo = all_d[:, lo:lo + n], lo + n
                    label = d.argmin(axis=1)
                    near = np.nan_to_num(d[np.arange(len(x)), label])
                    size = np.bincount(label, minlength=n)
                    at = np.flatnonzero(size)
                    add = lambda w: np.bincount(label, weights=w, minlength=n)[at]
                    made.append((np.full(len(at), i), np.full(len(at), m["k"], dtype=np.int32),
                                 np.full(len(at), m["__run"], dtype=np.int32), at.astype(np.int32), size[at].astype(np.int64),
                                 add(near), *[add(x0[:, j]) for j in range(len(cols))],
                                 *[(size[at] if whole else add(given[:, j])).astype(np.int64) for j in range(len(cols))]))
            if made:
                yield _batch(made, b, kk, names, {})

    def summed(some: DataFrame) -> DataFrame:
        """The sums of every cluster of the given models over the rows nearest to it."""
        packed = some.groupBy(*kk).agg(F.collect_list(F.struct("k", "__run", "__cents")).alias("__ms"))
        parts = _with_models(chunks, packed, kk, few).mapInArrow(sums, ", ".join([*_types(base, kk), *kinds]))
        return parts.groupBy(*g, "cluster_id").agg(*[F.sum(n).alias(n) for n in names[3:]])

    for _ in range(max_iter):
        active = models.filter(~F.col("converged"))
        if active.isEmpty():
            break
        means = summed(active).select(*g, "cluster_id", *[F.try_divide(f"s_{c}", f"n_{c}").alias(c) for c in cols])
        fresh = means.groupBy(*g).agg(F.map_from_entries(F.collect_list(
            F.struct("cluster_id", F.struct(*cols)))).alias("__new"))
        # finished models have no fresh means and stay as they are; one frame, so its partitions do not grow by pass
        moved = models.join(fresh, g, "left").withColumn("__next", F.transform("__cents", lambda c: F.struct(
            c["cluster_id"].alias("cluster_id"),
            *[F.coalesce(F.try_element_at("__new", c["cluster_id"])[x], c[x]).alias(x) for x in cols])))
        shift = F.array_max(F.zip_with("__cents", "__next", lambda a, b: _sqdist(
            [a[x] for x in cols], [b[x] for x in cols])))
        models = moved.select(
            *g, F.when(F.col("converged"), F.col("__cents")).otherwise(F.col("__next")).alias("__cents"),
            (F.col("iterations") + F.when(F.col("converged"), 0).otherwise(1)).alias("iterations"),
            (F.col("converged") | (shift <= tol)).alias("converged")).checkpoint()
    per = summed(models).select(*g, "cluster_id", "size", "__d").checkpoint()
    inertia = per.groupBy(*g).agg(F.sum("__d").alias("inertia"))
    best = inertia.groupBy(*kk, "k").agg(F.min_by("__run", F.struct("inertia", "__run")).alias("__run"),
                                         F.min("inertia").alias("inertia"))
    chosen = (models.join(best, kk + ["k", "__run"])
                    .select(*g, "inertia", "iterations", "converged", F.inline("__cents"))
                    .join(per.drop("__d"), g + ["cluster_id"], "left")
                    .withColumn("size", F.coalesce(F.col("size"), F.lit(0))))
    rw = Window.partitionBy(*kk, "k").orderBy(F.col(order_by).desc(), F.col("cluster_id"))
    out = (chosen.withColumn("cluster_id", (F.row_number().over(rw) - 1).cast("int"))
                 .select(*kk, "k", "cluster_id", *cols, "size", "inertia", "iterations", "converged"))
    return out if keys else out.drop("__all")


def kmeans_sweep(df: DataFrame, cols: Sequence[str] = FEATURES, ks: Iterable[int] = range(2, 10),
                 keys: Sequence[str] = ("tenant_id",), id_col: str = "buyer_id", seed: int = 42,
                 n_init: int = 3, max_iter: int = 300, centroids: DataFrame | None = None) -> DataFrame:
    """Silhouette and Davies-Bouldin per key for every k with k <= n - 1.

    ``centroids`` (from ``kmeans_fit`` with a list of k) skips the fit when the caller
    also needs the models, so every k is fitted once.
    """
    from shopsight.session import staged

    ks = sorted(set(ks))
    cents = centroids if centroids is not None else \
        kmeans_fit(df, cols, ks, keys, id_col, seed, max_iter=max_iter, n_init=n_init)
    cents = cents.filter(F.col("k").isin(ks))
    d, kk = _keys(df, keys)
    if not keys:
        cents = cents.withColumn("__all", F.lit(0))
    pts = d.select(*kk, *cols).withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks])))
    # both scores read the labels twice
    assigned = staged(assign_clusters(pts, cents, cols, kk + ["k"]), "sweep-labels")
    sizes = d.groupBy(*kk).agg(F.count(F.lit(1)).alias("__n"))
    sil = silhouette(assigned, cols, kk + ["k"])
    db = davies_bouldin(assigned, cols, kk + ["k"])
    out = (sil.join(db, kk + ["k"]).join(sizes, kk)
              .filter(F.col("k") <= F.col("__n") - 1).drop("__n")
              .withColumnRenamed("davies_bouldin", "db_index"))
    return out if keys else out.drop("__all")


# --- G10 / E4: PCA explained variance ------------------------------------------------------------------

def eigenvalues(matrix: Column, n: int, sweeps: int = 10) -> Column:
    """Eigenvalues, falling, of a symmetric n x n matrix given as one array by rows: cyclic Jacobi
    rotations, each of which turns one entry off the diagonal to 0.  Ten sweeps are more than the
    quadratic convergence needs for the few features of a customer."""
    pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]

    def rotated(a: Column, p: int, q: int) -> Column:
        at = lambda i, j: a[i * n + j]
        theta = (at(q, q) - at(p, p)) / (2 * at(p, q))
        tangent = F.when(at(p, q) == 0, 0.0).otherwise(
            F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))

        def entries(t: Column) -> Column:
            c = 1 / F.sqrt(t * t + 1)
            new = {(p, p): at(p, p) - t * at(p, q), (q, q): at(q, q) + t * at(p, q), (p, q): F.lit(0.0)}
            for k in set(range(n)) - {p, q}:
                new[min(k, p), max(k, p)] = c * at(k, p) - t * c * at(k, q)
                new[min(k, q), max(k, q)] = t * c * at(k, p) + c * at(k, q)
            return F.array(*[new.get((min(i, j), max(i, j)), at(i, j)) for i in range(n) for j in range(n)])
        return F.transform(F.array(tangent), entries)[0]          # the tangent is computed once

    def step(a: Column, i: Column) -> Column:
        out = a
        for j, (p, q) in enumerate(pairs):
            out = F.when(i % len(pairs) == j, rotated(a, p, q)).otherwise(out)
        return out

    turned = F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * len(pairs) - 1)), matrix, step) if pairs else matrix
    return F.sort_array(F.transform(F.array(*[F.lit(i * n + i) for i in range(n)]), lambda i: F.get(turned, i)), asc=False)


def pca_variance(df: DataFrame, cols: Sequence[str] = FEATURES, keys: Sequence[str] = ("tenant_id",),
                 digits: int = 4) -> DataFrame:
    """Explained variance (%) per principal component and its running total.

    The d x d covariance matrix of each key is an aggregate (partial-aggregated); the
    eigenvalues are column expressions over that one row.  Without any variance the shares are NaN.
    """
    d, k = _keys(df, keys)
    n = len(cols)
    cell = lambda i, j: F.covar_pop(F.col(cols[min(i, j)]).cast("double"), F.col(cols[max(i, j)]).cast("double"))
    cov = d.groupBy(*k).agg(*[cell(i, j).alias(f"c_{i}_{j}") for i in range(n) for j in range(i, n)])
    matrix = F.array(*[F.col(f"c_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    # an expression that is read more than once would be computed more than once
    values = cov.select(*k, F.posexplode(eigenvalues(matrix, n)).alias("i", "value"))
    total = Window.partitionBy(*k)
    running = total.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    per = values.select(*k, (F.col("i") + 1).alias("component"), "value", F.sum("value").over(total).alias("total"))
    per = per.withColumn("pct", F.when(F.col("total") > 0, F.col("value") / F.col("total") * 100).otherwise(math.nan))
    out = per.select(*k, "component", F.round("pct", digits).alias("explained_variance_pct"),
                     F.round(F.sum("pct").over(running), digits).alias("cumulative_pct"))
    return out if keys else out.drop("__all")
