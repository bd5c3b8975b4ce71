"""Embedding metrics (A2, A3, A10-A13) without all-pairs row tables.

* A2 mean/std of off-diagonal dots come from the sum vector and the d x d
  second-moment matrix, partially aggregated per task; min/max come from one pass over
  a triangle of cells that skips what its bounds rule out -- no pair is ever a row.
* A10 ranks each text's true image with the exact kNN join (top-5).
* A11 deals every category's rows to groups by hash; every two groups meet in one cell of
  a triangle, whose number follows the category's pairs, so a hot category is many cells.
* A12/A13 work inside training batches, whose size is bounded by definition.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_LOSS_ALPHA, CONTRASTIVE_TEMPERATURE
from ..functions.vectors import as_double, norm, similarity
from .knn import BLOCK_ROWS, HELD_BYTES, _dimension, _packed, _sizes, knn_join
from ..sources.io import materialise
from .metrics import null_safe_join


# -- A2 -----------------------------------------------------------------------

def _moments(batches, dim: int):
    s = np.zeros(dim)
    S = np.zeros((dim, dim))
    for pdf in batches:
        if len(pdf) == 0:
            continue
        V = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        s += V.sum(axis=0)
        S += V.T @ V
    yield pd.DataFrame({"sums": [s.tolist() + S.ravel().tolist()]})


def _sum_arrays(df: DataFrame, col: str) -> DataFrame:
    """Element-wise sum of an array column across rows (partials -> one vector)."""
    return (df.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")))


def embedding_quality(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A2: count, dim, norm stats, off-diagonal dot stats, diversity (one row)."""
    v = vectors.select(F.col(id_col).alias("vec_id"), as_double(vec_col).alias("v"))
    v = v.withColumn("nrm", norm("v"))
    base = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                 F.avg("nrm").alias("norm_mean"), F.stddev_pop("nrm").alias("norm_std"),
                 F.min("nrm").alias("norm_min"), F.max("nrm").alias("norm_max"),
                 F.sum(F.col("nrm") * F.col("nrm")).alias("sq"),
                 F.sum(F.pow("nrm", 4)).alias("q4")).first()
    n, dim = base["n"], base["dim"]
    spark = vectors.sparkSession
    schema = ("num_embeddings long, embedding_dim int, norm_mean double, norm_std double, norm_min double, norm_max double, "
              "sim_mean double, sim_std double, sim_min double, sim_max double, diversity_score double")
    if n < 2:  # no pair: the statistics over pairs are null
        return spark.createDataFrame([(n, dim, *(base[f"norm_{x}"] for x in ("mean", "std", "min", "max")), *[None] * 5)], schema)
    # one pass: the sum vector and the moment matrix, as one array per task
    parts = v.select("v").mapInPandas(partial(_moments, dim=dim), "sums array<double>")
    sq = (_sum_arrays(parts, "sums").agg(
        F.sum(F.when(F.col("i") < dim, F.col("x") * F.col("x"))).alias("s"),
        F.sum(F.when(F.col("i") >= dim, F.col("x") * F.col("x"))).alias("f")).first())
    pairs = n * (n - 1)
    mean = (sq["s"] - base["sq"]) / pairs
    second = (sq["f"] - base["q4"]) / pairs
    std = math.sqrt(max(second - mean * mean, 0.0))
    ends = dot_extremes(v, "vec_id", "v").first()
    lo, hi = ends["lo"], ends["hi"]
    row = [(n, dim, base["norm_mean"], base["norm_std"], base["norm_min"], base["norm_max"],
            mean, std, lo, hi, 1.0 - mean)]
    return spark.createDataFrame(row, schema)


_TILE, _PIVOTS = 256, 32     # vectors in a tile, directions that tiles are cut by


class _Tiles:
    """The vectors of a group, cut by nearest pivot into tiles of about one direction;
    every vector of a tile lies within ``radius`` of its ``centre``."""

    def __init__(self, own: np.ndarray, vecs: np.ndarray):
        pivots = vecs[np.linspace(0, len(vecs) - 1, min(_PIVOTS, len(vecs))).astype(int)]
        near = np.argmax(vecs @ pivots.T - 0.5 * np.einsum("ij,ij->i", pivots, pivots), axis=1)
        order = np.argsort(near, kind="stable")
        self.own, self.vecs = own[order], vecs[order]
        begins = np.flatnonzero(np.diff(near[order], prepend=-1))
        ends = np.append(begins[1:], len(vecs))
        self.cuts = [(a, min(a + _TILE, e)) for b, e in zip(begins, ends, strict=True) for a in range(b, e, _TILE)]
        self.centre = np.stack([self.vecs[a:z].mean(axis=0) for a, z in self.cuts])
        self.radius = np.array([np.sqrt(((self.vecs[a:z] - c) ** 2).sum(axis=1).max())
                                for (a, z), c in zip(self.cuts, self.centre, strict=True)])
        self.norm = np.linalg.norm(self.centre, axis=1)


def _cell_extremes(A: _Tiles, B: _Tiles, same: bool) -> tuple[float, float, int, int]:
    """(lowest, highest dot product, tile pairs, tile pairs visited). With centres c, d and
    radii r, s a product of two tiles lies within |c| s + r |d| + r s of c d. Tile pairs are
    visited by rising bound until none left can beat the best found."""
    middle = A.centre @ B.centre.T
    reach = A.norm[:, None] * B.radius + A.radius[:, None] * (B.norm + B.radius)
    reach = reach + 1e-9 * (np.abs(middle) + reach + 1)  # rounding
    pairs = np.argwhere(np.triu(np.ones_like(middle, dtype=bool)) if same else np.ones_like(middle, dtype=bool))
    lower, upper = ((middle + sign * reach)[pairs[:, 0], pairs[:, 1]] for sign in (-1, 1))
    lower, upper = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
    lo, hi, seen = np.inf, -np.inf, np.zeros(len(pairs), bool)
    for low, high in zip(np.argsort(lower, kind="stable"), np.argsort(-upper, kind="stable"), strict=True):
        if lower[low] >= lo and upper[high] <= hi:
            break
        for k, open_ in ((low, lower[low] < lo), (high, upper[high] > hi)):
            if seen[k] or not open_:
                continue
            seen[k] = True
            (a, z), (b, y) = A.cuts[pairs[k, 0]], B.cuts[pairs[k, 1]]
            dots = A.vecs[a:z] @ B.vecs[b:y].T
            if same:
                dots[A.own[a:z][:, None] == B.own[b:y][None, :]] = np.nan
            dots = dots[np.isfinite(dots)]
            if len(dots):
                lo, hi = min(lo, dots.min()), max(hi, dots.max())
    return lo, hi, len(pairs), int(seen.sum())


def _extremes(batches, dim: int, groups: int):
    """Rows come by cell; a cell holds the vectors of one or two groups."""
    def result(cell, held):
        i, j = divmod(cell, groups)
        tiles = {g: _Tiles(*(np.concatenate(x) for x in zip(*parts, strict=True))) for g, parts in held.items()}
        if i in tiles and j in tiles:
            lo, hi, pairs, seen = _cell_extremes(tiles[i], tiles[j], i == j)
            yield pa.RecordBatch.from_pydict({"lo": [lo if np.isfinite(lo) else None], "hi": [hi if np.isfinite(hi) else None],
                                              "tiles": [pairs], "visited": [seen]}, schema=_EXTREMES)
    at, held = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            cell, g, own, vecs = (batch.column(c)[i].as_py() for c in ("cell", "g", "own", "vecs"))
            if cell != at:
                if held:
                    yield from result(at, held)
                at, held = cell, {}
            held.setdefault(g, []).append((np.frombuffer(own, np.int64), np.frombuffer(vecs, np.float64).reshape(-1, dim)))
    if held:
        yield from result(at, held)


_EXTREMES = pa.schema([("lo", pa.float64()), ("hi", pa.float64()), ("tiles", pa.int64()), ("visited", pa.int64())])


def dot_extremes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row (lo, hi, tiles, visited): the least and greatest dot product of two rows with
    different ids, exact, and how many tile pairs there are and were visited.

    Rows are dealt by hash of their id to groups, and every two groups (or one with itself)
    meet in one cell of a triangle, so a vector is sent once per group, about the square
    root of twice the number of tasks. Null or mixed vectors raise; no two ids give nulls;
    non-finite products do not count."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("k"), F.col(id_col).cast("long").alias("own"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    stats = _sizes(v, "vec")
    schema = "lo double, hi double, tiles bigint, visited bigint"
    if not stats["n"]:
        return vectors.sparkSession.createDataFrame([(None, None, 0, 0)], schema)
    dim = _dimension(stats, "vectors")
    cells = min(4 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(stats["n"] / BLOCK_ROWS) ** 2)
    groups = max(round(math.sqrt(2 * cells)), math.ceil(8 * dim * stats["n"] / HELD_BYTES), 1)
    packed = _packed(v.withColumn("key", F.lit(0).cast("bigint")), F.lit(groups))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    met = (packed.select("g", "own", "vecs", other.alias("j"))
           .select((F.least("g", "j").cast("long") * groups + F.greatest("g", "j")).alias("cell"), "g", "own", "vecs")
           .repartition(groups * (groups + 1) // 2, "cell").sortWithinPartitions("cell"))
    return met.mapInArrow(lambda it: _extremes(it, dim, groups), schema).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("tiles").alias("tiles"), F.sum("visited").alias("visited"))


# -- A3 -----------------------------------------------------------------------

def fusion_quality(pairs: DataFrame, a: str, b: str, relevance: str) -> DataFrame:
    """A3: Pearson correlation, MSE, MAE of cosine(a, b) against relevance."""
    p = pairs.select(similarity(a, b, "cosine").alias("pred"), F.col(relevance).cast("double").alias("rel"))
    return p.agg(F.corr("pred", "rel").alias("correlation"),
                 F.avg(F.pow(F.col("pred") - F.col("rel"), 2)).alias("mse"),
                 F.avg(F.abs(F.col("pred") - F.col("rel"))).alias("mae"))


# -- A10 ----------------------------------------------------------------------

def similarity_accuracy(texts: DataFrame, images: DataFrame, truth: DataFrame, dim: int) -> DataFrame:
    """A10: top-1 / top-5 accuracy of text -> image by dot product.

    ``texts (id, embedding)``, ``images (id, embedding)`` (a null image counts
    as the zero vector), ``truth (text_id, image_id)``. Ties order like a
    reversed stable sort: the larger image id first.
    """
    imgs = images.select(F.col("id").alias("vec_id"),
                         F.coalesce(as_double("embedding"), F.array_repeat(F.lit(0.0), dim)).alias("embedding"))
    q = texts.select(F.col("id").alias("query_id"), as_double("embedding").alias("embedding"))
    top = knn_join(q, imgs, k=5, metric="ip", ids_desc=True, tie_decimals=12)
    hit = truth.join(top.withColumnRenamed("query_id", "text_id").withColumnRenamed("vec_id", "image_id"),
                     ["text_id", "image_id"], "left")
    return hit.agg(
        F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("accuracy_top1"),
        F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("accuracy_top5"),
        F.count(F.lit(1)).alias("num_pairs"))


# -- A11 ----------------------------------------------------------------------

_ROWS_AT_ONCE = 1024


def _distances(A: np.ndarray, B: np.ndarray) -> float:
    """The sum of all distances between the rows of A and of B."""
    total, bb = 0.0, np.einsum("ij,ij->i", B, B)
    for a in range(0, len(A), _ROWS_AT_ONCE):
        some = A[a:a + _ROWS_AT_ONCE]
        aa = np.einsum("ij,ij->i", some, some)
        for b in range(0, len(B), _ROWS_AT_ONCE):
            part = slice(b, b + _ROWS_AT_ONCE)
            d2 = aa[:, None] + bb[part][None, :] - 2.0 * (some @ B[part].T)
            total += float(np.sqrt(np.maximum(d2, 0.0)).sum())
    return total


def _cell_sums(batches, kind):
    """Rows come by cell; a cell holds the vectors of one or two groups of a category."""
    def result(cell, held):
        key, i, j = cell
        if i in held and j in held:
            A, B = (np.concatenate(held[g]) for g in (i, j))
            yield pa.RecordBatch.from_pydict({"key": [key], "s": [_distances(A, B) * (1.0 if i == j else 2.0)]}, schema=_CELL_SUM)
    at, held = None, {}
    for batch in batches:
        for r in range(batch.num_rows):
            key, i, j, g, ids, vecs = (batch.column(c)[r].as_py() for c in ("key", "i", "j", "g", "ids", "vecs"))
            if (key, i, j) != at:
                if held:
                    yield from result(at, held)
                at, held = (key, i, j), {}
            held.setdefault(g, []).append(np.frombuffer(vecs, kind).astype(np.float64).reshape(len(ids) // 8, -1))
    if held:
        yield from result(at, held)


_CELL_SUM = pa.schema([("key", pa.int64()), ("s", pa.float64())])


def category_dispersion(vectors: DataFrame, cat_col: str, vec_col: str = "embedding",
                        id_col: str = "vec_id", block_rows: int = 512) -> DataFrame:
    """Mean full pairwise L2 distance per category (n > 1), summed, / #categories.

    Output: one row ``(category_loss, n_categories)`` plus per-category means
    via ``category_dispersion_by_group``.
    """
    per = category_dispersion_by_group(vectors, cat_col, vec_col, id_col, block_rows)
    return per.agg(
        F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("mean_dist")).otherwise(0.0)),
                     F.count(F.lit(1)).cast("double")).alias("category_loss"),
        F.count(F.lit(1)).alias("n_categories"))


def category_dispersion_by_group(vectors: DataFrame, cat_col: str, vec_col: str = "embedding",
                                 id_col: str = "vec_id", block_rows: int = 512) -> DataFrame:
    """Every category is a triangle of cells, with a share of the tasks by its number of
    pairs: its rows are dealt by hash of their id to groups (HELD_BYTES at most on average)
    and every two groups, or one with itself, meet in one cell. So a vector is sent once per
    group, whatever the size of the category. ``block_rows`` is the least size of a group."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(cat_col).alias("category"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    counts = materialise(v.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "key", F.monotonically_increasing_id()), "categories")
    v = v.where(F.col("vec").isNotNull())  # a null vector is counted and has no distance
    dim = v.agg(F.max(F.size("vec"))).first()[0] or 1
    kind = np.float32 if dict(v.dtypes)["vec"] == "array<float>" else np.float64
    tasks = 4 * spark.sparkContext.defaultParallelism
    pairs = counts.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 1.0
    n = F.col("n")
    cells = F.ceil(n * tasks / F.lit(pairs) * n)
    groups = F.greatest(F.least(F.round(F.sqrt(2.0 * cells)), F.ceil(n / block_rows).cast("double")),
                        F.ceil(n * (8 * dim) / HELD_BYTES).cast("double"), F.lit(1.0)).cast("int")
    grouped = counts.select("category", "key", groups.alias("groups"))
    packed = _packed(null_safe_join(v, grouped, ["category"]).select(
        "key", "id", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("own"), "vec", "groups"), F.col("groups"), F.lit(0).cast("bigint"))
    met = (packed.join(grouped.drop("category"), "key").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
           .select("key", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "ids", "vecs")
           .repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j"))
    sums = met.mapInArrow(lambda it: _cell_sums(it, kind), "key bigint, s double")
    tot = sums.groupBy("key").agg(F.sum("s").alias("s"))
    return (counts.join(tot, "key", "left")
            .select("category", "n", (F.coalesce(F.col("s"), F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("mean_dist")))


# -- A12, A13 -----------------------------------------------------------------

def _batch_loss(pdf: pd.DataFrame, temperature: float, alpha: float) -> pd.DataFrame:
    T_ = np.stack(pdf["t"].to_numpy()).astype(np.float64)
    I_ = np.stack(pdf["m"].to_numpy()).astype(np.float64)
    T_ = T_ / np.linalg.norm(T_, axis=1, keepdims=True)
    I_ = I_ / np.linalg.norm(I_, axis=1, keepdims=True)
    logits = T_ @ I_.T / temperature

    def ce(L):
        m = L.max(axis=1, keepdims=True)
        lse = (m[:, 0] + np.log(np.exp(L - m).sum(axis=1)))
        return float(np.mean(lse - np.diag(L)))

    contrastive = (ce(logits) + ce(logits.T)) / 2.0
    labels = pdf["label"].to_numpy()
    raw = np.stack(pdf["t"].to_numpy()).astype(np.float64)
    cats = np.unique(labels)
    cat_loss = 0.0
    for c in cats:
        F_ = raw[labels == c]
        if len(F_) > 1:
            d2 = ((F_[:, None, :] - F_[None, :, :]) ** 2).sum(-1)
            cat_loss += float(np.sqrt(np.maximum(d2, 0.0)).mean())
    cat_loss /= len(cats)
    return pd.DataFrame({"batch_id": [int(pdf["batch_id"].iloc[0])], "n": [len(pdf)],
                         "contrastive_loss": [contrastive], "category_loss": [cat_loss],
                         "total_loss": [contrastive + alpha * cat_loss]})


def batch_losses(pairs: DataFrame, batch_col: str, text_col: str, image_col: str, label_col: str,
                 temperature: float = CONTRASTIVE_TEMPERATURE, alpha: float = CATEGORY_LOSS_ALPHA) -> DataFrame:
    """A12 + A13 per training batch: symmetric contrastive loss at ``temperature``
    on normalised vectors, category loss on the text vectors, total =
    contrastive + alpha * category. Batches are bounded (training batch size)."""
    p = pairs.select(F.col(batch_col).alias("batch_id"), as_double(text_col).alias("t"),
                     as_double(image_col).alias("m"), F.col(label_col).alias("label"))
    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        return _batch_loss(pdf, temperature, alpha)

    return p.groupBy("batch_id").applyInPandas(
        per_batch,
        "batch_id long, n long, contrastive_loss double, category_loss double, total_loss double")
