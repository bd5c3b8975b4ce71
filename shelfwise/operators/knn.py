"""Exact and keyed k-nearest-neighbour joins, on the executors.

Exact search runs on a grid of tasks (see :func:`grid`): queries are dealt by hash of
their id to ``gq`` rows of cells, vectors to ``gv`` columns, and cell (i, j) compares
row i with column j. A query is sent ``gv`` times and a vector ``gq`` times, about the
square root of the number of tasks, whatever the number of blocks; a cell keeps its
vectors (HELD_BYTES at most on average, or there are more columns) and streams its
queries past them by matrix product, handing on k rows a query.

With keys (clusters, hash buckets) only pairs that share a key are compared: every key
has a grid of its own, with a share of the tasks by its number of pairs, so a row is
sent a few times per key, whatever the size of the key, and a hot key is many cells.
Rows travel as blocks of arrays, floats as four bytes if the column has them so.

Either way row_number() over the query follows, no side passes through the driver and
no query x vector pair becomes a row. Exact search is O(Q x V) work by definition.

Distances: L2 is the **squared** Euclidean distance (flat L2 index semantics),
ascending; inner product is descending. Ties break by ``vec_id``. Candidate
selection uses the fast ``|q|^2 + |v|^2 - 2 q.v`` form, then every candidate
within a tolerance of the cut is re-scored exactly from the differences, so the
result equals a brute-force computation in float64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import materialise

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("vec_id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("k", T.IntegerType(), False),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("vec_id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
])

BLOCK_ROWS = 1024
# Bytes of vectors a cell of the grid keeps, and rows of queries and of vectors in one product.
HELD_BYTES = 64 << 20
_AT_ONCE, _VECTORS_FIRST, _VECTORS_AT_ONCE = 1024, 1024, 4096
_IN_CACHE = 1 << 18  # products written over and over, a few queries at a time
_SCORED_AT_ONCE = 1 << 16


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _best(qi, score, ids, kmax, ids_desc):
    """The ``kmax`` first of every query row, by score, then id."""
    order = np.lexsort((-ids if ids_desc else ids, score, qi))
    qi, score, ids = qi[order], score[order], ids[order]
    first = np.flatnonzero(np.diff(qi, prepend=-1))
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    keep = rank < kmax
    return qi[keep], score[keep], ids[keep]


def grid(n_queries: int, n_vectors: int, dim: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """(gq, gv): four cells a core, or fewer if the blocks are few. The sides share them so
    that the copies of both, ``n_queries * gv + n_vectors * gq``, are about the fewest."""
    blocks = math.ceil(n_queries / block_rows) * math.ceil(n_vectors / block_rows)
    cells = min(4 * parallelism, blocks)
    gv = min(max(round(math.sqrt(cells * n_vectors / n_queries)), 1), cells)
    gv = max(gv, math.ceil(8 * dim * n_vectors / HELD_BYTES))
    return max(round(cells / gv), 1), gv


_PACKED = "key bigint, g int, ids binary, ks binary, own binary, vecs binary"


def _pack(batches: Iterator[pa.RecordBatch], kind=np.float64) -> Iterator[pa.RecordBatch]:
    """The rows of every batch, key and group as arrays: ids, k, own ids and vectors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.list_value_length(batch.column("vec"))
        if pc.count_distinct(lengths).as_py() > 1:  # of categories; a search has one dimension
            for n in pc.unique(lengths):
                yield from _pack([batch.filter(pc.equal(lengths, n))], kind)
            continue
        key, g, ids, ks, own = (batch.column(c).to_numpy() for c in ("key", "g", "id", "k", "own"))
        vecs = _matrix(batch.column("vec"), batch.num_rows).astype(kind)
        order = np.lexsort((g, key))
        parts = np.split(order, np.flatnonzero(np.diff(g[order]) | np.diff(key[order])) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[p[0]] for p in parts], pa.int64()), pa.array([g[p[0]] for p in parts], pa.int32()),
             *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (ids, ks, own, vecs))],
            ["key", "g", "ids", "ks", "own", "vecs"])


def _unpacked(vecs: bytes, n: int, dim: int) -> np.ndarray:
    """The float64 matrix of ``n`` packed vectors of four or eight bytes a component."""
    return np.frombuffer(vecs, f"f{len(vecs) // (n * dim)}").astype(np.float64).reshape(n, dim)


class _Column:
    """The vectors of a cell: a float32 product finds all that may be among a query's best,
    within the product's own error bound, and those are scored in float64 from the differences."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vecs: np.ndarray, metric: str):
        self.ids, self.own, self.vecs, self.metric = ids, own, vecs, metric
        self.norms = np.einsum("ij,ij->i", vecs, vecs)
        with np.errstate(over="ignore"):
            self.small = self._factors(np.float32)

    def _factors(self, kind) -> np.ndarray:
        """Vectors times a power of two, which is exact: a product with a query then has its sign and factor;
        of L2 with the norm as one more component, which meets a one."""
        if self.metric != "l2":
            return (self.vecs * -1.0).astype(kind)
        return np.concatenate([self.vecs * -2.0, self.norms[:, None]], axis=1).astype(kind)

    def _exact(self, Q, qi, vj):
        """Scores to minimise in float64, some pairs at a time: many vectors may be equally near."""
        out = np.empty(len(qi))
        for a in range(0, len(qi), _SCORED_AT_ONCE):
            part = slice(a, a + _SCORED_AT_ONCE)
            q, v = Q[qi[part]], self.vecs[vj[part]]
            out[part] = ((q - v) ** 2).sum(axis=1) if self.metric == "l2" else -(q * v).sum(axis=1)
        return out

    def nearest(self, Q, q_own, kmax, exclude_self, tol_scale, tie_decimals, ids_desc):
        """(query row, score to minimise, id) of the ``kmax`` best of every query row."""
        l2, dim = self.metric == "l2", Q.shape[1]
        qn = np.einsum("ij,ij->i", Q, Q)
        longest = self.norms.max(initial=0.0)
        # of a sum of dim float32 products, and of the rounded inputs and norms
        error = (dim + 8) * 2.0 ** -23 * ((2 * np.sqrt(qn * longest) + longest) if l2 else np.sqrt(qn * longest)) + tol_scale
        if tie_decimals is not None:
            error = np.maximum(error, 2.0 * 10.0 ** (-tie_decimals))
        # beyond float32's range the product is made in float64
        kind, vectors = ((np.float32, self.small) if max(longest, qn.max(initial=0.0)) < 1e30
                         else (np.float64, self._factors(np.float64)))
        small = np.concatenate([Q, np.ones((len(Q), 1))], axis=1).astype(kind) if l2 else Q.astype(kind)
        cut = np.full(len(Q), np.inf)   # of |v|^2 - 2 q.v, or of -q.v
        best, new, waiting, a = None, [], 0, 0
        while a < len(self.ids):
            z = a + (_VECTORS_AT_ONCE if a else _VECTORS_FIRST)
            if not a and len(self.ids[:z]) >= kmax:
                near = small @ vectors[:z].T
                if exclude_self:
                    near[q_own[:, None] == self.own[None, :z]] = np.inf
                cut = np.partition(near, kmax - 1, axis=1)[:, kmax - 1].astype(np.float64)
            bound = np.nextafter((cut + 2 * error).astype(kind), kind(np.inf))
            qi, vj = self._within(small, vectors[a:z], bound)
            vj += a
            if exclude_self:
                other = q_own[qi] != self.own[vj]
                qi, vj = qi[other], vj[other]
            exact = self._exact(Q, qi, vj)
            new.append((qi, exact if tie_decimals is None else np.round(exact, tie_decimals), self.ids[vj]))
            waiting, a = waiting + len(qi), z
            # those found wait till they are many beside the best, for a wider cut only finds more
            if best is None or a >= len(self.ids) or 2 * waiting >= len(best[0]):
                found = new if best is None else [best, *new]
                best, new, waiting = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), kmax, ids_desc), [], 0
                held = np.bincount(best[0], minlength=len(Q))
                full = np.flatnonzero(held >= kmax)
                worst = best[1][(np.cumsum(held) - 1)[full]]
                cut[full] = worst - qn[full] if l2 else worst
        return best

    @staticmethod
    def _within(small: np.ndarray, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, vector row) of finite products not above the query's bound; the products
        of some queries at a time are made in the same place, which stays in the cache."""
        wide = len(vectors)
        rows = max(_IN_CACHE // wide, 1)
        products, below = np.empty(rows * wide, small.dtype), np.empty(rows * wide, bool)
        qs, vs = [], []
        for i in range(0, len(small), rows):
            n = min(rows, len(small) - i)
            near = np.matmul(small[i:i + n], vectors.T, out=products[:n * wide].reshape(n, wide))
            # of the flat mask: over two dimensions nonzero takes longer than the product
            at = np.flatnonzero(np.less_equal(near, bound[i:i + n, None], out=below[:n * wide].reshape(n, wide)))
            at = at[np.isfinite(products[at])]
            qi, vj = np.divmod(at, wide)
            qs.append(qi + i)
            vs.append(vj)
        return np.concatenate(qs), np.concatenate(vs)


def _search_cells(batches: Iterator[pa.RecordBatch], dim: int, kmax: int, metric: str, exclude_self: bool, tol_scale: float,
                  tie_decimals: int | None, ids_desc: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, vectors before queries: keep the vectors, answer the queries."""
    cell, held, joined = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
            at = (value("key"), value("i"), value("j"))
            if at != cell:
                cell, held, joined = at, [], None
            ids, ks, own = np.frombuffer(value("ids"), np.int64), np.frombuffer(value("ks"), np.int32), np.frombuffer(value("own"), np.int64)
            vecs = _unpacked(value("vecs"), len(ids), dim)
            if value("side") == 0:
                held.append((ids, own, vecs))
                continue
            if joined is None:
                joined = [np.concatenate(x) for x in zip(*held, strict=True)] if held else None
                held = []
            if joined is None:  # no vectors in this column
                continue
            if not isinstance(joined, _Column):
                joined = _Column(*joined, metric)
            for a in range(0, len(ids), _AT_ONCE):
                part = slice(a, a + _AT_ONCE)
                qi, score, found = joined.nearest(vecs[part], own[part], kmax, exclude_self, tol_scale, tie_decimals, ids_desc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part][qi]), pa.array(found), pa.array(score if metric == "l2" else -score), pa.array(ks[part][qi])],
                    ["query_id", "vec_id", "score", "k"])


def _packed(rows: DataFrame, groups, ids=None) -> DataFrame:
    """Rows (key, id, k, own, vec) dealt by hash of their id to ``groups`` and packed, with
    ``ids`` instead of the id if it is not asked for again."""
    kind = "float" if dict(rows.dtypes)["vec"] == "array<float>" else "double"
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), groups).cast("int")).select(
        "key", "g", (F.col("id") if ids is None else ids).alias("id"), "k", "own", F.col("vec").cast(f"array<{kind}>").alias("vec"))
    return rows.mapInArrow(lambda it: _pack(it, np.float32 if kind == "float" else np.float64), _PACKED)


def _met(v: DataFrame, q: DataFrame, sizes: DataFrame | None, gq, gv, cells: int) -> DataFrame:
    """Packed vectors and queries in the cells (key, i, j) of their keys, vectors first.
    ``sizes`` (key, gq, gv) has the grid of every key; without it all have the one given,
    and every cell a task of its own: dealt by hash some tasks would get several, others none."""
    def sent(rows, own, other, side):
        rows = rows if sizes is None else rows.join(sizes, "key")
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), (gv if own == "i" else gq) - 1))).select(
            "key", F.col("g" if own == "i" else other).alias("i"), F.col("g" if own == "j" else other).alias("j"),
            F.lit(side).alias("side"), "ids", "ks", "own", "vecs")
    both = sent(v, "j", "i", 0).unionAll(sent(q, "i", "j", 1))
    dealt = (both.repartition(cells, "key", "i", "j") if sizes is not None
             else both.repartitionById(cells, (F.col("i") * gv + F.col("j")).cast("int")))
    return dealt.sortWithinPartitions("key", "i", "j", "side")


def _grid_hits(q: DataFrame, v: DataFrame, n_queries: int, n_vectors: int, dim: int, block_rows: int, *how) -> DataFrame:
    gq, gv = grid(n_queries, n_vectors, dim, q.sparkSession.sparkContext.defaultParallelism, block_rows)
    one = F.lit(0).cast("bigint").alias("key")
    q_rows = _packed(q.select(one, F.col("query_id").alias("id"), "k", "own", "vec"), F.lit(gq))
    v_rows = _packed(v.select(one, F.col("vec_id").alias("id"), F.lit(0).alias("k"), "own", "vec"), F.lit(gv))
    return _met(v_rows, q_rows, None, F.lit(gq), F.lit(gv), gq * gv).mapInArrow(
        lambda it: _search_cells(it, dim, *how), HIT_SCHEMA)


def _keyed_hits(q: DataFrame, v: DataFrame, dim: int, block_rows: int, *how) -> DataFrame:
    """The same over a grid per key (see :func:`grid`), for rows with a column ``key``."""
    tasks = 4 * q.sparkSession.sparkContext.defaultParallelism
    counted = materialise(q.groupBy("key").agg(F.count(F.lit(1)).alias("nq")).join(
        v.groupBy("key").agg(F.count(F.lit(1)).alias("nv")), "key"), "key-sizes")
    pairs = counted.agg(F.sum(F.col("nq").cast("double") * F.col("nv"))).first()[0] or 1.0
    nq, nv = F.col("nq"), F.col("nv")
    cells = F.least(F.ceil(nq * tasks / F.lit(pairs) * nv), F.ceil(nq / block_rows) * F.ceil(nv / block_rows))
    across = F.least(F.greatest(F.round(F.sqrt(cells * nv / nq)), F.lit(1.0)), cells.cast("double"))
    gv = F.greatest(across, F.ceil(nv * (8 * dim) / HELD_BYTES).cast("double")).cast("int")
    sizes = counted.select("key", gv.alias("gv"), cells.alias("cells")).select(
        "key", "gv", F.greatest(F.round(F.col("cells") / F.col("gv")), F.lit(1.0)).cast("int").alias("gq"))
    n_cells = sizes.agg(F.sum(F.col("gq").cast("long") * F.col("gv"))).first()[0] or 1

    q_rows = _packed(q.join(sizes, "key").select("key", F.col("query_id").alias("id"), "k", "own", "vec", "gq"), F.col("gq"))
    v_rows = _packed(v.join(sizes, "key").select("key", F.col("vec_id").alias("id"), F.lit(0).alias("k"), "own", "vec", "gv"), F.col("gv"))
    hits = _met(v_rows, q_rows, sizes, F.col("gq"), F.col("gv"), min(n_cells, tasks)).mapInArrow(
        lambda it: _search_cells(it, dim, *how), HIT_SCHEMA)
    return hits.repartition("query_id").dropDuplicates(["query_id", "vec_id"])  # a pair may share several keys


def _sizes(rows: DataFrame, vec: str):
    size = F.size(vec)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(vec).alias("with_vector"), F.min(size).alias("low"),
                    F.max(size).alias("high")).first()


def _dimension(stats, what: str) -> int:
    if stats["with_vector"] < stats["n"]:
        raise ValueError(f"{stats['n'] - stats['with_vector']} {what} have no vector")
    if stats["low"] != stats["high"]:
        raise ValueError(f"{what} have dimensions {stats['low']} to {stats['high']}")
    return stats["high"]


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2", *,
             query_id_col: str = "query_id", query_vec_col: str = "embedding",
             vec_id_col: str = "vec_id", vec_col: str = "embedding",
             k_col: str | None = None, exclude_self: bool = False,
             query_keys_col: str | None = None, vec_keys_col: str | None = None,
             query_own_col: str | None = None, vec_own_col: str | None = None,
             tol_scale: float = 1e-9, tie_decimals: int | None = None,
             ids_desc: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-``k`` vectors per query: ``(query_id, rank, vec_id, score)``.

    ``k_col`` gives a per-query k (request tables). ``exclude_self`` drops the
    vector whose id equals the query id before ranking, or whose ``vec_own_col``
    equals the query's ``query_own_col`` (bigint, say a hash of an URL). With ``query_keys_col`` and
    ``vec_keys_col`` (array<bigint> columns, or bigint for the vectors) a query is
    compared only with vectors that share one of its keys. ``tie_decimals`` ranks on
    scores rounded to that many places, so scores equal up to float noise (common
    with hashed count vectors) tie and break by ``vec_id`` (descending with
    ``ids_desc``, the order of a reversed stable ascending sort).

    A row without a vector, vectors of several dimensions and a query of another
    dimension than the index raise ``ValueError``; nothing is left out silently.
    """
    metric = metric.lower()
    if metric not in ("l2", "ip"):
        raise ValueError(f"unsupported metric: {metric}")
    spark = queries.sparkSession
    keyed = query_keys_col is not None

    def keys(df, name):
        kind = dict(df.dtypes)[name]
        return F.col(name).cast("array<bigint>") if kind.startswith("array") else F.array(F.col(name).cast("bigint"))

    q = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("vec"),
                       (F.col(k_col) if k_col else F.lit(k)).cast("int").alias("k"),
                       F.col(query_own_col or query_id_col).cast("long").alias("own"),
                       (keys(queries, query_keys_col) if keyed else F.array(F.lit(0).cast("bigint"))).alias("keys"))
    v = vectors.select(F.col(vec_id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"),
                       F.col(vec_own_col or vec_id_col).cast("long").alias("own"),
                       (keys(vectors, vec_keys_col) if keyed else F.array(F.lit(0).cast("bigint"))).alias("keys"))
    qs, vs = _sizes(q, "vec"), _sizes(v, "vec")
    kmax = q.agg(F.max("k")).first()[0] if k_col else k
    if not qs["n"] or not vs["n"] or not kmax or kmax < 1:
        return spark.createDataFrame([], RESULT_SCHEMA)
    dim, own = _dimension(vs, "vectors"), _dimension(qs, "queries")
    if dim != own:
        raise ValueError(f"query dimension {own} doesn't match index dimension {dim}")

    how = (int(kmax), metric, exclude_self, tol_scale, tie_decimals, ids_desc)
    if not keyed:
        hits = _grid_hits(q.drop("keys"), v.drop("keys"), qs["n"], vs["n"], dim, block_rows, *how)
    else:
        q, v = (rows.withColumn("key", F.explode("keys")).drop("keys") for rows in (q, v))
        hits = _keyed_hits(q, v, dim, block_rows, *how)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("vec_id").desc() if ids_desc else F.col("vec_id").asc())
    return (hits.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.col("k"))
            .select("query_id", "rank", "vec_id", "score"))


def compared_pairs(queries: DataFrame, vectors: DataFrame, query_keys_col: str, vec_keys_col: str) -> int:
    """How many pairs a keyed search compares: per key, queries times vectors."""
    def per_key(df, name, out):
        kind = dict(df.dtypes)[name]
        keys = F.explode(name) if kind.startswith("array") else F.col(name)
        return df.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias(out))
    both = per_key(queries, query_keys_col, "a").join(per_key(vectors, vec_keys_col, "b"), "key")
    return both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
