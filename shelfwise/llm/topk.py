"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors become integers (floor(64 x) of every component). The index keeps blocks of
about BLOCK vectors; in each, every posting (vector, dimension, value) has a level, the
quantised size of its value, so that the postings of a dimension at one level are a
segment. A query's components have levels too, and the quantised impact of a segment is
the sum of both levels. Segments are processed by descending impact, all those of one
impact for a whole group of queries in one pass (a product of the queries' components of
one level with the postings of another). After a pass a vector scores at most what it has
gathered plus, for each posting level, the norm of the query's components not yet met
times the norm of the vector's postings there (Cauchy-Schwarz). Exact scores of the vectors
that have gathered most give a score that k vectors surely reach, and every vector that
cannot reach it is out. Processing stops only when few are left, or all is processed;
those are then scored exactly in integers.

Plan: a grid of tasks (see ``operators.knn.grid``): queries are dealt to its rows and index
blocks to its columns, so a query is sent once per column and a block once per row, not
once per group of queries. A task keeps its blocks and streams its queries past them;
what earlier blocks hold bounds the later ones; it hands on k rows a query, and a window
over the query picks the best. Neither side passes through the driver.

Defined cases: a vector that is null, empty or holds a null or non-finite component
takes no part, nor does a null vec_id; repeated rows (equal id and vector) count
once; rows with a query's id are its own and no candidates; vectors of another
dimension are no candidates; ties go to the smaller vec_id; fewer than k candidates:
all of them; an empty table gives an empty result; other columns are ignored. Large
components are scored in integers of any width; codes are cut at 2^62 (components at
2^56) and scores shown are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.knn import grid
from .common import written

BLOCK, QUERY_BLOCK = 4_096, 256
SCALE = 64
LEVELS = 3                   # of postings and of a query's components, by size
FIRST_LOOK = 2               # impact after which bounds are looked at
LARGEST_CODE = 1 << 62
LEADERS = 2                  # times k vectors are scored exactly to find a floor
BLOCKS_KEPT = 16             # index blocks a task keeps, about


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, codes (array<bigint>), dim of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite)
    limit = F.lit(LARGEST_CODE).cast("bigint")

    def code(x):
        scaled = x.cast("double") * scale
        return (F.when(scaled >= float(LARGEST_CODE), limit).when(scaled <= -float(LARGEST_CODE), -limit)
                .otherwise(F.floor(scaled).cast("bigint")))
    return rows.select("vec_id", F.transform("embedding", code).alias("codes"), F.size("embedding").alias("dim")).distinct()


def _levels(sizes: np.ndarray, edges: list[float]) -> np.ndarray:
    """0 for the largest: how many of the (falling) edges a size lies under."""
    return sum((sizes < e).astype(np.uint8) for e in edges)


class Block:
    """One block of the index: ids, codes and the levels of its postings."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, levels: np.ndarray):
        self.ids, self.codes = ids, codes
        self.largest = max(abs(int(codes.min(initial=0))), abs(int(codes.max(initial=0))))
        self.levels = levels
        self.kind, self.postings = None, []
        parts = [np.where(levels == b, codes, 0).astype(np.float64) for b in range(LEVELS)]
        self.norms = np.stack([np.sqrt(np.einsum("ij,ij->i", p, p)) for p in parts], axis=1) * (1 + 1e-9)
        self.passes = self.survivors = 0  # of all queries, for tests and tuning

    @classmethod
    def build(cls, ids: np.ndarray, codes: np.ndarray) -> Block:
        by_id = np.argsort(ids, kind="stable")
        codes = codes[by_id]
        sizes = np.abs(codes.astype(np.float64))
        edges = [float(np.quantile(sizes, 1 - i / LEVELS)) for i in range(1, LEVELS)] if sizes.size else [0.0] * (LEVELS - 1)
        return cls(ids[by_id], codes, _levels(sizes, edges))

    def _as(self, kind) -> list[np.ndarray]:
        """Per level the postings of all dimensions, other places zero."""
        if self.kind != kind:
            self.kind = kind
            self.postings = [np.ascontiguousarray(np.where(self.levels == b, self.codes, 0).astype(kind).T) for b in range(LEVELS)]
        return self.postings

    def exact(self, slots: np.ndarray, queries: np.ndarray, wide: bool) -> np.ndarray:
        """Scores of vector ``slots[i]`` and query row i, in integers."""
        if wide:
            return (self.codes[slots].astype(object) * queries.astype(object)).sum(axis=1)
        out = np.empty(len(slots), np.int64)
        for a in range(0, len(slots), 1 << 16):
            part = slice(a, a + (1 << 16))
            out[part] = np.einsum("ij,ij->i", self.codes[slots[part]].astype(np.int64), queries[part])
        return out

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        """(query row, id, score) of all that may be among the k best of their query, with none
        of the rows of id ``own``, nor those that score below the query's ``floor``, which k
        others are known to reach."""
        n, dim = self.codes.shape
        m = len(queries)
        reach = max(self.largest, 1) * max(int(np.abs(queries.astype(np.float64)).max(initial=0)), 1) * dim
        wide = reach >= 1 << 62
        noise = 0.5 if reach < 1 << 52 else reach * 2.0 ** -45  # float error of a sum; scores are integers
        kind = np.float32 if reach < 1 << 24 else np.float64
        postings = self._as(kind)
        q = queries.astype(np.float64)
        sizes = np.abs(q)
        ranked = np.sort(sizes, axis=1)[:, ::-1]
        edges = [ranked[:, [min(dim * i // LEVELS, dim - 1)]] for i in range(1, LEVELS)]
        levels = _levels(sizes, [np.nextafter(e, np.inf) for e in edges])
        floor = np.full(m, -np.inf) if floor is None else floor.astype(np.float64)
        mine = [np.searchsorted(self.ids, own, side) for side in ("left", "right")]
        others = n - (mine[1] - mine[0])

        left = np.arange(m)          # queries not yet ended
        gathered = np.zeros((m, n), kind)
        out = []
        for impact in range(2 * LEVELS - 1):
            last = impact == 2 * LEVELS - 2
            for b in range(LEVELS):
                if 0 <= impact - b < LEVELS:
                    gathered += np.where(levels[left] == impact - b, q[left], 0).astype(kind) @ postings[b]
            self.passes += len(left)
            if impact < FIRST_LOOK and not last:
                continue
            if impact == FIRST_LOOK:
                for row, (a, z) in enumerate(zip(mine[0][left], mine[1][left], strict=True)):
                    gathered[row, a:z] = -np.inf
            some = min(LEADERS * k, n)
            ahead = np.argpartition(gathered, n - some, axis=1)[:, n - some:] if some < n else np.tile(np.arange(n), (len(left), 1))
            scored = self.exact(ahead.ravel(), np.repeat(queries[left], some, axis=0), wide).astype(np.float64).reshape(len(left), some)
            scored[~np.isfinite(np.take_along_axis(gathered, ahead, axis=1))] = -np.inf
            if some >= k:
                floor[left] = np.maximum(floor[left], np.where(others[left] >= k, np.partition(scored, some - k, axis=1)[:, some - k], -np.inf))
            unmet = np.stack([np.sqrt(np.where(levels[left] > impact - b, q[left] ** 2, 0).sum(axis=1)) for b in range(LEVELS)], axis=1)
            most = gathered + (unmet @ self.norms.T) * (1 + 1e-9)
            alive = (most >= (floor[left] - noise)[:, None]) & np.isfinite(gathered)
            count = alive.sum(axis=1)
            end = np.ones(len(left), bool) if last else count <= max(LEADERS * k, n // 16)
            row, slot = np.nonzero(alive & end[:, None])
            self.survivors += len(row)
            out.append((left[row], self.ids[slot], self.exact(slot, queries[left[row]], wide)))
            left, gathered = left[~end], gathered[~end]
            if not len(left):
                break
        row, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return _best(row, ids, scores, k)


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of every query row, by score, then id."""
    order = np.lexsort((ids, -scores, row)) if scores.dtype != object else np.array(
        sorted(range(len(row)), key=lambda i: (row[i], -scores[i], ids[i])), np.int64)
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = rank < k
    return row[keep], ids[keep], scores[keep]


def _type(codes: np.ndarray) -> np.dtype:
    return np.dtype(np.int16 if codes.size and np.abs(codes).max() < 1 << 15 else np.int64)


_INDEX = "dim int, block int, blocks int, n bigint, width int, ids binary, codes binary, levels binary"


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """dim, block, blocks and vectors of that dimension, and the block's arrays as binary columns."""
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    placed = vectors.join(sizes, "dim").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "codes"), F.col("blocks")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack(pdf["codes"].to_list()).astype(np.int64)
        b = Block.build(pdf["vec_id"].to_numpy(np.int64), codes.astype(_type(codes)))
        return pd.DataFrame({
            "dim": [codes.shape[1]], "block": [pdf["block"].iloc[0]], "blocks": [pdf["blocks"].iloc[0]], "n": [pdf["n"].iloc[0]],
            "width": [b.codes.dtype.itemsize], "ids": [b.ids.tobytes()], "codes": [b.codes.tobytes()],
            "levels": [b.levels.tobytes()]})
    return written(placed.groupBy("dim", "block").applyInPandas(pack, _INDEX), "impact-index")


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, index blocks before groups of queries."""
    cell, blocks = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
            dim = value("dim")
            if (dim, value("cell")) != cell:
                cell, blocks = (dim, value("cell")), []
            ids = np.frombuffer(value("ids"), np.int64)
            codes = np.frombuffer(value("codes"), np.dtype(f"<i{value('width')}")).reshape(-1, dim)
            if value("side") == 0:
                blocks.append(Block(ids, codes, np.frombuffer(value("levels"), np.uint8).reshape(-1, dim)))
                continue
            best, floor = None, np.full(len(ids), -np.inf)
            for b in blocks:
                found = b.top(ids, codes, k, floor)
                if best is not None:
                    found = _best(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
                best = found
                held = np.bincount(best[0], minlength=len(ids))
                full = np.flatnonzero(held >= k)
                floor[full] = best[2][(np.cumsum(held) - 1)[full]].astype(np.float64)  # the k-th score
            if best is None:
                continue
            row, found, scores = best
            if scores.dtype == object:
                scores = np.array([max(min(x, (1 << 63) - 1), -(1 << 63)) for x in scores], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (vec_id, codes, dim)."""
    spark = queries.sparkSession
    n_queries = queries.count()
    dims = index.groupBy("dim").agg(F.first("blocks").alias("blocks"), F.first("n").alias("n"))
    largest = dims.orderBy(F.col("n").desc(), "dim").first()
    if not n_queries or largest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    gq, gv = grid(n_queries, largest["n"], largest["dim"], spark.sparkContext.defaultParallelism)
    gv = max(1, min(max(gv, -(-largest["blocks"] // BLOCKS_KEPT)), largest["blocks"]))
    groups = max(gq, -(-n_queries // QUERY_BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack(pdf["codes"].to_list()).astype(np.int64)
        return pd.DataFrame({"dim": [codes.shape[1]], "group": [pdf["group"].iloc[0]],
                             "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()]})
    asked = (queries.withColumn("group", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(groups)).cast("int"))
             .groupBy("dim", "group").applyInPandas(pack, "dim int, group int, ids binary, codes binary"))
    columns = ["dim", "cell", "side", "width", "ids", "codes", "levels"]
    cell = lambda i, j: (i * gv + j).cast("int").alias("cell")
    rows = (index.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(gq - 1))))
            .select("dim", cell(F.col("i"), F.pmod("block", F.lit(gv))), F.lit(0).alias("side"), "width", "ids", "codes", "levels"))
    rows = rows.unionByName(
        asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(gv - 1))))
        .select("dim", cell(F.pmod("group", F.lit(gq)), F.col("j")), F.lit(1).alias("side"), F.lit(8).alias("width"), "ids", "codes",
                F.lit(None).cast("binary").alias("levels"))).select(*columns)
    cells = rows.repartition(gq * gv, "dim", "cell").sortWithinPartitions("dim", "cell", "side")
    found = cells.mapInArrow(lambda it: _search(it, k), "query_id bigint, vec_id bigint, score bigint").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best for every row whose vec_id is divisible by ``every``."""
    rows = written(integers(vectors), "integer-vectors")
    return search(rows.filter(F.col("vec_id") % every == 0), build_index(rows), k)
