"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into tiles: a row holds up to a fixed number of vectors as one matrix. Each pair of a
query tile and a candidate tile is one row of work: a matrix product, then a partial selection of k per query. The lists
of a query's tiles are merged in a tree of GROUP children a node, as deep as the number of tiles needs. Matrices travel in
the narrowest whole type that holds their values. No task holds more than two
tiles and a strip of their product; pairs are spread evenly whatever the vectors are, as no key of theirs is used.

Scores are exact: whole numbers are multiplied in double precision where the largest possible sum is below 2**53, and as
Python integers otherwise (scores beyond 64 bits are held at the ends of the range).

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id; a
row repeated exactly counts once; rows of one id are each other's own and never match; vectors of another length than
the query's are no candidates; equal scores go to the smaller id; fewer candidates than k give shorter lists; an empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

#: Vectors a tile, for queries and candidates, and query rows multiplied at once.
QUERY_TILE, TILE, STRIP = 2048, 8192, 128
#: Lists of a query that one merge takes.
GROUP = 64
_TILES = "dim int, ids binary, width int, matrix binary"


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the narrowest whole type that holds its values."""
    for kind in (np.int8, np.int16, np.int32):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            return matrix.astype(kind)
    return matrix


def _pack(rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            matrix = _narrow(np.array(vectors, np.int64).reshape(len(ids), dim)[order])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64)[order].tobytes()], "width": pa.array([matrix.itemsize], pa.int32()), "matrix": [matrix.tobytes()]})

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(key)
                vectors.append(vector)
                if len(ids) == rows:
                    yield tile(len(vector))
        for dim in list(held):
            yield tile(dim)

    return task


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores) of each query's k best rows of a tile whose ids ascend."""
    dim = max(queries.shape[1], 1)
    top = max(1, max((int(abs(int(f(x)))) for x in (queries, matrix) if x.size for f in (np.max, np.min)), default=1))
    exact = dim * top * top < 1 << 53
    right = matrix.T.astype(np.float64) if exact else matrix.T.astype(object)
    for start in range(0, len(queries), STRIP):
        own = query_ids[start : start + STRIP]
        left = queries[start : start + STRIP]
        scores = left.astype(np.float64) @ right if exact else np.clip(left.astype(object) @ right, -(2**63), 2**63 - 1)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for row in np.flatnonzero(first < last):
            scores[row, first[row] : last[row]] = -np.inf if exact else -(2**70)
        n = min(k, scores.shape[1])
        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        rows, columns = np.nonzero((scores >= least[:, None]) & (scores > (-np.inf if exact else -(2**69))))
        values = scores[rows, columns]
        order = np.lexsort((columns, -values, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < n
        yield own[rows[keep]], ids[columns[keep]], values[keep].astype(np.int64)


def _search(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q_ids, ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                queries = np.frombuffer(x["q_matrix"], f"i{x['q_width']}").reshape(len(q_ids), x["dim"])
                matrix = np.frombuffer(x["matrix"], f"i{x['width']}").reshape(len(ids), x["dim"])
                for q, v, s in best_of_tile(q_ids, queries, ids, matrix, k):
                    group = np.full(len(q), x["tile"], np.int64)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array(s), "part": pa.array(group)})

    return task


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key's lists, one merge of the tree."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k rows with the largest inner products, for every row of vectors
    where is_query holds (an expression over `vec_id`). Components become floor(scale * x)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()
    rows = workspace.materialize(rows, "vectors")

    def tiles(part: DataFrame, size: int, name: str) -> DataFrame:
        # consecutive numbers of the tiles: their count, and so this table without the matrices, is N / size
        packed = workspace.materialize(part.mapInArrow(_pack(size), _TILES).withColumn("key", F.monotonically_increasing_id()), name)
        number = packed.select("key", (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("tile"))
        return workspace.materialize(packed.join(number, "key").drop("key"), name)

    queries = tiles(rows.where(is_query), QUERY_TILE, "query-tiles").select("dim", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("matrix").alias("q_matrix"), F.col("tile").alias("q_tile"))
    shards = tiles(rows, TILE, "tiles")
    n_queries, n_shards = queries.count(), shards.count()
    if not n_queries or not n_shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    left = queries.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    right = shards.withColumn("q_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    pairs = left.join(right, ["q_tile", "tile", "dim"])
    lists = pairs.select("dim", "q_ids", "q_width", "q_matrix", "ids", "width", "matrix", "tile").mapInArrow(_search(k), "query_id long, vec_id long, score long, part long")
    while n_shards > GROUP:
        lists, n_shards = _merge(lists.withColumn("part", F.expr(f"part div {GROUP}")), ["query_id", "part"], k).drop("rank"), -(-n_shards // GROUP)
    return _merge(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
