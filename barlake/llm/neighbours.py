"""Nearest neighbours by a permutation index: vectors as the order in which they see a few pivots.

Nearness is the inner product.  A vector gets one more component, sqrt(m^2 -
|x|^2) with m the longest norm, and a query a zero there: the inner product
with a query is the same, all vectors are equally long, and near in angle means
near in inner product.  A vector's permutation is the order of its ``PREFIX``
nearest pivots.

The index is written as inverted files: a shard holds, for every pivot, where
each of its vectors has that pivot in its permutation.  A query adds up, over
the lists of its own pivots, how far the places agree: with absent pivots
placed last, the footrule distance is k (k + 1) less twice the sum of min(k -
r, k - s) over shared pivots, so the largest sums are the least distances.  The
nearest by footrule are then ranked by the inner product of the original
vectors.

Every shard meets the query set in blocks that it reads from the shared folder:
no pairs are shuffled, and only a shard's best ``k`` rows a query leave it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SharedFile, new_folder

#: Pivots: this many vectors, those with the least hash of their id and components.
PIVOTS = 128
#: Places of a permutation that are kept; at most 255, so that a place is a byte.
PREFIX = 64
#: Vectors that are ranked by inner product: this share of all, and at least ``LEAST`` of them.
SHARE, LEAST = 0.2, 4000
#: Vectors of a shard, and queries of a block.
SHARD, BLOCK = 8192, 1024


def usable(vectors: DataFrame, key: str, vector: str, dimension: int | None = None) -> DataFrame:
    """(id, x) of the rows that take part: with an id, of one length, finite, not zero."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & fine)
    return rows if dimension is None else rows.where(F.size("x") == dimension)


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def _unit(rows: np.ndarray) -> np.ndarray:
    long = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(long > 0, long, 1.0)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors in the space with one more component, in which all are equally long."""
    with np.errstate(over="ignore"):
        y = x / longest
        rest = np.maximum(0.0, 1.0 - (y * y).sum(1))
    return np.concatenate([y, np.sqrt(rest)[:, None]], 1)


def _permutations(y: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The nearest k pivots of each row in order, ties to the smaller pivot."""
    return np.argsort(-(y @ pivots.T), axis=1, kind="stable")[:, :k]


def _matrix(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False), flat.reshape(-1, dimension)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query, its own row left out.

    Queries are the rows for which ``is_query`` (of the columns of ``vectors``)
    holds.  Rows without id or vector, with null, non-finite or only zero
    components, or of another length than most rows (ties to the shorter), take
    no part.  Rows with the id of a query are its own; of queries with one id
    the one with the least vector is asked.  Copies are rows like others, and
    of equally near ones those with smaller ids are found, whatever their
    number: both rankings break ties by id.  If fewer than k rows can be found,
    all of them are.  An empty table gives none.
    """
    spark = vectors.sparkSession
    shape = usable(vectors, key, vector).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(_norm(F.col("x"))).alias("longest"))
    shape = shape.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, n, longest = shape["d"], shape["n"], shape["longest"]
    rows = usable(vectors, key, vector, dimension)
    pivots = rows.orderBy(F.xxhash64("id", "x"), "id").limit(PIVOTS).select("x").collect()  # PIVOTS rows
    pivots = _unit(_lifted(np.array([r["x"] for r in pivots]), longest))
    prefix = min(PREFIX, len(pivots))
    asked = usable(vectors.where(is_query), key, vector, dimension).groupBy("id").agg(F.min("x").alias("x"))
    folder = new_folder(spark, "query-blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks as files: ids, vectors, permutations; gives their names."""
        for ids, x in _slabs(batches, dimension, BLOCK):
            flat = np.concatenate([_unit(x), np.zeros((len(x), 1))], 1)
            data = io.BytesIO()
            np.savez(data, ids=ids, x=x, order=_permutations(flat, pivots, prefix))
            name = f"{folder}/{ids.min()}-{ids.max()}-{len(ids)}.npz"
            file = SharedFile(name)
            file.write(data.getvalue())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    blocks = sorted(r["name"] for r in asked.mapInArrow(write, "name string").collect())  # a name for BLOCK queries

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slabs(batches, dimension, SHARD):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            seen = _permutations(_lifted(x, longest), pivots, prefix)
            files = np.zeros((len(pivots), len(ids)), np.uint8)  # a pivot's list: prefix less place, 0 where it's absent
            files[seen.T, np.arange(len(ids))] = (prefix - np.arange(prefix, dtype=np.int64)).astype(np.uint8)[:, None]
            part = max(share * n, least) * len(ids) / n
            wanted = min(len(ids), int(np.ceil(part + 3 * np.sqrt(part))) + k)
            for name in blocks:
                yield from _answers(name, ids, x, files, prefix, wanted, k)

    shards = max(1, -(-n // SHARD))
    found = rows.repartition(shards, "id").mapInArrow(search, schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _slabs(batches: Iterator[pa.RecordBatch], dimension: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of consecutive rows, ``most`` at once, the rest at the end."""
    ids, xs, held = [], [], 0
    for batch in batches:
        a, x = _matrix(batch, dimension)
        while len(a):
            take = most - held
            ids.append(a[:take])
            xs.append(x[:take])
            held, a, x = held + len(ids[-1]), a[take:], x[take:]
            if held == most:
                yield np.concatenate(ids), np.concatenate(xs)
                ids, xs, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(xs)


def _answers(name: str, ids: np.ndarray, x: np.ndarray, files: np.ndarray, prefix: int, wanted: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of a shard for each query of a block."""
    fs, path = pa.fs.FileSystem.from_uri(name)
    with fs.open_input_stream(path) as f:
        block = np.load(io.BytesIO(f.read()))
    weight = (prefix - np.arange(prefix)).astype(np.uint8)
    back = np.arange(len(ids), dtype=np.int64)
    query, vec, score = [], [], []
    for q, y, order in zip(block["ids"].tolist(), block["x"], block["order"], strict=True):
        total = np.zeros(len(ids), np.uint16)
        for pivot, w in zip(order, weight, strict=True):
            total += np.minimum(files[pivot], w)
        rank = total.astype(np.int64) * len(ids) - back  # ties to the smaller id
        own = ids == q
        rank[own] = np.iinfo(np.int64).min
        near = np.argpartition(rank, len(ids) - wanted)[len(ids) - wanted :]
        near = near[~own[near]]
        products = (x[near] * y).sum(1)  # row by row: equal vectors get equal scores
        best = _best(products, ids[near], k)
        query.append(np.full(len(best), q))
        vec.append(ids[near][best])
        score.append(products[best])
    if query:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (query, vec, score)], ["query_id", "vec_id", "score"])


def recall(found: DataFrame, vectors: DataFrame, queries: list[int], k: int = 20, *, key: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the exact k nearest rows of some queries (a bounded list) that ``found`` has; brute force over all rows."""
    rows = usable(vectors, key, vector)
    asked = {r["id"]: r["x"] for r in rows.where(F.col("id").isin(queries)).collect()}
    exact = None
    for q, y in asked.items():
        product = F.aggregate(F.zip_with("x", F.array(*map(F.lit, y)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        one = rows.where(F.col("id") != q).select(F.lit(q).alias("query_id"), F.col("id").alias("vec_id"), product.alias("_s")).orderBy(F.desc("_s"), "vec_id").limit(k)
        exact = one if exact is None else exact.unionByName(one)
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]
