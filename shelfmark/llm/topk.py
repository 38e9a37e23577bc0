"""Exact top-k search by inner product: tiled matrix products and merged top lists.

Vectors are packed into shards and queries into blocks, each one binary row. Every (block, shard)
tile is one matrix product that leaves k rows per query; the partial lists merge in two levels, so
no task ever sees more than the lists of a few tiles for a query.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows without id. Only vectors of one length are compared. Ties go to the smaller id. A query never
finds its own id. If an id is repeated, every row of it is a candidate; as query its smallest
vector counts. Scores outside 64 bits are held at the end of their range. Empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import checkpointed

#: Components of one shard and of one query block: bounds the memory of a tile.
SHARD_VALUES = 1 << 20
BLOCK_VALUES = 1 << 16
#: Partial lists that meet in one first-level merge.
MERGE_FAN_IN = 32

_LONG = 2 ** 63


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, computed in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"))


def finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _packed(df: DataFrame, part: Column) -> DataFrame:
    """One row per part: ids and components, both as binary."""
    def pack(key, rows):
        rows = rows.sort_by("id")
        dim = key[0].as_py()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([rows.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "matrix": pa.array([flat.astype("<f8").tobytes()], pa.binary())})
    # Kept in the shared folder: two Python passes in one stage could block each other.
    return checkpointed(df.withColumn("part", part).groupBy("dim", "part")
                        .applyInArrow(pack, "dim int, part long, ids binary, matrix binary"))


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum fits 53 bits, else in big ints."""
    dim = queries.shape[1]
    bound = dim * float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0))
    if bound < 2 ** 53:
        return (queries @ shard.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], dtype=object).reshape(len(queries), dim)
    other = np.array([[int(x) for x in row] for row in shard], dtype=object).reshape(len(shard), dim)
    full = whole.dot(other.T)
    return np.vectorize(lambda s: max(-_LONG, min(_LONG - 1, int(s))), otypes=[np.int64])(full)


def best(row: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ids ascend, so the first of equal scores wins."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = row[at]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > edge]
        at = np.concatenate([above, at[s == edge][:k - len(above)]])
    return at[np.lexsort((ids[at], -row[at].astype(object) if row.min(initial=0) == -_LONG else -row[at]))]


def _tiles(k: int):
    def run(batches):
        for batch in batches:
            for dim, qids, qm, ids, m in zip(*(c.to_pylist() for c in batch.columns)):
                qids, ids = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                q = np.frombuffer(qm, "<f8").reshape(len(qids), dim)
                s = np.frombuffer(m, "<f8").reshape(len(ids), dim)
                product = scores(q, s)
                picked = [best(product[n], ids, ids != qid, k) for n, qid in enumerate(qids)]
                size = [len(p) for p in picked]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(qids, size)), pa.array(np.concatenate([ids[p] for p in picked])),
                    pa.array(np.concatenate([product[n][p] for n, p in enumerate(picked)]))],
                    ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id: str = "vec_id",
          vector: str = "embedding", factor: int = 1024, shard_values: int = SHARD_VALUES,
          block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row."""
    rows = (vectors.select(vectors[id].cast("long").alias("id"), is_query.alias("q"),
                           vectors[vector].alias("raw"))
            .where(F.col("id").isNotNull() & finite(F.col("raw")))
            .select("id", "q", scaled(F.col("raw"), factor).alias("vector"),
                    F.size("raw").cast("int").alias("dim")))
    asked = (rows.where("q").groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("v"))
             .select("id", "v.dim", "v.vector"))
    values, asked_values = (df.agg(F.coalesce(F.sum(F.greatest("dim", F.lit(1))), F.lit(0))).head()[0]
                            for df in (rows, asked))
    shards = max(1, -(-values // shard_values))
    blocks = max(1, -(-asked_values // block_values))
    shard = _packed(rows.select("id", "dim", "vector"), F.pmod(F.xxhash64("id"), F.lit(shards)))
    block = _packed(asked, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    # Each block meets each shard: the blocks are repeated, once per shard, and joined on its number.
    tiles = (block.select("dim", F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"),
                          F.explode(F.sequence(*(F.lit(n).cast("long") for n in (0, shards - 1)))).alias("part"))
             .join(shard, ["dim", "part"])
             .select("dim", "qids", "qmatrix", "ids", "matrix"))
    lists = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    groups = -(-shards // MERGE_FAN_IN)
    if groups > 1:
        near = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).orderBy(*order)
        lists = lists.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).drop("n")
    return (lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
