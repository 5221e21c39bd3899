"""Exact top-k inner products of quantised vectors (operator 5).

Vectors are packed into shards and query blocks. Each tile, one block against one shard, is a matrix product
followed by a partial selection; the tiles' top lists are merged by query in a tree of bounded fan-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.common import small_batches

LONG = 2**63 - 1
FAN = 64


def usable(vec: str):
    """Whether a vector takes part: not null, no null and no non-finite component."""
    return F.col(vec).isNotNull() & ~F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _pack(most: int, scale: int):
    """Rows of ``(id, vector)`` to blocks of at most ``most`` bytes of vectors of equal length: ids ascending, components ``floor(scale * x)``."""

    def run(batches):
        held: dict[int, list] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            got = held.pop(dim)
            ids = np.array([g[0] for g in got], np.int64)
            x = np.floor(scale * np.array([g[1] for g in got], np.float64).reshape(len(got), dim))
            order = np.argsort(ids, kind="stable")
            made += 1
            number = (TaskContext.get().partitionId() << 24) + made
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([x[order].tobytes()])], ["block", "dim", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if 8 * len(v) * (len(mine) + 1) > most:
                    yield block(len(v))
        for dim in sorted(held):
            yield block(dim)

    return run


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold every sum, else in whole numbers, held within a BIGINT."""
    most = (float(np.abs(q).max(initial=0)) + 1) * (float(np.abs(c).max(initial=0)) + 1) * (q.shape[1] + 1)
    if most < 2.0**53:
        return q @ c.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG)


def best_of(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of each query's ``k`` best, ties to the smaller id; a query's own id doesn't count. ``ids`` ascend."""
    own = query_ids[:, None] == ids[None, :]
    if scores.shape[1] > k + int(own.sum(axis=1).max(initial=0)):
        ranked = scores.astype(np.float64) if scores.dtype == object else scores
        ranked = np.where(own, -np.inf, ranked)
        least = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, -k]
        rows, cols = np.nonzero(~own & (ranked >= least[:, None]))
    else:
        rows, cols = np.nonzero(~own)
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda z: (rows[z], -scores[rows[z], cols[z]], cols[z])), np.int64)
    else:
        order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_bytes: int = 1 << 20, block_bytes: int = 1 << 18, group_shards: int = 16) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best among the vectors with another id.

    Components count as ``floor(scale * x)`` in whole numbers. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; vectors meet only those of their own length. Equal scores
    rank by the smaller id. Repeated rows are candidates of their own. Empty tables give no rows, other columns
    are not read. Sums beyond a BIGINT are held at its ends. A tile is one block of queries, of ``block_bytes``,
    against one shard, of ``shard_bytes``, however long the vectors are (one vector at least).
    """
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v") & F.col("id").isNotNull())
    schema = "block bigint, dim int, ids binary, data binary"
    small_batches(vectors.sparkSession)
    shards = pick(vectors).mapInArrow(_pack(shard_bytes, scale), schema)
    blocks = pick(queries).mapInArrow(_pack(block_bytes, scale), schema)
    held = pick(vectors).agg(F.coalesce(F.sum(8 * F.size("v").cast("bigint")), F.lit(0))).first()[0]
    n_shards = max(1, -(-held // shard_bytes))
    groups = max(1, -(-n_shards // group_shards))
    left = shards.select("dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), "block", "ids", "data")
    right = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    tiles = left.join(right, ["dim", "g"]).select("block", "dim", "ids", "data", "q_ids", "q_data")

    def tile(batches):
        for b in batches:
            for at in range(b.num_rows):
                number, dim, ids, data, q_ids, q_data = (b.column(c)[at].as_py() for c in range(6))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                c, q = np.frombuffer(data).reshape(len(ids), dim), np.frombuffer(q_data).reshape(len(q_ids), dim)
                s = inner(q, c)
                rows, cols = best_of(s, q_ids, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids[cols]), pa.array(s[rows, cols].astype(np.int64)), pa.array(np.full(len(rows), number, np.int64))], ["query_id", "vec_id", "score", "part"])

    found = tiles.mapInArrow(tile, "query_id bigint, vec_id bigint, score bigint, part bigint")
    levels = 1
    while FAN**levels < n_shards:
        levels += 1
    found = found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(FAN**levels)))
    for _ in range(levels):
        found = found.withColumn("part", F.floor(F.col("part") / FAN))
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
