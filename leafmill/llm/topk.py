"""Exact top-k search by inner product, without random access.

Every component has a sorted list of a block's values. Lists are read in step from the
end that the query's sign asks for. A vector's score then has a lower bound (what was read,
and the list's worst value for the rest) and an upper bound (what was read, and the value
read last). A query is done reading when at most ``OPEN`` times k vectors can still qualify,
and the others read on; the scores of those vectors are resolved exactly, as whole numbers.

Blocks of candidates stay where they are read. The query set is taken in blocks of bounded
size, one after the other: a block is broadcast, every task keeps k rows for each of its queries,
the tasks' rows are merged and written, and the broadcast is dropped.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, batch, shared_table
from leafmill.session import new_dir

#: Vectors that may stay open for each wanted one; queries whose bounds are held at once.
OPEN, TOGETHER = 16, 256

_WHOLE = {"row": pa.int64(), "id": pa.int64(), "dim": pa.int32(), "x": pa.binary()}
_HITS = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _finite(batches: Batches):
    """Vectors as doubles; those with a null or non-finite component take no part."""
    part, n = TaskContext.get().partitionId() << 33, 0
    for rows in batches:
        out: dict[str, list] = {name: [] for name in _WHOLE}
        lists = rows.column("x")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
        ids, at = rows.column("id").to_pylist(), 0
        for i, size in enumerate(sizes.tolist()):
            if size != size:  # a null vector
                continue
            x = values[at : at + int(size)]
            at += int(size)
            if ids[i] is not None and np.isfinite(x).all():
                for name, value in zip(_WHOLE, (part + n + i, ids[i], int(size), x.tobytes()), strict=True):
                    out[name].append(value)
        n += rows.num_rows
        yield batch(out, _WHOLE)


def survivors(block: np.ndarray, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the best k, by bounds from the sorted lists.

    ``own``: for each query its own place in the block, or -1; ``known``: a score that k
    vectors are known to reach, or minus infinity.
    """
    n = len(block)
    order = np.argsort(block, axis=0, kind="stable")
    values = np.take_along_axis(block, order, 0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    reading, found = np.arange(len(queries)), []
    depth = max(1, n // 8)
    while len(reading):
        up, down = np.maximum(queries[reading], 0).T, np.minimum(queries[reading], 0).T
        high, low = rank >= n - depth, rank < depth  # what was read from either end
        upper = np.where(high, block, values[n - depth]) @ up + np.where(low, block, values[depth - 1]) @ down
        lower = np.where(high, block, values[0]) @ up + np.where(low, block, values[-1]) @ down
        open_ = qualify(lower, upper, own[reading], known[reading], k)
        done = (open_.sum(0) <= OPEN * k) | (depth == n)
        vector, query = np.nonzero(open_[:, done])
        found.append((reading[done][query], vector))
        reading, depth = reading[~done], min(n, depth * 2)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def qualify(lower: np.ndarray, upper: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Which vectors (rows) no k others surely beat, for each query (column), itself left out."""
    n, mine = len(lower), np.flatnonzero(own >= 0)
    lower[own[mine], mine] = -np.inf
    reached = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(lower.shape[1], -np.inf)
    open_ = upper >= np.maximum(reached, known)
    open_[own[mine], mine] = False
    return open_


def near_survivors(block: np.ndarray, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for numbers whose products doubles don't hold: bounds are the rounded scores with
    all that rounding may have changed; beyond the range of doubles, nothing is known."""
    with np.errstate(all="ignore"):
        about = block @ queries.T
        slack = (np.abs(block) @ np.abs(queries).T) * (block.shape[1] + 4) * 2.0**-51
        lower, upper = (np.clip(x, -(2.0**63), 2.0**63) for x in (about - slack, about + slack))  # as the scores are
    lost = ~(np.isfinite(about) & np.isfinite(slack))
    lower[lost], upper[lost] = -np.inf, np.inf
    vector, query = np.nonzero(qualify(lower, upper, own, known, k))
    return query, vector


def whole(x: float, scale: float) -> int:
    """``floor(scale * x)``, also where the product is beyond the range of doubles."""
    product = scale * x
    return int(np.floor(product)) if np.isfinite(product) else int(x) * int(scale)


def best(block: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, known: np.ndarray, k: int, scale: float):
    """The best k of a block for each query: arrays query, id, score."""
    place = {r: i for i, r in enumerate(rows.tolist())}
    own = np.array([place.get(r, -1) for r in query_rows.tolist()], np.int64)
    found = []
    with np.errstate(over="ignore"):
        large_block, large_queries = np.floor(scale * block), np.floor(scale * queries)
        most = np.abs(large_block).max(initial=0) * np.abs(large_queries).max(initial=0) * max(1, block.shape[1])
    exact = most < 2.0**52
    for low in range(0, len(queries), TOGETHER):
        part = slice(low, low + TOGETHER)
        if not block.shape[1]:  # every score is 0
            query, vector = (a.ravel() for a in np.indices((len(queries[part]), len(block))))
            query, vector = (a[own[part][query] != vector] for a in (query, vector))
        else:
            near = survivors if exact else near_survivors
            query, vector = near(large_block, large_queries[part], own[part], known[part], k)
        scores = np.empty(len(query), np.int64)
        for a in range(0, len(query), 1 << 16):
            q, v = query[a : a + (1 << 16)] + low, vector[a : a + (1 << 16)]
            if exact:
                scores[a : a + (1 << 16)] = (large_queries[q].astype(np.int64) * large_block[v].astype(np.int64)).sum(1)
            else:
                sums = [sum(whole(s, scale) * whole(t, scale) for s, t in zip(b, c, strict=True)) for b, c in zip(queries[q].tolist(), block[v].tolist())]
                scores[a : a + (1 << 16)] = [max(-(2**63), min(2**63 - 1, x)) for x in sums]
        found.append(highest(query + low, ids[vector], scores, k))
    return tuple(np.concatenate(x) for x in zip(*found))


def highest(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller id (whole numbers throughout)."""
    order = np.lexsort((ids, ~scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], ids[top], scores[top]


def _search(batches: Batches, queries, k: int, block_rows: int, scale: float):
    sets: dict[int, tuple[np.ndarray, ...]] = {}
    rows, ids, dims, data = queries.value
    for dim in set(dims.tolist()):
        has = np.flatnonzero(dims == dim)
        x = np.frombuffer(b"".join(data[i] for i in has.tolist()), float).reshape(len(has), dim)
        none = np.full((len(has), 0), 0, np.int64)
        sets[dim] = (rows[has], ids[has], x, none)
    best_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def run(dim: int, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held)
        query_rows, _, x, _ = sets[dim]
        vectors = np.frombuffer(b"".join(table.column("x").to_pylist()), float).reshape(table.num_rows, dim)
        known = np.full(len(x), -np.inf)
        if dim in best_of:
            q, i, s = best_of[dim]
            counts = np.bincount(q, minlength=len(x))
            np.minimum.at(low := np.full(len(x), np.inf), q, s.astype(float))
            known = np.where(counts >= k, low, -np.inf)
        new = best(vectors, table.column("id").to_numpy(), table.column("row").to_numpy(), x, query_rows, known, k, scale)
        if dim in best_of:
            new = highest(*(np.concatenate(pair) for pair in zip(best_of[dim], new, strict=True)), k)
        best_of[dim] = new

    held: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        of = b.column("dim").to_numpy()
        for dim in set(of.tolist()) & set(sets):
            held.setdefault(dim, []).append(b.filter(pa.array(of == dim)))
            if sum(x.num_rows for x in held[dim]) >= block_rows:
                run(dim, held.pop(dim))
    for dim, some in held.items():
        run(dim, some)
    for dim, (q, i, s) in best_of.items():
        yield batch({"query_row": sets[dim][0][q], "query_id": sets[dim][1][q], "vec_id": i, "score": s}, _HITS)


def search(
    vectors: DataFrame,
    is_query: str = "id % 50 = 0",
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``. Queries are the rows that ``is_query`` (SQL over
    ``id``) picks; candidates are all rows but the query's own. Ties go to the smaller id.
    Vectors that are null, or hold null or non-finite components, take no part, nor do rows
    without an id, which could not be named. Vectors of different length are not compared.
    Repeated rows are candidates each for itself, and each is a query of its own. Scores beyond
    64 bits are cut to their limits. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    stored = shared_table(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        .mapInArrow(_finite, "row long, id long, dim int, x binary"),
        "vectors",
    )
    asked = stored.filter(is_query)
    blocks = max(1, -(-asked.count() // query_rows))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    found, path = None, new_dir(spark, "best")
    for b in range(blocks):
        rows = asked.filter(block == b).collect()  # about query_rows of them
        queries = spark.sparkContext.broadcast(
            (np.array([r.row for r in rows], np.int64), np.array([r.id for r in rows], np.int64),
             np.array([r.dim for r in rows], np.int64), [bytes(r.x) for r in rows])
        )
        part = stored.mapInArrow(
            partial(_search, queries=queries, k=k, block_rows=block_rows, scale=scale), "query_row long, query_id long, vec_id long, score long"
        )
        found = part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        if blocks > 1:  # one block in memory at a time
            found.write.mode("append").parquet(path)
            queries.unpersist()
    return found if blocks == 1 else spark.read.schema(found.schema).parquet(path)
