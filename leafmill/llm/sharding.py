"""Sharding by jump consistent hashing: keys find their shard without a ring table.

A key's shard depends on the key and the number of shards alone. With one more shard, the
expected share of one in that many keys moves, and only into the new shard.

Slots number the rows of a shard without gaps. Each task counts its own rows by shard;
only these counts (tasks times shards) are summed up, so a shard may have any size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import Batches, batch, shared_table


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key (Lamping and Veach's published recurrence)."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    after = np.zeros(len(state), np.int64)
    while (live := np.flatnonzero(after < shards)).size:
        shard[live] = after[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        steps = 2.0**31 / ((state[live] >> np.uint64(33)).astype(float) + 1.0)
        after[live] = ((shard[live] + 1) * steps).astype(np.int64)
    return shard


def _place(batches: Batches, kind: pa.DataType, shards: int):
    part = TaskContext.get().partitionId()
    seen = np.zeros(shards, np.int64)
    types = {"id": kind, "size": pa.int64(), "text_crc32": pa.int64(), "shard": pa.int32(),
             "grown_shard": pa.int32(), "part": pa.int32(), "nth": pa.int64()}
    for rows in batches:
        keys = rows.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        shard = jump(keys, shards)
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(shard, minlength=shards)
        nth = np.empty(len(shard), np.int64)
        nth[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
        nth += seen[shard]
        seen += counts
        yield batch(
            {
                "id": rows.column("id"), "size": rows.column("size"), "text_crc32": rows.column("text_crc32"),
                "shard": shard, "grown_shard": jump(keys, shards + 1),
                "part": np.full(len(shard), part), "nth": nth,
            },
            types,
        )


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards decide. Size is the text's UTF-8
    bytes (null: none) and 16. ``slot`` counts a shard's rows from 0 without gaps.
    ``grown_shard`` is the shard with one more. Equal texts with different ids are
    different keys; rows of one id, and all rows of a null id, share a shard and have slots
    of their own. An empty table gives no rows; other columns are not read.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col)).alias("key"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, size long, text_crc32 long, shard int, grown_shard int, part int, nth long"
    placed = shared_table(rows.mapInArrow(partial(_place, kind=to_arrow_type(kind), shards=shards), schema), "shards")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    return placed.join(bases, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("nth")).alias("slot"), "grown_shard",
    )
