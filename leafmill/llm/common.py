"""Small helpers of the corpus operators: Arrow columns, byte hashing, staging."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, run: Callable[[Batches], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function over the batches of one task."""
    return df.mapInArrow(run, schema)


def batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := columns[name], pa.Array) else pa.array(x, kind) for name, kind in types.items()],
        names=list(types),
    )


def row_key(*columns: str) -> Column:
    """A key that depends on the row's content alone, so that every scan computes it alike."""
    return F.xxhash64(*(F.col(c) for c in columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit number for each byte value, and the base of the polynomial hashes.
BYTE_CODES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, from a table that grows with the longest text seen."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


class Rolling:
    """Hashes of any substrings of one byte string, after one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start, end) -> np.ndarray:
        """Of the substrings from ``start`` to ``end`` (arrays or slices of the same size)."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def slices(batches: Batches, column: str, most: int = 16_000_000) -> Batches:
    """Batches cut so that a text column has about ``most`` bytes in each."""
    for rows in batches:
        sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy().astype(np.int64)
        part = np.cumsum(sizes) // most
        low = 0
        for high in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]:
            if high > low:
                yield rows.slice(low, high - low)
            low = high


#: Bits of the filter below: 8 MB in 2048 rows, whatever the number of keys.
_BITS, _ROW = 1 << 26, 1 << 15


def may_hold(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the row's ``key`` may be among ``keys``.

    True for all that are, and few others. A bitmap of fixed size is broadcast, so that rows can
    leave, or pass by, a shuffled join. With very many keys it is full, and then only
    costs its look-up.
    """
    slot = F.pmod(F.col("key"), F.lit(_BITS))
    word = F.floor(slot / _ROW)
    maps = keys.select(slot.alias("slot"), word.alias("word")).groupBy("word").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")
    )
    byte = F.expr("cast(conv(hex(substring(bits, cast(slot % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.getbit(F.coalesce(byte, F.lit(0)), (F.col("slot") % 8).cast("int")) == 1
    out = df.withColumns({"slot": slot, "word": word}).join(F.broadcast(maps), "word", "left")
    return out.select(*df.columns, bit.alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of undirected edges (a, b): the smallest node that can be reached.

    Labels spread to neighbours and jump along labels, so that the rounds grow with the
    logarithm of a component's width; each round is written to the shared folder.
    """
    both = shared_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = shared_table(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = (
            labels.join(far, F.col("label") == F.col("via"), "left").join(near, F.col("node") == F.col("a"), "left")
            .select("node", F.least("label", "far", "near").alias("label"), F.col("label").alias("old"))
        )
        new = shared_table(new, "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").limit(1).count() == 0:
            return labels


def lower_words(table: bytes, text: bytes) -> list[bytes]:
    """Words of a text whose bytes ``table`` maps to themselves, lower case or blanks."""
    return text.translate(table).split()


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as zstd Parquet and read again."""
    from leafmill.session import new_dir

    path = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
