"""Joins of a large table with a keyed lookup table.

Two settings of the session bound what is broadcast (see README): ``spark.leafmill.broadcastRows``
and ``spark.leafmill.broadcastChars``. They choose between plans, never between results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from leafmill.session import stage

BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000
#: A key is hot when it holds more than this share of the rows, so there are at most 4,000.
HOT_SHARE = 1 / 4000
#: Copies of a hot key's lookup row where those rows are too large to broadcast.
SALTS = 64


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.leafmill.{name}", str(default)))


def is_small(df: DataFrame, max_rows: int | None = None, max_chars: int | None = None) -> bool:
    """Does ``df`` stay below both bounds? Each task sends one row of sums.

    ``df`` should be a stored table or a ``stage``: it is read again by the join.
    """
    spark = df.sparkSession
    sizes = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("chars"),
    ).first()
    if max_rows is None:
        max_rows = _setting(spark, "broadcastRows", BROADCAST_ROWS)
    if max_chars is None:
        max_chars = _setting(spark, "broadcastChars", BROADCAST_CHARS)
    return sizes["rows"] <= max_rows and sizes["chars"] <= max_chars


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    max_rows: int | None = None,
    max_chars: int | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``big`` with a table that has at most one row per key.

    A lookup that was measured to be small is broadcast, and ``big`` does not move.
    Beyond that, see ``hot_key_join``.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if is_small(lookup, max_rows, max_chars):
        return big.join(F.broadcast(lookup), on, how)
    return hot_key_join(big, lookup, on, how, hot_share=hot_share, max_chars=max_chars)


def hot_key_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str,
    *,
    hot_share: float = HOT_SHARE,
    max_chars: int | None = None,
) -> DataFrame:
    """Join with a large lookup when some keys may hold a large share of ``big``.

    Keys with more than ``hot_share`` of the rows are counted out first (the counts combine
    before the shuffle); there are at most 1 / ``hot_share`` of them at any size. Their
    lookup rows are measured and broadcast, or, where they are too large for that, copied
    ``SALTS`` times and joined by (key, salt). All other rows take a shuffled join, in which
    no key is large. Rows with a null key match nothing and take part in no join.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    counts = stage(big.where(known).groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > total * hot_share).select(*on)
    keyed = big.where(known)
    hot_rows = keyed.join(F.broadcast(hot), on, "left_semi")
    hot_lookup = stage(lookup.join(F.broadcast(hot), on, "left_semi"), "hot-lookup")
    if is_small(hot_lookup, max_chars=max_chars):
        hot_part = hot_rows.join(F.broadcast(hot_lookup), on, how)
    else:
        # From the row's content, so that a task that is run again deals its rows alike.
        plain = [f.name for f in big.schema if isinstance(f.dataType, AtomicType)]
        salted = hot_rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
        copies = hot_lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot_part = salted.join(copies, [*on, "_salt"], how).drop("_salt")
    cold_part = keyed.join(F.broadcast(hot), on, "left_anti").join(lookup, on, how)
    out = hot_part.unionByName(cold_part)
    if how in ("left", "left_anti"):
        out = out.unionByName(big.where(~known), allowMissingColumns=True)
    return out
