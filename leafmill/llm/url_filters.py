"""URL filters as a sort-merge range join.

A host's labels in reverse order make a key under which a host and all its subdomains are
one interval, and intervals of two hosts are nested or apart. URLs are sorted by that key in
ranges of equal size; every rule goes to the ranges that its interval meets. One sweep over
a sorted range keeps a stack of the rules whose interval is open; the stack holds one frame
for each host level, and within a frame paths are looked up by length.

The ranges are cut by key, path and row, so one host, or one URL, may fill many of them.
Only the first and last key of each range reach the driver (``ranges`` of them).
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, shared_table

#: Ends each label of a key; no printable character sorts before it.
_END = "\x01"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return _ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END))


def _sweep(batches: Batches):
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    part = None
    for rows in batches:
        c = {name: rows.column(name).to_pylist() for name in ("part", "host_key", "kind", "path", "verdict", "rule")}
        texts, verdicts = [], []
        for p, key, kind, path, verdict, rule in zip(*c.values(), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:  # a rule opens
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                _, paths, sizes = stack[-1]
                if path not in paths or verdict == "block":
                    paths[path] = (verdict, rule)
                sizes.add(len(path))
                continue
            best = None
            for level, (_, paths, sizes) in enumerate(stack):
                for n in sizes:
                    found = paths.get(path[:n]) if n <= len(path) else None
                    if found and (best is None or (len(found[1]), level) > best[0]):
                        best = ((len(found[1]), level), found)
            verdicts.append(best[1][0] if best else None)
            texts.append(best[1][1] if best else None)
        urls = rows.filter(pc.equal(rows.column("kind"), 1))
        yield pa.RecordBatch.from_arrays(
            [urls.column("row"), pa.array(texts, pa.string()), pa.array(verdicts, pa.string())],
            names=["row", "rule", "verdict"],
        )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int = 0,
) -> DataFrame:
    """Verdict of every URL: ``id_col``, ``url_col``, host, path, rule, verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``); of any size. A rule fits
    its host and all subdomains if the URL's path starts with the rule's. The longest text
    (host and path) wins, of equally long ones that of the longer host; a rule given twice
    with both verdicts blocks. Without a rule, ``rule`` is null and the verdict ``default``.
    A null URL, or one without ``://``, has an empty host and path, which only a rule with
    an empty host fits. Each row is judged for itself, also with repeated or null ids. Empty
    tables give no rows; other columns are not read. ``ranges``: 0 takes the session's
    number of shuffle partitions.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    urls = pages.select(
        F.struct(F.col(id_col).alias("id"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path")).alias("row")
    ).withColumn("host_key", host_key(F.col("row.host")))
    # A URL that fills many ranges is dealt by its row's id.
    ordered = urls.repartitionByRange(n, "host_key", "row.path", F.xxhash64("row.id")).withColumn("part", F.spark_partition_id())
    ordered = shared_table(ordered, "urls")
    bounds = sorted(map(tuple, ordered.groupBy("part").agg(F.min("host_key"), F.max("host_key")).collect()))
    parts, lows, highs = ([b[i] for b in bounds] for i in range(3))

    def routed(batches: Iterable[pa.RecordBatch]):
        """A copy of each rule for every range that its interval meets."""
        for rows in batches:
            at, which = [], []
            for i, key in enumerate(rows.column("host_key").to_pylist()):
                first = bisect_left(highs, key)
                last = bisect_right(lows, key + "\U0010ffff")
                at += parts[first:last]
                which += [i] * max(0, last - first)
            copies = rows.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *copies.columns], names=["part", *copies.schema.names])

    known = rules.select(
        host_key(_ascii_lower(F.coalesce("host", F.lit("")))).alias("host_key"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict").cast("string").alias("verdict"),
        F.concat(_ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("rule"),
    )
    copies = known.mapInArrow(routed, "part int, host_key string, path string, verdict string, rule string")
    events = ordered.select(
        "part", "host_key", F.lit(1).alias("kind"), F.col("row.path").alias("path"),
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"), "row",
    ).unionByName(copies.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    swept = (
        events.repartitionByRange(n, "part")
        .sortWithinPartitions("part", "host_key", "kind")
        .mapInArrow(_sweep, f"row {ordered.schema['row'].dataType.simpleString()}, rule string, verdict string")
    )
    return swept.select(
        F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "row.host", "row.path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
