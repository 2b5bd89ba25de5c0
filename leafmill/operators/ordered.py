"""Ordered work on keyed rows without sending a whole key to one task.

The rows are range-partitioned by (key, order): a key that holds a third of the
table covers many partitions, each with a contiguous stretch of its rows. A stretch
is summarised where it lies, and only the summaries of a key meet; a key owns at
most one summary per partition.

* ``summarise`` - summaries of the stretches, the base of the folds.
* ``compose_stretches`` - summaries of a key put together in pairs, in log rounds.
* ``scan_states`` - state of a small machine before every row.
* ``chunked_row_number`` - exact row numbers.
* ``last_distinct``, ``fold_lists`` - folds whose state is a short list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from leafmill.operators.joins import lookup_join
from leafmill.session import shared_dir, stage


class Part(NamedTuple):
    """One column of a summary.

    ``new(continues)`` gives the empty state; ``continues`` is true for the first
    stretch of a partition, the only one whose key may have rows in earlier
    partitions. ``absorb(state, *arrays)`` takes the next rows of ``columns``.
    """

    name: str
    ddl: str
    columns: list[str]
    new: Callable[[bool], Any]
    absorb: Callable[..., Any]


def sort_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partitioned and sorted, with ``_chunk`` naming the partition of a row."""
    cols = [*keys, *order]
    return (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_chunk", F.spark_partition_id())
    )


def chunked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``sort_rows``, kept in the shared checkpoint folder.

    Range boundaries are sampled, so work that reads the chunks twice must not draw
    them twice; the checkpoint also spares a lost executor the whole sort.
    """
    shared_dir(df.sparkSession)
    return sort_rows(df, keys, order).checkpoint()


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of the stretches of equal keys in a sorted batch."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    columns = [_column(batch, name) for name in keys]
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], batch.num_rows)
    return [
        (tuple(c[int(a)].as_py() for c in columns), int(a), int(b))
        for a, b in zip(starts, ends)
    ]


def _summary_schema(df: DataFrame, keys: list[str], parts: list[Part]) -> StructType:
    added = ["_chunk int", *[f"{p.name} {p.ddl}" for p in parts]]
    return StructType(
        [df.schema[k] for k in keys] + StructType.fromDDL(", ".join(added)).fields
    )


def summarise(rows: DataFrame, keys: list[str], parts: list[Part]) -> DataFrame:
    """One row per stretch of ``rows`` (from ``sort_rows`` or ``chunked``)."""
    schema = _summary_schema(rows, keys, parts)
    added = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema[len(keys) :]]
    columns = list(dict.fromkeys(c for p in parts for c in p.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        key, chunk, states, continues = None, None, None, True
        key_fields: list[pa.Field] = []

        def emit():
            row = dict(zip(keys, key), _chunk=chunk)
            row.update((p.name, s) for p, s in zip(parts, states))
            done.append(row)

        def flush():
            out = pa.RecordBatch.from_pylist(done, schema=pa.schema([*key_fields, *added]))
            done.clear()
            return out

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_fields = [batch.schema.field(k) for k in keys]
            arrays = {c: _column(batch, c).to_numpy(zero_copy_only=False) for c in columns}
            chunk = _column(batch, "_chunk")[0].as_py()
            for here, a, b in _runs(batch, keys):
                if states is None or here != key:
                    if states is not None:
                        emit()
                        continues = False
                    key, states = here, [p.new(continues) for p in parts]
                states = [
                    p.absorb(s, *(arrays[c][a:b] for c in p.columns))
                    for p, s in zip(parts, states)
                ]
            if len(done) >= 10_000:
                yield flush()
        if states is not None:
            emit()
            yield flush()

    return rows.select(*keys, *columns, "_chunk").mapInArrow(run, schema)


def machine(name: str, symbol: str, table: Callable[[], np.ndarray], start: int) -> Part:
    """Summary of a finite state machine: the state every entry state leads to.

    ``table()[symbol, state]`` is the next state. A stretch that begins a key holds
    just the state it ends in.
    """

    def new(continues: bool) -> list[int]:
        return list(range(table().shape[1])) if continues else [start]

    def absorb(states: list[int], symbols: np.ndarray) -> list[int]:
        moves = table()
        # Entry states soon fall together: walk each distinct state once.
        distinct, place = np.unique(np.asarray(states), return_inverse=True)
        at = 0
        while len(distinct) > 4 and at < len(symbols):
            for s in symbols[at : at + 16]:
                distinct = moves[s][distinct]
            distinct, merged = np.unique(distinct, return_inverse=True)
            place = merged[place]
            at += 16
        rest = symbols[at:].tolist()
        ends = []
        for state in distinct.tolist():
            for s in rest:
                state = moves[s, state]
            ends.append(int(state))
        return [ends[i] for i in place.tolist()]

    return Part(name, "array<int>", [symbol], new, absorb)


def run_machine(segments: Column, name: str, start: Column) -> Column:
    """Lead ``start`` through the summaries of a key, given in chunk order."""

    def through(state, seg):
        ends = seg[name]
        return F.when(F.size(ends) == 1, F.element_at(ends, 1)).otherwise(
            F.element_at(ends, state + 1)
        )

    return F.aggregate(segments, start, through)


def segments(parts: list[str]) -> Column:
    """Aggregate: the summaries of a key in chunk order (one per partition at most)."""
    return F.array_sort(F.collect_list(F.struct("_chunk", *parts)))


def compose_stretches(
    stretches: DataFrame, keys: list[str], together: dict[str, Callable[[Column, Column], Column]]
) -> DataFrame:
    """One row per key: its stretches (from ``summarise``) put together in chunk order.

    ``together`` says for each summary how two neighbours become one. A key that lies in one
    chunk is done at once. The others, at most one for each border between chunks, are put
    together in pairs of neighbouring chunks, round by round, so n chunks take log2(n) rounds,
    and no row or task ever holds more than two summaries of a key. Null keys are keys.
    """
    names = list(together)
    stretches = stage(stretches.select(*keys, "_chunk", *names), "stretches")  # chunks are drawn once
    many = stretches.groupBy(*keys).agg(F.count("*").alias("_of")).where("_of > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys]
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    done = stretches.join(F.broadcast(many), same, "left_anti").drop("_chunk")
    open_ = stretches.join(F.broadcast(many), same, "left_semi")
    while True:
        two = F.array_sort(F.collect_list(F.struct("_chunk", *names)))
        pairs = open_.groupBy(*keys, F.floor(F.col("_chunk") / 2).cast("int").alias("_pair")).agg(two.alias("_two"))
        one, other = F.col("_two")[0], F.get("_two", F.lit(1))
        open_ = stage(
            pairs.select(
                *keys,
                F.col("_pair").alias("_chunk"),
                *[F.when(other.isNull(), one[n]).otherwise(join(one[n], other[n])).alias(n) for n, join in together.items()],
            ),
            "stretches",
        )
        if open_.groupBy(*keys).count().where("count > 1").isEmpty():
            return done.unionByName(open_.drop("_chunk"))


def compose_tables(first: Column, then: Column) -> Column:
    """Machine tables one after the other; a table whose entries agree becomes that one value."""
    through = F.when(F.size(then) == 1, then).otherwise(
        F.transform(first, lambda state: F.element_at(then, state + 1))
    )
    return F.when(F.size(F.array_distinct(through)) == 1, F.slice(through, 1, 1)).otherwise(through)


def scan_states(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    symbol: str,
    table: np.ndarray,
    start: int,
) -> DataFrame:
    """``df`` with the state of a small machine before each row (``_before``).

    The first pass summarises the chunks. The entry state of a chunk that continues a
    key (at most one row per partition) is broadcast, and the chunks are walked again.
    """
    rows = chunked(df, keys, order)
    spans = (
        summarise(rows, keys, [machine("_ends", symbol, lambda: table, start)])
        .groupBy(*keys)
        .agg(segments(["_ends"]).alias("_segs"))
        .where(F.size("_segs") > 1)
    )
    entry = spans.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("_segs") - 1),
                lambda i: F.struct(
                    F.element_at("_segs", i + 1)["_chunk"].alias("_chunk"),
                    run_machine(F.slice("_segs", 1, i), "_ends", F.lit(start)).alias("_entry"),
                ),
            )
        ).alias("_e")
    ).select("_e.*")
    out = rows.join(F.broadcast(entry), "_chunk", "left").select(*df.columns, "_entry")
    schema = StructType(df.schema.fields + StructType.fromDDL("_before int").fields)
    moves = table.tolist()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, first = None, start, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            symbols = _column(batch, symbol).to_pylist()
            given = _column(batch, "_entry")
            before = []
            for key, a, b in _runs(batch, keys):
                if first or key != open_key:
                    entered = given[a].as_py() if first else None
                    state = start if entered is None else entered
                    open_key, first = key, False
                for s in symbols[a:b]:
                    before.append(state)
                    state = moves[s][state]
            columns = [_column(batch, n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(before, pa.int32())], schema.names
            )

    return out.mapInArrow(walk, schema)


def chunked_row_number(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for keys of any size.

    Rows are numbered inside (chunk, key) and the rows of the key's earlier chunks are
    added. Only the first key of a chunk has earlier chunks, so there is at most one
    offset per partition.
    """
    rows = chunked(df, keys, order)
    counts = rows.groupBy("_chunk", *keys).agg(F.count("*").alias("_n"))
    earlier = (
        W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_offset", F.sum("_n").over(earlier))
        .where("_offset > 0")
        .select(*[F.col(c).alias(f"_o_{c}") for c in ("_chunk", *keys)], "_offset")
    )
    local = W.partitionBy("_chunk", *keys).orderBy(*order)
    numbered = rows.withColumn("_local", F.row_number().over(local))
    same = F.lit(True)
    for c in ("_chunk", *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return numbered.join(F.broadcast(offsets), same, "left").select(
        *df.columns,
        (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long").alias(name),
    )


def last_distinct(
    df: DataFrame, keys: list[str], order: list[str], value: str, size: int
) -> DataFrame:
    """Keys with the list (``_list``) that a queue of distinct values holds in the end.

    A value already in the queue changes nothing; a new one goes to its end, and the
    oldest leaves once there are more than ``size``. A key with at most ``size`` distinct
    values never loses one, so its list is the order of their first rows: sums that
    combine before the shuffle and a row-number limit, whatever the key's size. Only keys
    with more values are walked in order (``fold_lists``).
    """
    rows = df.select(*keys, *order, value)
    firsts = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_first", value))
    heads = (
        firsts.withColumn("_rank", rank)
        .where(F.col("_rank") <= size + 1)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", value))).alias("_heads"))
    )
    heads = stage(heads, "list-heads")
    whole = heads.where(F.size("_heads") <= size).select(
        *keys, F.transform("_heads", lambda h: h[value]).alias("_list")
    )
    long = heads.where(F.size("_heads") > size).select(*keys)
    if long.isEmpty():
        return whole

    def extend(items: list, item: Any) -> list:  # ignores the value it was given last
        return items if item in items else [*items, item][-size:]

    walked = fold_lists(
        lookup_join(rows, long, keys, "left_semi"), keys, [*order, value], value, extend
    )
    return whole.unionByName(walked)


def value_changes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of sorted chunks whose value differs from the one before, in the same key and chunk.

    ``_at`` is a row's place in its chunk. A list of distinct values ignores a value that was just
    put in, so nothing else ever changes such a list.
    """
    schema = StructType([rows.schema[c] for c in (*keys, value, "_chunk")] + StructType.fromDDL("_at bigint").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [_column(batch, c) for c in (*keys, value)]
            starts = np.array([a for _, a, _ in _runs(batch, [*keys, value])])
            head = tuple(c[0].as_py() for c in columns)
            keep = starts[1:] if head == last else starts
            last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
            out = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*(_column(out, c) for c in (*keys, value, "_chunk")), pa.array(keep + at, pa.int64())], schema.names
            )
            at += batch.num_rows

    return rows.select(*keys, value, "_chunk").mapInArrow(run, schema)


def fold_lists(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    extend: Callable[[list, Any], list],
    *,
    rounds: int = 2,
) -> DataFrame:
    """Keys with the list (``_list``) that ``extend(list, value)`` builds in row order.

    ``extend`` must ignore a value equal to the last one it was given. So only the changes of
    each key's values are kept (``value_changes``); all later steps read those. Every chunk is
    walked from an empty list first. Where a chunk that continues a key should have begun with
    another list, it is walked again, all such chunks at once, for a few rounds: lists that
    forget how they began are right by then. Keys that are still stale are walked from their
    first change on, each key for itself, so that a task streams through the changes of its own
    keys and holds one list. The driver sees two short lists per partition and round.
    """
    changes = stage(
        value_changes(sort_rows(df.select(*dict.fromkeys([*keys, *order, value])), keys, order), keys, value), "changes"
    )
    sc = df.sparkSession.sparkContext
    schema = StructType(
        [changes.schema[k] for k in keys]
        + StructType.fromDDL(
            "_chunk int, _continues boolean, _entry array<string>, _list array<string>"
        ).fields
    )
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def walked(part_of: DataFrame, entries: dict[int, list], by: list[str]) -> DataFrame:
        """The lists of the stretches that ``by`` names, each begun as ``entries`` says or empty."""
        shared = sc.broadcast(entries)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, chunk, row, built, done = None, None, None, [], []

            def flush() -> pa.RecordBatch:
                out = [dict(zip(schema.names, r)) for r in done]
                done.clear()
                return pa.RecordBatch.from_pylist(out, schema=kinds)

            for batch in batches:
                if batch.num_rows == 0:
                    continue
                values = _column(batch, value).to_pylist()
                chunks = _column(batch, "_chunk").to_numpy()
                for key, a, b in _runs(batch, by):
                    if at != key:
                        if at is not None:
                            done.append((*row, built))
                        continues = chunks[a] != chunk
                        built = shared.value.get(int(chunks[a]), []) if continues else []
                        names = tuple(_column(batch, k)[a].as_py() for k in keys)
                        at, chunk, row = key, chunks[a], (*names, int(chunks[a]), bool(continues), built)
                    for v in values[a:b]:
                        built = extend(built, v)
                if len(done) >= 10_000:
                    yield flush()
            if at is not None:
                done.append((*row, built))
                yield flush()

        return part_of.mapInArrow(walk, schema)

    def chunk_by_chunk(part_of: DataFrame, entries: dict[int, list]) -> DataFrame:
        return walked(part_of.repartition("_chunk").sortWithinPartitions("_chunk", "_at"), entries, ["_chunk", *keys])

    def stale(result: DataFrame) -> tuple[dict[int, list], list[int]]:
        """The list each chunk should begin with, and the chunks that began with another one."""
        edges = (  # first and last stretch of every chunk; a stretch may be both
            result.groupBy("_chunk")
            .agg(
                F.max_by(F.struct(*keys, "_entry"), "_continues").alias("first"),
                F.max(F.struct(*keys, "_list")).alias("last"),
            )
            .orderBy("_chunk")
            .collect()
        )
        found: dict[int, list] = {}
        wrong: list[int] = []
        for before, here in zip(edges, edges[1:]):
            if all(before["last"][k] == here["first"][k] for k in keys):
                found[here["_chunk"]] = list(before["last"]["_list"])
                if here["first"]["_entry"] != before["last"]["_list"]:
                    wrong.append(here["_chunk"])
        return found, wrong

    result = stage(chunk_by_chunk(changes, {}), "lists")
    found, wrong = stale(result)
    for _ in range(rounds):
        if not wrong:
            break
        again = chunk_by_chunk(changes.where(F.col("_chunk").isin(wrong)), found)
        result = stage(result.where(~F.col("_chunk").isin(wrong)).unionByName(again), "lists")
        found, wrong = stale(result)
    lists = result.groupBy(*keys).agg(F.max_by("_list", "_chunk").alias("_list"))
    if not wrong:
        return lists
    # At most one key for each border between chunks.
    open_ = stage(result.where(F.col("_chunk").isin(wrong) & F.col("_continues")).select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct(), "stale")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    whole = changes.join(F.broadcast(open_), same, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "_chunk", "_at")
    return lists.join(F.broadcast(open_), same, "left_anti").unionByName(walked(whole, {}, keys).select(*keys, "_list"))
