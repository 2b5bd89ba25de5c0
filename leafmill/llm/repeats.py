"""Repeated byte strings by a depth-limited radix sort of suffixes.

The windows are the suffixes cut at ``least`` bytes; equal windows are found in passes of
the most significant digit first, and a group of one leaves at once.

* First digit: the gram of ``GRAM`` bytes whose hash is smallest within the window. Equal
  windows have equal first digits, and neighbouring windows mostly share one occurrence
  of it: such a run of windows, a stretch, stays one row (about one for 85 bytes).
* Second digit: all bytes of the stretch. Equal stretches are repeated as a whole.
* Last digit: each window of the few stretches left, side by side with the others of its
  first digit. A first digit with very many different stretches is dealt out by window.

Digits are 64-bit hashes of the bytes. Counts are combined before they are shuffled, and rows
of a frequent digit are only joined to its count, never gathered.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import BASE, Batches, Rolling, as_bytes, mix, row_key, shared_table, slices
from leafmill.llm.decontamination import merged

GRAM = 32
#: Windows are taken up to so many at a time; positions need 24 bits.
_PART = 1 << 23
#: A place is a stretch's first window times this, plus its windows but one.
_PLACE = 1 << 12


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First digit, second digit and place of each run of windows that share an occurrence of the first."""
    digits = []
    for low in range(0, max(0, len(text) - least + 1), _PART):
        data = np.frombuffer(text[low : low + _PART + least - 1], np.uint8)
        roll = Rolling(data)
        at = np.arange(len(data) - GRAM + 1)
        gram = roll.of(at, at + GRAM)
        mask = np.uint64((1 << 24) - 1)
        found = (smallest((gram & ~mask) | at.astype(np.uint64), least - GRAM + 1) & mask).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(found)) + 1)
        count = np.diff(np.append(first, len(found)))
        end = first + count - 1 + least
        whole = mix(roll.of(first, end) + ((found[first] - first) * _PLACE + count).astype(np.uint64) * BASE)
        digits.append((gram[found[first]].view(np.int64), whole.view(np.int64), (first + low) * _PLACE + count - 1))
    if not digits:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(d) for d in zip(*digits, strict=True))


def _stretches(batches: Batches, least: int):
    for rows in slices(batches, "text", 8_000_000):
        keys = rows.column("key").to_numpy()
        found = [stretches(t, least) for t in as_bytes(rows.column("text"))]
        if found:
            of = np.repeat(keys, [len(f[0]) for f in found])
            gram, whole, place = (np.concatenate([f[i] for f in found]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, whole, of, place)], names=["gram", "whole", "key", "place"])


def _cut(batches: Batches, least: int):
    """The bytes of the stretches that are still open."""
    names = ("gram", "many", "place", "done")
    for rows in batches:
        out: list[list] = [[], [], [], [], [], []]
        for key, text, wanted in zip(rows.column("key").to_pylist(), as_bytes(rows.column("text")), rows.column("open").to_pylist(), strict=True):
            for w in wanted:
                low, more = divmod(w["place"], _PLACE)
                for column, value in zip(out, (*(w[n] for n in names), key, text[low : low + more + least]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[*names, "key", "bytes"])


def window_digits(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The last digit of every window of these stretches, and how many windows each has."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = sizes - least + 1
    starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return Rolling(data).of(starts, starts + least), counts


def _compare(batches: Batches, least: int, together: int):
    """Runs of repeated windows among stretches that come sorted by their first digit."""
    held: list[tuple[int, int, bool, bytes]] = []

    def runs() -> pa.RecordBatch:
        digits, counts = window_digits([h[3] for h in held], least)
        _, which, times = np.unique(digits, return_inverse=True, return_counts=True)
        again = times[which] > 1
        keys, starts, ends = [], [], []
        for (key, place, done, _), mine in zip(held, np.split(again, np.cumsum(counts)[:-1]), strict=True):
            if not done and mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    keys.append(key)
                    starts.append(place // _PLACE + a)
                    ends.append(place // _PLACE + b - 1 + least)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, ends)], names=["key", "start", "end"])

    last = None
    for rows in batches:
        for gram, key, place, done, part in zip(*(rows.column(c).to_pylist() for c in ("gram", "key", "place", "done", "bytes")), strict=True):
            if gram != last and len(held) >= together:
                yield runs()
                held = []
            last = gram
            held.append((key, place, done, part))
    if held:
        yield runs()


def _windows(batches: Batches, least: int):
    for rows in batches:
        for low in range(0, rows.num_rows, 5000):
            some = rows.slice(low, 5000)
            digits, counts = window_digits(some.column("bytes").to_pylist(), least)
            first = np.repeat(some.column("place").to_numpy() // _PLACE - (np.cumsum(counts) - counts), counts) + np.arange(len(digits))
            key = np.repeat(some.column("key").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(digits.view(np.int64)), pa.array(key), pa.array(first)], names=["digit", "key", "start"])


_KEPT = {"n_bytes": pa.int64(), "runs": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}


def _remove(batches: Batches):
    for rows in batches:
        sizes, runs, kept = [], [], []
        for text, found in zip(as_bytes(rows.column("text")), rows.column("found").to_pylist(), strict=True):
            cut = merged([(f["start"], f["end"]) for f in found or ()])
            edges = [0, *(x for run in cut for x in run), len(text)]
            sizes.append(len(text))
            runs.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), *(pa.array(x, k) for x, k in zip((sizes, runs, kept), _KEPT.values(), strict=True))],
            names=["id", *_KEPT],
        )


def _span(place: Column, least: int) -> Column:
    start = F.floor(place / _PLACE)
    return F.struct(start.alias("start"), (start + place % _PLACE + least).alias("end"))


def remove_repeats(
    docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", together: int = 20_000, most: int = 40_000
) -> DataFrame:
    """Every row without the bytes that repeat: ``id_col``, n_bytes, runs, kept.

    A byte goes if a string of ``least`` bytes that covers it also starts anywhere else, in
    another row or the same; all strings are judged on the input. ``runs`` are the maximal
    removed runs (bytes, ends exclusive), ``kept`` the remaining bytes. Null counts as
    empty; texts shorter than ``least`` stay whole; repeated rows lose all their strings.
    An empty table gives no rows; other columns are not read. ``most``: different stretches
    under one first digit up to which they are compared in one task; ``together`` is about
    how many a task compares at a time.
    """
    if not GRAM < least < _PLACE:
        raise ValueError(f"least must be between {GRAM + 1} and {_PLACE - 1}")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", row_key("id", "text"))
    marks = texts.select("key", "text").mapInArrow(partial(_stretches, least=least), "gram long, whole long, key long, place long")
    counts = marks.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    # Written first: a join of two plain shuffles can split a frequent digit.
    again = shared_table(counts.filter("n > 1").select("gram", (F.col("a") == F.col("b")).alias("alike")), "again")
    members = shared_table(marks.join(again, "gram"), "members")
    mixed = members.filter("not alike")
    kinds = shared_table(
        mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")), "kinds"
    )
    wide = kinds.groupBy("gram").agg((F.count("*") > most).alias("many"))
    equal = members.filter("alike").select("key", "place").unionByName(
        mixed.join(kinds.filter("n > 1").select("gram", "whole"), ["gram", "whole"]).select("key", "place")
    )
    # What is open, and of equal stretches one to compare it with.
    still = kinds.join(wide, "gram").select("gram", "one.key", "one.place", "many", (F.col("n") > 1).alias("done"))
    wanted = still.groupBy("key").agg(F.collect_set(F.struct("gram", "many", "place", "done")).alias("open"))
    cut = shared_table(
        texts.join(wanted, "key").mapInArrow(
            partial(_cut, least=least), "gram long, many boolean, place long, done boolean, key long, bytes binary"
        ),
        "open",
    )
    near = (
        cut.filter("not many").repartition("gram").sortWithinPartitions("gram")
        .mapInArrow(partial(_compare, least=least, together=together), "key long, start long, end long")
    )
    # A row of an equal stretch stands for its windows only; those of ``done`` are known.
    wide_rows = cut.filter("many")
    windows = wide_rows.mapInArrow(partial(_windows, least=least), "digit long, key long, start long")
    twice = windows.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit")
    far = windows.join(twice, "digit").select("key", "start", (F.col("start") + least).alias("end"))
    spans = (
        equal.groupBy("key", "place").agg(F.first(F.lit(1))).select("key", _span(F.col("place"), least).alias("span"))
        .unionByName(near.unionByName(far).select("key", F.struct("start", "end").alias("span")))
    )
    found = spans.groupBy("key").agg(F.collect_set("span").alias("found"))
    kind = texts.schema["id"].dataType
    return texts.join(found, "key", "left").select("id", "text", "found").mapInArrow(
        _remove, f"id {kind.simpleString()}, n_bytes long, runs array<struct<start: long, end: long>>, kept binary"
    ).withColumnRenamed("id", id_col)

