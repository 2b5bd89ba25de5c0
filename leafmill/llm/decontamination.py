"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words (a shorter item is one window). A
window occurs in a document only if all its words do, so its rarest word, by counts over
all documents, is a necessary prefix: documents are joined to windows on that word alone.
The word's place in the window bounds where the window may start (positional bound) and the
document must be long enough (length bound). What is left is compared word by word.

The benchmark is taken in blocks of bounded size, so that a block's windows can be broadcast
(4 MB of text make about half a million windows and 0.2 to 0.35 GB in a process). Documents
are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, as_bytes, batch, lower_words, shared_table

#: Digits, letters (A-Z as a-z) and all bytes beyond ASCII stay; the rest are blanks.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; one of all its words if it has fewer, none if it has none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _count(batches: Batches, vocabulary):
    counts: Counter[bytes] = Counter()
    for rows in batches:
        for text in as_bytes(rows.column(0)):
            counts.update(filter(vocabulary.value.__contains__, lower_words(WORDS, text)))
    yield batch({"word": list(counts), "n": list(counts.values())}, {"word": pa.binary(), "n": pa.int64()})


class Block:
    """The windows of a block of items, by their rarest word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int], size: int):
        self.items: dict[tuple[bytes, ...], list[str | None]] = {}
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for item, words in items:
            for window in windows_of(words, size):
                self.items.setdefault(window, []).append(item)
        places: dict[bytes, set[tuple[int, int]]] = {}
        for window in self.items:
            _, rare, at = min((counts.get(w, 0), w, i) for i, w in enumerate(window))
            if counts.get(rare, 0):  # else some word is in no document
                places.setdefault(rare, set()).add((at, len(window)))
        self.places = {w: sorted(p) for w, p in places.items()}

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int, tuple[bytes, ...]]]:
        """(start, end, window) of every occurrence in a document's words."""
        found, n = [], len(words)
        places = self.places
        for i, word in enumerate(words):
            if word in places:
                for at, size in places[word]:
                    start = i - at
                    if start >= 0 and start + size <= n:
                        window = tuple(words[start : start + size])
                        if window in self.items:
                            found.append((start, start + size, window))
        return found


def merged(intervals: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
        ("unnamed", pa.bool_()),
    ]
)
FOUND_SQL = "struct<n_words: long, runs: array<struct<start: int, end: int>>, items: array<string>, unnamed: boolean>"


def _mark(batches: Batches, block):
    for rows in batches:
        out = []
        for text, before in zip(as_bytes(rows.column("text")), rows.column("found").to_pylist(), strict=True):
            words = lower_words(WORDS, text)
            found = block.value.occurrences(words)
            runs = [(a, b) for a, b, _ in found]
            items = {i for _, _, window in found for i in block.value.items[window]}
            if before:
                runs += [(r["start"], r["end"]) for r in before["runs"]]
                items.update(before["items"], [None] * before["unnamed"])
            out.append(
                {
                    "n_words": len(words), "runs": [{"start": a, "end": b} for a, b in merged(runs)],
                    "items": sorted(items - {None}), "unnamed": None in items,
                }
            )
        yield pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("text"), pa.array(out, _FOUND)], names=["row", "text", "found"]
        )


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """Every document with what it shares with the benchmark: ``row`` (struct of ``carry``) and ``found``.

    ``found`` has n_words, runs (maximal runs of hit words, as word numbers, ends exclusive),
    items (ids of the items with an occurring window, as texts and sorted so) and unnamed (whether items
    without an id are among them; all of those are one item). Words: A-Z in lower
    case, then runs of digits, letters and characters beyond ASCII. Null and empty texts
    have no words and no hits; items without words match nothing, those without an id
    mark words like any other.
    Repeated documents are judged each for itself, repeated items count by id. Empty tables
    on either side give no rows, or rows without hits. Carried columns may have any names.
    """
    spark = docs.sparkSession
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast(FOUND_SQL).alias("found"),
    )
    kind = marked.schema["row"].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")).dropna(subset=["text"])
    items = items.distinct()  # before blocks are cut: a repeated row would come to one block as often as it is there
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about block_bytes
        words = [(r.id, lower_words(WORDS, r.text.encode())) for r in some]
        vocabulary = spark.sparkContext.broadcast({w for _, ws in words for w in ws})
        counts = (
            docs.select(F.col(text_col).cast("string"))
            .mapInArrow(partial(_count, vocabulary=vocabulary), "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .collect()  # the words of the block
        )
        block = Block(words, {bytes(r.word): r.n for r in counts}, window)
        sent = spark.sparkContext.broadcast(block)
        marked = marked.mapInArrow(partial(_mark, block=sent), f"row {kind}, text string, found {FOUND_SQL}")
        if b + 1 < blocks:  # one block's windows in memory at a time
            marked = shared_table(marked, "marked")
    return marked.select("row", "found")
