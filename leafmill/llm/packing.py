"""Packing token sequences into windows of one size.

Method: shallow combinations of piece lengths that fill a window exactly are enumerated;
non-negative least squares finds how often to use each, against the histogram of the
lengths; the counts are rounded to what is there; what remains is packed greedily, and cut
where a window would stay open.

Every task packs what it reads, in chunks of bounded size, and ends a chunk without
padding: its last, open window is cut at powers of two, which need none. So nothing is
shuffled, a lost task is repeated alone, and a table of any size costs one scan.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from functools import cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, batch
from leafmill.llm.fragments import byte_alphabet

#: Classes of bytes for splitting: letters, digits, others, white space, ends of texts.
_L, _N, _O, _W, _Z = range(5)
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _L
_CLASS[48:58] = _N
_CLASS[[9, 10, 13, 32]] = _W
_CLASS[0] = _Z
#: Texts with any of these are split by the library's own pattern instead: control
#: characters, and all that is not ASCII or a Latin letter of two bytes.
_SIMPLE = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3])


def _rare(text: bytes) -> bool:
    return bool(text.translate(None, _SIMPLE)) or b"\xc3\x97" in text or b"\xc3\xb7" in text


#: The endings that the pattern keeps apart after an apostrophe (fixed values).
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def split_points(data: np.ndarray) -> np.ndarray:
    """Starts of the byte-level pre-tokens in texts of simple bytes, each ended by a zero byte."""
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= kind == _Z
    before = np.zeros(len(data), bool)
    before[1:] = data[:-1] == 32
    word = kind <= _O
    start = change & ~(word & before)
    # The last of the white space before a word stands alone, or begins the word.
    last = np.flatnonzero(change & word) - 1
    last = last[last >= 0]
    start[last[kind[last] == _W]] = True
    for i in np.flatnonzero((data == 39) & start).tolist():
        end = next((len(e) for e in _ENDINGS if data[i + 1 : i + 1 + len(e)].tobytes() == e), 0)
        if end:
            start[i + 1] = False
            if kind[i + 1 + end] == _L:
                start[i + 1 + end] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole batches of texts: every distinct pre-token is merged once.

    ``vocabulary`` is a tokenizer file with a byte-level alphabet whose ids are in the order of its
    merges, ``pattern`` the one that it splits by. Results equal the library's ``encode_batch`` on
    the file (tested), where an added token written in a text is that token; the memo of pre-tokens
    is bounded.
    """

    def __init__(self, vocabulary: str, pattern: str, memo: int = 300_000):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        names = {t: i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.added}
        ranks = {bytes(map(byte_of.get, t)): i for t, i in names.items()}
        self.library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        either = b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.splitter = re.compile(b"(" + either + b")" if either else b"(?!)")
        self.memo: dict[bytes, bytes] = {}
        self.most = memo

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, four bytes an id; the zero byte that ends a text has none."""
        out = list(map(self.memo.get, words))
        if len(self.memo) > self.most:
            self.memo.clear()
        merge = self.library.encode_ordinary  # a pre-token alone is one pre-token again
        for i, found in enumerate(out):
            if found is None:
                word = words[i]
                out[i] = self.memo[word] = b"" if word == b"\0" else array("I", merge(word.decode("utf-8", "replace"))).tobytes()
        return out

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        simple = []
        for i, text in enumerate(texts):
            if self.splitter.search(text):
                parts = [p for p in self.splitter.split(text) if p]
                ids = iter(self([p for p in parts if p not in self.added]))
                out[i] = np.concatenate([np.array([self.added[p]], np.uint32) if p in self.added else next(ids) for p in parts])
            elif _rare(text):
                out[i] = np.array(self.library.encode_ordinary(text.decode("utf-8")), np.uint32)
            else:
                simple.append(i)
        if not simple:
            return out
        data = b"\0".join([*(texts[i] for i in simple), b""])
        starts = split_points(np.frombuffer(data, np.uint8))
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        cuts = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1].tolist()
        distinct = words.dictionary.buffers()[2].to_pybytes()
        each = self._ids([distinct[a:b] for a, b in pairwise(cuts)])
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        index = words.indices.to_numpy()
        counts = sizes[index]
        ends = np.cumsum(counts)
        at = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - counts), counts)
        ids = flat[at + np.arange(len(at))]
        stops = ends[np.flatnonzero(np.frombuffer(data, np.uint8)[starts] == 0)]
        for i, part in zip(simple, np.split(ids, stops[:-1]), strict=True):
            out[i] = part
        return out


@cache
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One for each worker process, so that tasks share the memo."""
    return Encoder(vocabulary, pattern)


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All multisets of two (or three) of these lengths that sum to the window; 0 pads a row."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    rows = [(a, window - a, 0) for a in lengths.tolist() if a <= window - a and have[window - a]]
    pairs = np.array(rows, np.int64).reshape(-1, 3)
    if depth < 3:
        return pairs
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[c]
    return np.concatenate([pairs, np.stack([a[ok], b[ok], c[ok]], 1)])


def repeat_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 40) -> np.ndarray:
    """Non-negative least squares: x >= 0 so that the combinations use up the histogram.

    Accelerated projected gradient; the matrix has at most three entries a column, so a
    step is two passes over them.
    """
    size = len(histogram)
    goal = histogram.astype(float)
    goal[0] = 0
    flat = rows.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), size)
        out[0] = 0
        return out

    # The largest eigenvalue is at most the largest row sum of the products.
    bound = 3.0 * max(1.0, np.bincount(flat, minlength=size)[1:].max(initial=1))
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        step = y - (used(y) - goal)[rows].sum(1, where=rows > 0) / bound
        new = np.maximum(step, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: np.ndarray, window: int, depth: int) -> list[tuple[list[int], int]]:
    """Combinations and their whole counts; together they use no more than is there."""
    lengths = np.flatnonzero(histogram[:window])
    lengths = lengths[lengths > 0]
    rows = combinations(lengths, window, depth) if len(lengths) else np.zeros((0, 3), np.int64)
    if not len(rows):
        return []
    x = repeat_counts(rows, histogram[: window + 1])
    left, out = histogram.copy(), []
    order = np.argsort(-x, kind="stable")
    for up in (False, True):  # first the rounded counts, then what still fits
        some = order[((left[rows] > 0) | (rows == 0))[order].all(1)] if up else order[x[order] >= 0.5]
        for k in some.tolist():
            parts = [p for p in rows[k].tolist() if p]
            fits = min(left[p] // parts.count(p) for p in parts)
            n = int(fits if up else min(round(float(x[k])), fits))
            if n:
                out.append((parts, n))
                for p in parts:
                    left[p] -= n
    return out


def pack_lengths(lengths: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, ...]:
    """Pieces of these documents: document, start, length, sequence, offset (arrays).

    Sequences are full windows, but for the last of all, which are powers of two.
    """
    full, tail = lengths // window, lengths % window
    docs = np.repeat(np.arange(len(lengths)), full)
    starts = (np.arange(len(docs)) - np.repeat(np.cumsum(full) - full, full)) * window
    whole = (docs, starts, np.full(len(docs), window), np.arange(len(docs)), np.zeros(len(docs), np.int64))
    sequence = len(docs)
    rows: list[tuple[int, int, int, int, int]] = []
    order = np.argsort(tail, kind="stable")
    histogram = np.bincount(tail, minlength=window + 1)
    queues = {n: q.tolist() for n, q in enumerate(np.split(order, np.cumsum(histogram)[:-1])) if n and len(q)}
    for parts, count in plan(histogram, window, depth):
        for _ in range(count):
            at = 0
            for n in parts:
                d = queues[n].pop()
                rows.append((d, int(full[d]) * window, n, sequence, at))
                at += n
            sequence += 1
    # Greedy: the longest that fits the room; if none does, the shortest is cut.
    rest = sorted((n, d) for n, q in queues.items() for d in q)
    at = 0
    while rest:
        i = bisect_right(rest, (window - at, len(lengths))) - 1
        n, d = rest.pop(max(i, 0))
        start = int(full[d]) * window
        while n:
            used = min(n, window - at)
            rows.append((d, start, used, sequence, at))
            start, n, at = start + used, n - used, at + used
            if at == window:
                sequence, at = sequence + 1, 0
    if at:  # the open window becomes sequences whose lengths are powers of two
        last = [r for r in rows if r[3] == sequence]
        del rows[len(rows) - len(last) :]
        room, filled = 1 << (at.bit_length() - 1), 0
        for d, start, n, _, _ in last:
            while n:
                used = min(n, room - filled)
                rows.append((d, start, used, sequence, filled))
                start, n, filled, at = start + used, n - used, filled + used, at - used
                if filled == room:
                    sequence, filled = sequence + 1, 0
                    room = 1 << max(0, at.bit_length() - 1)
    tails = np.array(rows, np.int64).reshape(-1, 5).T
    return tuple(np.concatenate([a, b]).astype(np.int64) for a, b in zip(whole, tails, strict=True))


def _pack(batches: Batches, kind: pa.DataType, vocabulary: str, pattern: str, stop: int, window: int, depth: int, chunk: int):
    encode = encoder(vocabulary, pattern)
    types = {"key": kind, "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
             "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    ending = np.array([stop], np.uint32)
    sequence = TaskContext.get().partitionId() << 36

    def packed(keys: list, tokens: list[np.ndarray]):
        nonlocal sequence
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        docs, starts, sizes, sequences, offsets = pack_lengths(lengths, window, depth)
        for low in range(0, len(docs), 4096):
            d, s, n = docs[low : low + 4096], starts[low : low + 4096], sizes[low : low + 4096]
            yield batch(
                {
                    "key": [keys[i] for i in d.tolist()], "start": s, "length": n,
                    "ids": [tokens[i][a : a + b].astype("<u4").tobytes() for i, a, b in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)],
                    "doc_tokens": lengths[d], "sequence_id": sequences[low : low + 4096] + sequence, "offset": offsets[low : low + 4096],
                },
                types,
            )
        sequence += int(sequences.max(initial=-1)) + 1

    keys, tokens, held = [], [], 0
    for rows in batches:
        texts = [x or b"" for x in rows.column(1).cast(pa.binary()).to_pylist()]
        names = rows.column(0).to_pylist()
        low = 0
        while low < len(texts):  # a few megabytes at a time
            high, size = low, 0
            while high < len(texts) and (size < 4_000_000 or high == low):
                size, high = size + len(texts[high]), high + 1
            for name, ids in zip(names[low:high], encode(texts[low:high]), strict=True):
                keys.append(name)
                tokens.append(np.concatenate([ids, ending]))
                held += len(ids) + 1
            low = high
            if held >= chunk:
                yield from packed(keys, tokens)
                keys, tokens, held = [], [], 0
    if keys:
        yield from packed(keys, tokens)


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    stop_id: int = 0,
    depth: int = 3,
    chunk_tokens: int = 6_000_000,
) -> DataFrame:
    """Pieces of all documents, packed: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. Each document is
    its text's ids and ``stop_id``; null texts count as empty, so every row has at least
    one piece. Equal and repeated rows, also of one id or of null ids, are packed each for
    itself. Texts of any length are cut into windows. An empty table gives no pieces. Other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = partial(
        _pack, kind=to_arrow_type(kind), vocabulary=vocabulary, pattern=pattern, stop=stop_id, window=window, depth=depth, chunk=chunk_tokens
    )
    schema = f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", id_col)
