"""Cutting texts where no token can reach across, and putting results of the pieces together again.

A byte pair that lies inside no token of a vocabulary is a certain boundary: merges never
join its two bytes, so the text before and after it can be encoded each for itself. Where
a tokenizer also looks at the text before merging (patterns, case, word ends), a cut must be
certain for that step too; ``bpe.py`` and ``alignment.py`` say which pairs are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafmill.llm.common import Batches, slices

Cuts = Callable[[np.ndarray], np.ndarray]


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def pair_table(tokens: Iterable[bytes]) -> np.ndarray:
    """``table[a, b]``: do bytes a, b stand side by side inside any of these tokens?"""
    table = np.zeros((256, 256), bool)
    for token in tokens:
        codes = np.frombuffer(token, np.uint8)
        table[codes[:-1], codes[1:]] = True
    return table


def dealt(batches: Batches, column: str, most: int) -> Batches:
    """Slices of about ``most`` bytes of text, in which a longer text stands alone."""
    for rows in slices(batches, column, most):
        sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy()
        edges = {0, rows.num_rows}
        for i in np.flatnonzero(sizes > most).tolist():
            edges |= {i, i + 1}
        cut = sorted(edges)
        yield from (rows.slice(low, high - low) for low, high in zip(cut, cut[1:]))


def portions(text: bytes, cuts: Cuts, most: int) -> Iterator[bytes]:
    """``text`` in portions of about ``most`` bytes that end at certain cuts.

    A stretch without any cut stays whole, whatever its size. Memory is that of a portion.
    """
    low, n = 0, len(text)
    while n - low > most:
        found, high = -1, low
        while found < 0 and high < n:
            base, high = max(high - 8, low), min(high + most, n)
            at = np.flatnonzero(cuts(np.frombuffer(text, np.uint8, high - base, base))) + base
            at = at[(at > max(base + 8, low)) | ((base == low) & (at > low))]
            found = int(at[-1]) if len(at) else -1
        if found < 0:
            break
        yield text[low:found]
        low = found
    yield text[low:]


def fragments(texts: list[bytes], cuts: Cuts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct fragments of all texts, the distinct one of each fragment, and per text the
    number of its first fragment (with one more entry for the end)."""
    data = b"".join(texts)
    codes = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    start = cuts(codes)
    start[begins[sizes > 0]] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(codes)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()
    bounds = np.searchsorted(at, np.append(begins, len(codes)))
    return words.dictionary.to_pylist(), words.indices.to_numpy(), bounds


def spread(parts: list[bytes], index: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``parts[i]`` for i in ``index``, one after the other, and where each part
    begins (with one more entry for the end). A part holds numbers of this kind as bytes."""
    flat = np.frombuffer(b"".join(parts), kind)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // flat.itemsize
    counts = sizes[index]
    ends = np.cumsum(counts)
    at = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - counts), counts)
    return flat[at + np.arange(len(at))], np.append(0, ends)
