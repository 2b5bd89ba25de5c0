"""Alignment of two tokenizations of the same text, and how often their tokens meet.

Method: the cumulative byte ends of both token lists become dictionaries from end to index; the
intersection of their keys, sorted, slices both lists into groups, and the links of a slice
(tokens whose byte ranges overlap) are expanded there. An id pair's count is the number of links
of the whole corpus that hold it.

Texts are cut into fragments first: where the pattern of the one tokenizer ends a word in any
context, and neither vocabulary has a token that holds the byte pair. Each cut is an end in both
lists, so the groups of a text are those of its fragments, and a fragment is aligned once for
all places where it stands.

Counting does not move links. Tasks gather texts into chunks of bounded size; a chunk has one
row for each of its distinct pairs, with their number, and per text the places of its links in
that list. Pairs are counted over the chunks' rows, every chunk row gets its pair's count back,
and a chunk's counts and texts meet again in one sorted stream. What is shuffled is the distinct
pairs of the chunks and the packed links. A pair occurs at most once a chunk, so none is hot.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from functools import cache, partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import Batches, as_bytes, batch
from leafmill.llm.fragments import byte_alphabet, dealt, fragments, pair_table, portions, spread

#: Fragments of more bytes don't stay in the memo; texts are worked off in portions of this size.
LONG, PORTION = 256, 4_000_000
#: Ends are compared in stretches of so many bytes, so that the dictionaries stay small.
STRETCH = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def word_ends(data: np.ndarray) -> np.ndarray:
    """Which bytes begin something that the byte-level pattern never joins to what comes before.

    They are ASCII white space directly after a character that surely is none (visible ASCII,
    characters of two bytes but those of the first block, of three and four bytes but those of
    the blocks that have some), and other visible ASCII signs after a Latin letter.
    """
    at = np.flatnonzero(_SPACE[data] | ((data > 32) & (data < 127) & ~_LETTER[data]))
    at = at[at > 0]
    before = data[at - 1]
    lead = [data[np.maximum(at - k, 0)] for k in (2, 3, 4)]
    tail = (before >= 0x80) & (before < 0xC0)
    letter = _LETTER[before] | (tail & (lead[0] > 0xC2) & (lead[0] < 0xCA) & ~((lead[0] == 0xC3) & ((before == 0x97) | (before == 0xB7))))
    sign = (before > 32) & (before < 127)
    sign |= tail & (lead[0] > 0xC2) & (lead[0] < 0xE0)
    sign |= tail & (lead[1] > 0xE3) & (lead[1] < 0xF0) & (lead[0] >= 0x80) & (lead[0] < 0xC0) & (at > 2)
    sign |= tail & (lead[2] >= 0xF0) & (lead[1] >= 0x80) & (lead[1] < 0xC0) & (at > 3)
    out = np.zeros(len(data), bool)
    out[at[np.where(_SPACE[data[at]], sign, letter)]] = True
    return out


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j) with ``ends_a[i] == ends_b[j]``, in order. Ends grow strictly."""
    low_a = low_b = 0
    last = int(max(ends_a.max(initial=0), ends_b.max(initial=0)))
    for top in range(STRETCH, last + STRETCH, STRETCH):
        high_a, high_b = (int(np.searchsorted(e, top, "right")) for e in (ends_a, ends_b))
        index_a = dict(zip(ends_a[low_a:high_a].tolist(), range(low_a, high_a)))
        index_b = dict(zip(ends_b[low_b:high_b].tolist(), range(low_b, high_b)))
        for end in sorted(index_a.keys() & index_b.keys()):
            yield index_a[end], index_b[end]
        low_a, low_b = high_a, high_b


class Aligner:
    """Two tokenizers over one text. ``byte_level``: a byte-level vocabulary of ``tokenizers``,
    in which added tokens count as plain text; ``pieces``: a model of ``sentencepiece`` with byte
    pieces, which puts a space before the text. The memo of fragments is bounded."""

    def __init__(self, byte_level: str, pieces: str, memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = byte_alphabet()
        names = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        pieces_inside = pair_table(self.bytes_b)
        self.inside = pair_table(self.bytes_a) | pieces_inside
        # A line end before a fragment keeps the model's own space away from it.
        self.lead = self.b.encode("\n")
        self.free = not pieces_inside[10].any() and not pieces_inside[:, 10].any()
        self.memo: dict[bytes, tuple | None] = {}
        self.most = memo

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where fragments begin: where words end and no token has the pair inside (and no piece
        has a line end inside, see ``lead``)."""
        if not self.free:
            return np.zeros(len(data), bool)
        out = word_ends(data)
        out[1:] &= ~self.inside[data[:-1], data[1:]]
        return out

    def _same(self, text: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        """Do both token lists spell this text?"""
        return b"".join([self.bytes_a[i] for i in ids_a]) == text == b"".join([self.bytes_b[i] for i in ids_b])

    def align(self, sizes: list[int], all_a: list[list[int]], all_b: list[list[int]]) -> list[tuple[int, int, int, bytes, bytes]]:
        """For each of these texts (their sizes in bytes, and their tokens of both kinds): numbers of
        tokens and groups, the groups spelled, the code of every link.

        The texts are laid end to end. Inside a slice, each distinct end of a token closes one
        link: that of the two tokens which hold the byte before it.
        """
        ids_a, ids_b = np.fromiter(chain.from_iterable(all_a), np.int64), np.fromiter(chain.from_iterable(all_b), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        last_a, last_b, groups = [], [], []
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        i = j = 0
        for a, b in common_ends(ends_a, ends_b):
            last_a.append(a)
            groups.append(f"{','.join(text_a[i : a + 1])}|{','.join(text_b[j : b + 1])}")
            i, j = a + 1, b + 1
        closed = np.union1d(ends_a, ends_b)
        codes = ids_a[np.searchsorted(ends_a, closed)] * len(self.bytes_b) + ids_b[np.searchsorted(ends_b, closed)]
        stops = np.cumsum(sizes)
        group_at = np.searchsorted(ends_a[last_a], stops, "right").tolist() if last_a else [0] * len(sizes)
        link_at = np.searchsorted(closed, stops, "right").tolist()
        return [
            (len(a), len(b), g1 - g0, ";".join(groups[g0:g1]).encode(), codes[l0:l1].tobytes())
            for a, b, (g0, g1), (l0, l1) in zip(all_a, all_b, pairwise([0, *group_at]), pairwise([0, *link_at]), strict=True)
        ]

    def _learn(self, unknown: list[bytes]) -> None:
        """Align fragments into the memo; None where a tokenizer does not give the bytes back."""
        texts = [f.decode("utf-8", "replace") for f in unknown]
        coded_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        n = len(self.lead)
        coded_b = [ids[n:] if ids[:n] == self.lead else [] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        good = list(map(self._same, unknown, coded_a, coded_b))
        self.memo.update((f, None) for f, g in zip(unknown, good, strict=True) if not g)
        if any(good):
            fragments, all_a, all_b = zip(*((f, a, b) for f, a, b, g in zip(unknown, coded_a, coded_b, good, strict=True) if g))
            self.memo.update(zip(fragments, self.align(list(map(len, fragments)), all_a, all_b), strict=True))

    def whole(self, text: bytes) -> list[Part]:
        """The alignment of a text (with its leading space) without any cut."""
        plain = text.decode("utf-8", "replace")
        ids_a, ids_b = self.a.encode(plain, add_special_tokens=False).ids, self.b.encode(plain[1:])
        if not text or not self._same(text, ids_a, ids_b):
            return []
        [(n_a, n_b, n_groups, groups, codes)] = self.align([len(text)], [ids_a], [ids_b])
        return [((n_a, n_b, n_groups), groups, np.frombuffer(codes, np.int64))]

    def __call__(self, texts: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct alignments, the one of each fragment, where each text's fragments begin
        (one more entry for the end), and which texts have a fragment without alignment."""
        if len(self.memo) > self.most:
            self.memo.clear()
        distinct, index, bounds = fragments(texts, self.cuts)
        self._learn([d for d in distinct if d not in self.memo])
        known = [self.memo[d] for d in distinct]
        for d in distinct:
            if len(d) > LONG:
                del self.memo[d]
        bad = np.fromiter((k is None for k in known), bool, len(known))[index]
        broken = np.diff(np.append(0, np.cumsum(bad))[bounds]) > 0
        return [k or (0, 0, 0, b"", b"") for k in known], index, bounds, broken


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each worker process."""
    return Aligner(byte_level, pieces)


#: A text's alignment in parts: numbers of tokens and groups, the groups spelled, codes of links.
Part = tuple[Sequence[int], bytes, np.ndarray]


def _texts(align: Aligner, texts: list[bytes]) -> Iterator[list[Part]]:
    known, index, bounds, broken = align(texts)
    numbers = np.array([k[:3] for k in known], np.int64).reshape(-1, 3)[index]
    sums = np.diff(np.append(np.zeros((1, 3), np.int64), np.cumsum(numbers, 0), 0)[bounds], axis=0)
    codes, begins = spread([k[4] for k in known], index, np.int64)
    groups = list(map([k[3] for k in known].__getitem__, index.tolist()))
    ends = zip(pairwise(bounds.tolist()), pairwise(begins[bounds].tolist()), strict=True)
    for t, ((low, high), (begin, end)) in enumerate(ends):
        yield align.whole(texts[t]) if broken[t] else [(sums[t], b";".join(groups[low:high]), codes[begin:end])]


def _portions(align: Aligner, text: bytes, most: int) -> Iterator[list[Part]]:
    """The same for one long text."""
    parts: list[Part] = []
    for portion in portions(text, align.cuts, most):
        known, index, _, broken = align([portion])
        if broken[0]:
            parts = align.whole(text)
            break
        numbers = np.array([k[:3] for k in known], np.int64).reshape(-1, 3)[index].sum(0)
        codes, _ = spread([k[4] for k in known], index, np.int64)
        parts.append((numbers, b";".join([known[i][3] for i in index.tolist()]), codes))
    yield parts


_TYPES = {
    "kind": pa.int8(), "chunk": pa.int64(), "doc": pa.int64(), "place": pa.int32(), "code": pa.int64(), "times": pa.int64(), "links": pa.binary(),
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(),
}
#: Kinds of rows: a chunk's pair, the links of (a portion of) a text, a text.
_PAIR, _LINKS, _TEXT = range(3)


def pack_links(places: np.ndarray) -> bytes:
    """A multiset of places as distances between its sorted distinct values, and their numbers."""
    values, times = np.unique(places, return_counts=True)
    plain = np.concatenate([np.diff(values, prepend=0), times]).astype("<u4").tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    both = np.frombuffer(plain, "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _align(batches: Batches, byte_level: str, pieces: str, kind: pa.DataType, most: int, portion: int):
    align = aligner(byte_level, pieces)
    types = _TYPES | {"key": kind}
    serial = TaskContext.get().partitionId() << 34
    held: list[tuple[int, np.ndarray]] = []
    size = chunk = 0

    def rows(n: int, **columns):
        given = {name: pa.nulls(n, t) for name, t in types.items()} | columns
        return batch(given, types)

    def flush():
        """The open chunk: its links, then its distinct pairs."""
        nonlocal held, size, chunk
        if held:
            codes, places = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
            times = np.bincount(places, minlength=len(codes))
            ends = np.cumsum([len(c) for _, c in held])
            packed = [pack_links(p) for p in np.split(places, ends[:-1])]
            n, here = len(held), (TaskContext.get().partitionId() << 34) + chunk
            yield rows(n, kind=[_LINKS] * n, chunk=[here] * n, doc=[d for d, _ in held], links=packed)
            for low in range(0, len(codes), 100_000):
                part, n = codes[low : low + 100_000], min(100_000, len(codes) - low)
                yield rows(n, kind=[_PAIR] * n, chunk=[here] * n, place=range(low, low + n), code=part, times=times[low : low + n])
            held, size, chunk = [], 0, chunk + 1

    for some in dealt(batches, "text", portion):
        texts = [b" " + t if t else b"" for t in as_bytes(some.column("text"))]
        n, spelled, counts = len(texts), [], []
        found = _portions(align, texts[0], portion) if len(texts[0]) > portion + 1 else _texts(align, texts)
        for doc, parts in enumerate(found, serial):
            numbers = np.zeros(4, np.int64)
            for given, _, links in parts:
                numbers += [*given, len(links)]
                if len(links):
                    held.append((doc, links))
                    size += len(links)
                if size >= most:
                    yield from flush()
            counts.append(numbers)
            spelled.append(b";".join(p[1] for p in parts))
        n_a, n_b, n_groups, n_links = np.array(counts).T
        yield rows(
            n, kind=[_TEXT] * n, doc=range(serial, serial + n), key=some.column("key").cast(kind),
            n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups=pa.array(spelled, pa.string()),
        )
        serial += n
    yield from flush()


def align(
    docs: DataFrame,
    byte_level: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_links: int = 2_000_000,
    portion: int = PORTION,
) -> DataFrame:
    """Alignments of all texts, with what ``score`` needs.

    Rows of kind 2 are texts: ``key`` (the id), n_a and n_b (tokens), n_groups, n_links and
    ``groups``, spelled ``a1,a2|b1;a3|b2,b3`` by ids; those of kinds 0 and 1 are the pairs and links
    of a chunk of about ``chunk_links`` links. A text that is null, empty, or whose tokens of
    either tokenizer don't spell space and text has zeros and empty groups. Repeated rows and null
    ids are texts of their own; an empty table has no rows. Other columns are not read. Long
    texts are worked off in portions of about ``portion`` bytes that end at certain cuts.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    field = rows.schema["key"].dataType
    run = partial(_align, byte_level=byte_level, pieces=pieces, kind=to_arrow_type(field), most=chunk_links, portion=portion)
    schema = (
        "kind byte, chunk long, doc long, place int, code long, times long, links binary, "
        f"n_a long, n_b long, n_groups long, n_links long, groups string, key {field.simpleString()}"
    )
    return rows.mapInArrow(run, schema)


def _sums(batches: Batches):
    """From a chunk's counts and then its links: (doc, n_best, count_sum) for each row of links."""
    types = {"doc": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64()}
    chunk, counts, best = None, [], []
    for rows in batches:
        out: list[tuple[int, int, int]] = []
        chunks = rows.column("chunk").to_numpy()
        kinds = rows.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
        for low, high in pairwise([0, *edges.tolist(), rows.num_rows]):
            if low == high:
                continue
            if chunks[low] != chunk:
                chunk, counts, best = chunks[low], [], []
            part = rows.slice(low, high - low)
            if kinds[low] == _PAIR:
                counts.append(part.column("total").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            counts, best = [np.concatenate(counts)], [np.concatenate(best)]
            for doc, packed in zip(part.column("doc").to_pylist(), part.column("links").to_pylist(), strict=True):
                places, times = unpack_links(packed)
                out.append((doc, int(times[best[0][places]].sum()), int((times * counts[0][places]).sum())))
        yield batch(dict(zip(types, zip(*out))) if out else dict.fromkeys(types, []), types)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(code, total, best) of every id pair: its links in the corpus, and whether no other id of
    the first tokenizer has more links with its id of the second (at most one window row for
    each id of the first vocabulary, so groups are bounded)."""
    totals = aligned.where(F.col("kind") == _PAIR).groupBy("code").agg(F.sum("times").alias("total"))
    of_b = W.partitionBy(F.col("code") % size_b)
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def score(aligned: DataFrame, size_b: int, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``align`` with n_best and count_sum, over the counts of the whole corpus.

    ``aligned`` must be stored (see ``store``): chunks are drawn once. ``size_b`` is the size of
    the second vocabulary. Its other columns stay.
    """
    pairs = aligned.where(F.col("kind") == _PAIR).select("chunk", "place", "code")
    back = pairs.join(pair_counts(aligned, size_b), "code").select(
        "chunk", F.lit(_PAIR).cast("byte").alias("kind"), "place", F.lit(None).cast("long").alias("doc"), "total", "best", F.lit(None).cast("binary").alias("links")
    )
    links = aligned.where(F.col("kind") == _LINKS).select(
        "chunk", "kind", F.lit(0).alias("place"), "doc", F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "links"
    )
    met = back.unionByName(links).repartition("chunk").sortWithinPartitions("chunk", "kind", "place", "doc")
    sums = met.mapInArrow(_sums, "doc long, n_best long, count_sum long").groupBy("doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = aligned.where(F.col("kind") == _TEXT).drop("kind", "chunk", "place", "code", "times", "links")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.join(sums, "doc", "left").select(
        F.col("key").alias(id_col), *[c for c in texts.columns if c not in ("doc", "key")], zero("n_best"), zero("count_sum")
    )


def piece_count(pieces: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()


def store(aligned: DataFrame) -> DataFrame:
    """``aligned`` written to the shared folder, a folder for each kind of rows, and read again."""
    from leafmill.session import new_dir

    path = new_dir(aligned.sparkSession, "alignments")
    aligned.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return aligned.sparkSession.read.schema(aligned.schema).parquet(path)
