"""Encoding by byte-pair merges with word ends, and decoding, fragment by fragment.

Method: forced boundaries. A table of 256 x 256 says which byte pairs occur inside any token of
the vocabulary (its added tokens included). A pair that never does is a certain cut. It is used
twice: texts are cut into fragments where the pair is absent from the table and the pattern
that makes words always ends a word there; and every word is cut again at each absent pair, so
that merges run over the shortest possible pieces, of which only the last bears the word end.
Each distinct fragment is encoded once and the ids are concatenated.

Pairs at which the pattern always ends a word (ASCII only, others are left alone): beside white
space or a digit, between a letter and another sign, and between any sign but an apostrophe
and a letter. The case is folded before the table is asked, as the vocabulary does.

One scan, no shuffle; a lost task is repeated alone. Long texts are worked off in portions that
end at certain cuts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import Batches, as_bytes
from leafmill.llm.fragments import byte_alphabet, dealt, fragments, pair_table, portions, spread

_L, _N, _P, _S, _X = range(5)
#: Fragments of more bytes don't stay in the memo; texts are worked off in portions of this size.
LONG, PORTION = 256, 4_000_000


def _word_ends() -> np.ndarray:
    """``table[a, b]``: a word of the pattern ends between ASCII bytes a and b in any context."""
    kind = np.full(256, _X)
    kind[:128] = _P
    kind[[*range(65, 91), *range(97, 123)]] = _L
    kind[48:58] = _N
    kind[[9, 10, 11, 12, 13, 32]] = _S
    a, b = np.meshgrid(kind, kind, indexing="ij")
    ends = (a == _S) | (b == _S) | (a == _N) | (b == _N) | ((a == _L) & (b == _P)) | ((a == _P) & (b == _L))
    ends[ord("'"), kind == _L] = False
    return ends


class Codec:
    """Ids and decoded text of whole batches of texts, as the library gives them for each text alone.

    ``vocabulary`` is a tokenizer file with a byte-level alphabet, the pattern of words that
    ``_word_ends`` describes, case folding and a word-end mark. The memo is bounded.
    """

    def __init__(self, vocabulary: str, memo: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(vocabulary)
        mark = model["end_of_word_suffix"]
        #: Two readings of the same merges: the last piece of a word bears the mark, others don't.
        rules = {"vocab": model["vocab"], "merges": list(map(tuple, model["merges"])), "cache_capacity": 0}
        self.last, self.inner = models.BPE(**rules, end_of_word_suffix=mark), models.BPE(**rules)
        byte_of = byte_alphabet()
        spelled = {t: t.removesuffix(mark) if t != mark else t for t in model["vocab"]}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [bytes(map(byte_of.get, s)) for t, s in spelled.items() if t not in added]
        inside = self.inside = pair_table([*plain, *(t.encode() for t in added)])
        self.joined = {x + y for x, i in byte_of.items() for y, j in byte_of.items() if inside[i, j]}
        fold = np.arange(256)
        fold[65:91] += 32
        exact = inside | pair_table(t.encode() for t in added)
        #: A cut is certain where the pair is inside no token, as written and with its case folded.
        self.cut = _word_ends() & ~inside[np.ix_(fold, fold)] & ~exact
        self.added = {t.encode(): i for t, i in added.items()}
        self.splitter = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if added else None
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.alphabet = {b: c for c, b in byte_of.items()}
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.most = memo

    def cuts(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data), bool)
        out[1:] = self.cut[data[:-1], data[1:]]
        return out

    def _word(self, word: str) -> list[int]:
        ids, low = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                ids += [t.id for t in self.inner.tokenize(word[low:i])]
                low = i
        return ids + [t.id for t in self.last.tokenize(word[low:])]

    def _fragment(self, fragment: bytes) -> list[int]:
        ids: list[int] = []
        for part in self.splitter.split(fragment) if self.splitter else [fragment]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                text = part.decode("utf-8", "replace")
                if self.library.normalizer is not None:
                    text = self.library.normalizer.normalize_str(text)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
                    ids += self._word(word)
        return ids

    def _keep(self, fragment: bytes, ids: list[int]) -> None:
        self.memo[fragment] = array("i", ids).tobytes(), " ".join([self.names[i] for i in ids]).encode()

    def _learn(self, unknown: list[bytes]) -> None:
        """Encode fragments into the memo. Plain Latin letters are one word each, with nothing to
        normalise but the case, and the table is asked for all of them at once."""
        words, texts = [], []
        for fragment in unknown:
            text = fragment.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0130":
                words.append(fragment)
                texts.append(text.lower().encode())
            else:
                self._keep(fragment, self._fragment(fragment))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        absent = np.zeros(len(data), bool)
        absent[1:] = ~self.inside[data[:-1], data[1:]]
        absent[ends[:-1]] = False
        cut = np.diff(np.append(0, np.cumsum(absent))[np.append(0, ends)]) > 0
        for fragment, text, split in zip(words, texts, cut.tolist(), strict=True):
            word = text.decode("latin-1").translate(self.alphabet)
            self._keep(fragment, self._word(word) if split else [t.id for t in self.last.tokenize(word)])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids, where each text's ids begin (one more entry for the end), decoded texts."""
        if len(self.memo) > self.most:
            self.memo.clear()
        distinct, index, bounds = fragments(texts, self.cuts)
        self._learn([d for d in distinct if d not in self.memo])
        known = list(map(self.memo.__getitem__, distinct))
        for fragment in distinct:
            if len(fragment) > LONG:
                del self.memo[fragment]
        spoken = np.fromiter((len(k[0]) > 0 for k in known), bool, len(known))[index]
        index, bounds = index[spoken], np.append(0, np.cumsum(spoken))[bounds]
        ids, begins = spread([k[0] for k in known], index, np.int32)
        words = list(map([k[1] for k in known].__getitem__, index.tolist()))
        at = bounds.tolist()
        return ids, begins[bounds], [b" ".join(words[low:high]) for low, high in zip(at, at[1:])]


@cache
def codec(vocabulary: str) -> Codec:
    """One for each worker process."""
    return Codec(vocabulary)


def _encode(batches: Batches, vocabulary: str, kind: pa.DataType, portion: int):
    coder = codec(vocabulary)
    for rows in dealt(batches, "text", portion):
        texts = as_bytes(rows.column("text"))
        if len(texts) > 1 or len(texts[0]) <= portion:
            ids, begins, decoded = coder(texts)
        else:  # one long text
            parts = [coder([p]) for p in portions(texts[0], coder.cuts, portion)]
            ids = np.concatenate([p[0] for p in parts])
            begins = np.array([0, len(ids)])
            decoded = [b" ".join(d for p in parts for d in p[2] if d)]
        lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([rows.column("key").cast(kind), lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", portion: int = PORTION) -> DataFrame:
    """``id_col``, ids (array<int>), decoded: each text's ids and the text they decode to.

    As the library encodes without special tokens of its own, truncation and padding: an added
    token written in a text is that token. Decoding joins the token names as the library does
    without a decoder. A null or empty text, or one of white space alone, has no ids and decodes
    to an empty text. Every row gives one row, repeated rows and null ids included; an empty
    table gives none. Other columns are not read, whatever their names. Texts may have any
    length: they are worked off in portions of about ``portion`` bytes, but a stretch without any certain
    cut (one letter a million times) is encoded as a whole.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    field = rows.schema["key"].dataType
    run = partial(_encode, vocabulary=vocabulary, kind=to_arrow_type(field), portion=portion)
    out = rows.mapInArrow(run, f"key {field.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", id_col)
