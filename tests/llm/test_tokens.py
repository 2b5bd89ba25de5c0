"""The operators over tokenizers against the libraries themselves, text by text."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from leafmill.llm import alignment, bpe
from leafmill.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")

#: Signs at which patterns, normalisation or added tokens could make a cut wrong.
ODD = [
    *"abcXYZ 12.,!?<|>=\n\t'_-é", "'s", "'ll", "'RE", "’s", "́", "̸", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "日本", "İ", "K", "ﬀ",
    "\u0085", " ", "　", "▁", "\x00", "\x1c", "😀", "‍", "ß", "Σ", "Å", "१", "½", "²", "word", "Straße", " the", "\r\n", "≠",
]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(WORDS)
    out.no_truncation()
    out.no_padding()
    return out


def test_ids_and_decoded_texts_equal_the_library(library):
    coder = bpe.Codec(WORDS, memo=500)  # the memo is emptied again and again
    texts = odd_texts(6000)
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        ids, begins, decoded = coder([t.encode() for t in some])
        for i, t in enumerate(some):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[begins[i] : begins[i + 1]].tolist() == want, t
            assert decoded[i].decode() == library.decode(want, skip_special_tokens=False), t


def test_cut_pairs_are_inside_no_token(library):
    coder = bpe.Codec(WORDS)
    inside = {t.removesuffix("</w>")[i : i + 2] for t in library.get_vocab() for i in range(len(t.removesuffix("</w>")) - 1)}
    for a in range(33, 127):
        for b in range(33, 127):
            if coder.cut[a, b]:
                assert chr(a).lower() + chr(b).lower() not in inside
    assert coder.cut[ord("d"), ord(".")] and not coder.cut[ord("'"), ord("s")] and not coder.cut[ord("t"), ord("|")]


@pytest.mark.parametrize("portion", [1 << 12, 4_000_000])
def test_round_trip_of_whole_documents(docs, rows, library, portion):
    got = [(r.doc_id, r.ids, r.decoded) for r in bpe.encode(docs, WORDS, portion=portion).collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_very_long_texts_go_in_portions(library):
    coder = bpe.codec(WORDS)
    text = ("The mill'll stop 24 times, <|endoftext|>said río-José. " * 20_000)[:900_000]
    parts = list(bpe.portions(text.encode(), coder.cuts, 200_000))
    assert b"".join(parts).decode() == text and max(map(len, parts)) <= 200_000 + 8 and len(parts) > 2
    ids = [i for p in parts for i in coder([p])[0].tolist()]
    assert ids == library.encode(text, add_special_tokens=False).ids
    whole = b"\xc3\xa9" * 3000  # no cut at all
    assert list(bpe.portions(whole, coder.cuts, 1000)) == [whole]


def test_bpe_query(spark, library, tmp_path):
    texts = [*odd_texts(300, 9), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in QUERIES["op13_bpe_roundtrip"](spark, str(tmp_path)).collect()) == want


def test_no_documents(nothing):
    assert bpe.encode(nothing, WORDS).collect() == []


BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The alignment of one text, token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.a = Tokenizer.from_file(BYTE_LEVEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        assert decoders.ByteLevel().decode(["\u0120a"]) == " a"

    def __call__(self, text):
        if not text:
            return [], [], [], []
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spelled_a = [bytes(map(self.byte.get, self.a.id_to_token(i))) for i in a]
        pieces = list(map(self.b.id_to_piece, b))
        spelled_b = [bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("\u2581", " ").encode() for p in pieces]
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            return [], [], [], []
        spans = []
        for tokens in (spelled_a, spelled_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [
            ([i for i, (_, e) in zip(a, spans[0]) if low < e <= high], [j for j, (_, e) in zip(b, spans[1]) if low < e <= high])
            for low, high in zip([0, *common], common)
        ]
        links = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (x, y) in zip(b, spans[1]) if s < y and x < e]
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def spelled_groups(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected_alignments(plain, texts):
    """Rows as the query returns them, the id first."""
    found = {t: plain(t) for t in dict.fromkeys(texts)}
    counts = Counter(link for t in texts for link in found[t][3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    for i, t in enumerate(texts):
        a, b, groups, links = found[t]
        digest = hashlib.sha256(spelled_groups(groups).encode()).hexdigest() if a else ""
        tops = sum(counts[link] == best[link[1]] for link in links)
        yield i, len(a), len(b), len(groups), len(links), tops, sum(counts[link] for link in links), digest


def test_alignment_query(spark, plain, tmp_path, rows):
    texts = [*odd_texts(400, 3), *(t and t[:400] for _, t in rows), "a\u2581b", "the mill", "the mill", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()))
    assert got == list(expected_alignments(plain, texts))
    assert any(r[1] and r[5] < r[4] for r in got) and ("a\u2581b" in texts and got[texts.index("a\u2581b")][1:5] == (0, 0, 0, 0))


def test_alignment_in_small_chunks_and_portions(spark, plain, docs, rows):
    """Chunks of a few links and portions of a few bytes, so that texts and chunks are split."""
    aligned = alignment.store(alignment.align(docs, BYTE_LEVEL, PIECES, chunk_links=700, portion=900))
    got = alignment.score(aligned, alignment.piece_count(PIECES)).collect()
    cut = [(i, t if t is None or len(t) < 6000 else None) for i, t in rows]  # the longest ones are too slow to compare
    want = {t: spelled_groups(plain(t)[2]) for _, t in cut if t}
    size = {t: len(plain(t)[3]) for t in want}
    known = [(repr(i), want[t], size[t]) for i, t in cut if t]
    found = Counter((repr(r.doc_id), r.groups, r.n_links) for r in got)
    assert not Counter(known) - found
    assert len(got) == len(rows) and sum(r.n_a == 0 for r in got) == sum(not t for _, t in rows)
    whole = alignment.score(alignment.store(alignment.align(docs, BYTE_LEVEL, PIECES)), alignment.piece_count(PIECES)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, whole))


def test_no_documents_to_align(spark, nothing):
    aligned = alignment.store(alignment.align(nothing, BYTE_LEVEL, PIECES))
    assert alignment.score(aligned, 32000).collect() == []
