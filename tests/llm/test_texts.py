"""The operators over documents against plain Python, on whole odd texts."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination, near_duplicates, packing, personal_data, repeats, secret_scan, sharding


def windows(rows, least):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[s : s + least] for s in range(len(b) - least + 1))
    return seen


@pytest.mark.parametrize("most", [40_000, 0])  # with 0, every first digit is dealt out by window
def test_repeats(docs, rows, most):
    least = 200
    seen, want = windows(rows, least), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((i, len(b), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = repeats.remove_repeats(docs, most=most, together=3).collect()
    assert sorted(map(repr, want)) == sorted(
        repr((r.doc_id, r.n_bytes, [(x.start, x.end) for x in r.runs], bytes(r.kept))) for r in got
    )


def spans_of(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        ("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append(("card", *m.span()))
    out += [
        ("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return out


def test_personal_data(docs, rows):
    found = personal_data.find(docs, carry=docs.columns)
    got = personal_data.redact(found).collect()
    want = [(i, sorted(spans_of(t or ""))) for i, t in rows]
    base = [(r.row.doc_id, sorted((personal_data.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base)) for r in got]
    assert sorted(map(repr, want)) == sorted(map(repr, base))
    for r in got:
        if not r.spans:
            assert r.redacted == r.row.text
    assert any("<EMAIL>" in (r.redacted or "") for r in got)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@@a@b..c", "x@y.z_q@r.s", "1.2.3.4.5.6.7.8", "1" * 300, "+1+2345678901", "1-2 3" * 9, "a.b@-.-"])
def test_base_spans_of_odd_texts(text):
    got = sorted((personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text))
    assert got == sorted(spans_of(text))


@pytest.mark.parametrize("text", ["0" * 500 + "10.1.2.3", "1.2." + "0" * 6000 + ".255", "1.2.3." + "0" * 500 + "256", "9" * 6000 + ".1.2.3", "000.0.00.0"])
def test_zeros_before_an_ip_part_have_no_limit(text):
    least = re.sub("0+([0-9])", r"\1", text)  # int() of the other side refuses very long digits
    got = [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text) if k == 1]
    assert got == ([("ip", 0, len(text))] if least in ("10.1.2.3", "1.2.0.255", "0.0.0.0") else [])


def test_reliable_labelers_decide():
    good, bad = personal_data.code_of(3, False, (0, 1, 1, 1)), personal_data.code_of(2, False, (-1, -1, -1, -1))
    base = personal_data.code_of(3, True, (1, 1, 1, 1))
    import numpy as np

    accepted = personal_data.fit(np.array([good, bad, base]), np.array([20.0, 300.0, 200.0])).tolist()
    assert good in accepted and bad not in accepted


def test_secrets(docs, rows):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [
        ("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    ]
    want = [
        (i, sorted((m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(patterns) for m in re.finditer(p, t or "") if len(m[g]) >= least))
        for i, t in rows
    ]
    got = [(r.doc_id, [tuple(s) for s in r.secrets]) for r in secret_scan.scan(docs).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    assert sum(len(s) for _, s in want) >= 6


def test_secrets_sql(spark, docs, tmp_path):
    import duckdb

    from leafmill.llm import oracle, queries

    odd = ["PAſSWORD=longſecret", "toKen=abcdefgh", "toKen=abcdefgh", "é" * 9 + "AKIA" + "Z" * 12 + "AKIA12 aKIA" + "Q" * 20, "api_key api_key=API_KEY=secret:'x'", "f" * 31 + " " + "0" * 32 + "G" + "a" * 64]
    more = spark.createDataFrame([(100 + n, t) for n, t in enumerate(odd)], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_secret_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(oracle.ORACLE["op9_secret_scan"])
    assert [c[0] for c in want.description] == got.columns
    found = sorted(map(repr, (tuple(r) for r in got.collect())))
    assert found == sorted(map(repr, want.fetchall())) and sum("access:" in r for r in found) > 1


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    alternatives = secret_scan.trigram_query(secret_scan.RULES[0].pattern)
    assert frozenset({"api", "pi_", "i_k", "_ke", "key"}) in alternatives and frozenset({"api", "pik", "ike", "key"}) in alternatives
    assert secret_scan.trigram_query("ab(cd)?x*ef") is None


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [16_000_000, 150])  # one block, and many
def test_decontamination(spark, docs, rows, block_bytes):
    passage = dict(rows)[30].split("\n")[1].split(".")[0]
    items = [(1, passage), (2, "one two"), (2, "ONE"), (3, None), (4, "..."), (None, "one"), (5, " ".join(passage.split()[3:20])), (6, "not in any text at all")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, found string")
    wins = {}
    for i, t in items:
        w = words_of(t)
        if i is not None and w:
            for s in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, ids = words_of(t), set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                if found := wins.get(tuple(w[s : s + size])):
                    ids |= found
                    hit.update(range(s, s + size))
        want.append((i, len(w), len(hit), sorted(map(str, ids))))
    got = decontamination.mark(docs, bench, carry=docs.columns, block_bytes=block_bytes).collect()
    assert sorted(map(repr, want)) == sorted(
        repr((r.row.doc_id, r.found.n_words, sum(x.end - x.start for x in r.found.runs), list(r.found["items"]))) for r in got
    )
    assert sum(h > 0 for _, _, h, _ in want) >= 8


def test_items_may_have_text_ids(spark):
    docs = spark.createDataFrame([(1, "the old mill by the river stands"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([("b-17", "old mill"), ("9", "river stands"), ("10", "by the"), (None, "the river")], "item_id string, text string")
    got = {r.row.doc_id: (list(r.found["items"]), r.found.unnamed) for r in decontamination.mark(docs, bench).collect()}
    assert got == {1: (["10", "9", "b-17"], True), 2: ([], False)}


@pytest.mark.parametrize("block_bytes", [16_000_000, 20])
def test_benchmark_items_without_an_id_mark_words(spark, tmp_path, monkeypatch, block_bytes):
    import duckdb

    from leafmill.llm import oracle, queries

    long = " ".join(f"w{k}" for k in range(14))
    texts = [(1, f"see {long} end"), (2, "only here"), (3, "named too"), (4, None), (5, "nothing of it"), (6, f"only here {long}")]
    items = [(None, long), (None, "only here"), (7, "named too"), (7, "only here"), (None, None), (None, "..."), (None, long)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontamination.mark, "__defaults__", (*decontamination.mark.__defaults__[:-1], block_bytes))
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op5_decontamination"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == {r[0]: r for r in con.execute(oracle.ORACLE["op5_decontamination"]).fetchall()}
    assert {i: (r[2], r[3], r[5]) for i, r in got.items()} == {
        1: (14, 1, True), 2: (2, 2, True), 3: (2, 1, True), 4: (0, 0, False), 5: (0, 0, False), 6: (16, 2, True)
    }


def test_repeated_items_are_collected_once(spark, docs, monkeypatch):
    taken, made = [], decontamination.Block.__init__
    monkeypatch.setattr(decontamination.Block, "__init__", lambda self, items, *more: taken.append(len(items)) or made(self, items, *more))
    items = [(1, "one two")] * 300 + [(None, "one")] * 300 + [(k, f"only {k}") for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontamination.mark(docs, bench, block_bytes=500).filter("row.doc_id = 44").first()
    assert taken == [22]
    assert (got.found["items"], got.found.unnamed, [tuple(x) for x in got.found.runs]) == (["1"], True, [(0, 2)])


def linked(rows, width):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sets, group


@pytest.mark.parametrize(("width", "block_rows"), [(4, 800), (5, 800), (4, 1)])  # with 1, every class is a block
def test_near_duplicates(docs, rows, width, block_rows):
    sets, group = linked(rows, width)
    smallest = {}
    for (i, _), g in zip(rows, group, strict=True):
        smallest[g] = min((x for x in (i, smallest.get(g)) if x is not None), default=None)
    want = [(i, len(s), smallest[g], i == smallest[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)]
    found = near_duplicates.near_duplicates(docs, width=width, block_rows=block_rows)
    got = found.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.id, r.n_shingles, r.component_id, r.kept)) for r in got)
    once = near_duplicates.keep_one(docs, found, docs.columns)
    # Rows alike in id and text have one key; of texts without words all but such rows stay.
    keys = {(g if s else (i, t)) for (i, t), s, g in zip(rows, sets, group, strict=True)}
    assert once.count() == len(keys) and once.columns == docs.columns


def test_posterior_bounds():
    least = near_duplicates.least_matches(0.8, 1e-9)
    assert list(least) == sorted(least) and 0 < least[-1] < 0.8 * near_duplicates.HASHES


def test_packing(spark, docs, rows):
    import public_tokenizers as vocab
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, b"".join(x.to_bytes(4, "little") for x in ids)] += 1
    pieces = packing.pack(docs, vocab.path("byte_bpe_50k.json"), vocab.PATTERN, window=64, chunk_tokens=3000).collect()
    whole, sequences = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 1 <= p.length <= 64 and p.start + p.length <= p.doc_tokens
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        whole.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert sum(n * len(ids) for (_, ids), n in want.items()) == sum(4 * p.length for p in pieces)
    for (i, ids), n in want.items():
        if n == 1 and sum(1 for (j, x) in want if j == i and len(x) == len(ids)) == 1:
            assert b"".join(x for _, x in sorted(whole[i, len(ids) // 4])) == ids
    joined = b"".join(bytes(p.ids) for p in pieces)
    assert zlib.crc32(joined) and len(joined) == 4 * sum(p.length for p in pieces)


def test_ids_equal_the_library():
    import random

    import public_tokenizers as vocab
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["a", "B", "é", "ß", "'", "'s", "'re", "'t", " ", "  ", "\n", "\t", " \n", "12", "!", "_", "don't", "''s", "×", "—", "日本", "\x0c", "\xa0", "\0", "<|endoftext|>"]
    some = ["".join(r.choices(parts, k=r.randrange(16))) for _ in range(3000)]
    encode = packing.Encoder(vocab.path("byte_bpe_50k.json"), vocab.PATTERN)
    assert [x.tolist() for x in encode([t.encode() for t in some])] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_sharding(docs, rows):
    got = sharding.shard(docs, 6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        assert r.grown_shard in (r.shard, 6)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_jump_moves_only_into_the_new_shard():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(np.unique(after[before != after])) == {40} and 300 < (before != after).sum() < 700
    assert np.bincount(before).min() > 380


def test_empty_tables(spark, nothing, docs):
    import public_tokenizers as vocab

    bench = spark.createDataFrame([], "item_id long, text string")
    assert repeats.remove_repeats(nothing).count() == 0
    assert personal_data.redact(personal_data.find(nothing, carry=nothing.columns)).count() == 0
    assert secret_scan.scan(nothing).count() == 0
    assert near_duplicates.near_duplicates(nothing).count() == 0
    assert packing.pack(nothing, vocab.path("byte_bpe_50k.json"), vocab.PATTERN).count() == 0
    assert sharding.shard(nothing).count() == 0
    assert decontamination.mark(nothing, bench).count() == 0
    assert decontamination.mark(docs, bench).filter(F.size("found.runs") > 0).count() == 0


def test_hashes_are_stable():
    assert hashlib.sha256(near_duplicates.shingles(b"A b c d e", 4).tobytes()).hexdigest() == hashlib.sha256(
        near_duplicates.shingles(b"a\tb c  d E", 4).tobytes()
    ).hexdigest()
