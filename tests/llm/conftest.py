"""Documents with every odd case: nulls, empty and long texts, copies, repeats, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, found string, size int"


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(7)
    words = ["on", "the", "Mill", "leaf", "é", "stream", "of", "a", "under", "río", "stone", "x9", "bridge", "far"]

    def prose(n: int) -> str:
        return " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))

    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    far = [w if i % 6 else "z" + w for i, w in enumerate(base.split())]
    out = [(i, prose(r.randrange(1, 90))) for i in range(20)]
    out += [(20, base), (21, base), (22, " ".join(near)), (23, " ".join(far)), (24, base.upper())]
    out += [(30 + i, prose(15) + "\n" + passage + ". " + prose(15)) for i in range(6)]
    out += [(40, None), (41, ""), (42, "   \n\t"), (43, "one"), (44, "one two"), (45, "日本語 — ✓ 'tis don't\r\n")]
    out += [(46, "ab " * 4000), (47, "q" * 700), (48, prose(4000))]
    out += [(None, prose(30)), (None, base), (None, None), (2, prose(50)), (20, base), (43, "one")]
    out += [(50, "mail a.b@c.d_e@f.org or x@y, call +1 (206) 555-0142 at 10.0.0.300 and 192.168.1.20.7.8.9.1")]
    out += [(51, "card 4111 1111 1111 1111 4111-1111-1111-1112 ip 1.2.3.4 +12 me (at) here.com (206) 555-0199")]
    out += [(52, "Password: hunter22, api_key='ABCDEFGH' TOKEN==abcdefgh secret = short AKIAABCDEFGHIJKL"), (53, "deadbeef" * 5 + "é password=" + "0123456789abcdef" * 3)]
    out += [(54, "a<|endoftext|>b"), (55, "<|endoftext|><|endoftext|>"), (56, "the mill <|endoftext|>\n<|EndOfText|> é日<|endoftext|>")]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", f"src{k % 3}" if k % 7 else None, 0, "r", 1, "f", 2) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows, result):
    """Pairs each text's expected value with what came out, as sorted lists."""
    return sorted(map(repr, rows)), sorted(map(repr, result))
