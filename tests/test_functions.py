"""Scalar functions against the standard library on many small values."""

import itertools
import json
import math
import random
from datetime import datetime
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.numbers import round_exact
from leafmill.functions.validate import field_error, possible_errors


def column(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["r"] for r in df.select(expr(F.col("v")).alias("r")).collect()]


def test_round_exact_is_round(spark):
    rng = random.Random(1)
    xs = [rng.random() for _ in range(3000)] + [(m + 0.5) / 1000 for m in range(1000)]
    xs += [a / b for b in range(1, 60) for a in range(b + 1)]
    xs += [math.nextafter((m + 0.5) / 1000, d) for m in range(1000) for d in (0, 1)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", round_exact(F.col("x")).alias("r")).collect():
        assert r["r"] == round(r["x"], 3)


def test_strip_is_pythons_strip(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [b + "x" + b + "y" + b for b in blanks] + ["", " ", "\u200bx"]
    assert column(spark, values, T.strip) == [v.strip() for v in values]


def test_case_folding_joins_the_same_texts(spark):
    letters = [chr(c) for c in range(0x20, 0x2FA1D) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    folded = dict(zip(letters, column(spark, letters, T.fold_case)))
    ours, theirs = {}, {}
    for c in letters:
        ours.setdefault(folded[c], set()).add(c)
        theirs.setdefault(c.casefold(), set()).add(c)
    wrong = {frozenset(x) for x in ours.values()} ^ {frozenset(x) for x in theirs.values()}
    assert wrong == set()


def test_url_domain(spark):
    values = [
        "https://User:pw@Host.example:80/a?b#c", "//host/x", "no url", "http://a b/c", "mailto:x@y",
        "http:///x", "https://h?q", "https://h#f", "",
    ]
    assert column(spark, values, T.url_domain) == [urlparse(v).netloc for v in values]


def test_redact_url(spark):
    expected = {
        "https://user:secret@example.com/path?token=x#frag": "https://example.com/path",
        "HTTP://EXAMPLE.com:8080/A/B": "http://example.com:8080/A/B",
        "https://h:0/x": "https://h/x",
        "https://h:/x": "https://h/x",
        "https://h:99999/": "<invalid-url>",
        "https://h:x/": "<invalid-url>",
        "https://[::1]:443/x": "https://::1:443/x",
        "https://[::1/x": "<invalid-url>",
        "/only/path?q": "/only/path",
        "relative/path": "relative/path",
        "": "",
        "mailto:someone@example.com": "mailto:someone@example.com",
        "//host/x": "//host/x",
        "https://h": "https://h",
        "https://a@b@c/d": "https://c/d",
        "https://h:080/": "https://h:80/",
        "https://h:0000000080/y": "https://h:80/y",
    }
    assert column(spark, list(expected), T.redact_url) == list(expected.values())


@pytest.mark.parametrize(
    "raw, masked",
    [
        ("Authorization: Bearer abc.DEF-1~", "Authorization=<redacted> <redacted>"),
        ("x bEaReR tok/en+1 y", "x Bearer <redacted> y"),
        ("api-key = abc, token:xyz;", "api-key=<redacted>, token=<redacted>;"),
        ("APIKEY: k", "APIKEY=<redacted>"),
        ("mytoken=1 password =2", "mytoken=1 password=<redacted>"),
        ("étoken=1", "étoken=1"),
        ("sk-abcdefghijkl ghp_short xoxb-123456789012x", "<redacted> ghp_short <redacted>"),
        ("nothing here", "nothing here"),
    ],
)
def test_redact_text(spark, raw, masked):
    assert column(spark, [raw], T.redact_text) == [masked]
    df = T.redact_column(spark.createDataFrame([(raw,)], "v string"), "v").first()
    assert df["v"] == masked
    assert (df["bearer_hits"] + df["assignment_hits"] + df["prefix_hits"] > 0) == (raw != masked)


def test_presence(spark):
    values = [None, "", "  ", "N/A", " null ", "undefined", "None", "-", "--", "n/a", "0", "false"]
    absent = {"", "N/A", "null", "undefined", "None", "-"}
    assert column(spark, values, T.is_present) == [
        v is not None and v.strip() not in absent for v in values
    ]


def test_schema_name(spark):
    assert T.schema_name_of(["url", "price", "title", "name", "age"]) == "age_name_price_title"
    row = spark.range(1).select(T.schema_name(F.array(*[F.lit(x) for x in "edcba"])).alias("n")).first()
    assert row["n"] == "a_b_c_d"


def test_links(spark):
    base = "https://shop.example/list/page?x=1"
    links = ["/a", "b", "../c", "?q=1", "#f", "//cdn.example/d", "https://x.example/", "http://y/", "mailto:m", "httpx", "", None]
    df = spark.createDataFrame(
        [(base, {"url": v, "other": "/stay", "website": "/w"}) for v in links],
        "url string, rec map<string,string>",
    )
    plain = [r["rec"] for r in T.resolve_links(df).collect()]
    for v, rec in zip(links, plain):
        absolute = not v or v.startswith(("http://", "https://"))
        assert rec["url"] == (v if absolute else urljoin(base, v))
        assert rec["other"] == "/stay" and rec["website"] == "/w"
    compat = [r["rec"] for r in T.resolve_links(df, compat=True).collect()]
    for v, rec in zip(links, compat):
        assert rec["url"] == (v if not v or v.startswith("http") else urljoin(base, v))
        assert rec["website"] == urljoin(base, "/w")
    order = T.resolve_links(df).select(F.map_keys("rec").alias("k")).first()["k"]
    assert sorted(order) == ["other", "url", "website"]


def errors(spark, field, spec, values):
    return column(spark, values, lambda c: field_error(field, c, spec))


def test_field_errors(spark):
    assert errors(spark, "image_url", None, ["https://a", "HTTP://a", "ftp://a", "/x", "https://", None]) == [
        None, None, "invalid_url", "invalid_url", "invalid_url", None,
    ]
    assert errors(spark, "Email", None, ["a@b.c", "a b@c.d", "a@b", "a@@b.c"]) == [
        None, "invalid_email", "invalid_email", "invalid_email",
    ]
    assert errors(spark, "price", None, ["$5", "free", "- 5", "a - 5", "5-6", "x-5"]) == [
        None, "missing_number", "negative_value", "negative_value", None, None,
    ]
    assert errors(spark, "rooms", None, ["3", "-2 rooms", "minus", "-1,5"]) == [
        None, "negative_value", None, "negative_value",
    ]
    rated = {"type": "number", "required": True, "min": 0, "max": 5}
    assert errors(spark, "rating", rated, ["99", "-1", "5", "x", "", None, "1_0", "5d", "1e0", "nan"]) == [
        "above_maximum", "below_minimum", None, "invalid_number", "required", "required",
        "above_maximum", "invalid_number", None, None,
    ]
    assert errors(spark, "note", None, ["anything", None]) == [None, None]


def test_branch_depends_on_name_and_type():
    assert possible_errors("updated") == ["implausible_date"]
    assert possible_errors("available_from") == ["implausible_date"]
    assert possible_errors("email_url") == ["invalid_url"]
    assert possible_errors("rating", {"type": "number"})[0] == "invalid_number"
    assert possible_errors("title", {"required": True}) == ["required"]


def plausible(value):
    import re

    try:
        datetime.fromisoformat(value.replace("Z", "+00:00"))
        return True
    except ValueError:
        loose = r"\b(?:19|20)\d{2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
        return bool(re.search(loose, value))


def test_dates_are_those_the_standard_library_reads(spark):
    days = ["1850-01-31", "1850-02-30", "18500131", "18501331", "0000-01-01", "1850-W53", "1848-W53-5", "1853-W53-1", "1850W011", "1850-1-1", "185001", "1850"]
    times = ["", "T10", "T25", " 10:30", "x10:30:15", "T10:30:15.123456", "T103015", "T10:30Z", "T10:30+02:00", "T10:30+2", "T10:60"]
    values = [d + t for d, t in itertools.product(days, times)]
    values += ["soon", "12/31/99", "in 2024", "x2024", "1.2.2024", "20240101", "2024-01-01"]
    got = errors(spark, "date", None, values)
    wrong = [(v, e) for v, e in zip(values, got) if (e is None) != plausible(v)]
    assert wrong == []


def test_json_text_of_prompts_is_plain_json():
    from leafmill import fixed_values as fv

    assert "\\u20ac" in json.dumps(fv.SCHEMAS["RESTAURANTS"], indent=2)


def test_ports_with_leading_zeros(spark):
    urls = ["http://a.org:0000000080/x", "http://a.org:00000000000/x", "http://a.org:0000065536/", "http://a.org:" + "9" * 30 + "/"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", T.redact_url(F.col("u")).alias("r"))
    assert [r.r for r in got.orderBy("i").collect()] == ["http://a.org:80/x", "http://a.org/x", "<invalid-url>", "<invalid-url>"]
