"""The quality score against a plain count over small record sets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators import scoring

PLAIN = {"title": "t", "url": "u", "price": "p"}
GARBAGE = ["lorem ipsum", "placeholder", "test data", "click here", "read more", "loading..."]
ABSENT = {"", "N/A", "null", "undefined", "None", "-"}


def frame(spark, pages):
    rows = [(p, i, rec) for p, recs in pages.items() for i, rec in enumerate(recs)]
    return spark.createDataFrame(rows, "page_id long, rec_ord int, rec map<string,string>")


def present(v):
    return v is not None and v.strip() not in ABSENT


def field_ok(field, v):
    if not present(v):
        return True
    v = v.strip()
    if field == "url":
        return v.startswith(("http://", "https://")) and len(v.split("//", 1)[1]) > 0
    if field == "price":
        return any(c.isdigit() for c in v)
    return True


def expected(recs, identity):
    n, cells = len(recs), len(recs) * len(PLAIN)
    pairs = [(f, r.get(f)) for r in recs for f in PLAIN]
    fill = sum(present(v) for _, v in pairs) / cells
    basic = sum(
        present(v) and len(v.strip()) > 1 and v.strip().casefold() != f for f, v in pairs
    ) / cells
    sound = sum(field_ok(f, v) for f, v in pairs) / cells
    ids = {str(r.get(identity, "")).strip().casefold() for r in recs} - {""}
    unique = len(ids) / n
    content = 1 - sum(any(g in json.dumps(r).casefold() for g in GARBAGE) for r in recs) / n
    count = min(n / 5, 1.0)
    score = fill * 0.25 + basic * 0.2 + unique * 0.15 + content * 0.1 + sound * 0.2 + count * 0.1
    return {
        "score": round(min(max(score, 0.0), 1.0), 3),
        "fill_rate": round(fill, 3),
        "uniqueness": round(unique, 3),
        "confidence": round(min(1.0, 0.35 + 0.35 * count + 0.3 * sound), 3),
        "issues": [
            name
            for name, hit in (
                ("LOW_FILL_RATE", fill < 0.3), ("LOW_VALIDITY", basic < 0.3), ("MANY_DUPLICATES", unique < 0.5),
                ("GARBAGE_CONTENT", content < 0.5), ("SCHEMA_VALIDATION_FAILED", sound < 0.7), ("ONLY_ONE_RESULT", n == 1),
            )
            if hit
        ],
    }


def test_random_pages(spark):
    rng = random.Random(7)
    pool = {
        "title": ["A title", "a TITLE ", "title", "x", "", None, "Click Here now", "Straße", "STRASSE", "-"],
        "url": ["https://a.example/1", "http://b", "/rel", "https://", None, "N/A"],
        "price": ["$5", "free", "", None, "3 Placeholder"],
    }
    pages = {}
    for p in range(150):
        recs = []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rec = {f: rng.choice(vs) for f, vs in pool.items() if rng.random() < 0.85}
            if rng.random() < 0.2:
                rec["extra"] = "Lorem IPSUM"
            recs.append(rec)
        pages[p] = recs
    got = {r["page_id"]: r for r in scoring.score_records(frame(spark, pages), PLAIN).collect()}
    assert len(got) == len(pages)
    for p, recs in pages.items():
        want = expected(recs, "title")
        row = got[p]
        assert row["score"] == want["score"], (p, recs)
        assert row["components"]["uniqueness"] == want["uniqueness"], recs
        assert row["fill_rate"] == want["fill_rate"]
        assert row["confidence"] == want["confidence"]
        assert row["uncertainty"] == round(1 - want["confidence"], 3)
        assert row["issues"] == want["issues"]


def test_no_records(spark):
    pages = spark.createDataFrame([(1, "u"), (2, "v")], "page_id long, url string")
    out = scoring.score_records(frame(spark, {2: [{"title": "x y"}]}), PLAIN, pages)
    row = out.where("page_id = 1").first()
    assert (row["score"], row["confidence"], row["uncertainty"], row["issues"]) == (0.0, 0.0, 1.0, ["NO_RESULTS"])
    assert row["results_count"] == 0 and row["url"] == "u" and row["validation_errors"] == []


def test_good_beats_garbage(spark):
    good = [{"title": f"Item {i}", "url": f"https://e.example/{i}", "price": f"${i}"} for i in range(5)]
    bad = [{"title": "placeholder", "url": "bad", "price": "none given"}] * 2
    out = {r["page_id"]: r for r in scoring.score_records(frame(spark, {1: good, 2: bad}), PLAIN).collect()}
    assert out[1]["components"]["deterministic_validation"] == 1.0
    assert out[1]["score"] > out[2]["score"]
    assert {"GARBAGE_CONTENT", "SCHEMA_VALIDATION_FAILED"} <= set(out[2]["issues"])
    assert out[2]["validation_errors"] == ["price:missing_number", "url:invalid_url"]


def test_out_of_range(spark):
    schema = {
        "rating": {"type": "number", "min": 0, "max": 5, "required": True},
        "url": {"type": "url", "required": True},
    }
    recs = {1: [{"rating": "99", "url": "https://e.example"}], 2: [{}]}
    out = {r["page_id"]: r for r in scoring.score_records(frame(spark, recs), schema).collect()}
    assert out[1]["validation_errors"] == ["rating:above_maximum"] and out[1]["score"] < 0.9
    assert out[2]["validation_errors"] == ["rating:required", "url:required"]


def test_missing_key_is_empty_but_null_is_none(spark):
    recs = {1: [{"title": None}, {"title": "none"}, {}, {"title": " "}]}
    row = scoring.score_records(frame(spark, recs), {"title": "t"}).first()
    assert row["components"]["uniqueness"] == 0.25


def test_whole_records_identify_without_an_identity_field(spark):
    recs = {1: [{"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1"}]}
    row = scoring.score_records(frame(spark, recs), {"a": "x"}).first()
    assert row["components"]["uniqueness"] == round(2 / 3, 3)


def test_one_hot_page(spark):
    """A page with most of all records, over many partitions."""
    rows = spark.range(0, 20_000, numPartitions=9).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("page_id"),
        F.lit(0).alias("rec_ord"),
        F.create_map(F.lit("title"), F.concat(F.lit("t"), F.col("id") % 5000)).alias("rec"),
    )
    row = scoring.score_records(rows, {"title": "t"}).where("page_id = 0").first()
    assert row["results_count"] == 14_000 + 0
    titles = {i % 5000 for i in range(20_000) if i % 10 < 7}
    assert row["components"]["uniqueness"] == round(len(titles) / 14_000, 3)


def test_retry_and_strategy(spark):
    rows = [(1, 0.59, ["GARBAGE_CONTENT", "NO_RESULTS"]), (2, 0.6, []), (3, 0.1, ["MANY_DUPLICATES"]), (4, 0.1, ["LOW_VALIDITY"])]
    q = spark.createDataFrame(rows, "page_id long, score double, issues array<string>")
    out = {r["page_id"]: r for r in scoring.retry_strategy(scoring.should_retry(q)).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1]["wait_seconds_adjust"] == 3.0 and out[1]["extra_instructions"].startswith("Look for repeated")
    assert out[3]["extra_instructions"].startswith("Return each source record once")
    assert out[4]["extra_instructions"] == "" and out[4]["wait_seconds_adjust"] == 0.0
    assert scoring.should_retry(q, attempt=1).count() == 0


@pytest.mark.parametrize("candidate, accepted", [(0.55, True), (0.54, False), (None, False)])
def test_retry_is_kept_for_a_measured_gain_only(spark, candidate, accepted):
    base = spark.createDataFrame([(1, 0.5)], "page_id long, score double")
    new = spark.createDataFrame([] if candidate is None else [(1, candidate)], "page_id long, score double")
    choice = scoring.choose_refined(base, new)
    gain = candidate is not None and candidate - 0.5 >= 0.05
    assert choice.first()["accepted"] == gain == accepted
    old_recs = spark.createDataFrame([(1, "old")], "page_id long, rec string")
    new_recs = spark.createDataFrame([(1, "new")], "page_id long, rec string")
    kept = scoring.kept_records(choice, old_recs, new_recs).collect()
    assert [r["rec"] for r in kept] == ["new" if accepted else "old"]


def test_schema_per_row_in_one_scan(spark, tmp_path):
    """All known schemas and one without fields: as each schema by itself, from one scan."""
    schemas = {**fv.SCHEMAS, "NONE": {}, "WIDE": {f"price_{i}": "Price" for i in range(70)}}
    values = ["", "x", "12.5", "-3", "soon", "not an email", "a@b.example", "https://x.example/p", "2024-01-15", "click here", None]
    draw = random.Random(5)
    rows = []
    for key, schema in [*schemas.items(), ("UNKNOWN", {"a": "A"}), (None, {"a": "A"})]:
        for page in range(4):
            for _ in range(draw.randrange(1, 6)):
                rec = {f: draw.choice(values) for f in schema if draw.random() < 0.8}
                rows.append((key, page, rec))
    ddl = "schema_key string, page_id long, rec map<string,string>"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    out = scoring.score_by_schema(records, schemas)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1
    got = {(r.schema_key, r.page_id): r.asDict(recursive=True) for r in out.collect()}
    assert len(got) == 4 * len(schemas)
    for key in ("NONE", "WIDE", *list(fv.SCHEMAS)[:3]):
        for r in scoring.score_records(records.where(F.col("schema_key") == key), schemas[key]).collect():
            assert {**r.asDict(recursive=True), "schema_key": key} == got[key, r.page_id]
    pages = spark.createDataFrame([("NONE", 9, "u"), ("UNKNOWN", 1, "v")], "schema_key string, page_id long, url string")
    alone = scoring.score_by_schema(records, schemas, pages).collect()
    assert [(r.schema_key, r.page_id, r.url, r.score, r.issues) for r in alone] == [("NONE", 9, "u", 0.0, ["NO_RESULTS"])]
