"""Requests and responses."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators import requests, responses, scoring
from leafmill.plans import extraction

FENCE = "```"


def parsed(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "page_id long, raw_output string")
    return {r["page_id"]: r for r in responses.parse_responses(df).collect()}


RAWS = [
    f'{FENCE}json\n[{{"a": 1}}]\n{FENCE}', f'{FENCE}{{"a": 1}}{FENCE}', ' {"a": null, "b": {"c": [1, 2]}} ', "not json", "", None, " \n",
    "[1]", '[{"a": 1}, 2]', "[]", '"text"', "3", "null", "[null]", '[{"a":1}] x', '{"a":1} {"a":2}', '{"a": 1, "a": 2}',
    f"{FENCE}", f"{FENCE}\n{FENCE}", f'{FENCE}\n[{{"a": "x{FENCE}"}}]', '["{x"]', "{", "true", '[[{"a":1}]]', '[{"a":1},{"b":2}]',
]


def loaded(raw):
    """What the text of a response stands for, by the standard library."""
    if raw is None or not raw.strip():
        return "LLMExtractionError"
    body = raw.strip()
    if body.startswith(FENCE):
        if "\n" in body:
            body = body.split("\n", 1)[1].rstrip()
        else:
            body = body.removeprefix(FENCE)
        body = body.removesuffix(FENCE).strip()
    try:
        value = json.loads(body)
    except json.JSONDecodeError:
        return "LLMParseError"
    value = [value] if isinstance(value, dict) else value
    if not isinstance(value, list) or any(not isinstance(v, dict) for v in value):
        return "LLMExtractionError"
    return [set(v) for v in value]


def test_responses_are_read_as_json_is(spark):
    got = parsed(spark, RAWS)
    for i, raw in enumerate(RAWS):
        want = loaded(raw)
        row = got[i]
        if isinstance(want, str):
            assert (row["error_type"], row["records"]) == (want, None), raw
        else:
            assert row["error_type"] is None and [set(r) for r in row["records"]] == want, raw


def test_values(spark):
    row = parsed(spark, ['{"a": null, "b": {"c": [1, 2]}, "d": 1.50, "e": true, "f": "x"}'])[0]["records"][0]
    assert row["a"] is None and json.loads(row["b"]) == {"c": [1, 2]} and row["e"] == "true" and row["f"] == "x"


def test_records_keep_response_order_and_get_absolute_links(spark):
    df = spark.createDataFrame([(1, '[{"z":"1","url":"/p"},{"a":"2"}]'), (2, "bad")], "page_id long, raw_output string")
    pages = spark.createDataFrame([(1, "https://e.example/list"), (2, "https://e.example/")], "page_id long, url string")
    rows = responses.response_records(responses.parse_responses(df), pages).orderBy("rec_ord").collect()
    assert [(r["page_id"], r["rec_ord"], json.loads(r["rec_json"])) for r in rows] == [
        (1, 0, {"z": "1", "url": "https://e.example/p"}), (1, 1, {"a": "2"}),
    ]
    failed = responses.response_failures(responses.parse_responses(df)).collect()
    assert [(r["page_id"], r["error_type"], r["component"]) for r in failed] == [(2, "LLMParseError", "llm")]


def test_usage_falls_back_to_the_other_names(spark):
    df = spark.createDataFrame([(1, 10, 99, 4, "m"), (2, None, 7, 1, "m"), (3, 0, 5, 0, "m")], "page_id long, prompt_tokens long, input_tokens long, completion_tokens long, model string")
    pages = spark.createDataFrame([(i, "https://e.example/") for i in (1, 2, 3)], "page_id long, url string")
    row = responses.usage_tally(df, pages).first()
    assert (row["domain"], row["requests"], row["input_tokens"], row["output_tokens"]) == ("e.example", 3, 22, 5)


def test_text_answers(spark):
    df = spark.createDataFrame([(1, " Use the list below the fold. "), (2, "  "), (3, None), (4, "x" * 20), (5, "x" * 21)], "page_id long, raw_output string")
    out = responses.text_answers(df)
    got = {r["page_id"]: (r["answer"], r["error_type"]) for r in out.collect()}
    assert got[1] == ("Use the list below the fold.", None)
    assert got[2] == got[3] == (None, "LLMExtractionError")
    assert {r["page_id"] for r in responses.refinement_candidates(out).collect()} == {1, 5}


SCHEMA = {"price_range": "Price level (€, €€)", "rating": {"type": "number", "max": 5}}


def test_extraction_request(spark):
    text = "ä" * 60
    pages = spark.createDataFrame([(1, text)], "page_id long, text string")
    row = requests.extraction_requests(pages, SCHEMA, F.lit("Only prices."), 50).first()
    assert row["system_prompt"] == (
        "You are a precise data extraction engine. Extract structured data from the provided content. "
        "Output only a valid JSON array of objects matching this schema:\n"
        + json.dumps(SCHEMA, indent=2) + "\n\nAdditional instructions:\nOnly prices."
    )
    assert (row["user_content"], row["content_chars"], row["truncated"]) == ("ä" * 50, 50, True)
    bare = requests.extraction_requests(pages, SCHEMA).first()
    assert bare["system_prompt"].endswith(json.dumps(SCHEMA, indent=2)) and not bare["truncated"]


@pytest.mark.parametrize(
    "own, learned, told",
    [
        ("Do x.", "Do y.", "Do x.\n\n[Accepted domain-specific refinement]\nDo y."),
        ("", "Do y.", "[Accepted domain-specific refinement]\nDo y."),
        ("Do x.", "", "Do x."),
        ("", "", ""),
    ],
)
def test_refinement_joins_instructions(spark, own, learned, told):
    row = spark.range(1).select(requests.with_refinement(F.lit(own), F.lit(learned)).alias("t")).first()
    assert row["t"] == told


def test_question_request(spark):
    pages = spark.createDataFrame([(1, "y" * 30_001)], "page_id long, text string")
    row = requests.question_requests(pages, F.lit("Why?")).first()
    assert row["user_content"] == (
        "Answer the question using only the supplied page content.\n\nQuestion: Why?\n\nPage content:\n" + "y" * 30_000
    )


def test_refinement_request_is_the_documented_text(spark):
    recs = [{"title": None, "url": "é"}, {"title": "only"}, {}, {"title": "fourth"}]
    rows = [(1, i, r, json.dumps(r)) for i, r in enumerate(recs)]
    records = spark.createDataFrame(rows, "page_id long, rec_ord int, rec map<string,string>, rec_json string")
    schema = {"title": "T", "url": "U"}
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    quality = scoring.score_records(records, schema, pages)
    text = spark.createDataFrame([(1, "p" * 6000), (2, "short"), (3, "")], "page_id long, text string")
    out = {r["page_id"]: r["user_content"] for r in requests.refinement_requests(quality, records, text, schema).collect()}
    assert set(out) == {1, 2}
    q = quality.where("page_id = 1").first()
    parts = q["components"].asDict()
    diagnostics = {
        "score_kind": "extraction_quality_proxy", "semantic_correctness_guaranteed": False, "results_count": 4, "components": parts,
        "fill_rate": parts["fill_rate"], "validity_rate": parts["basic_validity"], "uniqueness_rate": parts["uniqueness"],
        "content_quality": parts["content_quality"], "deterministic_validation_rate": parts["deterministic_validation"],
        "confidence": q["confidence"], "uncertainty": q["uncertainty"], "validation_errors": q["validation_errors"], "issues": q["issues"],
    }
    assert out[1] == (
        "Analyze this extraction and propose concise retry instructions.\n\nSchema:\n" + json.dumps(schema, indent=2)
        + "\n\nSample output:\n" + json.dumps(recs[:3], indent=2) + "\n\nProxy diagnostics:\n" + json.dumps(diagnostics, indent=2)
        + "\n\nPage sample:\n" + "p" * 3000 + "\n\nReturn only the improved extraction instructions."
    )
    assert "Sample output:\n[]\n" in out[2]


def test_run_isolates_failures(spark):
    def answers(batches):
        import pandas as pd

        for b in batches:
            raw = ["nonsense" if "broken" in t else '[{"title": "%s", "url": "/x"}]' % t.split("\n")[0] for t in b["user_content"]]
            yield pd.DataFrame({"page_id": b["page_id"], "raw_output": raw, "input_tokens": 1, "output_tokens": 1, "latency_ms": 0.0, "model": "m"})

    body = "<p>A good title</p><p>" + "words " * 20 + "</p>"
    pages = spark.createDataFrame(
        [(1, "https://a.example/1", body), (2, "https://a.example/2", "<p>broken</p>" + body), (3, "https://b.example/", "x"),
         (4, "https://b.example/4", body + "<div id='hcaptcha'></div>")],
        "page_id long, url string, html string",
    )
    schema = {"title": "t", "url": "u"}
    cleaned, reqs = extraction.build_requests(pages, schema)
    run = extraction.finish_run(cleaned, reqs, requests.run_extractor(reqs, answers), schema)
    assert {r["page_id"]: r["error_type"] for r in run.failures.collect()} == {
        2: "LLMParseError", 3: "EmptyPageError", 4: "UnsupportedChallengeError",
    }
    batch = extraction.batch_records(run).collect()
    assert [(r["page_id"], r["rec"]) for r in batch] == [
        (1, {"title": "A good title", "url": "https://a.example/x", "_source_url": "https://a.example/1"})
    ]
    assert [(r["page_id"], r["domain"], r["schema_name"]) for r in run.quality.collect()] == [(1, "a.example", "title_url")]


def test_extractor_errors_and_missing_answers_are_failures(spark):
    class Refused(Exception):
        error_type, status_code = "LLMProviderError", 503

    def answers(batches):
        import pandas as pd

        for b in batches:
            if any("refuse" in t for t in b["user_content"]):
                raise Refused
            if any("crash" in t for t in b["user_content"]):
                raise ValueError
            b = b[~b["user_content"].str.contains("silent")]
            said = [503 if "busy" in t else None for t in b["user_content"]]
            yield pd.DataFrame(
                {"page_id": b["page_id"], "raw_output": '[{"title": "t", "title": "u"}]',
                 "error_type": ["LLMProviderError" if s else None for s in said], "status_code": pd.Series(said, b.index, dtype=object)}
            )

    body = "<p>" + "words " * 20 + "</p>"
    kinds = ["fine", "refuse", "crash", "silent", "busy", "fine"]
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", f"<p>{k}</p>{body}") for i, k in enumerate(kinds)], "page_id long, url string, html string")
    schema = {"title": "t"}
    cleaned, reqs = extraction.build_requests(pages.coalesce(1), schema)
    run = extraction.finish_run(cleaned, reqs, requests.run_extractor(reqs, answers), schema)
    assert {r["page_id"]: (r["error_type"], r["status_code"]) for r in run.failures.collect()} == {
        1: ("LLMProviderError", 503), 2: ("LLMExtractionError", None), 3: ("LLMExtractionError", None), 4: ("LLMProviderError", 503),
    }
    assert [(r["page_id"], r["rec"]["title"]) for r in extraction.batch_records(run).orderBy("page_id").collect()] == [(0, "u"), (5, "u")]
    assert run.quality.count() == 2


def test_noise_is_learned_over_three_runs(spark):
    """Candidate after the first run, active after the second, gone from the third's text."""
    from datetime import datetime

    from leafmill.operators import cleaning
    from leafmill.operators.profiles import fold_profiles
    from leafmill.sources import tables

    noisy = "<div class='promo-card'>noise</div>" * 2 + "<main>" + "Plain page text here. " * 4 + "</main>"
    pages = spark.createDataFrame([(1, "https://a.example/1", noisy)], "page_id long, url string, html string")
    schema = {"title": "t", "url": "u", "price": "p"}

    def poor(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "raw_output": '[{"title": "x"}]', "input_tokens": 1, "output_tokens": 1, "latency_ms": 0.0, "model": "m"})

    known = fold_profiles(spark.createDataFrame([], "domain string, ts timestamp, id long, quality_score double"))
    made = spark.createDataFrame([], tables.layout("cleaning_rules"))
    states = []
    for day in (1, 2):
        cleaned, reqs = extraction.build_requests(pages, schema, cleaning_rules=made)
        run = extraction.finish_run(cleaned, reqs, requests.run_extractor(reqs, poor), schema)
        ts = F.lit(datetime(2024, 1, day)).cast("timestamp")
        known, made = extraction.fold_run(run, ts, profiles=known, cleaning_rules=made)
        made = tables.upgrade(spark.createDataFrame(made.collect(), made.schema), "cleaning_rules")
        states.append([(r["selector"], r["status"]) for r in made.collect()])
    assert states == [[("promo-card", "candidate")], [("promo-card", "active")]]
    text = cleaning.clean_pages(pages, made).first()
    assert "noise" not in text["text"] and text["applied_rule_ids"] == [1]
    row = known.first()
    assert (row["total_scrapes"], row["wait_seconds"]) == (2, 6.0 if row["avg_quality"] < 0.35 else 2.0)
