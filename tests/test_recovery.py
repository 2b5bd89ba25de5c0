"""Pages that fail at the model or score low, asked again inside the run."""

import json

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import cleaning, requests
from leafmill.plans import examples, extraction, recovery, refinement
from leafmill.sources import tables

SCHEMA = {"title": "The title", "url": "The link"}


def short_only():
    """A model that gives JSON for short content only, tells what it was sent, and never answers page 4."""

    def answer(batches):
        for batch in batches:
            rows = [r for r in batch.itertuples() if r.page_id != 4]
            said = [json.dumps([{"title": f"{r.asks}:{r.content_chars}:{r.truncated}", "url": "/a"}]) if r.content_chars <= 25_000 else "not json" for r in rows]
            yield pd.DataFrame({"page_id": [r.page_id for r in rows], "raw_output": said, "model": [r.model for r in rows]})

    return answer


def run(spark, texts, extractor, **more):
    cleaned = spark.createDataFrame(texts, "page_id long, text string")
    reqs = requests.extraction_requests(cleaned, SCHEMA)
    return recovery.ask_with_recovery(cleaned, reqs, extractor, F.lit("2024-01-01"), **more)


def test_parse_failures_are_asked_again_with_less_content(spark):
    out = run(spark, [(1, "short text"), (2, "x" * 60_000), (3, "y" * 24_000), (4, "silent")], short_only())
    said = {r.page_id: json.loads(r.raw_output)[0]["title"] for r in out.answered.collect()}
    assert said == {1: "1:10:False", 2: "2:25000:True", 3: "1:24000:False"}
    settings = {r.page_id: (r.asks, r.content_limit) for r in out.settings.collect()}
    assert settings == {1: (1, 50_000), 2: (2, 25_000), 3: (1, 50_000), 4: (3, 25_000)}
    plan = sorted((r.job_id, r.id, r.scenario, r.attempt, r.result) for r in out.plan.collect())
    assert plan[0] == ("2", 1, "json_parse_error", 1, "recovered")
    assert [(p[3], p[4]) for p in plan[1:]] == [(1, "partial_recovery"), (2, "partial_recovery"), (None, "escalation_required")]
    events = [r.event for r in out.events.where("job_id = '2'").orderBy("seq").collect()]
    assert events[0] == "recovery.attempted" and events[-1] == "recovery.succeeded"


def test_each_answer_is_asked_for_once(spark, tmp_path):
    calls = str(tmp_path)

    def counted(batches):
        import uuid

        for batch in batches:
            for r in batch.itertuples():
                open(f"{calls}/{r.page_id}-{r.asks}-{uuid.uuid4().hex}", "w").close()
            yield from examples.moody_extractor(iter([batch]))

    texts = [(i, f"Head {i}\nbody") for i in range(14)]
    out = run(spark, texts, counted, fallback_model=examples.FALLBACK)
    asks = {r.page_id: r.asks for r in out.settings.collect()}
    assert asks == {i: {0: 3, 1: 2, 2: 2, 3: 2, 4: 3}.get(i % 7, 1) for i in range(14)}
    out.answered.count(), out.plan.count(), out.events.count()
    assert len(list(tmp_path.iterdir())) == sum(asks.values())


def test_without_a_fallback_the_provider_stays_down(spark):
    out = run(spark, [(2, "Head\nbody"), (5, "Head\nbody")], examples.moody_extractor)
    plan = out.plan.collect()
    assert [(r.job_id, r.attempt, r.result) for r in plan] == [("2", 1, "partial_recovery")]
    assert {r.page_id: r.asks for r in out.settings.collect()} == {2: 1, 5: 1}


def test_no_requests(spark):
    out = run(spark, [], examples.moody_extractor)
    assert out.answered.count() == out.plan.count() == out.events.count() == out.settings.count() == 0


def test_a_page_without_url_fails(spark):
    page = "<p>" + "Some text about a mill. " * 9 + "</p>"
    rows = [(1, None, page), (2, "nothing", page), (3, "https://a.example/x", page), (4, "https://a.example/y", None)]
    cleaned = cleaning.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.error_type for r in cleaning.page_failures(cleaned).collect() if r.page_id < 4} == {1: "ValueError", 2: "ValueError"}
    assert [r.page_id for r in cleaning.extractable(cleaned).collect()] == [3]


def test_import_says_why_rows_are_rejected(spark):
    rows = [
        (1, "a", "class", "x", '["p"]'), (2, None, "class", "x", "[]"), (3, "a", "class", None, "[]"), (4, "a", "xpath", "x", "[]"),
        (5, "a", "tag", "x", "p"), (6, "a", "tag", "x", None), (7, "a", None, "x", "[]"),
    ]
    old = spark.createDataFrame(rows, "id long, domain string, rule_type string, selector string, supporting_evidence string")
    got = {r.id: (r.rejected, r.evidence) for r in tables.import_legacy(old, "cleaning_rules", rejects=True).collect()}
    assert got == {
        1: (None, ["p"]), 2: ("no domain", []), 3: ("no selector", []), 4: ("unsupported rule type", []),
        5: ("evidence is no list", []), 6: (None, []), 7: ("unsupported rule type", []),
    }
    history = spark.createDataFrame([("a", 0.5, 1.0), (None, 0.5, 1.0), ("a", 7.0, 1.0)], "domain string, quality_score double, timestamp double")
    assert [r.rejected for r in tables.import_legacy(history, "extraction_history", rejects=True).collect()] == [None, "no domain", "no score from 0 to 1"]


def test_replay_of_a_refinement_asks_nothing_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    place = str(calls)

    def counted(kind, model):
        def answer(batches):
            import uuid

            for batch in batches:
                for i in batch["page_id"]:
                    open(f"{place}/{kind}-{i}-{uuid.uuid4().hex}", "w").close()
                yield from model(iter([batch]))

        return answer

    rows = [(i, f"https://a{i % 2}.example/{i}", f"Mill {i} stops\nfor ever and a day, said the miller to the river below it.") for i in range(12)]
    cleaned = spark.createDataFrame(rows, "page_id long, url string, text string").selectExpr("*", "regexp_extract(url, '//([^/]*)', 1) AS domain", "CAST(NULL AS struct<type:string,marker:string>) AS challenge")
    schema = {"headline": "", "author": "", "published_date": "", "summary": "", "url": "", "category": ""}
    reqs = requests.extraction_requests(cleaned, schema)
    run = extraction.finish_run(cleaned, reqs, requests.run_extractor(reqs, examples.headline_extractor), schema)

    def refine(folder, **more):
        out = refinement.refine_run(
            run, schema, counted("write", examples.hint_writer), counted("second", examples.hinted_extractor), F.lit("2024-01-01").cast("timestamp"),
            path=folder, **more,
        )
        seen = sorted((r.id, r.status, r.version, r.extra_instructions) for r in out.refined.prompts.collect())
        return seen, {r.page_id: (r.answer, r.error_type) for r in out.written.collect()}, sorted(r.page_id for r in out.retried.collect())

    first = refine(f"{tmp_path}/answers")
    weak = [i for i in range(12) if i % 6]
    asked = sorted(f.name.rsplit("-", 1)[0] for f in calls.iterdir())
    retried = [i for i in weak if i % 5 not in (2, 3)]
    assert first[2] == retried and asked == sorted([*(f"write-{i}" for i in weak), *(f"second-{i}" for i in retried)])
    assert [r[0] for r in first[0]] == [i for i in weak if i % 5 in (0, 4)] and {r[1] for r in first[0]} == {"accepted"}
    assert first[1][1] == ("Look closer.", None) and first[1][2] == (None, "LLMExtractionError") and first[1][3] == (None, "LLMProviderError")
    again = refine(f"{tmp_path}/answers")
    assert again == first and len(list(calls.iterdir())) == len(asked)
    changed = refine(f"{tmp_path}/answers", instructions="Be brief.")  # other second requests, the same first ones
    assert changed[:1] == first[:1] and len(list(calls.iterdir())) == len(asked) + len(retried)
