"""Failure classification and planned recovery against a loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators import failures

T0 = datetime(2024, 1, 1)
ONE = "error_type string, status_code int, response_status int, challenge string, component string"


@pytest.mark.parametrize(
    "row, scenario",
    [
        (("TimeoutError", None, None, None, None), "network_timeout"),
        (("BrowserCrashedError", None, None, None, None), "browser_crash"),
        (("WebDriverException", None, None, None, None), "browser_crash"),
        (("LLMParseError", None, None, None, None), "json_parse_error"),
        (("JSONDecodeError", 429, None, None, None), "rate_limited"),
        (("LLMProviderError", 503, None, None, None), "llm_provider_error"),
        (("LLMProviderError", 429, None, None, None), "rate_limited"),
        (("UnsupportedChallengeError", None, None, "cloudflare", None), "cloudflare_challenge"),
        (("UnsupportedChallengeError", 429, None, "aws_waf", None), "captcha_blocked"),
        (("RuntimeError", None, None, None, None), "unknown"),
        (("RuntimeError", None, 504, None, None), "network_timeout"),
        (("RuntimeError", 400, 504, None, None), "unknown"),
        (("RuntimeError", 500, None, None, "llm"), "llm_provider_error"),
        (("RuntimeError", 500, None, None, "browser"), "unknown"),
        (("EmptyPageError", 503, None, None, "llm"), "empty_page"),
        (("LLMExtractionError", None, None, None, "llm"), "llm_extraction_failed"),
    ],
)
def test_scenarios(spark, row, scenario):
    assert failures.classify(spark.createDataFrame([row], ONE)).first()["scenario"] == scenario


ROWS = "job_id string, ts timestamp, id long, error_type string, challenge string, retry_ok boolean, retry_error string, model string"


def plan(spark, rows, **setup):
    df = failures.plan_recovery(spark.createDataFrame(rows, ROWS), **setup)
    return {r["id"]: r for r in df.collect()}, df


def test_third_parse_error_of_a_job_escalates(spark):
    rows = [("j", T0, i, "LLMParseError", None, None, None, None) for i in range(3)]
    got, df = plan(spark, rows)
    assert [got[i]["attempt"] for i in range(3)] == [1, 2, None]
    assert [got[i]["result"] for i in range(3)] == ["retry_ready", "retry_ready", "escalation_required"]
    assert got[2]["reason"] == "Max attempts (2) exhausted for json_parse_error"
    events = failures.recovery_events(df).where("id = 2").orderBy("seq").collect()
    assert [(e["event"], e["detail"]) for e in events] == [
        ("recovery.attempted", "Max attempts (2) exhausted for json_parse_error"),
        ("recovery.escalated", "log_and_continue"),
    ]


def test_challenge_is_skipped_and_escalated(spark):
    got, df = plan(spark, [("j", T0, 1, "UnsupportedChallengeError", "captcha", True, None, None)])
    assert (got[1]["result"], got[1]["steps_taken"], got[1]["steps_remaining"]) == ("escalation_required", 0, 0)
    events = [e["event"] for e in failures.recovery_events(df).orderBy("seq").collect()]
    assert events == ["recovery.attempted", "recovery.step.skipped_by_policy", "recovery.escalated"]


def test_empty_page_recovery_events_in_order(spark):
    got, df = plan(spark, [("j", T0, 1, "EmptyPageError", None, True, None, None)])
    assert got[1]["wait_added"] == 5.0 and got[1]["result"] == "recovered"
    events = failures.recovery_events(df).orderBy("seq").collect()
    assert [e["event"].split(".", 1)[1] for e in events] == ["attempted", *["step.applied"] * 4, "succeeded"]
    assert [e["step"] for e in events] == [None, "increase_wait", "clear_cookies", "restart_browser", "retry_request", None]
    stats = failures.recovery_stats(failures.recovery_events(df)).first()
    assert (stats["total_events"], stats["verified_recoveries"], stats["escalations"]) == (6, 1, 0)


def test_missing_handler_is_a_partial_recovery(spark):
    got, df = plan(spark, [("j", T0, 1, "EmptyPageError", None, True, None, None)], handlers=())
    assert (got[1]["result"], got[1]["reason"]) == ("partial_recovery", "No handler registered for clear_cookies")
    assert (got[1]["steps_taken"], got[1]["steps_remaining"]) == (1, 2)
    assert failures.recovery_events(df).where("event = 'recovery.step.unsupported'").count() == 1
    got, _ = plan(spark, [("j", T0, 1, "BrowserCrashedError", None, True, None, None)], handlers=())
    assert got[1]["result"] == "escalation_required"


@pytest.mark.parametrize(
    "setup, model, reason, switched",
    [
        ({}, None, "No fallback model configured", None),
        ({"fallback_model": "big"}, "big", "Fallback model is already active", None),
        ({"fallback_model": "big"}, "small", "", "big"),
    ],
)
def test_fallback_model(spark, setup, model, reason, switched):
    got, _ = plan(spark, [("j", T0, 1, "LLMProviderError", None, None, None, model)], **setup)
    assert (got[1]["reason"], got[1]["next_model"]) == (reason, switched)


def test_backoff_and_cooldown(spark):
    rows = [("j", T0 + timedelta(seconds=i), i, "TimeoutError", None, None, None, None) for i in range(4)]
    rows += [("j", T0, 9, "RateLimitError", None, False, "ValueError", None)]
    got, df = plan(spark, rows)
    assert [got[i]["planned_delay"] for i in range(4)] == [2.0, 4.0, 8.0, None]
    assert (got[9]["planned_delay"], got[9]["result"], got[9]["reason"]) == (60.0, "partial_recovery", "Retry failed with ValueError")
    details = [r["detail"] for r in failures.recovery_events(df).where("step = 'retry_with_backoff'").orderBy("id").collect()]
    assert details == ["Waited 2.0s", "Waited 4.0s", "Waited 8.0s"]


def test_budget_of_hot_jobs_with_resets(spark):
    rng = random.Random(3)
    kinds = {"TimeoutError": "network_timeout", "LLMParseError": "json_parse_error", "RuntimeError": "unknown"}
    rows = []
    for i in range(3000):
        job = "hot" if rng.random() < 0.4 else f"j{rng.randrange(200)}"
        rows.append((job, T0 + timedelta(seconds=rng.randrange(500)), i, rng.choice(list(kinds)), None, rng.random() < 0.7, None, None))
    count, want = {}, {}
    for job, ts, i, kind, _, ok, _, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        scenario = kinds[kind]
        key, most = (job, scenario), fv.RECIPES[scenario][0]
        if count.get(key, 0) >= most:
            want[i] = None
            continue
        count[key] = count.get(key, 0) + 1
        want[i] = count[key]
        if ok and scenario != "unknown":
            count[key] = 0
    got, _ = plan(spark, rows)
    assert {i: r["attempt"] for i, r in got.items()} == want


def test_catalog(spark):
    rows = {r["scenario"]: r for r in failures.recipe_catalog(spark).collect()}
    assert len(rows) == 11 and "stale_selector" in rows
    assert rows["network_timeout"]["steps"][0]["params"] == {"max_wait": 30.0, "base_delay": 2.0}


def test_latest_events(spark):
    rows = [("j", T0 + timedelta(seconds=i), i, "TimeoutError", None, True, None, None) for i in range(9)]
    _, df = plan(spark, rows)
    last = failures.latest_events(failures.recovery_events(df)).collect()
    assert len(last) == 10 and (last[0]["id"], last[0]["event"]) == (8, "recovery.succeeded")
