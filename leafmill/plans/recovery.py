"""Recovery inside a run: pages that fail at the model are asked again while their budget lasts.

Rounds are semi-naive: each takes only the pages that failed in the round before and whose
recipe still allows a try, with the settings that the recipe changes (less content, the
fallback model). A (page, scenario) has a budget, so the rounds end by themselves, and each is
written once, since answers are paid for.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators import failures as fail
from leafmill.operators import requests, responses
from leafmill.operators.cleaning import bounded
from leafmill.session import stage


#: Of the steps that need a handler, what a run can do: there is no browser in it.
HANDLED = ("retry_with_fallback_model",)


class Recovered(NamedTuple):
    """``answered``: the last answer of each page, for ``finish_run``. ``failures``: every failure
    on the way, in the columns of ``plan_recovery``. ``settings``: page_id, asks, content_limit,
    model (null for the configured one) of each page's last request. ``plan`` and ``events`` as the
    failure operators make them."""

    answered: DataFrame
    failures: DataFrame
    settings: DataFrame
    plan: DataFrame
    events: DataFrame


def _ask_again(reqs: DataFrame, cleaned: DataFrame, settings: DataFrame) -> DataFrame:
    """The requests of these pages, cut to their limit, with the model they go to."""
    texts = cleaned.select("page_id", "text")
    known = reqs.select("page_id", "kind", "system_prompt")
    wanted = settings.join(known, "page_id").join(texts, "page_id")
    return wanted.withColumn("_cut", bounded(F.col("text"), F.col("content_limit"))).select(
        "page_id",
        "kind",
        "system_prompt",
        F.col("_cut.content").alias("user_content"),
        F.length("_cut.content").alias("content_chars"),
        F.col("_cut.truncated").alias("truncated"),
        "content_limit",
        "model",
        "asks",
    )


def ask_with_recovery(
    cleaned: DataFrame,
    reqs: DataFrame,
    extractor: requests.Extractor,
    started: F.Column,
    *,
    fallback_model: str | None = None,
) -> Recovered:
    """Ask for all of ``reqs``, and again for what fails, as the recipes plan it.

    The extractor sees three columns more than in ``run_extractor``: ``content_limit``, ``model``
    (null for the configured one) and ``asks`` (1 for the first try). A page without an answer
    counts as an extraction failure. Scenario, budget and changes of settings are those of
    ``plan_recovery``; a changed setting stays for the page's later tries. A failure is dated
    ``started`` plus its round in seconds, and its id is the round. Page ids are unique, as
    everywhere in a run; requests without one are not asked. No requests give empty tables.
    """
    spark = reqs.sparkSession
    plans = fail.recipe_plans(spark, handlers=HANDLED, fallback_model=fallback_model)
    settings = stage(
        reqs.select("page_id").distinct().select(
            "page_id", F.lit(1).alias("asks"), F.lit(fv.CONTENT_CHARS).alias("content_limit"), F.lit(None).cast("string").alias("model")
        ),
        "asked",
    )
    kept, every, last = [], [], []
    past: DataFrame | None = None
    while True:
        answered = stage(requests.run_extractor(_ask_again(reqs, cleaned, settings), extractor), "answers")
        bad = responses.response_failures(responses.parse_responses(answered)).select("page_id", "error_type", "status_code")
        silent = settings.select("page_id").join(answered.select("page_id"), "page_id", "left_anti")
        bad = bad.unionByName(silent.withColumn("error_type", F.lit("LLMExtractionError")), allowMissingColumns=True)
        now = settings.join(bad.withColumn("_bad", F.lit(True)), "page_id", "left")
        if past is not None:  # was the try after the failure before this one good?
            told = now.select("page_id", F.col("_bad").isNull().alias("retry_ok"), F.col("error_type").alias("retry_error"))
            every.append(past.join(told, "page_id", "left"))
        active = F.coalesce(F.col("model") == F.lit(fallback_model), F.lit(False))
        failed = fail.classify(now.where("_bad").drop("_bad").withColumn("component", F.lit("llm")))
        failed = failed.withColumn("fallback_active", active).join(F.broadcast(plans), ["scenario", "fallback_active"])
        if every:
            before = every[0]
            for more in every[1:]:
                before = before.unionByName(more)
            counts = before.groupBy("page_id", "scenario").agg(F.count("*").alias("_before"))
            failed = failed.join(counts, ["page_id", "scenario"], "left")
        else:
            failed = failed.withColumn("_before", F.lit(0))
        failed = failed.withColumn(
            "again", (F.col("outcome") == "retry_ready") & (F.coalesce("_before", F.lit(0)) < F.col("max_attempts"))
        )
        failed = stage(
            failed.select(
                "page_id", "asks", "content_limit", "model", "error_type", "status_code", "component", "scenario", "again",
                F.coalesce(F.col("content_chars").cast("int"), "content_limit").alias("next_limit"),
                F.when(F.col("switches_model"), F.lit(fallback_model)).otherwise(F.col("model")).alias("next_model"),
            ),
            "failed",
        )
        past = failed
        again = failed.where("again")
        done = again.select("page_id")
        kept.append(answered.join(done, "page_id", "left_anti"))
        last.append(settings.join(done, "page_id", "left_anti"))
        settings = stage(
            again.select("page_id", (F.col("asks") + 1).alias("asks"), F.col("next_limit").alias("content_limit"), F.col("next_model").alias("model")),
            "asked",
        )
        if settings.isEmpty():
            break
    every.append(past.withColumn("retry_ok", F.lit(None).cast("boolean")).withColumn("retry_error", F.lit(None).cast("string")))
    failures, answers, ends = every[0], kept[0], last[0]
    for more in every[1:]:
        failures = failures.unionByName(more)
    for more in kept[1:]:
        answers = answers.unionByName(more)
    for more in last[1:]:
        ends = ends.unionByName(more)
    rows = failures.select(
        F.col("page_id").cast("string").alias("job_id"),
        F.timestamp_micros(F.unix_micros(started.cast("timestamp")) + F.col("asks") * 1_000_000).alias("ts"),
        F.col("asks").cast("long").alias("id"),
        "page_id", "error_type", "status_code", "component", "model",
        # A page that is not asked again says nothing about a retry.
        F.when(F.col("again"), F.col("retry_ok")).alias("retry_ok"),
        F.when(F.col("again"), F.col("retry_error")).alias("retry_error"),
    )
    plan = fail.plan_recovery(rows, handlers=HANDLED, fallback_model=fallback_model)
    return Recovered(answers, rows, ends, plan, fail.recovery_events(plan))
