"""Failures: scenario, attempt budget, planned recovery, events and totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators.ordered import scan_states

BROWSER_STEPS = ("restart_browser", "clear_cookies", "retry_with_fallback_model")
_PLAN = (
    "scenario string, fallback_active boolean, max_attempts int, policy string, "
    "steps array<struct<step:string,status:string,detail:string>>, steps_applied int, "
    "steps_remaining int, outcome string, reason string, base_delay double, "
    "max_delay double, cooldown double, wait_added double, content_chars int, "
    "switches_model boolean"
)


def status_of(status_code: Column, response_status: Column) -> Column:
    """The failure's own status, else that of the response it carries."""
    return F.coalesce(status_code, response_status)


def scenario_of(
    error_type: Column, status: Column, challenge: Column, component: Column
) -> Column:
    """Recovery scenario of a failure; the first matching line wins."""
    return (
        F.when(
            error_type == "UnsupportedChallengeError",
            F.when(challenge == "cloudflare", "cloudflare_challenge").otherwise(
                "captcha_blocked"
            ),
        )
        .when((error_type == "RateLimitError") | (status == 429), "rate_limited")
        .when(error_type.isin(fv.PARSE_TYPES), "json_parse_error")
        .when(error_type == "LLMExtractionError", "llm_extraction_failed")
        .when(error_type == "LLMProviderError", "llm_provider_error")
        .when(error_type == "EmptyPageError", "empty_page")
        .when(error_type.isin(fv.CRASH_TYPES), "browser_crash")
        .when(
            error_type.isin(fv.NETWORK_TYPES) | status.isin(fv.TIMEOUT_STATUSES),
            "network_timeout",
        )
        .when((status >= 500) & (component == "llm"), "llm_provider_error")
        .otherwise("unknown")
    )


def classify(failures: DataFrame) -> DataFrame:
    """``failures`` with status and scenario.

    Needs error_type; status_code, response_status, challenge and component are used
    where present.
    """
    have = lambda c, t: F.col(c) if c in failures.columns else F.lit(None).cast(t)
    status = status_of(have("status_code", "int"), have("response_status", "int"))
    scenario = scenario_of(
        F.col("error_type"), status, have("challenge", "string"), have("component", "string")
    )
    return failures.withColumn("status", status).withColumn("scenario", scenario)


def recipe_catalog(spark: SparkSession) -> DataFrame:
    """The recipe of each scenario: eleven constant rows."""
    rows = [
        (name, attempts, policy, [(s, {k: float(v) for k, v in p.items()}, d) for s, p, d in steps])
        for name, (attempts, policy, steps) in fv.RECIPES.items()
    ]
    return spark.createDataFrame(
        rows,
        "scenario string, max_attempts int, policy string, "
        "steps array<struct<step:string,params:map<string,double>,description:string>>",
    )


def _step_outcome(step: str, handlers, fallback_model, active: bool) -> tuple[str, str | None]:
    if step == "skip_and_log":
        return "skipped_by_policy", fv.STEP_DETAILS[step]
    if step in BROWSER_STEPS and step not in handlers:
        return "unsupported", f"No handler registered for {step}"
    if step == "retry_with_fallback_model" and not fallback_model:
        return "unsupported", fv.NO_FALLBACK_MODEL
    if step == "retry_with_fallback_model" and active:
        return "unsupported", fv.SAME_FALLBACK_MODEL
    return "applied", fv.STEP_DETAILS.get(step)


def recipe_plans(
    spark: SparkSession, *, handlers=BROWSER_STEPS, fallback_model: str | None = None
) -> DataFrame:
    """What each scenario's recipe comes to under the given set-up: 22 constant rows.

    A step that is not applied ends the recipe: escalation when nothing was applied
    before it, otherwise a partial recovery.
    """
    rows = []
    for scenario, (attempts, policy, steps) in fv.RECIPES.items():
        params = {k: v for _, p, _ in steps for k, v in p.items()}
        for active in (False, True):
            taken, outcome, reason = [], "retry_ready", ""
            for name, _, _ in steps:
                status, detail = _step_outcome(name, handlers, fallback_model, active)
                taken.append((name, status, detail))
                if status != "applied":
                    some = any(s == "applied" for _, s, _ in taken)
                    outcome = "partial_recovery" if some else "escalation_required"
                    reason = detail
                    break
            applied = [n for n, s, _ in taken if s == "applied"]
            number = lambda key: float(params[key]) if key in params else None
            rows.append(
                (
                    scenario, active, attempts, policy, taken, len(applied),
                    len(steps) - len(taken), outcome, reason, number("base_delay"),
                    number("max_wait"), number("duration"), number("additional_seconds"),
                    params.get("max_chars"), "retry_with_fallback_model" in applied,
                )
            )
    return spark.createDataFrame(rows, _PLAN)


def plan_recovery(
    failures: DataFrame, *, handlers=BROWSER_STEPS, fallback_model: str | None = None
) -> DataFrame:
    """Failures with attempt number, planned delay and settings, and the result.

    ``failures``: job_id, ts, id, the columns of ``classify``, and where known
    retry_ok (did the retry succeed), retry_error and model. The attempt counter of a
    (job, scenario) stops at the recipe's maximum and starts again after a verified
    success; it is a machine of four states, run over chunks of the sorted rows, so a
    job of any size is shared between tasks.
    """
    spark = failures.sparkSession
    out = classify(failures)
    for name, kind in (("retry_ok", "boolean"), ("retry_error", "string"), ("model", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    active = F.coalesce(F.col("model") == F.lit(fallback_model), F.lit(False))
    plans = recipe_plans(spark, handlers=handlers, fallback_model=fallback_model)
    out = out.withColumn("fallback_active", active).join(
        F.broadcast(plans), ["scenario", "fallback_active"]
    )
    ready = F.col("outcome") == "retry_ready"
    resets = ready & F.coalesce("retry_ok", F.lit(False))
    out = out.withColumn("_symbol", F.col("max_attempts") * 2 + resets.cast("int"))
    table = _attempt_table(max(a for a, _, _ in fv.RECIPES.values()))
    slim = out.select(
        "job_id", "scenario", "ts", "id", "fallback_active", "retry_ok", "retry_error",
        "model", "status", "_symbol",
    )
    counted = scan_states(slim, ["job_id", "scenario"], ["ts", "id"], "_symbol", table, 0)
    full = counted.drop("_symbol").join(
        F.broadcast(plans), ["scenario", "fallback_active"]
    )
    attempt = F.when(F.col("_before") < F.col("max_attempts"), F.col("_before") + 1)
    full = full.withColumn("attempt", attempt)
    tried = F.col("attempt").isNotNull()
    backoff = F.least(
        F.col("base_delay") * F.pow(F.lit(2.0), F.col("attempt") - 1), F.col("max_delay")
    )
    retried = tried & ready & F.col("retry_ok").isNotNull()
    result = (
        F.when(~tried, "escalation_required")
        .when(retried & F.col("retry_ok"), "recovered")
        .when(retried, "partial_recovery")
        .otherwise(F.col("outcome"))
    )
    reason = (
        F.when(
            ~tried,
            F.format_string(
                "Max attempts (%d) exhausted for %s", F.col("max_attempts"), F.col("scenario")
            ),
        )
        .when(
            retried & ~F.col("retry_ok"),
            F.concat(F.lit("Retry failed with "), F.coalesce("retry_error", F.lit("Exception"))),
        )
        .otherwise(F.col("reason"))
    )
    when_tried = lambda c: F.when(tried, F.col(c))
    return full.select(
        "job_id",
        "ts",
        "id",
        "scenario",
        "status",
        "attempt",
        "max_attempts",
        "policy",
        F.when(tried, F.coalesce(backoff, "cooldown")).alias("planned_delay"),
        when_tried("wait_added").alias("wait_added"),
        when_tried("content_chars").alias("content_chars"),
        F.when(tried & F.col("switches_model"), F.lit(fallback_model)).alias("next_model"),
        F.when(tried, F.col("steps_applied")).otherwise(0).alias("steps_taken"),
        F.when(tried, F.col("steps_remaining")).otherwise(0).alias("steps_remaining"),
        result.alias("result"),
        reason.alias("reason"),
        F.when(tried, F.col("steps")).alias("steps"),
        F.col("outcome").alias("_outcome"),
        retried.alias("_retried"),
    )


def _attempt_table(most: int) -> np.ndarray:
    """``table[2 * maximum + resets, attempts]``: attempts counted after a failure."""
    states = np.arange(most + 1)
    rows = []
    for maximum in range(most + 1):
        counted = np.where(states < maximum, states + 1, states)
        rows += [counted, np.where(states < maximum, 0, states)]
    return np.array(rows, dtype=np.int32)


_EVENT = "struct<event:string,step:string,result:string,detail:string>"


def recovery_events(plan: DataFrame) -> DataFrame:
    """Event rows of planned recoveries, in order of happening (``seq``).

    A failure gives at most seven events, so the rows grow by a constant.
    """
    text = lambda v: F.lit(v).cast("string")

    def event(name, step, result, detail):
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("event"),
            step.alias("step"),
            result.alias("result"),
            detail.alias("detail"),
        ).cast(_EVENT)

    exhausted = F.array(
        event("recovery.attempted", text(None), F.col("result"), F.col("reason")),
        event("recovery.escalated", text(None), F.col("result"), F.col("policy")),
    )
    opened = event(
        "recovery.attempted",
        text(None),
        text(None),
        F.format_string(
            "Attempt %d/%d for job %s", F.col("attempt"), F.col("max_attempts"), F.col("job_id")
        ),
    )
    waited = F.format_string("Waited %.1fs", F.col("planned_delay"))
    walked = F.transform(
        "steps",
        lambda s: event(
            F.concat(F.lit("recovery.step."), s["status"]),
            s["step"],
            text(None),
            F.coalesce(s["detail"], waited),
        ),
    )
    closing = (
        F.when(
            F.col("_retried"),
            F.array(
                event(
                    F.when(F.col("result") == "recovered", "recovery.succeeded").otherwise(
                        "recovery.failed"
                    ),
                    text(None),
                    F.col("result"),
                    F.when(F.col("result") == "recovered", fv.RETRY_SUCCEEDED).otherwise(
                        F.col("reason")
                    ),
                )
            ),
        )
        .when(F.col("_outcome") == "retry_ready", F.array().cast(f"array<{_EVENT}>"))
        .otherwise(
            F.array(
                event(
                    F.when(F.col("_outcome") == "partial_recovery", "recovery.failed").otherwise(
                        "recovery.escalated"
                    ),
                    text(None),
                    F.col("result"),
                    F.col("reason"),
                )
            )
        )
    )
    events = F.when(F.col("attempt").isNull(), exhausted).otherwise(
        F.concat(F.array(opened), walked, closing)
    )
    return plan.select(
        "job_id", "ts", "id", "scenario", F.posexplode_outer(events).alias("seq", "_e")
    ).select("job_id", "ts", "id", "seq", "_e.event", "scenario", "_e.step", "_e.result", "_e.detail")


def recovery_stats(events: DataFrame) -> DataFrame:
    """Totals over all events in one row."""
    count = lambda name: F.coalesce(
        F.sum((F.col("event") == name).cast("long")), F.lit(0)
    )
    return events.agg(
        F.count("*").alias("total_events"),
        count("recovery.succeeded").alias("verified_recoveries"),
        count("recovery.escalated").alias("escalations"),
    )


def latest_events(events: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` events (a top-k, not a sort of the table)."""
    return events.orderBy(F.desc("ts"), F.desc("id"), F.desc("seq")).limit(k)
