"""Domain profiles, waits, history windows and the reports over them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.numbers import milli
from leafmill.operators.joins import lookup_join
from leafmill.operators.ordered import (
    Part,
    compose_stretches,
    compose_tables,
    machine,
    sort_rows,
    summarise,
)

# Scores have three decimals, so an average is one of 1,001 values (in thousandths),
# or not there yet. Symbols up to 1000 are scores; symbol 1001 + a sets the average to
# a, which is how an older profile enters the fold.
_NONE = 1001
_SET = 1001


@lru_cache(maxsize=1)
def average_moves() -> np.ndarray:
    """``moves[symbol, average]``: the moving average after one more score.

    The first score is taken as it is; later ones give
    ``round(alpha * score + (1 - alpha) * average, 3)`` on doubles. Away from ties that
    is integer arithmetic; the doubles that sit on a tie are rounded one by one.
    """
    q, a = np.meshgrid(np.arange(1001), np.arange(1001), indexing="ij")
    tenths = 3 * q + 7 * a
    moves = (tenths + 5) // 10
    tie = tenths % 10 == 5
    exact = fv.AVERAGE_ALPHA * (q[tie] / 1000) + (1 - fv.AVERAGE_ALPHA) * (a[tie] / 1000)
    moves[tie] = [round(round(x, 3) * 1000) for x in exact.tolist()]
    scored = np.concatenate([moves, np.arange(1001)[:, None]], axis=1)
    fixed = np.repeat(np.arange(1001)[:, None], _NONE + 1, axis=1)
    return np.concatenate([scored, fixed]).astype(np.int32)


_POOR = round(fv.QUALITY_POOR * 1000)
_EXCELLENT = round(fv.QUALITY_EXCELLENT * 1000)


def _wait_step(wait: float, score: int) -> float:
    if score < _POOR:
        return min(wait + fv.WAIT_STEP_UP, fv.WAIT_CAP)
    return max(wait - fv.WAIT_STEP_DOWN, fv.WAIT_FLOOR)


def _moving(symbols: np.ndarray) -> np.ndarray:
    """Which scores change the wait: poor ones and excellent ones."""
    return (symbols < _POOR) | ((symbols >= _EXCELLENT) & (symbols < _SET))


def _absorb_wait(state, symbols: np.ndarray, used: np.ndarray, learn: np.ndarray) -> list[float]:
    """The steps of a stretch as one function ``min(high, max(low, wait + shift))``.

    A row that ran with a wait of its own (a raised one, after a recovery) sets the
    wait from that one: a constant is such a function too, with ``low == high``.
    """
    shift, low, high = state
    moving = _moving(symbols) & learn.astype(bool)
    for q, own in zip(symbols[moving].tolist(), used[moving].tolist()):
        if own == own:  # not missing
            new = _wait_step(own, q)
            if new != own:
                shift, low, high = 0.0, new, new
        else:
            shift += fv.WAIT_STEP_UP if q < _POOR else -fv.WAIT_STEP_DOWN
            low, high = _wait_step(low, q), _wait_step(high, q)
    return [shift, low, high]


def _then_wait(first: Column, then: Column) -> Column:
    """Two wait functions one after the other, which are one such function again."""
    shift, low, high = (then[i] for i in range(3))
    led = lambda wait: F.least(high, F.greatest(low, wait + shift))
    return F.array(first[0] + shift, led(first[1]), led(first[2]))


def _profile_parts() -> list[Part]:
    scores = lambda q: q[q < _SET]
    return [
        Part("_n", "bigint", ["_q"], lambda c: 0, lambda s, q: s + len(scores(q))),
        Part(
            "_ok", "bigint", ["_q"], lambda c: 0, lambda s, q: s + int((scores(q) >= _POOR).sum())
        ),
        machine("_avg", "_q", average_moves, _NONE),
        Part(
            "_moves",
            "bigint",
            ["_q", "_learn"],
            lambda c: 0,
            lambda s, q, learn: s + int((_moving(q) & learn.astype(bool)).sum()),
        ),
        Part(
            "_wait",
            "array<double>",
            ["_q", "_used", "_learn"],
            lambda c: [0.0, float("-inf"), float("inf")],
            _absorb_wait,
        ),
    ]


def _usable_score() -> Column:
    return F.coalesce(F.col("quality_score").cast("double").between(0.0, 1.0), F.lit(False))


def rejected_scores(history: DataFrame) -> DataFrame:
    """The rows that ``fold_profiles`` does not apply: score missing or outside 0 to 1."""
    return history.where(~_usable_score())


def fold_profiles(
    history: DataFrame,
    prior: DataFrame | None = None,
    *,
    default_wait: float = fv.DEFAULT_WAIT_SECONDS,
) -> DataFrame:
    """Domain profiles after all rows of ``history``, applied in (ts, id) order.

    ``history``: domain, ts, id, quality_score (three decimals); where present,
    ``wait_used`` is the wait a row really ran with (null for the learned one), and rows
    with ``learn_wait`` false leave the wait alone, as measured retries do. ``prior`` is
    an older profile table to continue from. A run reads its settings before it starts and is
    folded in afterwards, so a domain's rows never influence each other inside a run.

    Rows without a score from 0 to 1 are not applied; ``rejected_scores`` returns them. A null
    domain is a domain like any other, and goes on from its row in ``prior``. The
    wait of a domain that is not in ``prior`` starts from ``default_wait``, but 2.0 is stored
    until a row changes it.

    One range shuffle of (domain, ts, id, score) and small shuffles of summaries, of which
    no row or task holds more than two of a domain (``compose_stretches``).
    """
    optional = lambda c, absent: F.col(c) if c in history.columns else absent
    rows = history.where(_usable_score()).select(
        "domain",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
        F.col("id").cast("long").alias("id"),
        milli(F.col("quality_score")).cast("int").alias("_q"),
        optional("wait_used", F.lit(None)).cast("double").alias("_used"),
        F.coalesce(optional("learn_wait", F.lit(True)), F.lit(True)).alias("_learn"),
    )
    if prior is not None:
        rows = rows.unionByName(
            prior.select(
                "domain",
                F.lit(-(2**63) + 1).cast("long").alias("_us"),
                F.lit(-1).cast("long").alias("id"),
                (milli(F.coalesce("avg_quality", F.lit(0.0))) + _SET).cast("int").alias("_q"),
                F.lit(None).cast("double").alias("_used"),
                F.lit(False).alias("_learn"),
            )
        )
    parts = _profile_parts()
    latest = Part(
        "_last", "bigint", ["_us"], lambda c: 0, lambda s, t: int(t[-1]) if len(t) else s
    )
    stretches = summarise(sort_rows(rows, ["domain"], ["_us", "id"]), ["domain"], [*parts, latest])
    add = lambda a, b: a + b
    folded = compose_stretches(
        stretches,
        ["domain"],
        {"_n": add, "_ok": add, "_moves": add, "_last": F.greatest, "_avg": compose_tables, "_wait": _then_wait},
    )
    if prior is None:
        known = folded.select(
            "*",
            F.lit(None).cast("double").alias("_w"),
            F.lit(0).alias("_n0"),
            F.lit(0).alias("_ok0"),
            F.lit(None).cast("timestamp").alias("_last0"),
        )
    else:
        old = prior.select(
            F.col("domain").alias("_domain0"),
            F.col("wait_seconds").alias("_w"),
            F.col("total_scrapes").alias("_n0"),
            F.col("total_successes").alias("_ok0"),
            F.col("last_scraped").cast("timestamp").alias("_last0"),
        )
        known = folded.join(old, F.col("domain").eqNullSafe(F.col("_domain0")), "left").select(
            *folded.columns,
            "_w",
            F.coalesce("_n0", F.lit(0)).alias("_n0"),
            F.coalesce("_ok0", F.lit(0)).alias("_ok0"),
            "_last0",
        )

    shift, low, high = (F.col("_wait")[i] for i in range(3))
    total = (F.col("_n") + F.col("_n0")).cast("long")
    success = (F.col("_ok") + F.col("_ok0")).cast("long")
    seen = F.when(F.col("_n") > 0, F.timestamp_micros("_last"))
    start = F.when(F.col("_moves") > 0, float(default_wait)).otherwise(fv.DEFAULT_WAIT_SECONDS)
    return known.select(
        "domain",
        F.least(high, F.greatest(low, F.coalesce("_w", start) + shift)).alias("wait_seconds"),
        (F.element_at("_avg", F.when(F.size("_avg") == 1, 1).otherwise(_NONE + 1)) / 1000.0).alias("avg_quality"),
        total.alias("total_scrapes"),
        success.alias("total_successes"),
        (total - success).alias("total_failures"),
        F.coalesce(seen, F.col("_last0")).alias("last_scraped"),
    )


def learned_wait(domains: DataFrame, profiles: DataFrame) -> DataFrame:
    """``domains`` with the learned wait, 2.0 where the domain is not known yet."""
    out = lookup_join(domains, profiles.select("domain", "wait_seconds"), ["domain"])
    return out.withColumn(
        "wait_seconds", F.coalesce("wait_seconds", F.lit(fv.DEFAULT_WAIT_SECONDS))
    )


def last_rows(history: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` history rows of every domain, newest first in ``rank``.

    The limit is pushed below the shuffle (partial window group limit), so a domain
    sends at most ``limit`` rows per map task.
    """
    newest = W.partitionBy("domain").orderBy(F.desc("ts"), F.desc("id"))
    return history.withColumn("rank", F.row_number().over(newest)).where(
        F.col("rank") <= limit
    )


def success_rate(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "domain",
        F.when(F.col("total_scrapes") == 0, 0.0)
        .otherwise(F.col("total_successes") / F.col("total_scrapes"))
        .alias("success_rate"),
    )


def issue_frequency(history: DataFrame) -> DataFrame:
    """How often each issue occurs per domain; the most common has rank 1."""
    counts = (
        history.select("domain", F.explode("issues").alias("issue"))
        .groupBy("domain", "issue")
        .agg(F.count("*").alias("n"))
    )
    by_count = W.partitionBy("domain").orderBy(F.desc("n"), "issue")
    return counts.withColumn("rank", F.row_number().over(by_count))


def diagnose_domains(history: DataFrame, profiles: DataFrame) -> DataFrame:
    """Health report for every domain over its last 50 rows.

    Means are taken on integer thousandths: the result does not depend on the order in
    which partial sums meet.
    """
    recent = last_rows(history, 50).withColumn("_q", milli(F.col("quality_score")))
    span = lambda lo, hi: F.sum(F.when(F.col("rank").between(lo, hi), F.col("_q")))
    totals = recent.groupBy("domain").agg(
        F.count("*").alias("total_attempts"),
        F.sum("_q").alias("_sum"),
        span(1, 5).alias("_new"),
        span(6, 10).alias("_old"),
    )
    issues = (
        issue_frequency(recent)
        .groupBy("domain")
        .agg(  # as many entries as there are issue names
            F.array_sort(F.collect_list(F.struct("rank", "issue", "n"))).alias("_issues")
        )
    )
    change = F.col("_new") - F.col("_old")
    trend = (
        F.when(F.col("total_attempts") < 10, "unknown")
        .when(change > 500, "improving")
        .when(change < -500, "declining")
        .otherwise("stable")
    )
    low_fill = F.exists("common_issues", lambda i: i["issue"] == "LOW_FILL_RATE")
    return (
        totals.join(success_rate(profiles), "domain", "left")
        .join(issues, "domain", "left")
        .withColumn("success_rate", F.coalesce("success_rate", F.lit(0.0)))
        .withColumn(
            "common_issues",
            F.transform(
                F.coalesce("_issues", F.array()),
                lambda i: F.struct(i["issue"].alias("issue"), i["n"].alias("n")),
            ),
        )
        .select(
            "domain",
            "total_attempts",
            "success_rate",
            (F.col("_sum") / (1000.0 * F.col("total_attempts"))).alias("avg_quality"),
            trend.alias("trend"),
            "common_issues",
            F.array_compact(
                F.array(
                    F.when(F.col("success_rate") < 0.5, fv.ADVICE_LOW_SUCCESS),
                    F.when(low_fill, fv.ADVICE_LOW_FILL),
                )
            ).alias("recommendations"),
        )
    )


def top_domains(profiles: DataFrame, k: int = 10) -> DataFrame:
    """Domains with most scrapes; ties in domain order."""
    return (
        profiles.select(
            "domain", "total_scrapes", "avg_quality", "total_successes", "total_failures"
        )
        .orderBy(F.desc("total_scrapes"), "domain")
        .limit(k)
    )


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def memory_stats(
    history: DataFrame, prompts: DataFrame, rules: DataFrame, feedback: DataFrame
) -> DataFrame:
    """One row of totals over the strategy tables."""
    per_domain = history.groupBy("domain").agg(
        F.count("*").alias("_n"), F.sum(milli(F.col("quality_score"))).alias("_q")
    )
    scrapes = per_domain.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_scrapes"),
        F.count("*").alias("unique_domains"),
        F.coalesce(F.sum("_q") / (1000.0 * F.sum("_n")), F.lit(0.0)).alias("avg_quality"),
    )
    status = F.col("status")
    prompt_counts = prompts.agg(
        _count_where(status == "accepted").alias("total_refinements"),
        _count_where(status == "candidate").alias("candidate_refinements"),
    )
    rule_counts = rules.agg(_count_where(status == "active").alias("active_cleaning_rules"))
    notes = feedback.agg(F.count("*").alias("total_feedback"))
    one_value = lambda df, name: df.select(name).scalar().alias(name)
    return scrapes.select(
        "*",
        one_value(prompt_counts, "total_refinements"),
        one_value(prompt_counts, "candidate_refinements"),
        one_value(rule_counts, "active_cleaning_rules"),
        one_value(notes, "total_feedback"),
    )
