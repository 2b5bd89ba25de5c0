"""The whole run: pages to records, scores, failures and updated strategy tables."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.text import resolve_links, schema_name_of, strip, url_domain
from leafmill.operators import cleaning, requests, responses, rules, scoring
from leafmill.operators.profiles import fold_profiles
from leafmill.operators.prompts import count_usage, judge_candidates, save_candidates
from leafmill.session import stage


class Run(NamedTuple):
    cleaned: DataFrame
    requests: DataFrame
    records: DataFrame
    failures: DataFrame
    quality: DataFrame
    retry: DataFrame


def build_requests(
    pages: DataFrame,
    schema: dict[str, Any],
    *,
    instructions: str = "",
    profiles: DataFrame | None = None,
    prompts: DataFrame | None = None,
    cleaning_rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cleaned pages and one extraction request for each page that can be extracted."""
    cleaned = stage(cleaning.clean_pages(pages, cleaning_rules), "cleaned")
    ready = cleaning.extractable(cleaned)
    told = F.lit(instructions)
    if profiles is not None and prompts is not None and cleaning_rules is not None:
        ready = requests.page_settings(
            ready, profiles, prompts, cleaning_rules, schema_name_of(schema)
        )
        told = requests.with_refinement(told, F.col("extra_instructions"))
    return cleaned, requests.extraction_requests(ready, schema, told)


def finish_run(
    cleaned: DataFrame, reqs: DataFrame, answered: DataFrame, schema: dict[str, Any]
) -> Run:
    """Parse and score the responses of a run.

    A page fails alone: its failure becomes a row, the other pages go on. So does a page
    that was asked for and got no answer. Only pages whose response could be parsed are
    scored.
    """
    # Answers are paid for once: they are stored before anything reads them.
    parsed = stage(responses.parse_responses(answered), "parsed")
    places = cleaned.select("page_id", "url", "domain")
    records = responses.response_records(parsed, places).withColumn("_source_url", F.col("url"))
    silent = reqs.select("page_id").join(parsed.select("page_id"), "page_id", "left_anti")
    unanswered = silent.select(
        "page_id", F.lit("LLMExtractionError").alias("error_type"), F.lit("llm").alias("component")
    )
    failed = cleaning.page_failures(cleaned).unionByName(
        responses.response_failures(parsed)
        .unionByName(unanswered, allowMissingColumns=True)
        .join(places.drop("domain"), "page_id"),
        allowMissingColumns=True,
    )
    answered_pages = places.join(
        parsed.where(F.col("error_type").isNull()).select("page_id"), "page_id", "left_semi"
    )
    scored = scoring.score_records(records, schema, answered_pages)
    quality = stage(
        scored.withColumn("schema_name", F.lit(schema_name_of(schema))), "quality"
    )
    retry = scoring.retry_strategy(scoring.should_retry(quality))
    return Run(cleaned, reqs, records, failed, quality, retry)


class Refined(NamedTuple):
    choice: DataFrame
    records: DataFrame
    quality: DataFrame
    prompts: DataFrame | None


def retry_requests(
    run: Run,
    schema: dict[str, Any],
    *,
    instructions: str = "",
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Second requests for the pages whose score calls for one.

    ``candidates`` (page_id, extra_instructions) are model-written instructions; a page
    without one gets the text for its first issue.
    """
    told = run.retry.select("page_id", F.col("extra_instructions").alias("_told"))
    if candidates is not None:
        written = candidates.select("page_id", F.col("extra_instructions").alias("_written"))
        told = told.join(written, "page_id", "left").select(
            "page_id", F.coalesce("_written", "_told").alias("_told")
        )
    heading = F.concat(
        F.lit(f"{instructions}\n\n{fv.CANDIDATE_HEADING}\n"), F.col("_told")
    )
    pages = run.cleaned.select("page_id", "text").join(told, "page_id")
    return requests.extraction_requests(pages, schema, strip(heading))


def finish_retry(
    run: Run,
    answered: DataFrame,
    schema: dict[str, Any],
    ts: F.Column,
    *,
    candidates: DataFrame | None = None,
    prompts: DataFrame | None = None,
    minimum_improvement: float = fv.MINIMUM_IMPROVEMENT,
) -> Refined:
    """Score the second answers and keep each page's better records.

    A retry that cannot be parsed changes nothing. ``candidates`` (page_id,
    extra_instructions, latency_ms, input_tokens, output_tokens) become prompt rows,
    judged by what their pages gained; their cost includes the retry's. ``quality``
    holds the scores of the retries: they are further rows of the history.
    """
    parsed = stage(responses.parse_responses(answered), "retry-parsed")
    places = run.quality.select("page_id", "url", "domain", "schema_name")
    usable = parsed.where(F.col("error_type").isNull()).select("page_id")
    records = responses.response_records(parsed, places)
    quality = stage(
        scoring.score_records(
            records, schema, places.join(usable, "page_id", "left_semi")
        ),
        "retry-quality",
    )
    choice = stage(
        scoring.choose_refined(run.quality, quality, minimum_improvement), "choice"
    )
    kept = scoring.kept_records(
        choice,
        run.records.select("page_id", "rec_ord", "rec", "rec_json"),
        records.select("page_id", "rec_ord", "rec", "rec_json"),
    )
    judged = None
    if candidates is not None:
        cost = parsed.select(
            "page_id",
            *[F.col(c).alias(f"_{c}") for c in ("latency_ms", "input_tokens", "output_tokens")],
        )
        tried = choice.where("candidate_quality is not null").join(candidates, "page_id")
        rows = tried.join(cost, "page_id").join(places.drop("url"), "page_id").select(
            F.col("page_id").alias("id"),
            ts.alias("ts"),
            "domain",
            "schema_name",
            "extra_instructions",
            "baseline_quality",
            F.lit(minimum_improvement).alias("minimum_improvement"),
            *[
                (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
                for c in ("latency_ms", "input_tokens", "output_tokens")
            ],
            F.lit(0).cast("long").alias("times_used"),
        )
        saved = save_candidates(rows, prompts)
        measured = quality.select(
            F.col("page_id").alias("id"), F.col("score").alias("quality")
        )
        judged = judge_candidates(saved, measured)
    return Refined(choice, kept, quality, judged)


def batch_records(run: Run) -> DataFrame:
    """Records of all pages with the URL they come from as one more field."""
    source = F.create_map(F.lit("_source_url"), F.col("_source_url"))
    rec = F.map_concat(F.map_filter("rec", lambda k, v: k != "_source_url"), source)
    return run.records.select("page_id", "rec_ord", rec.alias("rec")).withColumn(
        "rec_json", F.to_json("rec")
    )


def history_rows(quality: DataFrame, ts: F.Column, **extra: Any) -> DataFrame:
    """Rows for the extraction history, one per scored page."""
    out = quality.select(
        F.col("page_id").alias("id"),
        "url",
        "domain",
        "schema_name",
        "results_count",
        F.col("score").alias("quality_score"),
        "confidence",
        "uncertainty",
        "fill_rate",
        "issues",
        ts.alias("ts"),
    )
    for name, value in extra.items():
        out = out.withColumn(name, F.lit(value))
    return out


def fold_run(
    run: Run,
    ts: F.Column,
    *,
    profiles: DataFrame,
    cleaning_rules: DataFrame,
    refined: Refined | None = None,
    retry_ts: F.Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Strategy tables after a run: profiles, and rules with outcomes and evidence.

    Outcomes compare with the profiles as they were before the run. Measured retries
    count as further scrapes at ``retry_ts`` (after ``ts``), but waits and rules learn
    from the first try alone.
    """
    rows = history_rows(run.quality, ts, learn_wait=True)
    if refined is not None:
        rows = rows.unionByName(history_rows(refined.quality, retry_ts, learn_wait=False))
    new_profiles = fold_profiles(rows, profiles)
    outcomes = rules.outcome_rows(run.cleaned, run.quality, profiles).select(
        "rule_id", ts.alias("ts"), F.col("page_id").alias("id"), "quality", "baseline_quality"
    )
    judged = stage(rules.fold_outcomes(cleaning_rules, outcomes), "rules")
    found = rules.propose_rules(run.cleaned, run.quality).select(
        *rules.KEY,
        ts.alias("ts"),
        F.col("page_id").alias("id"),
        "reason",
        "evidence",
        "confidence",
        F.lit(False).alias("explicit"),
    )
    counters = ["times_applied", "positive_outcomes", "negative_outcomes", "last_quality"]
    folded = rules.fold_evidence(found, judged)
    kept = judged.select("id", *counters)
    out = folded.join(kept, "id", "left")
    for c in counters[:3]:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return new_profiles, out


def prompts_after(run: Run, prompts: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """``prompts`` with one more use of a domain's best prompt for each page that was asked for."""
    asked = run.cleaned.join(run.requests.select("page_id"), "page_id", "left_semi")
    return count_usage(
        prompts, asked.select("domain", F.lit(schema_name_of(schema)).alias("schema_name"))
    )


def link_records(cleaned: DataFrame, *, shown_only: bool = False) -> DataFrame:
    """Rule-based records for the LINKS schema.

    ``cleaned``: page_id, url, title, links from ``clean_pages(..., links=True)``. Links
    in navigation and other blocks that hold no page text are links all the same;
    ``shown_only`` leaves them out.
    """
    links = F.filter("links", lambda l: l["shown"]) if shown_only else F.col("links")
    found = cleaned.select(
        "page_id", "url", F.col("title").alias("_title"), F.posexplode(links).alias("rec_ord", "_l")
    )
    rec = F.create_map(
        F.lit("text"), F.col("_l.text"), F.lit("url"), F.col("_l.url"),
        F.lit("context"), F.col("_title"),
    )
    return resolve_links(found.select("page_id", "url", "rec_ord", rec.alias("rec")))


def link_quality_by_domain(pages: DataFrame) -> DataFrame:
    """The smallest full run: links of every readable page, scored, per domain."""
    # Written once without html and text: pages are scanned and parsed once.
    cleaned = stage(
        cleaning.extractable(cleaning.clean_pages(pages, links=True)).select(
            "page_id", "url", "domain", "title", "links"
        ),
        "links",
    )
    readable = cleaned.select("page_id", "url", "domain")
    records = link_records(cleaned)
    quality = scoring.score_records(records, fv.SCHEMAS["LINKS"], readable)
    return (
        quality.groupBy("domain")
        .agg(
            F.count("*").alias("pages"),
            F.sum("results_count").alias("records"),
            (F.sum(F.round(F.col("score") * 1000).cast("long")) / (1000.0 * F.count("*"))).alias(
                "avg_quality"
            ),
            F.sum((F.col("score") >= fv.QUALITY_POOR).cast("long")).alias("successes"),
        )
    )


def domain_of(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", url_domain(F.col("url")))
