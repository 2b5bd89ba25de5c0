"""Every operator as a query over the given tables.

Results keep to flat columns (arrays as joined text, times as microseconds, long
texts as hashes) so that they can be compared with SQL value by value.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.numbers import milli
from leafmill.functions.text import (
    is_present,
    redact_column,
    redact_url,
    resolve_links,
    schema_name,
    schema_name_of,
    url_domain,
)
from leafmill.functions.validate import field_error
from leafmill.operators import (
    audit,
    cleaning,
    failures,
    profiles,
    prompts,
    requests,
    responses,
    rules,
    scoring,
)
from leafmill.plans import examples, extraction, recovery, refinement, views
from leafmill.session import new_dir, stage
from leafmill.sources import schemas, sinks, tables
from leafmill.streaming import profiles as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str, sep: str = ",") -> F.Column:
    return F.array_join(column, sep).alias(column)


# --- sources and sinks ---------------------------------------------------------
@query
def page_scan(spark, sf):
    return views.pages(spark, sf).select(
        "page_id", "url", F.length("html").cast("long").alias("html_chars")
    )


@query
def schema_lookup(spark, sf):
    names = views.pick(
        F.col("page_id") % 6, "articles", "Real-Estate agents", "job listings", "LINKS",
        "nothing", "real_estate-AGENTS",
    )
    asked = views.pages(spark, sf).select("page_id", names.alias("schema"))
    return schemas.resolve_names(asked).select(
        "page_id",
        "schema_key",
        F.coalesce(F.array_join("fields", ","), F.lit("")).alias("fields"),
        F.coalesce(schema_name(F.col("fields")), F.lit("")).alias("schema_name"),
    )


@query
def schema_catalog_fields(spark, sf):
    """All eight columns of the catalog, for built-in schemas and one with typed fields."""
    known = {**schemas.list_schemas(), "TYPED_ROWS": views.TYPED_SCHEMA}
    names = views.pick(F.col("page_id") % 4, "links", "Typed rows", "real-estate agents", "nothing")
    asked = views.pages(spark, sf).select("page_id", names.alias("schema"))
    return schemas.schema_fields(asked, known).drop("schema")


@query
def custom_schema_fields(spark, sf):
    parts = views.table(spark, sf, "part")
    listed = F.concat(
        F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit(" ,")), F.lit(", ,"), F.lower("p_type")
    )
    blank = F.when(F.col("p_size") == 1, F.lit(" , ")).otherwise(listed)
    return parts.select(
        "p_partkey", F.explode_outer(schemas.custom_fields(blank)).alias("_f")
    ).select("p_partkey", "_f.field", "_f.description")


@query
def csv_field_order(spark, sf):
    records = views.part_records(spark, sf).withColumn("page_id", -F.col("page_id"))
    first = sinks.field_order(records)
    return first.select(
        "field", "first_seen.page_id", "first_seen.rec_ord"
    )


@query
def csv_sink(spark, sf):
    path = new_dir(spark, "csv")
    sinks.save_csv(views.part_records(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("updated").agg(
        F.count("*").alias("records"),
        F.count("title").alias("titles"),
        F.count("rating").alias("ratings"),
        F.max("url").alias("max_url"),
    )


@query
def json_sink(spark, sf):
    path = new_dir(spark, "json")
    sinks.save_json(views.part_records(spark, sf), path)
    back = spark.read.schema("title string, rating string, url string").json(path)
    return back.groupBy("rating").agg(
        F.count("*").alias("records"), F.count("title").alias("titles"), F.min("url").alias("min_url")
    )


@query
def history_table(spark, sf):
    """Append to the history, read it back with the day pruned, bring it up to date."""
    path = new_dir(spark, "history")
    rows = views.history(spark, sf)
    tables.append_history(rows.where("schema_name <> 'view'"), path)
    tables.append_history(rows.where("schema_name = 'view'"), path)
    back = spark.read.parquet(path)
    return (
        tables.upgrade(back, "extraction_history")
        .groupBy("domain")
        .agg(
            F.count("*").alias("n"),
            F.sum("uncertainty").alias("uncertainty"),
            F.sum(F.size("issues")).cast("long").alias("issues"),
            F.sum(milli(F.col("quality_score"))).alias("milli_quality"),
            F.max(F.unix_micros("ts")).alias("last_us"),
        )
    )


@query
def strategy_table_versions(spark, sf):
    """Two versions of the profile table; the second starts from the first."""
    root = new_dir(spark, "tables")
    rows = views.history(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    first = profiles.fold_profiles(rows.where(F.col("ts") < cut))
    tables.write_table(first, root, "domain_profiles")
    old = tables.read_table(spark, root, "domain_profiles")
    tables.write_table(
        profiles.fold_profiles(rows.where(F.col("ts") >= cut), old), root, "domain_profiles"
    )
    return _profile_columns(tables.read_table(spark, root, "domain_profiles"))


@query
def table_upgrade(spark, sf):
    old = views.prompt_rows(spark, sf).select(
        "id", "domain", "schema_name", "extra_instructions", "ts"
    )
    return tables.upgrade(old, "prompt_refinements").select(
        "id", "domain", "version", "status", "baseline_quality",
        F.col("candidate_quality").isNull().alias("unmeasured"),
        "minimum_improvement", "input_tokens", F.unix_micros("ts").alias("us"),
    )


@query
def legacy_history_import(spark, sf):
    """History as the older row store kept it: seconds, joined issues, fewer columns."""
    rows = views.history(spark, sf)
    old = rows.select(
        "id", "domain", "schema_name", "quality_score",
        F.array_join("issues", ", ").alias("error"),
        (F.unix_micros("ts") / 1_000_000).alias("timestamp"),
    )
    back = tables.import_legacy(old, "extraction_history")
    return back.groupBy("domain").agg(
        F.count("*").alias("n"),
        F.sum(F.size("issues")).cast("long").alias("issues"),
        F.sum(milli(F.col("quality_score"))).alias("milli_quality"),
        F.min(F.date_trunc("second", "ts").cast("long")).alias("first_second"),
        F.sum("uncertainty").alias("uncertainty"),
    )


@query
def legacy_rules_import(spark, sf):
    """Rules of the older row store, from their evidence as a JSON list; what is unusable says why."""
    rows = views.evidence_rows(spark, sf)
    listed = F.to_json(F.array("evidence", "reason"))
    old = rows.select(
        "id", "domain", "rule_type", "selector", "confidence",
        F.when(F.col("id") % 11 == 5, F.lit("seen once")).otherwise(listed).alias("supporting_evidence"),
        F.unix_timestamp("ts").cast("double").alias("created_at"),
        F.lit(0.0).alias("updated_at"),
    )
    return tables.import_legacy(old, "cleaning_rules", rejects=True).select(
        "id", "domain", "rule_type", "selector", "status", "evidence_count",
        F.array_join("evidence", "|").alias("evidence"),
        F.col("created_at").cast("long").alias("created_second"),
        F.col("updated_at").isNull().alias("never_updated"),
        "rejected",
    )


@query
def feedback_to_rules(spark, sf):
    """Feedback rows with rule wishes in their details, some of them unusable."""
    e = views.table(spark, sf, "events")
    i = F.col("event_id")
    details = views.pick(
        i % 5,
        '{"rule_type": "class", "selector": "{k}"}',
        '{"rule_type": "xpath", "selector": "{k}"}',
        '{"selector": "{k}"}',
        "not json",
        '{"rule_type": "id", "selector": "{k}", "note": "x"}',
    )
    feedback = e.select(
        i.alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("d"), F.col("user_id") % 50, F.lit(".example.org")).alias("domain"),
        F.when(F.col("event_type") == "click", "note").otherwise("cleaning_rule").alias(
            "feedback_type"
        ),
        F.replace(details, F.lit("{k}"), F.col("event_type")).alias("details"),
    )
    path = new_dir(spark, "feedback")
    tables.append_feedback(feedback, path)
    kept = spark.read.parquet(path)
    wishes, rejected = rules.feedback_rules(kept)
    made = rules.fold_evidence(rules.explicit_rules(wishes))
    return made.select(
        "domain", "rule_type", "selector", "status", "evidence_count", "confidence", "reason",
        F.array_join("evidence", ",").alias("evidence"),
    ).unionByName(
        rejected.groupBy("domain").agg(F.count("*").alias("evidence_count")).select(
            "domain", F.lit("").alias("rule_type"), F.lit("").alias("selector"),
            F.lit("rejected").alias("status"), "evidence_count", F.lit(0.0).alias("confidence"),
            F.lit("").alias("reason"), F.lit("").alias("evidence"),
        )
    )


@query
def result_preview(spark, sf):
    return sinks.preview(views.part_records(spark, sf), views.PART_SCHEMA)


# --- page cleaning -------------------------------------------------------------
@query
def clean_page_text(spark, sf):
    out = cleaning.clean_pages(views.pages(spark, sf))
    return out.select(
        "page_id", "domain", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def clean_marked_pages(spark, sf):
    out = cleaning.clean_pages(views.marked_pages(spark, sf))
    return out.select(
        "page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def clean_marked_pages_compat(spark, sf):
    out = cleaning.clean_pages(views.marked_pages(spark, sf), profile="compat")
    return out.select(
        "page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def clean_with_learned_rules(spark, sf):
    out = cleaning.clean_pages(views.marked_pages(spark, sf), views.page_rules(spark, sf))
    return out.select(
        "page_id", _joined("applied_rule_ids"), F.md5("text").alias("text_md5")
    )


@query
def challenge_pages(spark, sf):
    marked = views.marked_pages(spark, sf)
    extra = views.pick(
        F.col("page_id") % 5, "", "<i>HCaptcha</i><b>CF-CHL-1</b>", "<i>awsWAF-captcha</i>",
        "challenge-platform", "",
    )
    html = F.concat("html", extra)
    return (
        marked.select("page_id", cleaning.challenge(html).alias("c"))
        .where("c is not null")
        .select("page_id", "c.type", "c.marker")
    )


@query
def page_failures(spark, sf):
    return cleaning.page_failures(cleaning.clean_pages(views.marked_pages(spark, sf))).select(
        "page_id", "url", "error_type", F.coalesce("challenge", F.lit("")).alias("challenge"), "component"
    )


@query
def bounded_content(spark, sf):
    docs = views.table(spark, sf, "documents")
    limits = {
        "standard": fv.CONTENT_CHARS, "reduced": fv.REDUCED_CONTENT_CHARS,
        "question": fv.QUESTION_CHARS, "sample": fv.REFINEMENT_SAMPLE_CHARS,
        "prompt": fv.REFINEMENT_PROMPT_CHARS,
    }
    cut = {n: cleaning.bounded(F.col("text"), limit) for n, limit in limits.items()}
    return docs.select(
        "doc_id",
        *[F.length(c["content"]).cast("long").alias(f"{n}_chars") for n, c in cut.items()],
        *[c["truncated"].alias(f"{n}_cut") for n, c in cut.items()],
        F.md5(cut["prompt"]["content"]).alias("prompt_md5"),
    )


# --- requests and responses ----------------------------------------------------
def _texts(spark, sf) -> DataFrame:
    return cleaning.clean_pages(views.pages(spark, sf)).select("page_id", "url", "domain", "text")


@query
def extraction_requests(spark, sf):
    instructions = F.when(F.col("page_id") % 2 == 0, F.lit("Keep prices.")).otherwise("")
    refinement = F.when(
        F.col("page_id") % 3 == 0, F.concat(F.lit("Look below "), "domain")
    ).otherwise("")
    told = requests.with_refinement(instructions, refinement)
    limit = F.when(F.col("page_id") % 5 == 0, 1000).otherwise(fv.CONTENT_CHARS)
    out = requests.extraction_requests(_texts(spark, sf), fv.SCHEMAS["ARTICLES"], told, limit)
    return out.select(
        "page_id", "kind", F.md5("system_prompt").alias("prompt_md5"),
        F.md5("user_content").alias("content_md5"), F.col("content_chars").cast("long").alias("content_chars"),
        "truncated",
    )


@query
def question_requests(spark, sf):
    ask = F.concat(F.lit("What does "), "domain", F.lit(" say?"))
    out = requests.question_requests(_texts(spark, sf), ask)
    return out.select(
        "page_id", "kind", F.md5("user_content").alias("content_md5"),
        F.col("content_chars").cast("long").alias("content_chars"),
    )


def _quality_of_responses(spark, sf):
    parsed = stage(responses.parse_responses(views.part_responses(spark, sf)), "parsed")
    records = stage(
        responses.response_records(parsed, views.part_pages(spark, sf)), "records"
    )
    good = parsed.where("error_type is null").select("page_id")
    return scoring.score_records(records, fv.SCHEMAS["PRODUCTS"], good), records


@query
def refinement_requests(spark, sf):
    """Whole requests, with JSON indented by two, for pages that were filled less than half."""
    quality, records = _quality_of_responses(spark, sf)
    pages = views.part_texts(spark, sf)
    return requests.refinement_requests(quality, records, pages, fv.SCHEMAS["PRODUCTS"])


@query
def parsed_responses(spark, sf):
    parsed = responses.parse_responses(views.part_responses(spark, sf))
    return parsed.select(
        "page_id",
        F.coalesce("error_type", F.lit("")).alias("error_type"),
        F.coalesce(F.size("records"), F.lit(-1)).cast("long").alias("n_records"),
    )


@query
def response_records(spark, sf):
    parsed = responses.parse_responses(views.part_responses(spark, sf))
    out = responses.response_records(parsed, views.part_pages(spark, sf))
    return out.select(
        "page_id", F.col("rec_ord").cast("long").alias("rec_ord"), F.col("rec.title").alias("title"),
        F.col("rec.url").alias("url"), F.col("rec.price").alias("price"), F.col("rec.stock").alias("stock"),
    )


@query
def usage_tally(spark, sf):
    return responses.usage_tally(
        views.part_responses(spark, sf), views.part_pages(spark, sf)
    )


@query
def text_answers(spark, sf):
    out = responses.text_answers(views.part_responses(spark, sf))
    long_enough = responses.refinement_candidates(out).select("page_id", F.lit(True).alias("candidate"))
    return out.join(long_enough, "page_id", "left").select(
        "page_id",
        F.coalesce(F.md5("answer"), F.lit("")).alias("answer_md5"),
        F.coalesce("error_type", F.lit("")).alias("error_type"),
        F.coalesce("candidate", F.lit(False)).alias("candidate"),
    )


@query
def resolved_links(spark, sf):
    cleaned = cleaning.clean_pages(views.linked_pages(spark, sf), links=True)
    out = extraction.link_records(cleaned)
    return out.select(
        "page_id", F.col("rec_ord").cast("long").alias("rec_ord"),
        F.col("rec.text").alias("text"), F.col("rec.url").alias("link"),
    )


@query
def resolved_links_compat(spark, sf):
    """The variant that also treats ``website`` and takes any ``http`` prefix as absolute."""
    pages = views.pages(spark, sf)
    rec = F.create_map(
        F.lit("website"), F.concat(F.lit("/about/"), "page_id"),
        F.lit("url"), F.lit("https:relative"), F.lit("image_url"), F.lit(""),
    )
    done = resolve_links(pages.select("page_id", "url", rec.alias("rec")), compat=True)
    return done.select(
        "page_id", F.col("rec.website").alias("website"), F.col("rec.url").alias("link"),
        F.col("rec.image_url").alias("image_url"),
    )


def _headline_extractor(batches):
    """Stands in for a model: the first line of the page as headline."""
    import json

    for batch in batches:
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "raw_output": [
                    json.dumps([{"headline": t.split("\n")[0], "summary": t.split("\n")[-1], "url": "/a"}])
                    for t in batch["user_content"]
                ],
                "input_tokens": batch["content_chars"].astype("int64") // 4,
                "output_tokens": 10,
                "latency_ms": 1.0,
                "model": "first-line",
            }
        )


def _article_run(spark, sf) -> extraction.Run:
    schema = fv.SCHEMAS["ARTICLES"]
    cleaned, reqs = extraction.build_requests(views.marked_pages(spark, sf), schema)
    answered = requests.run_extractor(reqs, _headline_extractor)
    return extraction.finish_run(cleaned, reqs, answered, schema)


@query
def batch_run_records(spark, sf):
    out = extraction.batch_records(_article_run(spark, sf))
    return out.select(
        "page_id", F.col("rec_ord").cast("long").alias("rec_ord"),
        F.col("rec._source_url").alias("source_url"), F.col("rec.url").alias("link"),
        F.md5(F.col("rec.headline")).alias("headline_md5"),
    )


@query
def batch_run_failures(spark, sf):
    return _article_run(spark, sf).failures.select("page_id", "url", "error_type")


@query
def batch_run_quality(spark, sf):
    return _article_run(spark, sf).quality.select(
        "page_id", "domain", "schema_name", "results_count", "score", _joined("issues")
    )


@query
def run_prompt_usage(spark, sf):
    """Prompts after a run, where every domain had an accepted one and a rejected one."""
    schema = fv.SCHEMAS["ARTICLES"]
    domains = extraction.domain_of(views.pages(spark, sf)).groupBy("domain").agg(F.min("page_id").alias("k"))
    before = domains.select(
        "domain", F.lit(schema_name_of(schema)).alias("schema_name"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("rejected"), "k",
    ).select(
        "domain", "schema_name", (F.col("k") * 2 + F.col("rejected")).alias("id"),
        F.when(F.col("rejected") == 1, "rejected").otherwise("accepted").alias("status"),
        F.lit(0.5).alias("candidate_quality"), F.lit(1).alias("version"),
        F.lit(3).cast("long").alias("times_used"),
    )
    after = extraction.prompts_after(_article_run(spark, sf), before, schema)
    return after.select("id", "domain", "status", "times_used")


@query
def batch_run_strategy(spark, sf):
    """Profiles after the run, from none before it."""
    run = _article_run(spark, sf)
    rows = extraction.history_rows(run.quality, F.lit("2024-02-01").cast("timestamp"))
    return _profile_columns(profiles.fold_profiles(rows))


@query
def batch_run_rules(spark, sf):
    """Rules after a run that applied learned rules and found new noise classes."""
    schema = fv.SCHEMAS["ARTICLES"]
    ts = F.lit("2024-02-01").cast("timestamp")
    old = tables.upgrade(views.page_rules(spark, sf), "cleaning_rules")
    cleaned, reqs = extraction.build_requests(
        views.marked_pages(spark, sf), schema, cleaning_rules=old
    )
    answered = requests.run_extractor(reqs, _headline_extractor)
    run = extraction.finish_run(cleaned, reqs, answered, schema)
    poor = run._replace(
        quality=run.quality.withColumn(
            "issues", F.array_append("issues", F.lit("LOW_VALIDITY"))
        )
    )
    before = profiles.fold_profiles(
        extraction.history_rows(
            run.quality.withColumn("score", F.lit(0.9)), F.lit("2024-01-01").cast("timestamp")
        )
    )
    _, after = extraction.fold_run(poor, ts, profiles=before, cleaning_rules=old)
    return after.select(
        "domain", "rule_type", "selector", "status", "evidence_count", "confidence",
        "times_applied", "negative_outcomes", "last_quality",
    )


def _second_extractor(batches):
    """A model that was told what to look for: more fields, and two records."""
    import json

    for batch in batches:
        lines = [t.split("\n") for t in batch["user_content"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "raw_output": [
                    "no answer"
                    if i % 5 == 0
                    else json.dumps(
                        [
                            {"headline": x[0], "author": "A. Writer", "published_date": "2024-01-15",
                             "summary": x[-1], "url": f"/{k}", "category": "news"}
                            for k in range(1 + i % 2)
                        ]
                    )
                    for i, x in zip(batch["page_id"], lines)
                ],
                "input_tokens": 7,
                "output_tokens": 3,
                "latency_ms": 2.0,
                "model": "second",
            }
        )


def _poor_extractor(batches):
    import json

    for batch in batches:
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "raw_output": [json.dumps([{"headline": "x"}])] * len(batch),
                "input_tokens": 5,
                "output_tokens": 1,
                "latency_ms": 1.0,
                "model": "poor",
            }
        )


def _refined(spark, sf):
    """A poor first run, then measured retries with written instructions."""
    schema = fv.SCHEMAS["ARTICLES"]
    cleaned, reqs = extraction.build_requests(views.pages(spark, sf), schema)
    run = extraction.finish_run(
        cleaned, reqs, requests.run_extractor(reqs, _poor_extractor), schema
    )
    written = run.quality.select(
        "page_id",
        F.concat(F.lit("Look for the headline of "), "domain").alias("extra_instructions"),
        F.lit(4.0).alias("latency_ms"),
        F.lit(20).cast("long").alias("input_tokens"),
        F.lit(2).cast("long").alias("output_tokens"),
    )
    again = extraction.retry_requests(run, schema, candidates=written)
    out = extraction.finish_retry(
        run,
        requests.run_extractor(again, _second_extractor),
        schema,
        F.lit("2024-02-01").cast("timestamp"),
        candidates=written,
    )
    return run, again, out


@query
def recovered_run(spark, sf):
    """A run whose failed pages are asked again: shorter content, the fallback model, until budgets end."""
    schema = fv.SCHEMAS["ARTICLES"]
    cleaned, reqs = extraction.build_requests(views.pages(spark, sf), schema)
    tried = recovery.ask_with_recovery(
        cleaned, reqs, examples.moody_extractor, F.lit("2024-03-01"), fallback_model=examples.FALLBACK
    )
    run = extraction.finish_run(cleaned, reqs, tried.answered, schema)
    results = tried.plan.groupBy(F.col("job_id").cast("long").alias("page_id")).agg(
        F.count("*").alias("failures"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "result", "attempt"))),
                                 lambda r: F.concat_ws(":", r["result"], r["attempt"])), ",").alias("results"),
    )
    told = tried.events.groupBy(F.col("job_id").cast("long").alias("page_id")).agg(F.count("*").alias("events"))
    return (
        tried.settings.join(results, "page_id", "left").join(told, "page_id", "left")
        .join(run.quality.select("page_id", "results_count"), "page_id", "left")
        .join(run.failures.select("page_id", "error_type"), "page_id", "left")
        .select(
            "page_id", F.col("asks").cast("long").alias("asks"), F.col("content_limit").cast("long").alias("content_limit"), "model",
            F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("results", F.lit("")).alias("results"),
            F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("results_count", F.lit(0)).cast("long").alias("records"), "error_type",
        )
    )


@query
def refined_run(spark, sf):
    run, again, out = _refined(spark, sf)
    kept = out.records.groupBy("page_id").agg(F.count("*").alias("n_records"))
    judged = out.prompts.select(
        F.col("id").alias("page_id"), "version", "status", "latency_ms", "input_tokens"
    )
    told = again.select("page_id", F.md5("system_prompt").alias("prompt_md5"))
    return (
        out.choice.join(kept, "page_id")
        .join(judged, "page_id", "left")
        .join(told, "page_id")
        .select(
            "page_id", "baseline_quality",
            F.coalesce("candidate_quality", F.lit(-1.0)).alias("candidate_quality"),
            "accepted", "n_records", F.coalesce("version", F.lit(0)).cast("long").alias("version"),
            F.coalesce("status", F.lit("")).alias("status"),
            F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
            F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), "prompt_md5",
        )
    )


@query
def refinement_chain(spark, sf):
    """First scores, instructions by a model, second scores, and the judged prompt rows."""
    schema = fv.SCHEMAS["ARTICLES"]
    cleaned, reqs = extraction.build_requests(views.pages(spark, sf), schema)
    run = extraction.finish_run(cleaned, reqs, requests.run_extractor(reqs, examples.headline_extractor), schema)
    out = refinement.refine_run(run, schema, examples.hint_writer, examples.hinted_extractor, F.lit("2024-03-01").cast("timestamp"))
    asked = out.written.select("page_id", F.coalesce("answer", "error_type").alias("written"))
    tried = out.retried.select("page_id", F.element_at(F.split("system_prompt", "\n"), -1).alias("told"))
    judged = out.refined.prompts.select(
        F.col("id").alias("page_id"), "version", "status", "extra_instructions", "latency_ms", "input_tokens", "output_tokens"
    )
    kept = out.refined.records.groupBy("page_id").agg(F.max(F.size("rec")).alias("fields"))
    return (
        out.refined.choice.join(asked, "page_id", "left").join(tried, "page_id", "left").join(judged, "page_id", "left").join(kept, "page_id")
        .select(
            "page_id", (F.col("baseline_quality") < fv.QUALITY_GOOD).alias("weak"), F.col("candidate_quality").isNotNull().alias("tried"), "accepted",
            "written", "told", F.col("version").cast("long").alias("version"), "status", "extra_instructions", "latency_ms",
            F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), F.col("fields").cast("long").alias("fields"),
        )
    )


@query
def refined_run_strategy(spark, sf):
    """Profiles after both tries: two scrapes a page, waits from the first alone."""
    run, _, out = _refined(spark, sf)
    none = tables.upgrade(views.page_rules(spark, sf), "cleaning_rules").where("false")
    before = profiles.fold_profiles(views.history(spark, sf).where("false"))
    after, _ = extraction.fold_run(
        run,
        F.lit("2024-02-01").cast("timestamp"),
        profiles=before,
        cleaning_rules=none,
        refined=out,
        retry_ts=F.lit("2024-02-02").cast("timestamp"),
    )
    return _profile_columns(after)


# --- scalar functions ----------------------------------------------------------
@query
def url_domains(spark, sf):
    return views.pages(spark, sf).select("page_id", url_domain(F.col("url")).alias("domain"))


def _mixed_urls(spark, sf) -> DataFrame:
    k = F.col("page_id") % 7
    url = F.col("url")
    rest = F.regexp_replace(url, "^https?://", "")
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    path = F.regexp_replace(rest, "^[^/]*", "")
    changed = (
        F.when(k == 0, F.concat(F.lit("HTTP://User:pw@"), F.upper(host), F.lit(":8080"), path))
        .when(k == 1, F.concat(F.lit("https://me@"), host, F.lit(":0"), path))
        .when(k == 2, F.concat(F.lit("https://"), host, F.lit(":99999"), path))
        .when(k == 3, F.concat(F.lit("https://[2001:DB8::1]:443"), path))
        .when(k == 4, path)
        .when(k == 5, F.concat(F.lit("https://"), host, F.lit(":x"), path))
        .otherwise(url)
    )
    return views.pages(spark, sf).select("page_id", changed.alias("url"))


@query
def redacted_urls(spark, sf):
    return _mixed_urls(spark, sf).select("page_id", redact_url(F.col("url")).alias("safe_url"))


def _redacted(docs: DataFrame) -> DataFrame:
    return redact_column(docs.select("doc_id", "text"), "text").select(
        "doc_id", F.md5("text").alias("safe_md5"), "bearer_hits", "assignment_hits", "prefix_hits"
    )


@query
def redacted_documents(spark, sf):
    return _redacted(views.table(spark, sf, "documents"))


@query
def redacted_secrets(spark, sf):
    """Secrets of every kind, set between the words of real documents."""
    docs = views.table(spark, sf, "documents")
    secret = views.pick(
        F.col("doc_id") % 6, "Authorization: BEARER abc.def-1", "token = t0k; x", "API_KEY:k,l",
        "sk-abcdefgh12345678", "ghp_abcdefgh123456", "no secret",
    )
    text = F.concat("text", F.lit(" "), secret, F.lit(" cookie= c\n"), "text")
    return _redacted(docs.withColumn("text", text))


@query
def present_values(spark, sf):
    rec = F.col("rec")
    fields = list(views.PART_SCHEMA)
    return views.part_records(spark, sf).agg(
        *[F.sum(is_present(rec[f]).cast("long")).alias(f) for f in fields]
    )


@query
def field_errors(spark, sf):
    rec = F.col("rec")
    errors = F.array(
        *[
            F.struct(F.lit(f).alias("field"), field_error(f, rec[f], spec).alias("error"))
            for f, spec in views.PART_SCHEMA.items()
        ]
    )
    return (
        views.part_records(spark, sf)
        .select(F.explode(errors).alias("e"))
        .groupBy("e.field", F.coalesce("e.error", F.lit("")).alias("error"))
        .agg(F.count("*").alias("n"))
    )


# --- quality -------------------------------------------------------------------
def _quality_columns(quality: DataFrame) -> DataFrame:
    return quality.select(
        "page_id",
        "results_count",
        "score",
        *[F.col(f"components.{c}").alias(c) for c in fv.SCORE_WEIGHTS],
        "confidence",
        "uncertainty",
        _joined("validation_errors"),
        _joined("issues"),
    )


@query
def page_quality_scores(spark, sf):
    """Pages without records are in it: every brand page is asked for as well."""
    records = views.part_records(spark, sf)
    known = records.select("page_id").unionByName(
        views.part_records(spark, sf, "brand").select((-F.col("page_id")).alias("page_id"))
    )
    return _quality_columns(
        scoring.score_records(records, views.PART_SCHEMA, known.distinct())
    )


@query
def brand_quality_scores(spark, sf):
    return _quality_columns(
        scoring.score_records(views.part_records(spark, sf, "brand"), views.PART_SCHEMA)
    )


@query
def quality_without_identity(spark, sf):
    """A schema without an identifying field: whole records are compared."""
    schema = {"price": "Price", "rooms": "Rooms"}
    records = views.part_records(spark, sf, "brand").withColumn(
        "rec", F.map_filter("rec", lambda k, v: k.isin(*schema))
    )
    return _quality_columns(scoring.score_records(records, schema))


@query
def mixed_schema_scores(spark, sf):
    """Pages of two schemas in one table."""
    odd = F.col("page_id") % 2 == 1
    slim = F.map_filter("rec", lambda k, v: k.isin("price", "rooms"))
    records = (
        views.part_records(spark, sf, "brand")
        .withColumn("schema_key", F.when(odd, "PARTS").otherwise("PRICES"))
        .withColumn("rec", F.when(odd, F.col("rec")).otherwise(slim))
    )
    chosen = {"PARTS": views.PART_SCHEMA, "PRICES": {"price": "Price", "rooms": "Rooms"}}
    out = scoring.score_by_schema(records, chosen)
    return out.select(
        "schema_key", "page_id", "results_count", "score", "confidence",
        _joined("validation_errors"), _joined("issues"),
    )


@query
def retry_strategies(spark, sf):
    weak = scoring.should_retry(views.page_quality(spark, sf))
    return scoring.retry_strategy(weak).select(
        "page_id", "extra_instructions", "wait_seconds_adjust", "retry"
    )


@query
def refinement_choice(spark, sf):
    """Small pages against the same pages with better records."""
    records = views.part_records(spark, sf)
    better = records.withColumn(
        "rec",
        F.transform_values(
            "rec",
            lambda k, v: F.when(k == "price", F.lit("$1")).when(k == "rating", F.lit("5")).otherwise(v),
        ),
    )
    base = scoring.score_records(records, views.PART_SCHEMA)
    retry = scoring.score_records(better, views.PART_SCHEMA)
    choice = stage(scoring.choose_refined(base, retry), "choice")
    kept = scoring.kept_records(choice, records, better)
    prices = kept.groupBy("page_id").agg(
        F.sum((F.col("rec.price") == "$1").cast("long")).alias("new_prices")
    )
    return choice.join(prices, "page_id")


@query
def link_quality_by_domain(spark, sf):
    return extraction.link_quality_by_domain(views.pages(spark, sf))


# --- profiles and reports ------------------------------------------------------
def _profile_columns(p: DataFrame) -> DataFrame:
    return p.select(
        "domain", "wait_seconds", "avg_quality", "total_scrapes", "total_successes",
        "total_failures", F.unix_micros("last_scraped").alias("last_us"),
    )


def _profiles(spark, sf) -> DataFrame:
    """The profile table as a run finds it: stored."""
    return stage(profiles.fold_profiles(views.history(spark, sf)), "profiles")


@query
def domain_profiles(spark, sf):
    return _profile_columns(profiles.fold_profiles(views.history(spark, sf)))


@query
def learned_waits(spark, sf):
    known = _profiles(spark, sf)
    asked = views.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("d"), F.col("user_id") % 60, F.lit(".example.org")).alias("domain")
    )
    return profiles.learned_wait(asked, known).select("event_id", "wait_seconds")


@query
def success_rates(spark, sf):
    return profiles.success_rate(_profiles(spark, sf))


@query
def domain_last_rows(spark, sf):
    return profiles.last_rows(views.history(spark, sf), 20).select(
        "domain", "id", F.col("rank").cast("long").alias("rank"), "quality_score"
    )


@query
def issue_frequency(spark, sf):
    return profiles.issue_frequency(views.history(spark, sf)).select(
        "domain", "issue", "n", F.col("rank").cast("long").alias("rank")
    )


@query
def domain_diagnosis(spark, sf):
    rows = views.history(spark, sf)
    out = profiles.diagnose_domains(rows, profiles.fold_profiles(rows))
    issues = F.transform("common_issues", lambda i: F.concat(i["issue"], F.lit(":"), i["n"]))
    return out.select(
        "domain", "total_attempts", "success_rate", "avg_quality", "trend",
        F.array_join(issues, ",").alias("common_issues"), _joined("recommendations", "|"),
    )


@query
def top_domains(spark, sf):
    return profiles.top_domains(_profiles(spark, sf))


@query
def memory_stats(spark, sf):
    judged = prompts.judge_candidates(_prompts(spark, sf), _measured(spark, sf))
    made = rules.fold_evidence(views.evidence_rows(spark, sf))
    notes = views.table(spark, sf, "events").where("event_type = 'purchase'")
    return profiles.memory_stats(views.history(spark, sf), judged, made, notes)


# --- prompts -------------------------------------------------------------------
def _prompts(spark, sf) -> DataFrame:
    return prompts.save_candidates(views.prompt_rows(spark, sf).drop("quality"))


def _measured(spark, sf) -> DataFrame:
    """Open orders have no measurement yet."""
    return views.prompt_rows(spark, sf).where("order_status <> 'O'").select("id", "quality")


def _judged(spark, sf) -> DataFrame:
    return prompts.judge_candidates(_prompts(spark, sf), _measured(spark, sf))


@query
def prompt_versions(spark, sf):
    rows = views.prompt_rows(spark, sf).drop("quality")
    old = prompts.save_candidates(rows.where("order_status = 'F'"))
    new = prompts.save_candidates(rows.where("order_status <> 'F'"), old)
    return old.unionByName(new).select(
        "id", "domain", "schema_name", F.col("version").cast("long").alias("version"), "status"
    )


@query
def prompt_decisions(spark, sf):
    return _judged(spark, sf).select(
        "id", "status", F.coalesce("candidate_quality", F.lit(-1.0)).alias("candidate_quality")
    )


@query
def best_prompts(spark, sf):
    return prompts.best_prompts(_judged(spark, sf)).select(
        "domain", "schema_name", "id", F.col("version").cast("long").alias("version"),
        "candidate_quality", "extra_instructions",
    )


@query
def prompt_rollback(spark, sf):
    bad = views.prompt_rows(spark, sf).where("order_status = 'F'").select("id")
    return prompts.roll_back(_judged(spark, sf), bad).select("id", "status")


@query
def prompt_usage(spark, sf):
    uses = views.prompt_rows(spark, sf).select("domain", "schema_name")
    return prompts.count_usage(_judged(spark, sf), uses).select("id", "times_used")


@query
def prompt_import(spark, sf):
    rows = views.prompt_rows(spark, sf)
    old = prompts.save_candidates(rows.where("order_status <> 'P'").drop("quality"))
    trusted = rows.where("order_status = 'P'").drop("baseline_quality")
    return prompts.import_trusted(trusted, old).select(
        "id", F.col("version").cast("long").alias("version"), "status", "baseline_quality",
        "candidate_quality", "minimum_improvement",
    )


# --- cleaning rules ------------------------------------------------------------
def _rule_columns(r: DataFrame) -> DataFrame:
    return r.select(
        "id", "domain", "rule_type", "selector", F.round("confidence", 6).alias("confidence"),
        "evidence_count", "status", "reason", F.array_join("evidence", ",").alias("evidence"),
        F.unix_micros("created_at").alias("created_us"),
    )


@query
def rule_evidence(spark, sf):
    return _rule_columns(rules.fold_evidence(views.evidence_rows(spark, sf)))


@query
def rule_evidence_continued(spark, sf):
    """The same rules, folded in two runs."""
    rows = views.evidence_rows(spark, sf)
    cut = F.lit("2024-01-04").cast("timestamp")
    old = rules.fold_evidence(rows.where(F.col("ts") < cut))
    return _rule_columns(rules.fold_evidence(rows.where(F.col("ts") >= cut), old))


@query
def rejected_evidence(spark, sf):
    bad = rules.rejected_evidence(views.evidence_rows(spark, sf))
    return bad.groupBy("domain", "rule_type").agg(F.count("*").alias("n"))


@query
def active_rules(spark, sf):
    made = rules.fold_evidence(views.evidence_rows(spark, sf))
    return rules.rules_of(made).select("id", "domain", "rule_type", "selector")


@query
def rule_outcomes(spark, sf):
    out = rules.fold_outcomes(views.outcome_rules(spark, sf), views.outcomes(spark, sf))
    return out.select(
        "id", "status", "times_applied", "positive_outcomes", "negative_outcomes", "last_quality"
    )


@query
def disabled_rules(spark, sf):
    bad = views.outcomes(spark, sf).where("quality > 0.5").select(F.col("rule_id").alias("id"))
    return rules.disable_rules(views.outcome_rules(spark, sf), bad).select("id", "status")


@query
def rule_proposals(spark, sf):
    cleaned = cleaning.clean_pages(views.marked_pages(spark, sf))
    return rules.propose_rules(cleaned, views.page_quality(spark, sf)).select(
        "page_id", "domain", "selector", "evidence", "confidence", "reason"
    )


@query
def rule_proposals_single(spark, sf):
    """As above for classes that occur once."""
    cleaned = cleaning.clean_pages(views.pages(spark, sf))
    return rules.propose_rules(cleaned, views.page_quality(spark, sf), min_count=1).select(
        "page_id", "domain", "selector", "evidence", "confidence"
    )


@query
def rule_learning(spark, sf):
    """Proposals of a run folded into rules."""
    cleaned = cleaning.clean_pages(views.pages(spark, sf))
    found = rules.propose_rules(cleaned, views.page_quality(spark, sf), min_count=1)
    rows = found.withColumn("ts", F.lit("2024-02-01").cast("timestamp")).withColumn(
        "id", F.col("page_id")
    ).withColumn("explicit", F.lit(False))
    return rules.fold_evidence(rows).select(
        "domain", "selector", "evidence_count", F.round("confidence", 6).alias("confidence"), "status"
    )


@query
def rule_outcome_rows(spark, sf):
    cleaned = cleaning.clean_pages(views.marked_pages(spark, sf), views.page_rules(spark, sf))
    quality = views.page_quality(spark, sf)
    shop = extraction.domain_of(views.pages(spark, sf)).groupBy("domain").agg(
        F.count("*").alias("n")
    )
    before = shop.where("n > 3").select("domain", (F.col("n") / 100.0).alias("avg_quality"))
    return rules.outcome_rows(cleaned, quality, before)


# --- settings ------------------------------------------------------------------
@query
def page_settings(spark, sf):
    """Settings of every event's domain; profiles, prompts and rules know some domains."""
    pages = views.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("d"), F.col("user_id") % 60, F.lit(".example.org")))
        .otherwise(F.concat(F.lit("c"), F.col("user_id") % 120, F.lit(".example.org")))
        .alias("domain"),
    )
    made = stage(rules.fold_evidence(views.evidence_rows(spark, sf)), "rules")
    judged = stage(_judged(spark, sf), "prompts")
    out = requests.page_settings(
        pages, _profiles(spark, sf), judged, made, "1-URGENT", default_wait=4.0
    )
    return out.select(
        "event_id", "wait_seconds", "learned", "extra_instructions",
        F.coalesce(F.size("cleaning_rules"), F.lit(0)).cast("long").alias("n_rules"),
    )


# --- failures ------------------------------------------------------------------
def _plan(spark, sf) -> DataFrame:
    return failures.plan_recovery(views.failures(spark, sf), fallback_model="large")


@query
def failure_scenarios(spark, sf):
    return failures.classify(views.failures(spark, sf)).select(
        "id", F.coalesce("status", F.lit(0)).cast("long").alias("status"), "scenario"
    )


@query
def failure_recipes(spark, sf):
    steps = F.array_join(F.transform("steps", lambda s: s["step"]), ",")
    out = failures.classify(views.failures(spark, sf)).join(
        F.broadcast(failures.recipe_catalog(spark)), "scenario"
    )
    return out.select(
        "id", "scenario", F.col("max_attempts").cast("long").alias("max_attempts"), "policy",
        steps.alias("steps"),
    )


@query
def recovery_attempts(spark, sf):
    return _plan(spark, sf).select(
        "id", "scenario", F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt")
    )


@query
def recovery_delays(spark, sf):
    return _plan(spark, sf).select("id", F.coalesce("planned_delay", F.lit(0.0)).alias("delay"))


@query
def recovery_settings(spark, sf):
    return _plan(spark, sf).select(
        "id", F.coalesce("wait_added", F.lit(0.0)).alias("wait_added"),
        F.coalesce("content_chars", F.lit(0)).cast("long").alias("content_chars"),
        F.coalesce("next_model", F.lit("")).alias("next_model"),
    )


@query
def recovery_results(spark, sf):
    return _plan(spark, sf).select(
        "id", "result", F.col("steps_taken").cast("long").alias("steps_taken"),
        F.col("steps_remaining").cast("long").alias("steps_remaining"), "reason",
    )


@query
def recovery_events(spark, sf):
    return failures.recovery_events(_plan(spark, sf)).select(
        "id", F.col("seq").cast("long").alias("seq"), "event", "scenario",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("step", "result", "detail")],
    )


@query
def recovery_stats(spark, sf):
    return failures.recovery_stats(failures.recovery_events(_plan(spark, sf)))


@query
def latest_recovery_events(spark, sf):
    events = failures.recovery_events(_plan(spark, sf))
    return failures.latest_events(events).select(
        "id", F.col("seq").cast("long").alias("seq"), "event", "detail"
    )


# --- streaming -----------------------------------------------------------------
def _history_of_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("d"), F.col("user_id") % 50, F.lit(".example.org")).alias("domain"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        (F.least(F.floor(F.col("value") * 2 + 0.5), F.lit(1000)) / 1000.0).alias("quality_score"),
    )


@query
def streaming_profiles(spark, sf):
    """Profiles from a stream of the events file; the state ends as in the batch fold."""
    schema = views.table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    rows = _history_of_events(events)
    root = new_dir(spark, "stream")
    running = stream.start_profile_stream(
        rows, root, checkpoint=f"{root}/checkpoint", available_now=True
    )
    running.awaitTermination()
    return _profile_columns(stream.current_profiles(spark, root))


@query
def streaming_profiles_ordered(spark, sf):
    """Events that come in three deliveries, every fifth up to 15 days late; a new start for each.

    Rows wait in keyed state until their slice is complete; the end is the batch fold again.
    """
    history = _history_of_events(views.table(spark, sf, "events"))
    root = new_dir(spark, "stream")
    half = (F.dayofmonth("ts") > 15).cast("int")
    late = (F.col("id") % 5 == 0).cast("int")
    sent = stage(history.withColumn("delivery", half + late), "deliveries")
    for n in range(3):
        sent.where(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{root}/arrived")
        arrived = spark.readStream.schema(history.schema).parquet(f"{root}/arrived")
        stream.start_ordered_profile_stream(
            arrived, root, checkpoint=f"{root}/checkpoint", delay="15 days", slice_seconds=86_400,
            available_now=True,
        ).awaitTermination()
    return _profile_columns(stream.ordered_profiles(spark, root, f"{root}/checkpoint"))


# --- command audit -------------------------------------------------------------
def _verdicts(spark, sf) -> DataFrame:
    return audit.audit_commands(
        views.commands(spark, sf), workspace="/srv/app", block=["node"], allow=["git"]
    )


@query
def command_intents(spark, sf):
    out = audit.with_intent(views.commands(spark, sf))
    return out.select("id", "first_command", "intent")


@query
def command_verdicts(spark, sf):
    return _verdicts(spark, sf).select(
        "id", "intent", "action", F.coalesce("failed_check", F.lit("")).alias("failed_check"), "reason"
    )


@query
def command_totals(spark, sf):
    return audit.audit_totals(_verdicts(spark, sf))
