"""Model requests as tables, and the plug-in that answers them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill import fixed_values as fv
from leafmill.functions.text import strip
from leafmill.operators.cleaning import bounded, rules_by_domain
from leafmill.operators.joins import lookup_join
from leafmill.operators.prompts import best_prompts

RESPONSE_SCHEMA = (
    "page_id bigint, raw_output string, input_tokens bigint, output_tokens bigint, "
    "latency_ms double, model string, error_type string, status_code int"
)


def page_settings(
    pages: DataFrame,
    profiles: DataFrame,
    prompts: DataFrame,
    rules: DataFrame,
    schema_name: str,
    *,
    default_wait: float = fv.DEFAULT_WAIT_SECONDS,
) -> DataFrame:
    """What was learned about each page's domain before the run.

    ``pages``: domain and any other columns. Every lookup has one row per domain.
    """
    known = profiles.select("domain", "wait_seconds", F.lit(True).alias("learned"))
    prompt = (
        best_prompts(prompts)
        .where(F.col("schema_name") == schema_name)
        .select("domain", "extra_instructions", F.col("id").alias("prompt_id"))
    )
    out = lookup_join(pages, known, ["domain"])
    out = lookup_join(out, prompt, ["domain"])
    out = lookup_join(out, rules_by_domain(rules), ["domain"])
    return (
        out.withColumn("wait_seconds", F.coalesce("wait_seconds", F.lit(float(default_wait))))
        .withColumn("learned", F.coalesce("learned", F.lit(False)))
        .withColumn("extra_instructions", F.coalesce("extra_instructions", F.lit("")))
    )


def with_refinement(
    instructions: Column, refinement: Column, heading: str = fv.ACCEPTED_HEADING
) -> Column:
    """Instructions followed by a refinement under its heading."""
    joined = F.concat(instructions, F.lit(f"\n\n{heading}\n"), refinement)
    return F.when(refinement != "", strip(joined)).otherwise(instructions)


def extraction_requests(
    cleaned: DataFrame,
    schema: dict[str, Any],
    instructions: Column | None = None,
    limit: Column | int = fv.CONTENT_CHARS,
) -> DataFrame:
    """One request per page: the schema in the prompt, the page text as content."""
    prompt = F.lit(fv.EXTRACTION_PROMPT + json.dumps(schema, indent=2))
    if instructions is not None:
        extra = F.when(
            instructions != "", F.concat(F.lit(fv.INSTRUCTIONS_HEADING), instructions)
        ).otherwise("")
        prompt = F.concat(prompt, extra)
    cut = bounded(F.col("text"), limit)
    return cleaned.withColumn("_cut", cut).select(
        "page_id",
        F.lit("extract").alias("kind"),
        prompt.alias("system_prompt"),
        F.col("_cut.content").alias("user_content"),
        F.length("_cut.content").alias("content_chars"),
        F.col("_cut.truncated").alias("truncated"),
    )


def question_requests(cleaned: DataFrame, question: Column) -> DataFrame:
    """One question per page about its text; ``question`` may be a column."""
    content = F.concat(
        F.lit(fv.QUESTION_PROMPT + "\n\nQuestion: "),
        question,
        F.lit("\n\nPage content:\n"),
        bounded(F.col("text"), fv.QUESTION_CHARS)["content"],
    )
    return cleaned.select(
        "page_id",
        F.lit("ask").alias("kind"),
        F.lit(None).cast("string").alias("system_prompt"),
        content.alias("user_content"),
        F.length(content).alias("content_chars"),
    )


@F.arrow_udf(StringType())
def _indented(text: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else json.dumps(json.loads(t), indent=2) for t in text.to_pylist()],
        pa.string(),
    )


def refinement_requests(
    quality: DataFrame, records: DataFrame, cleaned: DataFrame, schema: dict[str, Any]
) -> DataFrame:
    """Ask for better instructions for pages with a fill rate below one half.

    ``records``: page_id, rec_ord, rec_json. Only the first three records of a page
    and the first 3,000 characters of its 5,000-character sample go into the prompt.
    """
    weak = quality.where(F.col("fill_rate") < 0.5)
    sample = (
        records.where(F.col("rec_ord") < 3)
        .groupBy("page_id")
        .agg(  # at most three entries
            F.concat(
                F.lit("["),
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("rec_ord", "rec_json"))),
                        lambda r: r["rec_json"],
                    ),
                    ",",
                ),
                F.lit("]"),
            ).alias("_sample")
        )
    )
    diagnostics = F.to_json(
        F.struct(
            F.lit("extraction_quality_proxy").alias("score_kind"),
            F.lit(False).alias("semantic_correctness_guaranteed"),
            "results_count",
            "components",
            F.col("components.fill_rate").alias("fill_rate"),
            F.col("components.basic_validity").alias("validity_rate"),
            F.col("components.uniqueness").alias("uniqueness_rate"),
            F.col("components.content_quality").alias("content_quality"),
            F.col("components.deterministic_validation").alias("deterministic_validation_rate"),
            "confidence",
            "uncertainty",
            "validation_errors",
            "issues",
        )
    )
    text = F.substring("text", 1, fv.REFINEMENT_SAMPLE_CHARS)
    page_text = cleaned.select("page_id", text.alias("_text")).where(F.col("_text") != "")
    content = F.concat(
        F.lit(f"{fv.REFINEMENT_PROMPT_OPENING}\n\nSchema:\n{json.dumps(schema, indent=2)}"),
        F.lit("\n\nSample output:\n"),
        _indented(F.coalesce("_sample", F.lit("[]"))),
        F.lit("\n\nProxy diagnostics:\n"),
        _indented(diagnostics),
        F.lit("\n\nPage sample:\n"),
        F.substring("_text", 1, fv.REFINEMENT_PROMPT_CHARS),
        F.lit(f"\n\n{fv.REFINEMENT_PROMPT_CLOSING}"),
    )
    return (
        weak.join(sample, "page_id", "left")
        .join(page_text, "page_id")
        .select(
            "page_id",
            F.lit("refine").alias("kind"),
            F.lit(None).cast("string").alias("system_prompt"),
            content.alias("user_content"),
        )
        .withColumn("content_chars", F.length("user_content"))
    )


Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


_ANSWER = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ")]
_TEXTS = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ") if c.endswith(" string")]


def _whole(out: pd.DataFrame) -> pd.DataFrame:
    """All columns of an answer; what the function left out is null."""
    absent = pd.Series([None] * len(out), index=out.index, dtype=object)
    out = out.assign(**{c: absent for c in _ANSWER if c not in out.columns})[_ANSWER]
    # As plain objects: Arrow would cut a text column of pandas' own kind into chunks.
    return out.astype(dict.fromkeys(_TEXTS, object))


def _isolated(extractor: Extractor) -> Extractor:
    """``extractor``, such that a page it fails on becomes a row with an ``error_type``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, open_batch, answered, broken = iter(batches), [], set(), []

        def feed() -> Iterator[pd.DataFrame]:
            while True:
                try:
                    batch = next(given, None)
                except Exception:
                    broken.append(True)  # the input's failure, not the model's
                    raise
                if batch is None:
                    return
                open_batch[:] = [batch]
                answered.clear()
                yield batch

        while True:
            try:
                for out in extractor(feed()):
                    answered.update(out["page_id"])
                    yield _whole(out)
                return
            except Exception:
                if broken or not open_batch:
                    raise
            batch = open_batch.pop()
            for at in range(len(batch)):
                one = batch.iloc[at : at + 1]
                if one["page_id"].iloc[0] in answered:
                    continue
                try:
                    for out in extractor(iter([one])):
                        yield _whole(out)
                except Exception as e:
                    told = {
                        "error_type": getattr(e, "error_type", "LLMExtractionError"),
                        "status_code": getattr(e, "status_code", None),
                    }
                    yield _whole(one[["page_id"]].assign(**told))

    return run


def run_extractor(requests: DataFrame, extractor: Extractor) -> DataFrame:
    """Responses from a caller-supplied batch function over the request table.

    The function answers a batch before it takes the next one. If it raises, the pages of
    that batch without an answer are asked again one by one, and a page that raises alone
    gets ``error_type`` and ``status_code`` (the exception's own, if it has them). It may
    also return these two columns itself. A function that raises before it takes a batch
    ends the job.
    """
    return requests.mapInPandas(_isolated(extractor), RESPONSE_SCHEMA)
