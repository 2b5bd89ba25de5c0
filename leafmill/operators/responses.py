"""Model responses to records, answers and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import resolve_links, strip, url_domain

_FENCE = "```"
_REC = "map<string,string>"


def strip_code_fence(value: Column) -> Column:
    """The text inside one surrounding code fence; other text is only trimmed."""
    text = strip(value)
    one_line = F.regexp_replace(F.regexp_replace(text, r"\A```", ""), r"```\z", "")
    body = F.regexp_replace(text, r"\A[^\n]*\n", "")
    inner = F.when(text.contains("\n"), F.regexp_replace(body, r"```\z", "")).otherwise(one_line)
    return F.when(text.startswith(_FENCE), strip(inner)).otherwise(text)


def _last_wins(rec: Column) -> Column:
    """``rec`` with each key once: where it was first, with the value it had last."""
    entries, keys = F.map_entries(rec), F.array_distinct(F.map_keys(rec))
    last = F.transform(
        keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    )
    repeated = F.size(keys) < F.size(rec)
    return F.when(repeated, F.map_from_arrays(keys, last)).otherwise(rec)


def parse_responses(responses: DataFrame) -> DataFrame:
    """``responses`` with ``records`` (array of maps) or ``error_type``.

    The text is parsed inside an array of its own, so that trailing text or two values
    in a row are errors. A list of objects gives its records, a single object one
    record; any other JSON cannot be used, and no JSON at all is a parse failure. Of a
    repeated key the last value counts. An ``error_type`` that comes with a response (the
    model could not be asked) is kept, and its text is not read.
    """
    told = F.col("_told")
    given = F.col("error_type") if "error_type" in responses.columns else F.lit(None)
    responses = responses.withColumn("_told", given.cast("string"))
    inside = F.col("_inside")
    strict = {"allowSingleQuotes": "false"}
    whole = F.from_json(F.concat(F.lit("["), inside, F.lit("]")), "array<string>", strict)
    many = F.from_json(inside, f"array<{_REC}>", strict)
    single = F.from_json(inside, _REC, strict)
    blank = F.coalesce(inside == "", F.lit(True)) & F.coalesce(
        strip(F.col("raw_output")) == "", F.lit(True)
    )
    step = (
        responses.withColumn("_inside", strip_code_fence(F.col("raw_output")))
        .withColumn("_many", F.when(inside.startswith("["), many))
        .withColumn("_one", F.when(inside.startswith("{"), single))
        .withColumn("_json", F.size(whole) == 1)
    )
    usable = F.when(
        F.col("_many").isNotNull() & ~F.exists("_many", lambda r: r.isNull()), F.col("_many")
    ).when(F.col("_one").isNotNull(), F.array("_one"))
    return (
        step.withColumn(
            "records",
            F.transform(
                F.when(told.isNull() & ~blank & F.coalesce("_json", F.lit(False)), usable),
                _last_wins,
            ),
        )
        .withColumn(
            "error_type",
            F.when(told.isNotNull(), told)
            .when(blank, "LLMExtractionError")
            .when(~F.coalesce("_json", F.lit(False)), "LLMParseError")
            .when(F.col("records").isNull(), "LLMExtractionError"),
        )
        .drop("_inside", "_many", "_one", "_json", "_told")
    )


def response_records(
    parsed: DataFrame, pages: DataFrame | None = None, *, compat: bool = False
) -> DataFrame:
    """One row per record: page_id, rec_ord, rec, rec_json.

    With ``pages`` (page_id, url) link fields are made absolute.
    """
    out = parsed.select("page_id", "records")
    if pages is not None:
        # Joined while a response is still one row.
        out = out.join(pages.select("page_id", "url"), "page_id")
    keep = ["page_id"] + (["url"] if pages is not None else [])
    # Failed responses have no records and fall out after the outer explode. A filter
    # on the error, or the one Spark derives from a plain explode, would be pushed
    # below the parser and parse everything twice.
    out = out.select(*keep, F.posexplode_outer("records").alias("rec_ord", "rec")).where(
        "rec_ord is not null"
    )
    if pages is not None:
        out = resolve_links(out, compat=compat)
    return out.withColumn("rec_json", F.to_json("rec"))


def response_failures(parsed: DataFrame) -> DataFrame:
    status = ["status_code"] if "status_code" in parsed.columns else []
    return parsed.where(F.col("error_type").isNotNull()).select(
        "page_id", "error_type", F.lit("llm").alias("component"), *status
    )


def usage_tally(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens per (domain, model); either pair of column names is understood."""

    def tokens(*names: str) -> Column:
        have = [F.nullif(F.col(n), F.lit(0)) for n in names if n in responses.columns]
        return F.coalesce(*have, F.lit(0)).cast("long")

    return (
        responses.join(
            pages.select("page_id", url_domain(F.col("url")).alias("domain")), "page_id"
        )
        .groupBy("domain", "model")
        .agg(
            F.count("*").alias("requests"),
            F.sum(tokens("prompt_tokens", "input_tokens")).alias("input_tokens"),
            F.sum(tokens("completion_tokens", "output_tokens")).alias("output_tokens"),
        )
    )


def text_answers(responses: DataFrame) -> DataFrame:
    """Trimmed text answers; a blank one is an extraction failure."""
    answer = strip(F.col("raw_output"))
    blank = F.coalesce(answer == "", F.lit(True))
    return responses.select(
        "page_id",
        F.when(~blank, answer).alias("answer"),
        F.when(blank, "LLMExtractionError").alias("error_type"),
    )


def refinement_candidates(answers: DataFrame) -> DataFrame:
    """Answers long enough to be instructions (more than 20 characters)."""
    return answers.where(F.length("answer") > 20)
